"""Seasons to careers: eligibility, rollups and windows over a player's seasons.

A season frame has player, position, season, age, games and points (a total); other columns pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import clip, ratio0
from ..staging import staged
from . import order_stats


def by_season() -> WindowSpec:
    return Window.partitionBy("player").orderBy("season")


def eligible(seasons: DataFrame, min_season: int = C.MIN_SEASON, min_games: int = C.MIN_GAMES) -> DataFrame:
    """Regular seasons with enough games and a known age or rookie season."""
    kind = F.coalesce(F.nullif(F.col("season_type"), F.lit("")), F.lit("REG")) if "season_type" in seasons.columns else F.lit("REG")
    out = seasons.where((kind == "REG") & F.col("player").isNotNull() & (F.col("season") >= min_season) & (F.col("games") >= min_games))
    if "rookie_season" in seasons.columns:
        out = out.withColumn("age", F.coalesce("age", F.lit(22) + F.col("season") - F.col("rookie_season")))
    return out.where("age is not null")


def with_rate(seasons: DataFrame) -> DataFrame:
    return seasons.withColumn("rate", ratio0(F.col("points"), F.greatest("games", F.lit(1))))


def rollup(seasons: DataFrame, through: int = C.LONG_ARC_THROUGH, current: int = 2024) -> DataFrame:
    """One row per player: span, sums, flags."""
    g = seasons.groupBy("player", "position").agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("n_seasons"),
        F.sum("games").alias("career_games"), F.sum("points").alias("career_points"), F.max("age").alias("max_age"),
    )
    retired = F.col("last_season") <= through
    long_arc = retired | (F.col("n_seasons") >= C.LONG_ARC_SEASONS) | ((F.col("max_age") >= C.VETERAN_AGE) & (F.col("n_seasons") >= C.VETERAN_SEASONS))
    return g.withColumns({"retired": retired, "long_arc": long_arc, "active": F.col("last_season") >= current - 1})


def era_ratios(seasons: DataFrame, stats: list[str], base_era: int = 4, low: float = 0.6, high: float = 2.0) -> DataFrame:
    """Multipliers position x stat x era: the median rate of the base era over that of the era."""
    names = ", ".join(f"'{s}', cast({s} as double) / games" for s in stats)
    long = seasons.select("position", "era", F.expr(f"stack({len(stats)}, {names}) as (stat, rate)"))
    med = order_stats.quantiles(long, ["position", "stat", "era"], "rate", {"med": 0.5}).drop("_n")
    base = med.where(F.col("era") == base_era).select("position", "stat", F.col("med").alias("base"))
    ratio = F.when((F.col("med") <= 1e-6) | F.col("base").isNull(), 1.0).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.col("base") / F.col("med"))))
    return med.join(base, ["position", "stat"], "left").select("position", "stat", "era", "med", ratio.alias("multiplier"))


def peak3(seasons: DataFrame) -> DataFrame:
    """Best games-weighted rate over a season and the two that follow; short windows at the end count."""
    ahead = by_season().rowsBetween(0, 2)
    rows = seasons.select("player", ratio0(F.sum("points").over(ahead), F.sum("games").over(ahead)).alias("r"))
    return rows.groupBy("player").agg(F.greatest(F.max("r"), F.lit(0.0)).alias("peak3"))


def recent(seasons: DataFrame, n: int) -> DataFrame:
    last = Window.partitionBy("player").orderBy(F.desc("season"))
    rows = seasons.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n)
    return rows.groupBy("player").agg(ratio0(F.sum("points"), F.sum("games")).alias(f"recent{n}"))


def stages(seasons: DataFrame) -> DataFrame:
    """Running totals by career stage, from 1."""
    upto = by_season().rowsBetween(Window.unboundedPreceding, 0)
    return seasons.select("player", "position", "season", F.row_number().over(by_season()).cast("long").alias("stage"), F.sum("points").over(upto).alias("total"))


def strict_percentile(members: DataFrame, values: DataFrame, keys: list[str], value: str, out: str = "pct") -> DataFrame:
    """For each row of `values` the share of its bucket strictly below it; 0.5 for an empty bucket.

    The bucket's different values carry running counts over ranges, so no bucket is in one task."""
    return order_stats.strict_shares(members, values, keys, value, out).select(*values.columns, out)


def slope(seasons: DataFrame) -> DataFrame:
    """Least-squares slope of the rate over the season's index; 0 for a single season."""
    rows = with_rate(seasons).withColumn("x", (F.row_number().over(by_season()) - 1).cast("double"))
    return rows.groupBy("player").agg(F.coalesce(F.regr_slope("rate", "x"), F.lit(0.0)).alias("slope"))


def discounted_after(seasons: DataFrame, snapshots: DataFrame, min_games: int = C.MIN_GAMES, rate: float = C.DISCOUNT) -> DataFrame:
    """For (player, snapshot_age): sum of points * (1 - rate)^n over the seasons after it, n from 0."""
    rows = seasons.where(F.col("games") >= min_games).select("player", "season", "age", "points")
    rows = snapshots.join(rows, "player").where(F.col("age") > F.col("snapshot_age"))
    order = Window.partitionBy("player", "snapshot_age").orderBy("season")
    rows = rows.withColumn("n", (F.row_number().over(order) - 1).cast("double"))
    return rows.groupBy("player", "snapshot_age").agg(F.sum(F.col("points") * F.pow(F.lit(1 - rate), "n")).alias("future_points"), F.count("*").alias("future_seasons"))


def style_lifts(seasons: DataFrame, style: Column, era: Column, base: str, low: float = 1.0, high: float = 1.5, least: int = 3) -> DataFrame:
    """style, era, careers, lift: the base style's median number of seasons over the style's own, in one
    era, kept between `low` and `high`; 1 for fewer than `least` careers or without a base."""
    med = order_stats.quantiles(seasons.select("n", style.alias("style"), era.alias("era")), ["style", "era"], "n", {"med": 0.5}).withColumnRenamed("_n", "careers")
    med = staged(med, "lengths")
    plain = med.where(F.col("style") == base).select("era", F.col("med").alias("_base"))
    lift = F.when(F.col("careers") < least, 1.0).otherwise(F.coalesce(clip(F.try_divide("_base", "med"), low, high), F.lit(1.0)))
    return med.join(plain, "era", "left").select("style", "era", "careers", lift.alias("lift"))


def durability(games: Column, seasons: Column, whole: int = C.SEASON_GAMES) -> Column:
    return F.least(F.lit(1.0), games / (F.lit(float(whole)) * seasons))
