"""Era-adjusted scoring in several formats, and what careers are worth under each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import clip, ratio0, rounded
from ..functions.rules import one_way_lift

Fallback = Mapping[tuple[str, str, int], float]


def era_multiplied(seasons: DataFrame, table: DataFrame, stats: Sequence[str], fallback: Fallback) -> DataFrame:
    """`seasons` (position, era, stats) with {stat}_factor: the table's multiplier, else the documented
    one, else 1.  `table` has a row for each position, stat and era."""
    wide = table.groupBy("position", "era").agg(*(F.max(F.when(F.col("stat") == s, F.col("multiplier"))).alias(f"{s}_factor") for s in stats))
    known = lambda s: [F.when((F.col("position") == p) & (F.col("era") == e), F.lit(m)) for (p, stat, e), m in fallback.items() if stat == s]
    rows = seasons.join(wide, ["position", "era"], "left")
    return rows.withColumns({f"{s}_factor": F.coalesce(F.col(f"{s}_factor"), *known(s), F.lit(1.0)) for s in stats})


def scored(seasons: DataFrame, formats: Mapping[str, Mapping[str, float]], bonus: Mapping[str, tuple[str, str, float]] | None = None, adjusted: bool = True) -> DataFrame:
    """One row per season and format: format, total, per_game.

    formats: format -> {stat: points}; bonus: format -> (position, stat, points more)."""
    value = lambda s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) * (F.col(f"{s}_factor") if adjusted else F.lit(1.0))
    parts = []
    for name, points in formats.items():
        total = F.lit(0.0)
        for s, k in points.items():
            total = total + value(s) * F.lit(float(k))
        if name in (bonus or {}):
            where, s, k = bonus[name]
            total = total + F.when(F.col("position") == where, value(s) * F.lit(float(k))).otherwise(0.0)
        parts.append(F.struct(F.lit(name).alias("format"), total.alias("total")))
    rows = seasons.withColumn("_f", F.explode(F.array(*parts))).select("*", "_f.*").drop("_f")
    return rows.withColumn("per_game", F.col("total") / F.greatest("games", F.lit(1)))


def by_category(seasons: DataFrame, formats: Mapping[str, Mapping[str, float]], categories: Mapping[str, Sequence[str]], bonus: Mapping[str, tuple[str, str, float]] | None = None, bonus_category: str | None = None) -> DataFrame:
    """One row per season, format and category that has points: where a season's points come from.

    `seasons` as `scored` takes them, adjusted; a bonus counts to `bonus_category`."""
    value = lambda s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) * F.col(f"{s}_factor")
    parts = []
    for name, points in formats.items():
        for category, stats in categories.items():
            total = F.lit(0.0)
            for s in stats:
                if s in points:
                    total = total + value(s) * F.lit(float(points[s]))
            if name in (bonus or {}) and category == bonus_category:
                where, s, k = bonus[name]
                total = total + F.when(F.col("position") == where, value(s) * F.lit(float(k))).otherwise(0.0)
            parts.append(F.struct(F.lit(name).alias("format"), F.lit(category).alias("category"), total.alias("points")))
    return seasons.withColumn("_c", F.explode(F.filter(F.array(*parts), lambda x: x["points"] != 0))).select("player", "season", "_c.*")


def aliased(rows: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """`rows` and, for each alias, those of the format that it stands for."""
    named = [F.struct(F.lit(k).alias("to"), F.lit(v).alias("of")) for k, v in aliases.items()]
    if not named:
        return rows
    names = F.concat(F.array(F.col("format")), F.transform(F.filter(F.array(*named), lambda a: a["of"] == F.col("format")), lambda a: a["to"]))
    return rows.withColumn("format", F.explode(names))


def arcs(points: DataFrame) -> DataFrame:
    """One row per player and format: seasons in order (season, age, games, total, per_game), the career's
    total, best season rate, best rate over three seasons in a row, and mean rate, weighted by games.

    points: rows of `scored` with player, season, age and games."""
    w = Window.partitionBy("player", "format").orderBy("season").rowsBetween(0, 2)
    rolled = ratio0(F.sum("total").over(w), F.sum("games").over(w))
    g = points.withColumn("_r", rolled).groupBy("player", "format").agg(
        F.array_sort(F.collect_list(F.struct("season", "age", "games", "total", "per_game"))).alias("seasons"),  # a career is bounded
        F.sum("total").alias("career_total"), F.max("per_game").alias("peak_season"), F.greatest(F.max("_r"), F.lit(0.0)).alias("peak_3"), ratio0(F.sum("total"), F.sum("games")).alias("career_mean"),
    )
    return g


def same_formats(points: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Seasons whose points differ between two formats that ought to be equal: none if they are."""
    rows = points.where(F.col("format").isin(a, b)).groupBy("player", "season")
    g = rows.agg(F.round(F.max(F.when(F.col("format") == a, F.col("total"))), digits).alias("total_a"), F.round(F.max(F.when(F.col("format") == b, F.col("total"))), digits).alias("total_b"))
    return g.where(~F.col("total_a").eqNullSafe(F.col("total_b")))


def diagnostic(seasons: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Raw value, multiplier and adjusted value of each stat that is not zero."""
    cells = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("raw"), F.col(f"{s}_factor").alias("multiplier")) for s in stats))
    rows = seasons.select("player", "season", F.explode(F.filter(cells, lambda x: x["raw"] != 0)).alias("_c")).select("player", "season", "_c.*")
    return rows.withColumn("adjusted", F.col("raw") * F.col("multiplier"))


def lifts(style: Column, age: Column, recent: Column, peak: Column, table: Mapping[str, float], points: Mapping[str, float]) -> tuple[Column, Column, Column]:
    """(lift of points, lift of years, whether the decline gate shut): from DECLINE_AGE on, a mobile
    style whose recent rate is well below its peak is worth what the first style is."""
    at = lambda m: F.coalesce(*(F.when(style == k, F.lit(float(v))) for k, v in m.items()), F.lit(1.0))
    plain = next(iter(table))
    gate = F.coalesce((style != plain) & (age >= C.DECLINE_AGE) & (peak > 0) & (recent < peak * F.lit(C.DECLINE_SHARE)), F.lit(False))
    return F.when(gate, 1.0).otherwise(at(points)), F.when(gate, F.lit(float(table[plain]))).otherwise(at(table)), gate


def late_runner(years: Column, position: Column, age: Column, rate: Column, runner: str) -> Column:
    """Years left, one more for a runner of LATE_AGE who still produces."""
    return years + F.when((position == runner) & (age >= C.LATE_AGE) & (rate >= C.LATE_RATE), 1.0).otherwise(0.0)


def proven_floor(total: Column, recent2: Column, recent3: Column, peak: Column, years: Column, position: Column, bands: Mapping[str, tuple[float, float]]) -> Column:
    """What was banked, by the years left and by how near the recent rate is to the peak, and a short
    window of the recent rate."""
    rate = F.when(recent2 <= 0, recent3).otherwise(recent2)
    low = F.coalesce(*(F.when(position == p, F.lit(a)) for p, (a, _) in bands.items()), F.lit(0.55))
    high = F.coalesce(*(F.when(position == p, F.lit(b)) for p, (_, b) in bands.items()), F.lit(0.80))
    producing = F.when(peak > 0, clip((rate / peak - low) / (high - low), 0.0, 1.0)).otherwise(1.0)
    return total * clip(years / F.lit(6.0), 0.0, 1.0) * producing + rate * F.lit(float(C.SEASON_GAMES)) * F.least(years, F.lit(3.0)) * F.lit(0.90)


def comp_records(edges: DataFrame, comps: DataFrame, current: int) -> DataFrame:
    """Public rows of neighbours: rounded similarity, and whether the comp is out of the game early.

    comps: comp, final_age, seasons, last_season."""
    washed = F.coalesce((F.col("last_season") < current - 1) & (F.col("final_age") <= C.BUST_AGE) & (F.col("seasons") < C.BUST_SEASONS), F.lit(False))
    return edges.join(comps, "comp").select("player", "comp", "rank", F.round("sim", 3).alias("similarity"), "comp_age", "final_age", "seasons", washed.alias("washed_out"))


def overlay(targets: DataFrame, records: DataFrame, futures: DataFrame, bars: Mapping[str, float], bar: float = 0.0) -> DataFrame:
    """Every format's projection: comps' points under the format summed anew by their rounded similarity,
    and for the elite the larger of that and the own rate over the comps' years.

    targets: player, position, format, recent3, peak3, lift; records: player, comp, comp_age,
    similarity; futures: (comp, comp_age, format) with future_points and future_seasons."""
    e = records.select("player", "comp", "comp_age", "similarity").join(targets.select("player", "format"), "player")
    e = e.join(futures, ["comp", "comp_age", "format"], "left")
    w = F.sum("similarity")
    w = F.when(w == 0, F.lit(1.0)).otherwise(w)
    g = e.groupBy("player", "format").agg((F.sum(F.col("similarity") * F.coalesce("future_points", F.lit(0.0))) / w).alias("comp_mean"), (F.sum(F.col("similarity") * F.coalesce("future_seasons", F.lit(0))) / w).alias("years"), F.count("*").alias("n_comps"))
    r = targets.join(g, ["player", "format"])
    level = F.greatest(F.lit(1.1) * F.col("recent3"), F.lit(0.9) * F.col("peak3"))
    anchor = F.when((F.col("years") > 0) & (level > 0) & (F.col("n_comps") >= C.BLEND_COMPS), level * F.lit(float(C.SEASON_GAMES)) * F.col("years") * F.pow(F.lit(1 - C.DISCOUNT), F.col("years") / 2.0)).otherwise(0.0)
    at = F.coalesce(*(F.when(F.col("position") == p, F.lit(b)) for p, b in bars.items()), F.lit(bar))
    share = clip((F.col("peak3") - (at - C.BLEND_BAND)) / F.lit(C.BLEND_BAND), 0.0, 1.0)
    mixed = (F.lit(1.0) - share) * F.col("comp_mean") + share * F.greatest("comp_mean", "anchor")
    return r.withColumn("anchor", anchor).withColumn("score", rounded(one_way_lift(mixed, F.col("lift")), 1))


def best_rates(seasons: DataFrame, n: int = 3) -> DataFrame:
    """Career points, mean of the n best season rates, seasons, first and last season."""
    rate = ratio0(F.col("points"), F.col("games"))
    top = F.slice(F.sort_array(F.collect_list(rate), asc=False), 1, n)  # a career is bounded
    g = seasons.groupBy("player").agg(F.sum("points").alias("career_points"), top.alias("_top"), F.count("*").alias("seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    return g.withColumn("best_rate", F.aggregate("_top", F.lit(0.0), lambda a, x: a + x) / F.size("_top")).drop("_top")
