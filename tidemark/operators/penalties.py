"""Multiplicative penalties on a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import clip


def survival(edges: DataFrame) -> DataFrame:
    """From a target's comps (sim, rank, comp_last_age, comp_n_seasons, comp_retired): weighted rates
    of busts and short careers, and the multiplier."""
    e = edges.select("player", "sim", "rank", "comp_last_age", "comp_n_seasons", "comp_retired").repartition("player")
    return with_survival(e.groupBy("player").agg(*survival_rates()))


def survival_rates() -> list[Column]:
    """bust_rate, short_rate and top5_busts as aggregates over a target's comps."""
    bust = F.col("comp_retired") & (F.col("comp_last_age") <= C.BUST_AGE) & (F.col("comp_n_seasons") < C.BUST_SEASONS)
    short = F.when(F.col("comp_retired"), F.col("comp_n_seasons") <= C.SHORT_SEASONS).otherwise(F.col("comp_n_seasons") <= 2)
    w = F.sum("sim")
    w = F.when(w == 0, F.lit(1.0)).otherwise(w)
    rate = lambda flag: F.sum(F.when(flag, F.col("sim")).otherwise(0.0)) / w
    return [rate(bust).alias("bust_rate"), rate(short).alias("short_rate"), F.count_if(bust & (F.col("rank") <= 5)).alias("top5_busts")]


def with_survival(rows: DataFrame) -> DataFrame:
    return rows.withColumn("survival", survival_multiplier(F.col("bust_rate"), F.col("short_rate"), F.col("top5_busts")))


def survival_multiplier(bust: Column, short: Column, top5: Column) -> Column:
    base = F.lit(0.5) * (F.lit(1.0) - bust) + F.lit(0.2) * (F.lit(1.0) - short) + F.lit(0.3)
    return clip(base * (F.lit(1.0) - F.lit(0.08) * F.least(top5, F.lit(5))), 0.3, 1.0)


def confidence(games: Column, is_qb: Column) -> Column:
    qb = games / F.lit(C.CONFIDENCE_QB)
    qb = F.when(games < C.CONFIDENCE_LOW, F.least(qb, F.lit(C.CONFIDENCE_CAP))).otherwise(F.least(qb, F.lit(1.0)))
    return F.when(is_qb, qb).otherwise(F.least(F.lit(1.0), games / F.lit(C.CONFIDENCE_OTHER)))


def missed_season(last_season: Column, last_games: Column, corpus_last: Column) -> Column:
    gap = corpus_last - last_season
    two, one, few, games = C.MISSED
    return F.when(gap >= 2, two).when(gap == 1, one).when(last_games < games, few).otherwise(1.0)


def late_breakout(age: Column) -> Column:
    return F.when(age.isNull() | (age <= 22), 1.0).when(age == 23, 0.95).when(age == 24, 0.88).otherwise(0.80)


def upper_median_of_best(rows: DataFrame, key: str, value: str, n: int = 50, tie: str | None = None) -> DataFrame:
    """Per key, of the n largest values the one at place floor(n / 2): not the mean of two."""
    order = Window.partitionBy(key).orderBy(F.desc(value), *([tie] if tie else []))
    top = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    sizes = top.groupBy(key).agg((F.floor(F.count("*") / 2) + 1).alias("at"))
    return top.join(sizes, key).where(F.col("rn") == F.col("at")).select(key, F.col(value).alias("baseline"))


def stack(raw: Column, surv: Column, conf: Column, baseline: Column, late: Column, stale: Column, missed: Column) -> Column:
    """Survival, then shrinkage to the baseline (only from above, and only if not stale), then a late
    breakout and a missed season; at least FLOOR and at most all of the raw projection."""
    s = raw * surv
    shrunk = F.when((s > baseline) & ~stale, s * conf + baseline * (F.lit(1.0) - conf)).otherwise(s * conf)
    out = shrunk * (F.lit(1.0) - (F.lit(1.0) - late) * conf) * missed
    return F.least(raw, F.greatest(F.lit(C.FLOOR) * raw, out))
