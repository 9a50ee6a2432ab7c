"""Ranks, tiers, overlays and standard scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import tier
from ..staging import staged


def placed(rows: DataFrame, order: Sequence[Column | str], by: str | None = None, out: str = "place") -> DataFrame:
    """Places from 1 in the given order, which no two rows may share, over all rows or within `by`.

    Rows are dealt out by ranges of (by, order), so neither a group nor many rows that are equal but for
    the last of `order` must fit one task; a row's place is that in its range and the size of its
    group's ranges above."""
    spark, keys = rows.sparkSession, [by] if by else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = staged(rows.repartitionByRange(parts, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    above = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*keys, "_p").count()  # one row a range, and one more for each group
    lifts = sizes.select(*(F.col(k).alias("_by") for k in keys), F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_lift"))
    same = F.col("_p") == F.col("_q")
    same = same & F.col(by).eqNullSafe(F.col("_by")) if by else same
    own = Window.partitionBy(*keys, "_p").orderBy(*order)
    return r.withColumn("_rn", F.row_number().over(own)).join(lifts, same).withColumn(out, F.col("_rn") + F.col("_lift")).select(*(F.col(f"`{c}`") for c in rows.columns if c != out), out)


def ranked(rows: DataFrame, score: str, tie: str, by: str | None = None, out: str = "rank", tiers: bool = False) -> DataFrame:
    """Ranks from 1 by falling score, over all rows or within `by`; see `placed`."""
    out_rows = placed(rows, [F.desc(score), tie], by, out)
    return out_rows.withColumn("tier", tier(out)) if tiers else out_rows


def replacement_baseline(rows: DataFrame, score: str, tie: str, starters: dict[str, float], extra: int = 6) -> DataFrame:
    """Per position the score of rank round(starters) + extra, or of the last one."""
    places = {p: round(s) + extra for p, s in starters.items()}
    n = F.coalesce(*(F.when(F.col("position") == p, F.lit(k)) for p, k in places.items()), F.lit(1))
    order = Window.partitionBy("position").orderBy(F.desc(score), tie)
    # no more than the first few of each position leave their partitions
    top = rows.select("position", score, tie).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max([1, *places.values()])).where(F.col("rn") <= n)
    return top.groupBy("position").agg(F.max_by(score, "rn").alias("baseline"))


def starters_per_position(teams: int, qb: float, rb: float, wr: float, te: float, flex: float, superflex: float) -> dict[str, float]:
    return {"QB": teams * (qb + 0.85 * superflex), "RB": teams * (rb + 0.4 * flex + 0.05 * superflex), "WR": teams * (wr + 0.5 * flex + 0.05 * superflex), "TE": teams * (te + 0.1 * flex + 0.05 * superflex)}


def z_scores(rows: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """(x - mean) / population deviation by group; a deviation near 0, or one row, counts as 1."""
    g = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"), F.count(value).alias("_n"))
    sd = F.when((F.col("_sd") <= 1e-9) | (F.col("_n") < 2), 1.0).otherwise(F.col("_sd"))
    return rows.join(g, by).withColumn(out, (F.col(value) - F.col("_m")) / sd).drop("_m", "_sd", "_n")


def z_scores_of(rows: DataFrame, columns: Mapping[str, str], by: list[str], digits: int | None = None) -> DataFrame:
    """`z_scores` of several columns (name -> name of its score) by one aggregate and one join; with
    `digits`, scores are rounded."""
    moments = [f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"), F.count(c).alias(f"_n_{c}"))]
    j = rows.join(rows.groupBy(*by).agg(*moments), by)
    sd = lambda c: F.when((F.col(f"_sd_{c}") <= 1e-9) | (F.col(f"_n_{c}") < 2), 1.0).otherwise(F.col(f"_sd_{c}"))
    z = {out: (F.col(c) - F.col(f"_m_{c}")) / sd(c) for c, out in columns.items()}
    z = {out: x if digits is None else F.round(x, digits) for out, x in z.items()}
    return j.withColumns(z).drop(*(f"_{k}_{c}" for c in columns for k in ("m", "sd", "n")))


def min_max(rows: DataFrame, value: str, by: list[str], lower_is_better: bool = False, least: int = 5, out: str = "scaled") -> DataFrame:
    """0 to 10 within the group; null in groups of fewer than `least` values."""
    g = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    x = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 10.0
    x = F.lit(10.0) - x if lower_is_better else x
    return rows.join(g, by).withColumn(out, F.when(F.col("_n") >= least, x)).drop("_lo", "_hi", "_n")
