"""Connected components by alternating large-star and small-star rounds.

Each round is joins and grouped minima only, or windows while edges are few; no node's neighbours are collected."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dropped, hot_from, join_one, staged

FEW = 1 << 20  # edges of which a node's, all of them at most, may be in one task


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select("v", "u")).toDF("x", "y")


def _known(e: DataFrame) -> tuple:
    """(number of edges, a sum of hashes that tells rounds apart)."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _by_windows(e: DataFrame) -> DataFrame:
    """A round over few edges: each node's are in one place."""
    least = lambda of, value: F.min(value).over(Window.partitionBy(of))
    large = _both(e).withColumn("v", F.least("x", least("x", "y"))).where("y > x").select(F.col("y").alias("u"), "v")
    small = large.withColumn("m", least("u", "v"))
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _by_joins(e: DataFrame, n: int) -> DataFrame:
    """A round over any number of edges: a minimum is combined before the shuffle, and a hub's edges meet it by
    broadcast."""
    total = 2 * n
    hub = _both(e).groupBy("x").count().agg(F.max("count")).first()[0] or 0
    meet = functools.partial(join_one, weight="n", total=total) if hub > hot_from(total) else lambda rows, one, on: rows.join(one.drop("n"), on)
    both = _both(e)
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
    large = meet(both, least, ["x"]).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = meet(large, least, ["u"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("x"), "m")
    return small.toDF("u", "v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Loops, repeated and null edges are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = staged(e.distinct(), "edges")
    before = _known(e)
    for _ in range(max_rounds):
        r = _by_windows(e) if before[0] <= FEW else _by_joins(e, before[0])
        last, e = e, staged(r.where("u > v").distinct(), "edges")
        dropped(last)
        now = _known(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
