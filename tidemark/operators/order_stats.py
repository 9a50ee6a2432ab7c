"""Quantiles and ranks with ties, exact, of groups of any size.

Everything rests on one table: the different values of each group with how many rows have them and how
many rows of the group lie below.  Different values are dealt out by ranges of (group, value); a value's
count below is the sum within its range and the sizes of the group's ranges below.  So neither a group
nor the rows of one value have to fit a task, and a value that many rows share is one row before any of
that is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of columns that holds for nulls too."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def counted(rows: DataFrame, by: Sequence[str], value: str, count: Column | None = None) -> DataFrame:
    """One row for each group and value that is not null: `by`, _v, _at (rows with the value) and _below
    (rows of the group with smaller ones).  With `count`, a row counts so many times, 0 included."""
    by = list(by)
    each = F.count("*") if count is None else F.sum(count)
    table = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(each.alias("_at"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = staged(table.repartitionByRange(parts, *by, "_v").withColumn("_p", F.spark_partition_id()), "values")
    sizes = r.groupBy(*by, "_p").agg(F.sum("_at").alias("_n"))  # one row a range, and one more for each group
    lower = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_g{k}" for k in range(len(by))]
    lifts = sizes.select(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True)), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lift"))
    upto = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_in", F.coalesce(F.sum("_at").over(upto), F.lit(0)))
    return r.join(lifts, (F.col("_p") == F.col("_q")) & same_keys(by, named)).select(*by, "_v", "_at", (F.col("_in") + F.col("_lift")).alias("_below"))


def with_counts(rows: DataFrame, table: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`rows` with _at and _below of their value.  Of the table's side each key is one row, so a value
    that many rows share can be split."""
    named = [f"_g{k}" for k in range(len(by))]
    t = table.select(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True)), F.col("_v").alias("_w"), "_at", "_below")
    return rows.join(t, same_keys([*by, value], [*named, "_w"]), "left").drop(*named, "_w")


def average_ranks(rows: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Ranks from the smallest, ties share their mean rank; within groups.  A null has no rank."""
    r = with_counts(rows, counted(rows, by, value), by, value)
    return r.withColumn(out, F.col("_below") + (F.col("_at") + 1) / F.lit(2.0)).drop("_at", "_below")


def strict_shares(members: DataFrame, values: DataFrame, by: Sequence[str], value: str, out: str, empty: float = 0.5) -> DataFrame:
    """For each row of `values` the share of its group's members strictly below it; `empty` for a group
    without members."""
    one = lambda df, n: df.select(*by, F.col(value), F.lit(n).alias("_one"))
    table = counted(one(members, 1).union(one(values, 0)), by, value, F.col("_one"))
    r = with_counts(values, table, by, value)
    named = [f"_g{k}" for k in range(len(by))]
    sizes = members.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True))).agg(F.count("*").alias("_size"))
    r = r.join(sizes, same_keys(by, named), "left").drop(*named)
    return r.withColumn(out, F.when(F.coalesce("_size", F.lit(0)) == 0, F.lit(empty)).otherwise(F.col("_below") / F.col("_size"))).drop("_at", "_below", "_size")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row per group: each named quantile, between neighbours where it falls between two rows, and
    _n, the number of values.  A group without values is left out."""
    by = list(by)
    table = staged(counted(rows, by, value), "counted")
    named = [f"_g{k}" for k in range(len(by))]
    sizes = table.groupBy(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True))).agg(F.sum("_at").alias("_n"))
    t = table.join(sizes, same_keys(by, named))
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    holds = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_at"))
    ends = []
    for name, at in place.items():  # the values in the two places around the quantile's
        ends += [F.max(F.when(holds(F.floor(at)), F.col("_v").cast("double"))).alias(f"_lo_{name}"), F.max(F.when(holds(F.ceil(at)), F.col("_v").cast("double"))).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_f_{name}")]
    g = t.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    mixed = lambda n: F.when(F.col(f"_f_{n}") == 0, F.col(f"_lo_{n}")).otherwise((F.lit(1.0) - F.col(f"_f_{n}")) * F.col(f"_lo_{n}") + F.col(f"_f_{n}") * F.col(f"_hi_{n}"))
    return g.select(*by, *(mixed(n).alias(n) for n in shares), "_n")


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, out: str) -> DataFrame:
    """The first k rows of each group with their place: what leaves a task is k rows a group at most."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)
