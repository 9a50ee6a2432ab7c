"""Writers: append-only snapshots, replaced partitions, a dated table with its latest part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_snapshot(rows: DataFrame, path: str, at: str = "captured_at") -> None:
    """Adds rows below the date of `at`; nothing that is there changes."""
    rows.withColumn("captured_date", F.to_date(at)).write.mode("append").partitionBy("captured_date").parquet(path)


def replace_parts(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that `rows` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def latest_part(spark: SparkSession, path: str) -> DataFrame:
    """The newest date's rows; the date comes from the folders, so other dates are not read."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("captured_date")).first()[0]
    return rows.where(F.col("captured_date") == F.lit(newest))


def checked(rows: DataFrame, needed: list[str]) -> DataFrame:
    """`rows` if it has the needed columns; else an error, before anything is replaced."""
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def nested_json(rows: DataFrame, key: str, children: list[str], path: str, name: str = "comps") -> None:
    """One JSON object per key with its child rows as an array, in the order of the first child column."""
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*children))).alias(name))
    nested.write.mode("overwrite").json(path)
