"""Refreshing tables without losing what is there.

What comes in is written beside the table and measured as it is written; only parts that pass take the
place of old ones.  An empty table, a missing column or a missing id leaves all as it was, and a part
that is too small leaves that part as it was."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..staging import staged


class Refused(ValueError):
    """Nothing was replaced; the message says why."""


@dataclass
class Report:
    rows: int = 0  #: that came in
    replaced: dict = field(default_factory=dict)  #: part -> rows
    kept: dict = field(default_factory=dict)  #: part -> why its old rows stay


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def measured(rows: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, dict]:
    """`rows` written to the shared folder, and what was counted on the way: all rows, and for each id
    those without one."""
    seen = Observation("refresh")
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"without_{c}") for c in ids))
    return staged(watched, "incoming"), seen.get


def replace_guarded(rows: DataFrame, path: str, by: str, needed: Sequence[str] = (), ids: Sequence[str] = (), least: int = 1, share: float = 0.0) -> Report:
    """Replaces the parts of the table at `path` that `rows` has.

    Refused as a whole: a needed column that is missing, no rows, a row without one of its ids.  A part
    stays as it was if it would have fewer than `least` rows, or fewer than `share` of those it has.
    Parts are few: their counts come to the driver."""
    if missing := [c for c in dict.fromkeys([by, *needed, *ids]) if c not in rows.columns]:
        raise Refused(f"missing columns: {', '.join(missing)}")
    came, counts = measured(rows, ids)
    if not counts["rows"]:
        raise Refused("no rows")
    if lost := [f"{counts[f'without_{c}']} rows without {c}" for c in ids if counts[f"without_{c}"]]:
        raise Refused("; ".join(lost))
    old = existing(rows.sparkSession, path)
    before = {} if old is None else {r[0]: r[1] for r in old.groupBy(F.col(by).cast(rows.schema[by].dataType)).count().collect()}
    report = Report(rows=counts["rows"])
    for r in came.groupBy(by).count().orderBy(by).collect():
        part, n = r[0], r["count"]
        if n < least:
            report.kept[part] = f"{n} rows, {least} needed"
        elif n < share * before.get(part, 0):
            report.kept[part] = f"{n} rows, {before[part]} before"
        else:
            report.replaced[part] = n
    good = came.where(F.coalesce(F.col(by).isin([p for p in report.replaced if p is not None]), F.lit(False)) | (F.col(by).isNull() if None in report.replaced else F.lit(False)))
    if report.replaced:
        good.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return report


def replace_snapshot(rows: DataFrame, path: str, needed: Sequence[str] = (), ids: Sequence[str] = ()) -> int:
    """Replaces a whole table, by the same rules; returns its rows.  Readers see the old or the new one: the
    table's folder holds a version each, and the newest whole one counts."""
    if missing := [c for c in dict.fromkeys([*needed, *ids]) if c not in rows.columns]:
        raise Refused(f"missing columns: {', '.join(missing)}")
    came, counts = measured(rows, ids)
    if not counts["rows"]:
        raise Refused("no rows")
    if lost := [f"{counts[f'without_{c}']} rows without {c}" for c in ids if counts[f"without_{c}"]]:
        raise Refused("; ".join(lost))
    versions = existing(rows.sparkSession, path)
    last = -1 if versions is None else versions.agg(F.max("version")).first()[0]
    came.withColumn("version", F.lit(last + 1)).write.mode("append").partitionBy("version").parquet(path)
    return counts["rows"]


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table of `replace_snapshot`; other versions are not read."""
    versions = existing(spark, path)
    if versions is None:
        return None
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]  #: gets the results of the steps before it
    fatal: bool = False


def daily(spark: SparkSession, steps: Sequence[Step]) -> tuple[dict, DataFrame]:
    """(results by name, a row for each step: name, outcome, detail).

    Steps run in turn.  One that fails is reported, and the rest go on with what was there before;
    after a fatal one the rest are skipped."""
    results: dict = {}
    rows: list[tuple[str, str, str | None]] = []
    stopped = False
    for s in steps:
        if stopped:
            rows.append((s.name, "skipped", None))
            continue
        try:
            results[s.name] = s.run(results)
            rows.append((s.name, "done", None))
        except Exception as e:  # a step's failure is its own, by design; it is in the report
            rows.append((s.name, "failed", f"{type(e).__name__}: {e}"[:500]))
            stopped = s.fatal
    return results, spark.createDataFrame(rows, "name string, outcome string, detail string")


def seasons_to_fetch(current: int, first: int, have: Mapping[int, int], full: bool = False, since: int | None = None) -> list[int]:
    """The current season; all from `first` on if nothing is there or all are wanted; from `since` on if given."""
    if full or not have:
        return list(range(first, current + 1))
    return list(range(max(since, first), current + 1)) if since is not None else [current]
