"""python -m tidemark.cli COMMAND ...: queries over a folder of tables, sources and settings.

list                          the queries
run NAME DIR [--out PATH]     a query's rows, shown or written
explain NAME DIR              its plan
top DIR [--n N] [--position P] [--format F]
                              the best ranked players, of all or one position, or by one format's points
score DIR [--format F]        every career's points in a format, to the terminal's length
inspect PATH                  columns, rows and nulls of any table or file of JSON or CSV
sources                       the ranking sources that can be read by name
league DIR                    teams of every league and their places
managers DIR                  managers of every league by skill
backtest DIR [--record PATH]  how projections did; appended to the track record if a path is given
prospects DIR [--year Y]      draft classes and what is projected for them
snapshot PATH                 the present version of a table of versions
settings                      what the session sets"""

from __future__ import annotations

import argparse
import dataclasses
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import settings
from .operators import evaluation
from .plans import commerce
from .session import session
from .sources import adapters, refresh

DIRS = ("run", "explain", "top", "score", "league", "managers", "backtest", "prospects")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name) for name in ("list", "sources", "settings", "inspect", "snapshot", *DIRS)}
    for name in ("run", "explain"):
        made[name].add_argument("name")
    for name in DIRS:
        made[name].add_argument("sf_dir")
    for name in ("inspect", "snapshot"):
        made[name].add_argument("path")
    made["run"].add_argument("--out")
    made["backtest"].add_argument("--record")
    made["prospects"].add_argument("--year", type=int)
    for name in ("top", "score", "league", "managers", "prospects"):
        made[name].add_argument("--n", type=int, default=30)
    made["top"].add_argument("--position")
    for name in ("top", "score"):
        made[name].add_argument("--format")
    return p


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.json(path) if kind in ("json", "jsonl") else spark.read.parquet(path)


def inspected(df: DataFrame) -> DataFrame:
    """A row for each column: its type, and how many rows lack it."""
    got = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns))).first()
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), got[0], got[k + 1]) for k, f in enumerate(df.schema.fields)], "column string, type string, rows long, nulls long")


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arcs = commerce.QUERIES["q_career_arcs"](spark, sf_dir).where(F.col("format") == name)
    who = commerce.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("position"))
    return arcs.join(who, "player").orderBy(F.desc("career_total"), "player")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(commerce.QUERIES))
        return 0
    if a.command == "sources":
        print("\n".join(f"{slug}: {(cls.__doc__ or '').strip()}" for slug, cls in adapters.REGISTRY.items()))
        return 0
    spark = session()
    run = lambda name: commerce.QUERIES[name](spark, a.sf_dir)
    if a.command in ("run", "explain") and a.name not in commerce.QUERIES:
        print(f"no query {a.name}; see list")
        return 2
    if a.command == "settings":
        print("\n".join(f"{k} = {v}" for k, v in dataclasses.asdict(settings(spark)).items()))
    elif a.command == "explain":
        run(a.name).explain("formatted")
    elif a.command == "run":
        df = run(a.name)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, truncate=False)
    elif a.command == "inspect":
        df = inspected(read(spark, a.path))
        df.show(df.count(), truncate=False)
    elif a.command == "snapshot":
        df = refresh.snapshot(spark, a.path)
        if df is None:
            print("nothing there")
            return 1
        df.show(30, truncate=False)
    elif a.command == "backtest":
        figures = run("q_class_backtest")
        if a.record:
            figures = evaluation.appended(spark, figures, a.record, datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
        figures.show(100, truncate=False)
        run("q_backtest_by_class").orderBy("class").show(100, truncate=False)
    else:
        if a.command == "top":
            rows = points(spark, a.sf_dir, a.format) if a.format else run("q_rank_tier").orderBy("rank")
            rows = rows.where(F.col("position") == a.position) if a.position else rows
        elif a.command == "score":
            rows = points(spark, a.sf_dir, a.format or settings(spark).league_format)
        elif a.command == "prospects":
            rows = run("q_prospect_records").orderBy("year", "model_overall_rank")
            rows = rows.where(F.col("year") == a.year) if a.year else rows
        else:
            rows = run("q_leagues_report").orderBy("league", "power_rank") if a.command == "league" else run("q_managers_by_league").orderBy("league", "skill_rank")
        rows.limit(a.n).show(a.n, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
