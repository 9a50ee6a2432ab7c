"""Refreshes that are refused, files that are the same on every run, results kept by their inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import artefacts, refresh
from tidemark.sources.refresh import Refused, Step


def held(spark, path, by="season"):
    return {r[by]: r["count"] for r in spark.read.parquet(path).groupBy(by).count().collect()}


def seasons(spark, sizes, start=0):
    rows = [(y, f"g{start + k}", float(k)) for y, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "season int, gsis_id string, points double")


def test_parts_are_replaced_only_if_they_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    first = refresh.replace_guarded(seasons(spark, {2000: 10, 2001: 10}), path, "season", ids=["gsis_id"], least=5, share=0.5)
    assert first.rows == 20 and first.replaced == {2000: 10, 2001: 10} and not first.kept
    # one season too small for its old one, one too small for any, one new
    second = refresh.replace_guarded(seasons(spark, {2000: 12, 2001: 4, 2002: 6, 2003: 1}), path, "season", ids=["gsis_id"], least=2, share=0.5)
    assert second.replaced == {2000: 12, 2002: 6} and second.kept == {2001: "4 rows, 10 before", 2003: "1 rows, 2 needed"}
    assert held(spark, path) == {2000: 12, 2001: 10, 2002: 6}


@pytest.mark.parametrize(("change", "why"), [(lambda df: df.drop("gsis_id"), "missing columns: gsis_id"), (lambda df: df.limit(0), "no rows"), (lambda df: df.withColumn("gsis_id", F.when(F.col("points") > 2, F.col("gsis_id")).otherwise(" ")), "6 rows without gsis_id")])
def test_a_refusal_leaves_all_as_it_was(spark, tmp_path, change, why):
    path, snap = str(tmp_path / "t"), str(tmp_path / "s")
    old = seasons(spark, {2000: 4, 2001: 4})
    refresh.replace_guarded(old, path, "season", ids=["gsis_id"])
    refresh.replace_snapshot(old, snap, ids=["gsis_id"])
    with pytest.raises(Refused, match=why):
        refresh.replace_guarded(change(seasons(spark, {2000: 5, 2001: 5})), path, "season", ids=["gsis_id"])
    with pytest.raises(Refused, match=why):
        refresh.replace_snapshot(change(seasons(spark, {2000: 5, 2001: 5})), snap, ids=["gsis_id"])
    assert held(spark, path) == {2000: 4, 2001: 4} and refresh.snapshot(spark, snap).count() == 8


def test_snapshots_have_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert refresh.snapshot(spark, path) is None
    assert refresh.replace_snapshot(seasons(spark, {2000: 4}), path, ["points"], ["gsis_id"]) == 4
    assert refresh.replace_snapshot(seasons(spark, {2000: 2}), path) == 2
    now = refresh.snapshot(spark, path)
    assert now.count() == 2 and now.columns == ["season", "gsis_id", "points"]


def test_daily_goes_on_after_a_failure(spark):
    steps = [Step("a", lambda r: 1), Step("b", lambda r: 1 / 0), Step("c", lambda r: r["a"] + 1), Step("d", lambda r: r["b"], fatal=True), Step("e", lambda r: 5)]
    results, report = refresh.daily(spark, steps)
    assert results == {"a": 1, "c": 2}
    assert [(r.name, r.outcome) for r in report.collect()] == [("a", "done"), ("b", "failed"), ("c", "done"), ("d", "failed"), ("e", "skipped")]
    assert "ZeroDivisionError" in report.where("name = 'b'").first().detail


def test_seasons_to_fetch():
    assert refresh.seasons_to_fetch(2003, 2000, {2002: 5}) == [2003]
    assert refresh.seasons_to_fetch(2003, 2000, {}) == [2000, 2001, 2002, 2003] == refresh.seasons_to_fetch(2003, 2000, {2001: 1}, full=True)
    assert refresh.seasons_to_fetch(2003, 2000, {2001: 1}, since=1990) == [2000, 2001, 2002, 2003]
    assert refresh.seasons_to_fetch(2003, 2000, {2001: 1}, since=2002) == [2002, 2003]


def files(path):
    return {p.name: p.read_bytes() for p in path.iterdir()}


def test_class_files_are_the_same_on_every_run(spark, tmp_path):
    rows = spark.createDataFrame([(2000 + k % 3, k, f"né {k}", {"x": k} if k % 2 else None) for k in range(40)] + [(None, 99, None, None)], "draft_class int, pick int, name string, more map<string,int>")
    one = artefacts.class_files(rows.repartition(5), "draft_class", [F.desc("pick")], "name", str(tmp_path / "a"), "prospects", "v1", file_rows=10)
    two = artefacts.class_files(rows.orderBy("name").repartition(2), "draft_class", [F.desc("pick")], "name", f"file:{tmp_path}/b", "prospects", "v1", file_rows=10)
    assert one == two and files(tmp_path / "a") == files(tmp_path / "b")
    assert sorted(files(tmp_path / "a")) == ["prospects_2000.1.json", "prospects_2000.json", "prospects_2001.1.json", "prospects_2001.json", "prospects_2002.1.json", "prospects_2002.json", "prospects_None.json", "prospects_index.json"]
    held = json.loads(files(tmp_path / "a")["prospects_2001.json"])
    assert held["n"] == 10 and held["class"] == "2001" and [r["pick"] for r in held["rows"]] == sorted((k for k in range(40) if k % 3 == 1), reverse=True)[:10]
    assert sum(f["n"] for f in one["files"]) == 41
    three = artefacts.class_files(rows.where("pick <> 4"), "draft_class", [F.desc("pick")], "name", str(tmp_path / "c"), "prospects", "v1", file_rows=10)
    assert [f["sha256"] for f in three["files"]] != [f["sha256"] for f in one["files"]]


def test_penalty_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "QB", 0.5, 0.9, 30, 0.8, 24, 0.88, 2000, 3, 0.7)], "player int, position string, bust_rate double, survival double, career_games int, confidence double, breakout_age int, late double, last_season int, last_games int, missed double")
    index = artefacts.penalty_files(df, str(tmp_path), "v")
    assert [f["class"] for f in index["files"]] == ["confidence", "late_breakout", "missed_season", "survival"]
    row = json.loads((tmp_path / "penalties_survival.json").read_text())["rows"][0]
    assert json.loads(row["figures"]) == {"bust_rate": 0.5, "survival": 0.9} and row["player"] == 1


def test_cache_goes_by_its_inputs(spark, tmp_path):
    built = []
    a = spark.createDataFrame([(1, "x", {"k": 1}), (2, None, None), (2, None, None)], "i int, s string, m map<string,int>")

    def build(df):
        built.append(1)
        return df.groupBy("i").count()

    run = lambda df, version="1": artefacts.cached(spark, str(tmp_path / "c"), {"a": df}, lambda: build(df), version)
    first, was = run(a)
    assert not was and sorted(first.collect()) == sorted(run(a.repartition(3).orderBy("s"))[0].collect()) and run(a)[1] and len(built) == 1
    for other in (a.union(a.limit(1)), a.withColumn("i", F.col("i").cast("long")), a.withColumn("s", F.lit("x")), a.where("i = 2").union(a.where("i = 2"))):
        assert not run(other)[1]
    assert not run(a, "2")[1] and run(a)[1] and len(built) == 6
