"""What the commerce plans need not shuffle."""

from pyspark.sql import functions as F

from tidemark.plans import commerce

SMALL = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_targets_and_pool_are_told_apart_without_a_shuffle(spark):
    s = commerce.careers_once(spark, SMALL)
    targets, pool = commerce.targets_and_pool(spark, SMALL, s)
    assert shuffles(targets) == shuffles(pool) == 0
    seasons = commerce.played(spark, SMALL).groupBy("player").agg(F.max("season").alias("last"), F.count("*").alias("n"), F.max("age").alias("age")).collect()
    assert {(r.player, r.season, r.n_seasons) for r in targets.collect()} == {(r.player, r.last, r.n) for r in seasons if r.last >= commerce.CURRENT - 1}
    assert {(r.player, r.n_seasons, r.max_age) for r in pool.collect()} == {(r.player, r.n, r.age) for r in seasons if r.last < commerce.CURRENT - 1 and r.n >= 2}


def test_projections_and_survivals_in_one_are_those_of_each(spark):
    s = commerce.careers_once(spark, "/root/testdata/sf0.01")
    e = commerce.staged(commerce.edges(spark, "/root/testdata/sf0.01", s), "edges")
    both = commerce.projected_and_survived(spark, "/root/testdata/sf0.01", e, s)
    each = commerce.projections(spark, "/root/testdata/sf0.01", e, s).join(commerce.survivals(spark, "/root/testdata/sf0.01", e, s), "player")
    assert sorted(both.columns) == sorted(each.columns)
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("raw_sim#")
    assert (reads(both), reads(each)) == (1, 2)
    digits = {c: F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in each.dtypes}
    rows = lambda df: sorted(map(str, df.select(*(digits[c] for c in each.columns)).collect()))
    got = rows(both)
    assert len(got) > 100 and got == rows(each)


def test_prospects_and_backtests_make_played_seasons_once(spark, monkeypatch):
    from tidemark.plans import seasons

    made, played = [], commerce.played
    monkeypatch.setattr(commerce, "played", lambda *a: made.append(a) or played(*a))
    commerce.prospect_knn(spark, SMALL)
    assert len(made) == 1
    write = commerce.staged
    labels = []
    monkeypatch.setattr(commerce, "staged", lambda df, label: labels.append(label) or write(df, label))
    seasons.backtest_by_class(spark, SMALL)
    assert len(made) == 2 and labels.count("played") == 1
    commerce.prospects(spark, SMALL)
    assert labels.count("played") == 2
