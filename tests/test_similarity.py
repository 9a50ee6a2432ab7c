"""Neighbours found in cells are those of brute force, and pairs grow with the rows, not with their square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import similarity


def careers(n, seed, noise=0.7):
    """n careers of four seasons whose numbers go together, as those of real ones do."""
    r = np.random.default_rng(seed)
    good, steady = r.normal(0, 1, n), r.normal(0, 1, n)
    rows = []
    for k in range(n):
        for stage in range(1, 5):
            base = 10 + 4 * good[k] + 2 * steady[k] * np.linspace(-1, 1, 11) + r.normal(0, noise, 11)
            rows.append((k, "P" if r.random() < 0.9 else "Q", 1990 + k % 9 + stage, 21 + stage, stage, *(float(x) for x in base)))
    by = {}
    return [(p, by.setdefault(p, pos), *rest) for p, pos, *rest in rows]


SCHEMA = "player long, position string, season int, age int, stage int, " + ", ".join(f"{v} double" for v in similarity.V)


def frames(spark, n_targets, n_pool, seed=1, noise=0.7):
    pool = [(10_000_000 + p, *x) for p, *x in careers(n_pool, seed, noise)]
    own = [x for x in careers(n_targets, seed + 1, noise) if x[4] == 3]
    own.append((*own[0][:1], own[0][1], *own[0][2:5], *(500.0 for _ in similarity.V)))  # far from all others
    own[-1] = (9_999_999, *own[-1][1:])
    targets = spark.createDataFrame(own, SCHEMA).withColumn("n_seasons", F.lit(3))
    pool = spark.createDataFrame(pool, SCHEMA)
    spans = pool.groupBy("player").agg(F.count("*").alias("n_seasons"), F.max("age").alias("max_age"))
    return targets, pool, spans


@pytest.mark.parametrize("old", [None, 1996])
def test_cells_give_what_whole_groups_give(spark, old):
    targets, pool, spans = frames(spark, 40, 400)
    run = lambda whole: sorted(tuple(x) for x in similarity.neighbours(targets, pool, spans, k=7, old_before=old, whole=whole).collect())
    want = run(10**9)
    assert len(want) == 41 * 7 and run(0) == want


def test_fewer_candidates_than_wanted(spark):
    targets, pool, spans = frames(spark, 30, 6)
    run = lambda whole: sorted(tuple(x) for x in similarity.neighbours(targets, pool, spans, k=25, whole=whole).collect())
    assert run(0) == run(10**9)
    assert similarity.neighbours(targets, pool.limit(0), spans, whole=0).count() == 0
    assert similarity.neighbours(targets.limit(0), pool, spans, whole=0).count() == 0


def test_equal_careers_are_ties_by_id(spark):
    targets, pool, spans = frames(spark, 5, 1)
    one = pool.limit(0)
    for k in range(60):
        one = one.union(spark.createDataFrame([(k, "P", 1995, 24, 3, *(1.0 for _ in similarity.V)), (k, "P", 1998, 27, 4, *(1.0 for _ in similarity.V))], SCHEMA)) if k % 20 == 0 else one
    copies = one.withColumn("player", F.explode(F.sequence(F.col("player") * 100, F.col("player") * 100 + 30)))
    spans = copies.groupBy("player").agg(F.lit(4).alias("n_seasons"), F.max("age").alias("max_age"))
    run = lambda whole: sorted(tuple(x) for x in similarity.neighbours(targets.withColumn("position", F.lit("P")), copies, spans, k=9, whole=whole).collect())
    want = run(10**9)
    assert want and run(0) == want


def brute_before(rows, weights, k):
    out = set()
    for p, g, at, *x in rows:
        d = sorted((sum(w * (a - b) ** 2 for w, a, b in zip(weights, x, y, strict=True)) ** 0.5, q) for q, h, s, *y in rows if h == g and s < at)
        out |= {(p, q, n + 1) for n, (_, q) in enumerate(d[:k])}
    return out


def test_nearest_before_is_exact(spark):
    r = np.random.default_rng(7)
    rows = [(k, "ab"[k % 2], int(r.integers(0, 6)), *(float(x) for x in r.normal(0, (1, 3, 1, 0.1)))) for k in range(300)] + [(900 + k, "c", k, 0.0, 0.0, 0.0, 0.0) for k in range(5)]
    df = spark.createDataFrame(rows, "player int, position string, last_season int, a double, b double, c double, d double")
    got = {(x.player, x.comp, x["rank"]) for x in similarity.nearest_before(df, {"a": 1.0, "b": 2.0, "c": 0.5, "d": 3.0}, 6).collect()}
    assert got == brute_before(rows, (1.0, 2.0, 0.5, 3.0), 6)


def test_no_axis_lengthens_a_distance(spark):
    targets, pool, _ = frames(spark, 5, 50)
    turn = similarity.directions(pool, similarity.V, C.CAREER_WEIGHTS)
    x = np.array([[r[v] for v in similarity.V] for r in pool.collect()])
    placed = x @ np.array(turn).T
    d = np.sqrt((((x[:, None] - x[None]) ** 2) * np.array(C.CAREER_WEIGHTS)).sum(-1))
    along = np.sqrt(((placed[:, None] - placed[None]) ** 2).sum(-1))
    assert (along <= d + 1e-9).all() and along.sum() > 0.8 * d.sum()




def test_pairs_grow_with_the_rows(spark, monkeypatch):
    made, kind = [], type(spark.range(1))
    join = kind.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how) if how else join(self, other, on)
        if isinstance(on, list) and "_x0" in on:
            made.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    grown = []
    for n in (400, 4000):
        made.clear()
        targets, pool, spans = frames(spark, n // 4, n, noise=0.1)
        similarity.neighbours(targets, pool, spans, k=5, whole=0).count()
        grown.append(sum(made))
    assert grown[1] < 20 * grown[0], grown


@pytest.mark.parametrize("n", [8, 300])
def test_rookies_in_cells_are_those_of_whole_groups(spark, n):
    from tidemark.operators import rookies

    r = np.random.default_rng(n)
    rows = [(k, "P", 2000 + k % 25, 20 + int(r.integers(0, 9)), int(r.integers(4, 18)), *(float(x) for x in r.normal(10, 4, 2)), float(r.integers(0, 3) * 300), 1.0, 1) for k in range(n)]
    df = spark.createDataFrame(rows, "player int, position string, season int, age int, games int, a double, b double, later double, later_discounted double, later_seasons int")
    w = {"a": 1.0, "b": 0.3, "age": 2.0}
    run = lambda whole: sorted(map(tuple, rookies.neighbours(df.where("season > 2003"), df, w, 6, whole=whole).collect()))
    want = run(10**9)
    assert want and run(0) == want


def test_a_run_has_a_folder_that_can_be_cleared(spark):
    from pathlib import Path

    from tidemark import staging

    df = staging.staged(spark.range(3), "x")
    own = Path(staging.run_folder(spark).removeprefix("file:"))
    assert own.name == spark.sparkContext.applicationId and df.count() == 3 and any(own.iterdir())
    assert staging.clear(spark) and not own.exists() and not staging.clear(spark)


def test_few_earlier_rows_cost_few_pairs(spark, monkeypatch):
    """A season with few before it meets those, not all rows around: pairs by one key a later season."""
    r = np.random.default_rng(3)
    rows = [(k, "p", 1990 + (0 if k < 30 else 1 if k < 400 else 2), *(float(v) for v in r.normal(0, 1, 2))) for k in range(1200)]
    df = spark.createDataFrame(rows, "player int, position string, last_season int, a double, b double")
    seen, real = [], similarity.in_cells
    monkeypatch.setattr(similarity, "in_cells", lambda t, pool, keys, *rest: (seen.append((pool, keys)), real(t, pool, keys, *rest))[1])
    got = {(x.player, x.comp, x["rank"]) for x in similarity.nearest_before(df, {"a": 1.0, "b": 2.0}, 5).collect()}
    assert got == brute_before(rows, (1.0, 2.0), 5)
    (pool, keys), = seen
    assert "_at" in keys and {x["_at"]: x["count"] for x in pool.groupBy("_at").count().collect()} == {1991: 30, 1992: 400}


@pytest.fixture
def met(monkeypatch):
    """How many rows of targets and of offers the search in cells is given."""
    seen, whole = [], similarity.in_cells
    count = lambda targets, pool, *rest: seen.append((targets.count(), pool.count())) or whole(targets, pool, *rest)
    monkeypatch.setattr(similarity, "in_cells", count)
    return seen


def test_copies_of_careers_search_once(spark, met):
    targets, pool, spans = frames(spark, 8, 60)
    times = lambda df, n: df.withColumn("player", F.explode(F.sequence(F.col("player") * 100, F.col("player") * 100 + n)))
    targets, pool, spans = times(targets, 19), times(pool, 19), times(spans, 19)
    run = lambda whole: sorted(tuple(x) for x in similarity.neighbours(targets, pool, spans, k=3, whole=whole).collect())
    want = run(10**9)
    assert len(want) == 9 * 20 * 3 and run(0) == want
    once = similarity.snapshots(*(df.where("player % 100 = 0") for df in (pool, spans))).count() * 3
    assert met[0][0] <= 9 and met[0][1] <= once * 4


def test_copies_of_rows_search_once(spark, met):
    r = np.random.default_rng(5)
    some = [(k, "P", 2000 + k % 3, float(a), float(b)) for k, (a, b) in enumerate(r.normal(0, 1, (30, 2)))]
    rows = [(k * 100 + n, *rest) for k, *rest in some for n in range(20)]
    df = spark.createDataFrame(rows, "player long, position string, last_season int, a double, b double")
    got = {(x.player, x.comp, x["rank"]) for x in similarity.nearest_before(df, {"a": 1.0, "b": 2.0}, 3).collect()}
    want = set()
    for p, _, s, a, b in rows:
        near = sorted(((a - c) ** 2 + 2 * (b - d) ** 2, q) for q, _, t, c, d in rows if t < s)[:3]
        want |= {(p, q, n) for n, (_, q) in enumerate(near, 1)}
    assert got == want and len(want) == 20 * 20 * 3
    assert met == [(20, 3 * (10 * 2 + 10 * 1))]


def test_copies_of_first_seasons_leave_themselves_out(spark):
    from tidemark.operators import prospects, rookies

    rows = [(k * 100 + n, "P", 2000 + k % 3, 22, 14, float(k % 7), float(k), 5.0 * k, 4.0 * k, 3) for k in range(12) for n in range(9)]
    df = spark.createDataFrame(rows, "player long, position string, season int, age int, games int, rate double, qty double, later double, later_discounted double, later_seasons int")
    run = lambda whole: sorted(map(tuple, rookies.neighbours(df, df, {"rate": 2.0, "qty": 1.0, "age": 3.0}, 4, whole=whole).collect()))
    want = run(10**9)
    assert len(want) == 108 * 4 and run(0) == want and all(x[0] != x[1] for x in want)
    careers = df.select("player", "position", F.col("season").alias("last_season"), F.lit(2.0).alias("stage"), F.col("age").cast("double"), *(F.col("rate").alias(c) for c in C.PROSPECT_WEIGHTS if c not in ("stage", "age")))
    for before in (False, True):
        run = lambda whole: sorted(map(tuple, prospects.similar(careers, careers, 4, before, whole).collect()))  # noqa: E731, B023
        want = run(10**9)
        assert run(0) == want and want and all(x[0] != x[1] for x in want)


def test_copies_in_small_groups_search_once(spark, monkeypatch):
    """Where one group is large, equal targets of the small ones, too, are ranked once."""
    targets, pool, spans = frames(spark, 20, 120)
    times = lambda df, n: df.withColumn("player", F.explode(F.sequence(F.col("player") * 100, F.col("player") * 100 + n)))
    targets = times(targets, 19)
    run = lambda whole: sorted(tuple(x) for x in similarity.neighbours(targets, pool, spans, k=3, whole=whole).collect())
    want = run(10**9)
    seen, ranked = [], similarity.first_by
    monkeypatch.setattr(similarity, "first_by", lambda pairs, *rest: seen.append(pairs.select("player").distinct().count()) or ranked(pairs, *rest))
    assert run(60) == want and len(seen) == 2 and min(seen) > 0 and sum(seen) <= 21


def test_two_cuts_from_one_search(spark, monkeypatch):
    targets, pool, spans = frames(spark, 40, 400)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    want = [rows(similarity.neighbours(targets, pool, spans, k=7, old_before=old, whole=10**9)) for old in (1996, None)]
    seen, cells = [], similarity.in_cells
    monkeypatch.setattr(similarity, "in_cells", lambda *rest: seen.append(1) or cells(*rest))
    for whole in (0, 60, 10**9):
        assert [rows(df) for df in similarity.neighbours_by(targets, pool, spans, [1996, None], k=7, whole=whole)] == want
    assert want[0] != want[1] and len(seen) == 2


def test_first_seasons_of_small_groups_search_once(spark, monkeypatch):
    from tidemark.operators import prospects, rookies

    rows = [(k * 100 + n, "P" if k < 9 else "Q", 2000, 22, 14, float(k % 7), float(k), 5.0 * k, 4.0 * k, 3) for k in range(12) for n in range(9)]
    df = spark.createDataFrame(rows, "player long, position string, season int, age int, games int, rate double, qty double, later double, later_discounted double, later_seasons int")
    run = lambda whole: sorted(map(tuple, rookies.neighbours(df, df, {"rate": 2.0, "qty": 1.0, "age": 3.0}, 4, whole=whole).collect()))
    want = run(10**9)
    seen, ranked = [], rookies.first_by
    monkeypatch.setattr(rookies, "first_by", lambda pairs, *rest: seen.append(pairs.select("player").distinct().count()) or ranked(pairs, *rest))
    assert len(want) == 108 * 4 and run(30) == want and seen == [3]
    careers = df.select("player", "position", F.col("season").alias("last_season"), F.lit(2.0).alias("stage"), F.col("age").cast("double"), *(F.col("rate").alias(c) for c in C.PROSPECT_WEIGHTS if c not in ("stage", "age")))
    run = lambda whole: sorted(map(tuple, prospects.similar(careers, careers, 4, False, whole).collect()))
    want = run(10**9)
    assert want and run(30) == want
