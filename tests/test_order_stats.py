"""Quantiles, ranks with ties and shares over ranges, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import careers, evaluation, order_stats, scouting, similarity


def groups(rows):
    out = {}
    for g, v in rows:
        out.setdefault(g, []).append(v)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    some = [("tie", 5.0)] * 400 + [("tie", 4.0), ("tie", 6.0)]  # one value, many times the share of a range
    some += [(r.choice("abc"), float(r.randint(0, 30))) for _ in range(600)] + [("one", 2.5), (None, 1.0), (None, 3.0), ("a", None), ("none", None)]
    return some


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(k, g, v) for k, (g, v) in enumerate(rows)], "id int, g string, v double").repartition(5)


def test_quantiles(df, rows):
    got = {r.g: (r.mid, r.low, r._n) for r in order_stats.quantiles(df, ["g"], "v", {"mid": 0.5, "low": 0.3}).collect()}
    for g, vs in groups(rows).items():
        vs = sorted(v for v in vs if v is not None)
        if not vs:
            assert g not in got
            continue
        at = 0.3 * (len(vs) - 1)
        low = vs[int(at)] + (at - int(at)) * (vs[min(int(at) + 1, len(vs) - 1)] - vs[int(at)])
        assert got[g] == (pytest.approx(statistics.median(vs)), pytest.approx(low), len(vs))


def test_a_tie_over_all_ranges_has_one_mean_rank(df, rows):
    got = order_stats.average_ranks(df, "v", ["g"], "r").collect()
    assert len(got) == len(rows)
    by = groups(rows)
    for x in got:
        vs = [v for v in by[x.g] if v is not None]
        want = None if x.v is None else sum(v < x.v for v in vs) + (sum(v == x.v for v in vs) + 1) / 2
        assert x.r == want


def test_shares_strictly_below(spark, df, rows):
    values = spark.createDataFrame([("a", 10.0, "x"), ("a", 10.5, "y"), ("tie", 5.0, "z"), ("new", 1.0, "w"), (None, 2.0, "v")], "g string, v double, other string")
    got = {r.other: r.s for r in order_stats.strict_shares(df, values, ["g"], "v", "s").collect()}
    by = groups(rows)
    share = lambda g, x: sum(v < x for v in by[g] if v is not None) / sum(v is not None for v in by[g])
    assert got == {"x": share("a", 10.0), "y": share("a", 10.5), "z": share("tie", 5.0), "w": 0.5, "v": share(None, 2.0)}


def test_no_group_is_in_one_task(df):
    """No window and no aggregate over a whole group of rows: plans hold ranges only."""
    plan = order_stats.counted(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # it is written, then read
    assert "percentile" not in plan and "median" not in plan


def test_hits_among_the_best(spark):
    x = spark.createDataFrame([("p", k, float(k), float(k % 7)) for k in range(50)] + [("q", 1, 1.0, 1.0)], "g string, id int, a double, b double")
    best = lambda key: {k for k in sorted(range(50), key=key)[:10]}
    want = len(best(lambda k: (-k, k)) & best(lambda k: (-(k % 7), k))) / 10
    assert {r.g: r.hit_rate for r in evaluation.hit_at_k(x, "a", "b", "id", ["g"], 10).collect()} == {"p": want, "q": 1.0}


def test_style_lifts(spark):
    x = spark.createDataFrame([("low", 1, n) for n in (4, 6, 8)] + [("high", 1, n) for n in (2, 4, 3)] + [("mid", 1, 2)] + [("high", 2, 9)] * 3, "style string, era int, n int")
    got = {(r.style, r.era): (r.careers, r.lift) for r in careers.style_lifts(x, F.col("style"), F.col("era"), "low").collect()}
    assert got == {("low", 1): (3, 1.0), ("high", 1): (3, 1.5), ("mid", 1): (1, 1.0), ("high", 2): (3, 1.0)}


def test_nearest_before_ends_with_odd_coordinates(spark):
    some = [(1, "p", 1, 0.0, 1.0), (2, "p", 2, 0.5, 1.0), (3, "p", 2, None, 1.0), (4, "p", 3, float("nan"), 1.0), (5, "p", 3, float("inf"), 2.0), (6, "p", 4, 90.0, 1e6), (7, "q", 1, 1.0, 1.0)]
    df = spark.createDataFrame(some, "player int, position string, last_season int, a double, b double")
    got = sorted((r.player, r.comp) for r in similarity.nearest_before(df, {"a": 1.0, "b": 2.0}, 10).collect())
    assert got == [(2, 1), (6, 1), (6, 2)]
    assert similarity.nearest_before(df.limit(0), {"a": 1.0, "b": 2.0}, 10).count() == 0


def brute_bridge(rows, candidates):
    out = {}
    for i, name, school in rows:
        own = [c for c in candidates if c[0] == name]
        s = school.strip().lower() if school else ""
        fits = [c for c in own if s and (c[1] or "").strip() and ((c[1].strip().lower() in s) or (s in c[1].strip().lower()))]
        hit = own if len(own) == 1 else fits
        out[i] = min(hit, key=lambda c: c[3])[2] if hit else None
    return out


def test_names_meet_by_college_and_year(spark):
    r = random.Random(5)
    rows = [(k, f"n{k % 5}", r.choice(["Ohio", " ohio state", "Texas", "", None])) for k in range(80)] + [(99, "solo", "Nowhere")]
    candidates = [(f"n{k % 6}", r.choice(["Ohio State", "Texas A&M", "", "Iowa"]), f"g{k}", k) for k in range(60)] + [("solo", "Elsewhere", "gs", 1000)]
    got = scouting.name_bridge(spark.createDataFrame(rows, "id int, name string, school string"), spark.createDataFrame(candidates, "name string, college string, gid string, seq int"), ["name"], "school", "college", "gid", "seq")
    assert {x.id: x.resolved for x in got.collect()} == brute_bridge(rows, candidates)
    picks = [(k, f"n{k % 4}", 2000 + k % 9) for k in range(60)]
    corpus = [(f"n{r.randint(0, 5)}", k, 1998 + r.randint(0, 9)) for k in range(40)]
    got = scouting.draft_match(spark.createDataFrame(picks, "pick int, name string, year int"), spark.createDataFrame(corpus, "name string, player int, last_season int"), ["name"])
    want = {}
    for pick, name, year in picks:
        near = [(abs(s - (year - 1)), -s, p) for n, p, s in corpus if n == name and abs(s - (year - 1)) <= 2]
        want[pick] = min(near)[2] if near else None
    assert {x.pick: x.matched for x in got.collect()} == want


def test_a_college_may_have_to_hold_the_school(spark):
    rows = spark.createDataFrame([(1, "n", "Nation 10"), (2, "n", "Nation 1")], "id int, name string, school string")
    found = spark.createDataFrame([("n", "Nation 1", "a", 1), ("n", "Nation 10", "b", 2)], "name string, college string, gid string, seq int")
    get = lambda **x: {r.id: r.resolved for r in scouting.name_bridge(rows, found, ["name"], "school", "college", "gid", "seq", **x).collect()}
    assert get() == {1: "a", 2: "a"} and get(either=False) == {1: "b", 2: "a"}
