"""Hand-computed values of the row-wise rules and windows."""

import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import names, rules
from tidemark.functions.numeric import cosine, int_or_null, inverse_distance, num0, squared_distance
from tidemark.operators import careers, evaluation, identity, penalties, ranking, similarity


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


L = F.lit


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: penalties.survival_multiplier(L(0.6), L(0.6), L(0)), 0.58),
        (lambda: penalties.survival_multiplier(L(0.6), L(0.6), L(2)), 0.4872),
        (lambda: penalties.survival_multiplier(L(1.0), L(1.0), L(5)), 0.3),
        (lambda: penalties.stack(L(2000.0), L(0.8), L(0.5), L(1000.0), L(0.88), L(False), L(1.0)), 1222.0),
        (lambda: penalties.stack(L(2000.0), L(0.8), L(0.5), L(1000.0), L(0.88), L(True), L(1.0)), 752.0),
        (lambda: penalties.stack(L(500.0), L(1.0), L(0.2), L(1500.0), L(1.0), L(False), L(1.0)), 100.0),
        (lambda: penalties.stack(L(2000.0), L(0.6), L(0.0), L(10.0), L(0.75), L(True), L(1.0)), 400.0),
        (lambda: penalties.confidence(L(15.0), L(True)), 0.46875),
        (lambda: penalties.confidence(L(16.0), L(True)), 0.5),
        (lambda: penalties.confidence(L(40.0), L(True)), 1.0),
        (lambda: rules.breakout_bonus(L(0.0)), 1.0),
        (lambda: rules.breakout_bonus(L(1500.0)), 1.3),
        (lambda: rules.breakout_bonus(L(3000.0)), 1.4755),
        (lambda: rules.recency_bonus(L(2015)), 1.0),
        (lambda: rules.recency_bonus(L(2018)), 1.10714),
        (lambda: rules.recency_bonus(L(2024)), 1.25),
        (lambda: rules.schedule_adjusted(L(20.0), L(-3.0)), 13.0),
        (lambda: rules.schedule_adjusted(L(20.0), L(-1.0)), 17.0),
        (lambda: rules.schedule_adjusted(L(20.0), L(0.0)), 20.0),
        (lambda: rules.schedule_adjusted(L(20.0), L(1.0)), 22.0),
        (lambda: inverse_distance(L(400.0), 20.0), 0.5),
        (lambda: inverse_distance(L(225.0), 15.0), 0.5),
        (lambda: F.sqrt(squared_distance([(L(float(3 * (k == 10))) / 2, L(0.0)) for k in range(11)], C.CAREER_WEIGHTS)), 3.354102),
        (lambda: careers.durability(L(40.0), L(3)), 0.784314),
        (lambda: rules.expected_at_pick(L(0)), 100.0),
        (lambda: rules.expected_at_pick(L(1)), 100.0),
        (lambda: rules.expected_at_pick(L(60)), 76.4),
        (lambda: rules.expected_at_pick(L(200)), 20.4),
        (lambda: rules.expected_at_pick(L(250)), 0.4),
        (lambda: rules.expected_at_pick(L(251)), 0.0),
        (lambda: num0(L("NA")), 0.0),
        (lambda: int_or_null(L("3.0")), 3),
        (lambda: rules.height_inches(L("6-3")), 75),
        (lambda: rules.age_at(F.to_date(L("2024-09-01")), F.to_date(L("2000-09-02"))), 23),
        (lambda: cosine(F.array(L(1.0), L(1.0)), F.array(L(2.0), L(2.0))), 1.0),
        (lambda: penalties.missed_season(L(2022), L(10), L(2024)), 0.45),
        (lambda: penalties.missed_season(L(2024), L(7), L(2024)), 0.85),
    ],
)
def test_golden(spark, column, want):
    assert value(spark, column()) == pytest.approx(want, abs=5e-5 if isinstance(want, float) else 0)


def test_season_points(spark):
    row = spark.createDataFrame([(4000, 30, 10, 300, 2, None)], "passing_yards int, passing_tds int, interceptions int, rushing_yards int, rushing_tds int, receptions int")
    k = {s: c for s, c in C.SCORING if s in row.columns}
    assert row.select(rules.season_points(k).alias("x")).first().x == 302.0


@pytest.mark.parametrize(
    ("normalise", "want"),
    [
        (names.identity_name, "odell beckham"),
        (names.compact_name, "odellbeckham"),
        (names.bridge_name, "odéll beckham"),
        (names.draft_name, "odéll beckham jr"),
        (names.prospect_name, "odéll beckham"),
    ],
)
def test_names(spark, normalise, want):
    assert value(spark, normalise(L("Odéll  Beckham Jr."))).replace("  ", " ") == want


def seasons(spark, rates, games, first_age=22):
    rows = [(1, "WR", 2000 + k, first_age + k, g, float(r * g)) for k, (r, g) in enumerate(zip(rates, games, strict=True))]
    return spark.createDataFrame(rows, "player long, position string, season int, age int, games int, points double")


def test_windows(spark):
    assert careers.slope(seasons(spark, [10, 14, 12, 18], [16] * 4)).first().slope == pytest.approx(2.2)
    assert careers.peak3(seasons(spark, [10, 20, 30, 5], [16, 8, 16, 4])).first().peak3 == pytest.approx(25.0)
    s = seasons(spark, [10] * 4, [10] * 4)
    snap = spark.createDataFrame([(1, 22)], "player long, snapshot_age int")
    assert careers.discounted_after(s, snap).first().future_points == pytest.approx(285.25)


def test_percentile_is_strict_and_half_for_an_empty_bucket(spark):
    m = spark.createDataFrame([("a", x) for x in (10.0, 20.0, 20.0, 30.0)], "k string, v double")
    v = spark.createDataFrame([("a", 20.0, 1), ("b", 5.0, 2), ("a", 99.0, 3)], "k string, v double, id int")
    assert {r.id: r.pct for r in careers.strict_percentile(m, v, ["k"], "v").collect()} == {1: 0.25, 2: 0.5, 3: 1.0}


def test_vectors_keep_age_gaps_as_zero(spark):
    rows = [(1, "WR", 2000, 22, 10, 100.0), (1, "WR", 2002, 24, 10, 200.0)]
    s = spark.createDataFrame(rows, "player long, position string, season int, age int, games int, points double")
    last = similarity.vectors(s, careers.stages(s)).where("age = 24").first()
    assert (last.v0, last.v1, last.v2) == (20.0, 0.0, 5.0) and last.v4 == 15.0 or last.v4 == 20.0


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, 5), ("a", 4, 1)], "g string, x int, y int")
    assert evaluation.spearman(rows, "x", "y", ["g"]).first().rho == pytest.approx(-0.316228, abs=1e-6)


def test_upper_median(spark):
    rows = spark.createDataFrame([("p", float(x)) for x in (10, 9, 8, 7)], "k string, v double")
    assert penalties.upper_median_of_best(rows, "k", "v").first().baseline == 8.0


def test_starters():
    got = ranking.starters_per_position(12, 1, 2, 3, 1, 1, 1)
    assert [round(x, 1) for x in got.values()] == [22.2, 29.4, 42.6, 13.8]


def test_ranks_equal_row_number(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("v"), F.when(F.col("id") % 10 > 2, "a").when(F.col("id") % 10 > 0, "b").alias("g"))
    rows = rows.union(spark.sql("SELECT id + 500, 7.0D, 'a' FROM range(200)"))  # many with one score
    got = [r.id for r in ranking.ranked(rows, "v", "id").orderBy("rank").collect()]
    assert got == [r.id for r in rows.orderBy(F.desc("v"), "id").collect()]
    within = ranking.ranked(rows, "v", "id", by="g", out="place")
    assert within.columns == ["id", "v", "g", "place"]
    for g in ("a", "b", None):
        one = within.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("place").collect()
        assert [r.place for r in one] == list(range(1, len(one) + 1)) and [(-r.v, r.id) for r in one] == sorted((-r.v, r.id) for r in one)
    assert ranking.ranked(rows.limit(0), "v", "id").count() == 0


def test_unique_cascade_falls_through(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "z", "q")], "row int, name string, pos string")
    cand = spark.createDataFrame([(10, "x", "p"), (11, "x", "p"), (12, "y", "q"), (13, "w", "q")], "id int, name string, pos string")
    got = {r.row: r.resolved for r in identity.unique_cascade(rows, cand, [["name", "pos"], ["name"]], "id").collect()}
    assert got == {1: None, 2: 12, 3: None}


def test_fill_only_never_overwrites(spark):
    base = spark.createDataFrame([(1, "a", None), (2, None, "t")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "z", "n"), (3, "q", None)], "k int, x string, y string")
    assert {tuple(r) for r in identity.fill_only(base, new, "k", ["x", "y"]).collect()} == {(1, "a", "n"), (2, None, "t"), (3, "q", None)}


def test_nearest_season_is_that_of_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(k, r.choice("abc"), r.randint(1980, 2010)) for k in range(300)] + [(300, None, 1990)]
    cand = [(k, r.choice("ab"), 1970 + 3 * r.randint(0, 9) + r.randint(0, 1)) for k in range(25)]
    want = {}
    for i, p, s in rows:
        near = min(((abs(s - cs), -cs, c) for c, cp, cs in cand if cp == p), default=(9,))
        want[i] = (near[2], near[0]) if near[0] <= 2 else (None, None)
    got = identity.nearest_season(spark.createDataFrame(rows, "row_id int, position string, season int"), spark.createDataFrame(cand, "id int, position string, season int"), ["position"])
    assert {g.row_id: (g.c_id, g.delta) for g in got.collect()} == want


def test_nearest_season_meets_no_whole_position(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.lit("a").alias("position"), F.lit(1990).alias("season"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = type(rows)
    join = frame.join

    def counted(self, *a, **k):
        out = join(self, *a, **k)
        return out.mapInArrow(count, out.schema)

    frame.join = counted
    try:
        got = identity.nearest_season(rows, rows.select(F.col("row_id").alias("id"), "position", "season"), ["position"]).collect()
    finally:
        frame.join = join
    assert len(got) == 1000 and {(g.c_id, g.delta) for g in got} == {(0, 0)}
    assert seen.value == 1000


def test_player_dimension_prefers_the_last_skill_row(spark):
    main = spark.createDataFrame([("a", "K", 1), ("a", "QB", 2), ("a", "P", 3), ("b", "K", 4), ("b", "P", 5), ("", "QB", 6), (None, "QB", 7), ("c", "WR", 8)], "id string, position string, order int")
    side = spark.createDataFrame([("c", "TE", "x", 1), ("d", "K", "y", 2)], "id string, position string, note string, order int")
    got = {r.id: (r.position, r.note) for r in identity.player_dimension([main, side], "id", "position").collect()}
    assert got == {"a": ("QB", None), "b": ("K", None), "c": ("TE", "x"), "d": ("K", "y")}


def test_crosswalk_maps_know_who_wins(spark):
    rows = spark.createDataFrame([("g1", "k1", "m1", "ann", "QB", 1), ("g2", "k1", "NA", "ann", "QB", 2), ("NA", "k9", "m9", "bob", "WR", 3), (None, "k8", "", "cy", "WR", 4), ("g3", "", "m1", "ann", "WR", 5)], "gid string, k string, m string, name string, position string, order int")
    maps = identity.crosswalk_maps(rows, "gid", ["k", "m"], "name")
    assert {r.k: r.gid for r in maps["k"].collect()} == {"k1": "g2"} and {r.m: r.gid for r in maps["m"].collect()} == {"m1": "g3"}
    assert {(r.name, r.position): r.gid for r in maps["name"].collect()} == {("ann", "QB"): "g1", ("ann", "WR"): "g3"}


def test_import_finds_new_players(spark):
    players = spark.createDataFrame([("ann", "QB")], "match_name string, position string")
    rows = spark.createDataFrame([("ANN", "QB", 1), ("Bob", "WR", 2), ("bob", "WR", 3)], "name string, position string, rank int")
    stamped, new = identity.imported(rows, players, F.lower("name"), ["position"], "2024-01-02 00:00:00")
    assert stamped.count() == 3 and [tuple(r) for r in new.collect()] == [("bob", "WR")]
    assert {str(r.captured_at) for r in stamped.collect()} == {"2024-01-02 00:00:00"}


def test_sync_resolves_fills_and_creates(spark):
    players = spark.createDataFrame([(1, "s1", None, "ann", "QB", None), (2, None, "g2", "bob", "WR", "old"), (3, None, None, "bob", "TE", None)], "pid int, sid string, gid string, name string, position string, team string")
    records = spark.createDataFrame([("s1", None, "x", "QB", "new"), ("s9", "g2", "y", "WR", "new"), ("s8", None, "bob", "TE", "new"), ("s7", None, "zed", "QB", "new")], "sid string, gid string, name string, position string, team string")
    out, filled, new = identity.synced(records, players, [["sid"], ["gid"], ["name", "position"], ["name"]], "pid", ["sid", "gid", "team"])
    assert {r.sid: r.resolved for r in out.collect()} == {"s1": 1, "s9": 2, "s8": 3, "s7": None}
    assert {r.pid: (r.sid, r.gid, r.team) for r in filled.collect()} == {1: ("s1", None, "new"), 2: ("s9", "g2", "old"), 3: ("s8", None, "new")}
    assert [r.name for r in new.collect()] == ["zed"]
