"""Prospects by hand-computed figures and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import prospects

SEASON = "player int, position string, season int, games int, rate double, volume double, tier string, z double, class_year string"


def seasons(spark):
    rows = [(1, "QB", 2001, 10, 10.0, 150.0, "P5", 2.0, "fr"), (1, "QB", 2002, 10, 20.0, 150.0, "G5", None, " So "), (1, "QB", 2003, 3, 99.0, 900.0, "P5", 0.0, "JR"), (2, "QB", 2001, 12, 8.0, 250.0, None, -9.0, ""), (3, "RB", 2001, 12, 8.0, 199.0, "P5", 0.0, "SR")]
    return spark.createDataFrame(rows, SEASON)


def test_corpus(spark):
    got = {r.player: r for r in prospects.corpus(seasons(spark)).collect()}
    assert set(got) == {1, 2}  # 3 is below the bar, and three games are no season
    one, two = got[1], got[2]
    assert (one.avg, one.peak, one.final, one.factor) == (pytest.approx((11.0 + 15.0) / 2), 15.0, 15.0, pytest.approx(0.875))
    assert (one.stage, one.age, one.age_inferred, one.last_season, one.tier) == (2.0, 20.0, False, 2002, "G5")
    assert two.avg == pytest.approx(8 * 0.65 * 0.65) and (two.age, two.age_inferred) == (19.0, True)
    assert one.z_avg == -two.z_avg == 1.0


def careers(spark, n=300):
    rows = [(k, "QR"[k % 2] + "B", 1990 + k % 7, float(1 + k % 4), 19.0 + (k * 7 % 9) / 2, *((k * m % 101) / 50 - 1 for m in (3, 7, 11, 13))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "player int, position string, last_season int, stage double, age double, z_avg double, z_peak double, z_final double, z_factor double")


def brute(rows, k, before):
    w = C.PROSPECT_WEIGHTS
    out = set()
    for p, pos, last, stage, age, a, b, f, m in rows:
        near = []
        for q, qos, qlast, qs, qa, qx, qy, qz, qm in rows:
            if q != p and qos == pos and abs(qs - stage) <= 1 and abs(qa - age) <= 2 and (not before or qlast < last):
                near.append((math.sqrt(w["z_avg"] * (a - qx) ** 2 + w["z_peak"] * (b - qy) ** 2 + w["z_final"] * (f - qz) ** 2 + w["stage"] * (stage - qs) ** 2 + w["age"] * (age - qa) ** 2 + w["z_factor"] * (m - qm) ** 2), q))
        out |= {(p, q, n + 1) for n, (_, q) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("whole", [10**9, 0])
def test_similar_careers(spark, before, whole):
    rows, df = careers(spark)
    got = prospects.similar(df, df, 6, before, whole).collect()
    assert {(r.player, r.comp, r["rank"]) for r in got} == brute(rows, 6, before)
    assert all(r.similarity == pytest.approx(1 / (1 + r.distance), abs=1e-5) for r in got)


def test_projection_blends_with_the_pick(spark):
    targets = spark.createDataFrame([("a", "QB", 5), ("b", "RB", None), ("c", "WR", 300), ("d", "TE", 40)], "player string, position string, pick int")
    pro = "struct<career:double,peak:double,seasons:int>"
    comps = [("a", k / 10, (100.0 * k, float(k), k)) for k in range(8)] + [("c", 1.0, (50.0, 6.0, 2)), ("c", 0.0, None), ("d", 2.0, None)]
    got = {r.player: r for r in prospects.projected(targets, spark.createDataFrame(comps, f"player string, distance double, pro {pro}")).collect()}
    w = [1 / (1 + k / 10) for k in range(8)]
    assert got["a"].projected_career == round(sum(x * 100 * k for k, x in enumerate(w)) / sum(w), 1) and got["a"].source == "comp_weighted" and got["a"].confidence == 1.0
    assert (got["b"].projected_career, got["b"].projected_peak, got["b"].projected_years, got["b"].source) == (55.0, 2.0, 1.2, "pick_tier_baseline_UDFA")
    share = 1 / 8
    assert got["c"].projected_career == pytest.approx(round(share * (25.0 / 1.5) + (1 - share) * 85.0, 1)) and got["c"].source == f"blend_{share:.2f}_pick_tier_baseline_R7"
    assert (got["d"].projected_career, got["d"].n_comps_with_nfl, got["d"].base_career) == (520.0, 0, 520.0)


def test_labels_and_tiers(spark):
    df = spark.createDataFrame([(19.0, 1, 10), (12.0, 9, 11), (5.9, 3, 64), (5.9, 2, 201), (8.0, 9, None)], "p double, s int, k int")
    got = df.select(prospects.hit_label(F.col("p"), F.col("s")).alias("h"), prospects.tier_of_pick(F.col("k")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("elite", "R1_top10"), ("starter", "R1"), ("bust", "R2"), ("unknown", "R7"), ("unknown", "UDFA")]


def test_the_official_source_wins(spark):
    official = spark.createDataFrame([(1, 2027, "Al", "QB", 3, "NYJ"), (2, 2027, "Al", "QB", 1, "DAL"), (3, 2026, "Bo", "QB", None, None)], "pick_id int, year int, name string, position string, pick int, team string")
    board = spark.createDataFrame([(8, 2027, "Al", "QB", 1, "x"), (9, 2027, "Al", "WR", 7, "y")], "pick_id int, year int, name string, position string, pick int, school string")
    got = {(r.year, r.name, r.position): (r.pick_id, r.pick_source, r.team, r.school) for r in prospects.all_picks(official, board).collect()}
    assert got == {(2027, "Al", "QB"): (2, "official", "DAL", None), (2026, "Bo", "QB"): (3, "official", None, None), (2027, "Al", "WR"): (9, "board", None, "y")}


def test_records_hold_stubs_and_comps(spark):
    rows, df = careers(spark, 60)
    df = df.withColumns({"name": F.concat(F.lit("n"), "player"), "first_season": F.col("last_season") - 3, "age_inferred": F.lit(False), "tier": F.lit("P5"), "avg": F.lit(1.0), "peak": F.lit(2.0), "final": F.lit(1.5), "factor": F.lit(1.0)})
    picks = spark.createDataFrame([("k1", 1992, "n1", "RB", 4), ("k2", 1999, "n2", "QB", 9), ("k3", 1991, "nobody", "QB", None)], "pick_id string, year int, name string, position string, pick int")
    bridge = spark.createDataFrame([(k, f"g{k}", "id") for k in range(0, 60, 3)], "comp int, pro_id string, strategy string")
    pro = spark.createDataFrame([(f"g{k}", 1000.0, 19.0, 5) for k in range(60)], "pro_id string, career double, peak double, seasons int")
    by_name = spark.createDataFrame([(k, f"g{k}") for k in range(1, 60, 3)], "comp int, name_id string")
    seen = spark.createDataFrame([("n1", "RB", 5, 9)], "name string, position string, pos_rank int, overall_rank int")
    got = {r.pick_id: r for r in prospects.records(picks, df, bridge, pro, by_name, seen, k=7).collect()}
    one = got["k1"]
    assert one.corpus_match and one.matched == 1 and [x.rank for x in one.comps] == list(range(1, 8))
    want = {q for p, q, _ in brute(rows, 7, False) if p == 1}
    assert {x.comp for x in one.comps} == want
    assert {x.comp: x.strategy for x in one.comps} == {k: {0: "id", 1: "name_fallback", 2: None}[k % 3] for k in want}
    assert one.projection.n_comps_with_nfl == sum(k % 3 < 2 for k in want) and one.delta_pos == 5 - one.model_pos_rank and one.career.production.peak == 2.0
    assert not got["k2"].corpus_match and not got["k3"].corpus_match and got["k3"].comps == [] and got["k3"].career is None and got["k2"].projection.source == "pick_tier_baseline_R1_top10"
    assert sorted(r.model_overall_rank for r in got.values()) == [1, 2, 3]


def test_namesakes_with_one_pick_go_by_the_number_of_their_id(spark):
    rows = spark.createDataFrame([(k, 2027, "Al", "QB", 7) for k in (1002, 999, 10000)], "pick_id int, year int, name string, position string, pick int")
    assert [r.pick_id for r in prospects.all_picks(rows, rows.limit(0)).collect()] == [999]
    late = spark.createDataFrame([(1, 2027, "Al", "QB", None), (2, 2027, "Al", "QB", 12000)], rows.schema)
    assert [r.pick_id for r in prospects.all_picks(rows.limit(0), late).collect()] == [2]  # no pick comes last


def test_other_lengths_and_ages_are_met_only_within_what_was_found(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, "WR", 2000, float(1 + k % 3), float(19 + k % 2), *map(float, r.normal(0, 0.3, 4).round(6))) for k in range(360)]
    rows += [(1000 + k, "WR", 2000, float(1 + k), 22.0, 2.0, 2.0, 2.0, 2.0) for k in range(3)]  # few of their age
    df = spark.createDataFrame(rows, "player long, position string, last_season int, stage double, age double, z_avg double, z_peak double, z_final double, z_factor double")
    sizes, write = [], prospects.staged
    monkeypatch.setattr(prospects, "staged", lambda d, label: (out := write(d, label), sizes.append((label, out.count())))[0])
    got = prospects.similar(df, df, 5).collect()
    w = C.PROSPECT_WEIGHTS
    names = df.columns
    want = {}
    for a in rows:
        pairs = []
        for b in rows:
            x, y = dict(zip(names, a, strict=True)), dict(zip(names, b, strict=True))
            if a[0] != b[0] and abs(x["age"] - y["age"]) <= 2 and abs(x["stage"] - y["stage"]) <= 1:
                pairs.append((sum(v * (x[c] - y[c]) ** 2 for c, v in w.items()) ** 0.5, b[0]))
        want[a[0]] = [p[1] for p in sorted(pairs)[:5]]
    have = {}
    for g in sorted(got, key=lambda g: g["rank"]):
        have.setdefault(g["player"], []).append(g["comp"])
    assert have == {k: v for k, v in want.items() if v}
    assert dict(sizes)["offers"] == len(rows)  # each once, not for each length and age
    assert [n for label, n in sizes if label == "asked"][1] < 3 * len(rows)  # of 14 others each
