"""Sync against a cascade over one record at a time; a second run creates nothing."""

import random

from pyspark.sql import functions as F


from tidemark.functions.names import identity_name
from tidemark.operators import sync

RECORD = "order int, sleeper_id string, gsis_id string, mfl_id string, pfr_id string, full_name string, position string, nfl_team string, college string, draft_year int, draft_round int, draft_pick_overall int, draft_team string"
PLAYER = "player_id long, sleeper_id string, gsis_id string, mfl_id string, pfr_id string, full_name string, position string, nfl_team string, college string, draft_year int, draft_round int, draft_pick_overall int, draft_team string, note string"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
OWN = [c.split()[0] for c in PLAYER.split(", ")]


NORMAL: dict = {}


def normal(x):
    return NORMAL.get(x or "", "")


def one_by_one(records, players):
    players = [dict(p) for p in players]
    out = {}

    def first(fits):
        return min(fits, key=lambda p: p["player_id"], default=None)

    for r in sorted(records, key=lambda r: r["order"]):
        p, step = None, None
        for i in sync.IDS:
            if p is None and r[i]:
                p, step = first([x for x in players if x[i] == r[i]]), i
        for step_name, key in (("name", lambda x: x["full_name"]), ("normal_name", lambda x: normal(x["full_name"]))):
            if p is None and r["full_name"] and key(r):
                p, step = first([x for x in players if key(x) == key(r) and (not r["position"] or x["position"] == r["position"])]), step_name
        if p is None:
            p = dict.fromkeys(OWN) | {k: r[k] for k in NAMES if k != "order"} | {"player_id": max((x["player_id"] for x in players), default=0) + 1, "full_name": r["full_name"] or "(unknown)"}
            players.append(p)
            step = "created"
        else:
            for c in sync.FILLED:
                if r[c] and not p[c]:
                    p[c] = r[c]
        out[r["order"]] = (p["player_id"], step)
    return out, players


def world():
    r = random.Random(17)
    people = [(f"{a} {b}", pos) for a in ("Al", "Bo", "Cy") for b in ("Ray", "O'Neil", "St. John") for pos in ("QB", "WR")]
    players = [dict.fromkeys(OWN) | {"player_id": 10 + k, "full_name": n, "position": p, "gsis_id": f"g{n}{p}" if k % 2 else None, "note": "kept"} for k, (n, p) in enumerate(people[:9])]
    records = []
    for k in range(160):
        n, p = r.choice(people)
        shown = r.choice([n, n, n + " Jr.", n.replace("'", "")])
        records.append(dict.fromkeys(NAMES) | {"order": k, "full_name": shown, "position": p, "gsis_id": r.choice([None, f"g{n}{p}"]), "sleeper_id": r.choice([None, "", f"s{n}{p}"]), "nfl_team": r.choice([None, "", "NYJ", "DAL"]), "draft_year": r.choice([None, 2001, 2002])})
    records += [dict.fromkeys(NAMES) | {"order": 500 + k} for k in range(2)] + [dict.fromkeys(NAMES) | {"order": 510, "mfl_id": "m1"}, dict.fromkeys(NAMES) | {"order": 511, "mfl_id": "m1", "full_name": "Late Name", "college": "Rice"}]
    return records, players


def table(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def test_sync_is_the_cascade(spark):
    records, players = world()
    every = spark.createDataFrame([(x["full_name"],) for x in [*records, *players] if x["full_name"]], "n string").distinct()
    NORMAL.update({r.n: r.k for r in every.select("n", identity_name(F.col("n")).alias("k")).collect()})
    got = sync.sync(table(spark, records, RECORD).repartition(4), table(spark, players, PLAYER), identity_name)
    want, after = one_by_one(records, players)
    ids = {r.order: r.player_id for r in got.records.collect()}
    assert ids == {k: v[0] for k, v in want.items()} and {r.order: r.step for r in got.records.collect()} == {k: v[1] for k, v in want.items()}
    assert got.created == len(after) - len(players) == got.players.count() - len(players)
    old = {p["player_id"] for p in players}
    filled = {p.player_id: (p.full_name, *(p[c] or None for c in (*sync.IDS, *sync.FILLED))) for p in got.players.collect()}
    assert filled == {p["player_id"]: (p["full_name"], *(p[c] or None for c in (*sync.IDS, *sync.FILLED))) for p in after}
    assert {p.note for p in got.players.collect() if p.player_id in old} == {"kept"}
    assert sorted(p.player_id for p in got.players.collect())[-1] == max(old) + got.created

    again = sync.sync(table(spark, records, RECORD), got.players.drop("normalized_name"), identity_name)
    unknown = 2  # records without ids and name can't be found again
    assert again.created == unknown
    known = {r.order: r.player_id for r in again.records.collect() if r.order not in (500, 501)}
    assert known == {k: v for k, v in ids.items() if k not in (500, 501)}


def test_several_candidates_are_reported(spark):
    players = [dict.fromkeys(OWN) | {"player_id": k, "full_name": "Al Ray", "position": "QB"} for k in (7, 5, 9)]
    records = [dict.fromkeys(NAMES) | {"order": 1, "full_name": "Al Ray Jr", "position": "QB"}, dict.fromkeys(NAMES) | {"order": 2, "full_name": "Al Ray"}, dict.fromkeys(NAMES) | {"order": 3, "full_name": "Al Ray", "position": "TE"}]
    got = sync.sync(table(spark, records, RECORD), table(spark, players, PLAYER), identity_name)
    assert {r.order: (r.player_id, r.step, r.candidates) for r in got.records.collect()} == {1: (5, "normal_name", 3), 2: (5, "name", 3), 3: (10, "created", 0)}


def test_nothing_to_sync(spark):
    none, some = table(spark, [], RECORD), table(spark, world()[1], PLAYER)
    got = sync.sync(none, some, identity_name)
    assert got.created == 0 and got.records.count() == 0 and got.players.count() == 9
    got = sync.sync(table(spark, world()[0][:1], RECORD), table(spark, [], PLAYER), identity_name)
    assert got.created == 1 and got.players.first().player_id == 1


def test_crosswalk_counts(spark):
    players = spark.createDataFrame([(1, "al", "QB", "NYJ", None), (2, "al", "QB", "DAL", "8"), (3, "bo", "WR", None, None), (4, "cy", "QB", "X", None), (5, "cy", "QB", "X", None)], "player_id int, normalized_name string, position string, nfl_team string, mfl_id string")
    rows = spark.createDataFrame([("7", "al", "QB", "NYJ"), ("8", "al", "QB", "DAL"), ("9", "al", "QB", "SEA"), ("10", "bo", "TE", None), ("11", "cy", "QB", "X"), ("12", "di", "QB", "X"), ("13", "bo", "K", None), (None, "bo", "WR", None)], "mfl_id string, normalized_name string, position string, nfl_team string")
    steps = [["normalized_name", "position", "nfl_team"], ["normalized_name", "position"], ["normalized_name"]]
    got, counts = sync.crosswalk(rows, players, steps, "mfl_id", ["QB", "RB", "WR", "TE", "FB"])
    assert {r.mfl_id: (r.player_id, r.outcome) for r in got.collect()} == {"7": (1, "matched"), "8": (2, "already_set"), "9": (None, "ambiguous"), "10": (3, "matched"), "11": (None, "ambiguous"), "12": (None, "unmatched"), "13": (None, "skipped"), None: (None, "skipped")}
    assert {r.outcome: r["count"] for r in counts.collect()} == {"matched": 2, "already_set": 1, "ambiguous": 2, "unmatched": 1, "skipped": 2}
