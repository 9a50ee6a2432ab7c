"""Readers, sinks and streams over files written here."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import adapters, files, html, sinks
from tidemark.streaming import snapshots


def test_season_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("player,games\nx,3\n")
    (tmp_path / "b.csv").write_text("player,games\nold,NA\n")
    got = files.season_csv(spark, str(tmp_path / "a.csv"), ["player", "games"], str(tmp_path / "b.csv"))
    assert {tuple(r) for r in got.collect()} == {("x", "3"), ("old", "NA")}


def test_yearly_csv_takes_the_year_from_the_name(spark, tmp_path):
    (tmp_path / "sos_2001.csv").write_text("school,sos\nA,1.5\nB,\nA,2.5\n")
    (tmp_path / "sos_2002.csv").write_text("school,sos\nA,0.5\n")
    got = files.yearly_csv(spark, str(tmp_path / "sos_*.csv"), ["school", "sos"], "sos_")
    assert {tuple(r) for r in got.collect()} == {(2001, "A", 2.5), (2002, "A", 0.5)}


def test_keyed_json_and_missing_snapshot(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"k1": {"pro": "p1", "n": 3}, "k2": {"pro": None, "n": 4}}))
    assert {tuple(r) for r in files.keyed_json(spark, str(tmp_path / "b.json"), "pro: string, n: int").collect()} == {("k1", "p1", 3), ("k2", None, 4)}
    assert files.snapshot(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"captured_at": "2024-01-01", "players": [{"id": 1, "name": "A", "position": "QB", "superflex": {"rank": 1}, "one_qb": {"rank": 2}}]}))
    r = files.snapshot(spark, str(tmp_path / "s.json")).first()
    assert (r.id, r.superflex.rank, r.one_qb.rank) == (1, 1, 2)


def test_json_arrays_leave_out_broken_files(spark, tmp_path):
    (tmp_path / "season_1.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "season_2.json").write_text('[{"a": 1')
    from pyspark.sql import types as T

    got = files.json_arrays(spark, str(tmp_path / "season_*.json"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert sorted(r.a for r in got.collect()) == [1, 2]


TABLE = """<table id="other"><tr data-append-csv="n"><td data-stat="x">0</td></tr></table>
<!-- <div><table class="t" id="stats"><thead><tr><th data-stat="player">Name</th></tr></thead><tbody>
<tr><th data-append-csv="p1" data-stat="player"><a href="/p">Ann&amp;Co</a>*+<td data-stat="x">7<td data-stat="team">2TM
<tr class="full thead"><th data-stat="x" data-append-csv="zz">X</th></tr>
<tr><th data-stat='player' data-append-csv='p2'>Bob <b>Ray</b></th><td data-stat=x>8<table id="in"><tr><td data-stat="x">9</td></tr></table></td><td data-stat="">none</td></tr>
<tr><td data-stat="x">no key</td></tr>
<tr><th data-stat="player" data-append-csv="p1">Ann&amp;Co</th><td data-stat="x">5</td><td data-stat="team_name_abbr">HOU</td></tr></tbody>
<tfoot><tr><th data-stat="player" data-append-csv="sum">All</th></tr></tfoot></table></div> -->"""


def test_html_table_and_fields(spark):
    pages = spark.createDataFrame([(1, TABLE, 1990), (2, None, 1991), (3, "<table id=stats><td data-stat=x data-append-csv=q>1</table>", 1992), (1, TABLE, 1990)], "`page.id` int, html string, year int")
    got = html.table_rows(pages, "html", "stats").collect()
    rows = sorted((r["page.id"], r.year, r.row_id, tuple(sorted(r.cells.items()))) for r in got)
    one = [("p1", (("player", "Ann&Co*+"), ("team", "2TM"), ("x", "7"))), ("p1", (("player", "Ann&Co"), ("team_name_abbr", "HOU"), ("x", "5"))), ("p2", (("player", "BobRay"), ("x", "89")))]
    assert rows == sorted([(1, 1990, *x) for x in one * 2])  # cells without a row of their own are left out
    first = html.table_rows(pages.limit(1), "html", "stats", keep_first="player").collect()
    assert sorted(r.row_id for r in first) == ["p1", "p1", "p2"]
    named = sorted(tuple(r)[:5] for r in html.season_rows(pages.limit(1), "html", "stats", "year").collect())
    assert named == [("p1", "Ann&Co", "2TM", 1990, "stats"), ("p1", "Ann&Co", "HOU", 1990, "stats"), ("p2", "BobRay", "", 1990, "stats")]
    assert html.table_rows(pages, "html", "absent").count() == 0 and html.table_rows(pages.limit(0), "html", "stats").count() == 0
    one = spark.createDataFrame([('<h1> <b>A</b> B</h1><span data-birth="1990-02-03">',)], "h string").select(html.birth_date(F.col("h")).alias("d"), html.page_title(F.col("h")).alias("t")).first()
    assert str(one.d) == "1990-02-03" and one.t == "A B"


def test_draft_class(spark):
    page = """<table id="drafts"><tbody><tr><th data-stat="draft_round">1</th><td data-stat="draft_pick">2</td><td data-stat="team">NYJ</td><td data-stat="player" data-append-csv="AbcDe00">Abc De+</td><td data-stat="pos">HB</td><td data-stat="age">21</td><td data-stat="college_id"><a>Ohio St.</a></td></tr>
    <tr class="thead"><th data-stat="draft_round">Rnd</th></tr><tr><th data-stat="draft_round">1</th><td data-stat="draft_pick"></td><td data-stat="player" data-append-csv="x">No Pick</td></tr></tbody></table>"""
    got = html.draft_rows(spark.createDataFrame([(2001, page)], "year int, html string"), "html", "year").collect()
    assert [tuple(r) for r in got] == [(2001, 1, 2, "NYJ", "AbcDe00", "Abc De", "HB", "Ohio St.", 21)]


BOARD = """<div class="mock-row nfl" data-pos="WR"><div class="mock-row-pick-number">1</div><div class="mock-row-logo"><a href="/nfl/colleges/ohio-state"><img src=x></a></div>
<div class="mock-row-player"><a href="/nfl/players/a"><div class="mock-row-name">Ann O&#39;Day</div><div class="mock-row-school-position">WR | Ohio State </div></a></div>
<div class="mock-row-measurements"><div>6&#39;3&#34;</div><div>215</div></div></div>
<div data-pos="QB" class="future nfl mock-row"><div class="mock-row-pick-number x">2029</div><div class="mock-row-logo"></div><div class="mock-row-player"><a href="/p"><div class="mock-row-name">Bob</div><div class="mock-row-school-position">QB | Iowa</div></a></div></div>
<div class="mock-row nfl future" data-pos="TE"><div class="mock-row-pick-number">soon</div><div class="mock-row-name">Cy</div><div class="mock-row-school-position">TE |</div></div>
<div class="mock-row nfl" data-pos="RB"><div class="mock-row-pick-number">-</div><div class="mock-row-name">Di</div><div class="mock-row-school-position">RB | Rice</div></div>
<div class="mock-row nfl" data-pos="WR"><div class="mock-row-pick-number">9</div><div class="mock-row-name">ANN O'DAY</div><div class="mock-row-school-position">WR | ohio state</div></div>
<div class="mock-row nfl" data-pos="WR"><div class="mock-row-pick-number">10</div></div>"""


def test_big_board(spark):
    got = html.big_board(spark.createDataFrame([("2026-01-01", BOARD), ("2026-01-02", None)], "at string, html string"), "html", 2027)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("2026-01-01", -1, "Bob", "QB", "Iowa", None, None, None, 2029),
        ("2026-01-01", -1, "Cy", "TE", None, None, None, None, 2028),
        ("2026-01-01", -1, "Di", "RB", "Rice", None, None, None, 2027),
        ("2026-01-01", 1, "Ann O'Day", "WR", "Ohio State", "ohio-state", "6'3\"", 215, 2027),
    ]


def test_elements_stand_in_their_tables(spark):
    from tidemark.sources import elements

    page = "<p>a<p>b <i>c</i><ul><li>1<li>2</ul><table><tr><td>x<table><tr><td>y</table>z<tr><td>w</table><br class=k><script>var no='<td>';</script>"
    got = elements.elements(spark.createDataFrame([(page,)], "h string"), "h", ("p", "li", "td"), ("k",)).orderBy("no").collect()
    assert [(r.tag, r.text) for r in got] == [("p", "a"), ("p", "bc"), ("li", "1"), ("li", "2"), ("td", "xyz"), ("td", "y"), ("td", "w"), ("br", None)]
    assert got[4].table_no == got[6].table_no != got[5].table_no and got[4].row_no != got[6].row_no and got[4].end_no >= got[5].no


def test_player_seasons_of_two_eras(spark, tmp_path):
    (tmp_path / "new.csv").write_text("player_id,player_name,position,season,season_type,recent_team,games,passing_yards,extra\ng1,Al, qb ,2001,,NYJ,16,NA,x\n,none,QB,2001,REG,X,1,1,x\ng2,Bo,WR,2000,POST,DAL,2.0,7.5,x\n")
    (tmp_path / "old.csv").write_text("season,player_id,player_name,position,games\n1998,p1,Al,QB,15\n1998,p9,Cy,RB,3\n")
    cross = spark.createDataFrame([("p1", "g1"), ("p9", "g9")], "old string, new string")
    got = files.player_seasons(spark, str(tmp_path / "new.csv"), str(tmp_path / "old.csv"), cross, ["games", "passing_yards"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("g1", "Al", "QB", 2001, "REG", "NYJ", 16.0, None), ("g2", "Bo", "WR", 2000, "POST", "DAL", 2.0, 7.5), ("g1", "Al", "QB", 1998, "REG", None, 15.0, None), ("p9", "Cy", "RB", 1998, "REG", None, 3.0, None)], key=str)
    assert files.player_seasons(spark, str(tmp_path / "new.csv")).count() == 2


def test_player_files_and_crosswalks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gsis_id,position,name\ng1,K,first\ng1,QB,second\ng2,K,only\n")
    (tmp_path / "b.csv").write_text("gsis_id,position,birth\ng1,LB,1990\ng3,WR,1991\n")
    got = {r.gsis_id: (r.position, r.name, r.birth) for r in files.players(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert got == {"g1": ("QB", "second", None), "g2": ("K", "only", None), "g3": ("WR", None, "1991")}
    (tmp_path / "x.csv").write_text("ktc_id,mfl_id,gsis_id,merge_name,position\n1,10,g1,al,QB\n1,11,g2,al,QB\n2,NA,NA,bo,WR\n3,,g3,,TE\n")
    maps = files.crosswalk(spark, str(tmp_path / "x.csv"))
    rows = lambda k: sorted(tuple(r) for r in maps[k].collect())
    assert rows("ktc_id") == [("1", "g2"), ("3", "g3")] and rows("mfl_id") == [("10", "g1"), ("11", "g2")] and rows("merge_name") == [("al", "QB", "g1")]
    with pytest.raises(ValueError, match="ktc_id"):
        files.crosswalk(spark, str(tmp_path / "a.csv"))


def test_combine_and_leagues(spark, tmp_path):
    (tmp_path / "c.csv").write_text("player_name,pos,ht,wt,forty\nAl,fb,6-3,230,NA\nBo,OL,6-5,300,5.1\nCy,WR,71,,4.4\nDi,TE,x-y,240,4.6\n")
    got = {r.player_name: (r.pos, r.ht, r.wt, r.forty, r.bench) for r in files.combine(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"Al": ("RB", 75.0, 230.0, None, None), "Cy": ("WR", 71.0, None, 4.4, None), "Di": ("TE", None, 240.0, 4.6, None)}
    (tmp_path / "l.json").write_text(json.dumps({"_comment": "x", "leagues": [{"platform": "mfl", "league_id": "62557", "year": 2026}, {"platform": None}]}))
    assert [tuple(r) for r in files.leagues(spark, str(tmp_path / "l.json")).collect()] == [("mfl", "62557", 2026, "sf_ppr")]


def test_page_snapshot(spark):
    page = '<script>var playersArray = [{"playerID": 7, "playerName": "A]; b", "position": "QB", "team": "NYJ", "superflexValues": {"rank": "1", "positionalRank": 2.0, "value": 9999, "overallTier": "x", "adp": "1.5", "overallTrend": -3}, "oneQBValues": null}, {"playerID": 8}]; var other = [1];</script>'
    r = files.page_snapshot(spark.createDataFrame([(page,), ("<p>none</p>",), (None,)], "h string"), "h").collect()
    assert len(r) == 1 and (r[0].id, r[0].name, r[0].superflex.rank, r[0].superflex.positional_rank, r[0].superflex.tier, r[0].superflex.adp, r[0].superflex.overall_trend, r[0].one_qb.value) == (7, "A]; b", 1, 2, None, 1.5, -3, None)


def test_settings(spark):
    from tidemark.config import Settings, settings

    assert settings(spark) == Settings()
    for k, v in (("neighbours", "7"), ("least_share", "0.25"), ("full_refresh", "Yes"), ("current_season", "2024"), ("data_dir", " "), ("unknown", "x")):
        spark.conf.set(f"tidemark.{k}", v)
    try:
        assert settings(spark, neighbours=9) == Settings(neighbours=9, least_share=0.25, full_refresh=True, current_season=2024)
        spark.conf.set("tidemark.full_refresh", "maybe")
        with pytest.raises(ValueError, match="full_refresh"):
            settings(spark)
    finally:
        for k in ("neighbours", "least_share", "full_refresh", "current_season", "data_dir", "unknown"):
            spark.conf.unset(f"tidemark.{k}")


def test_embedded_array(spark):
    pages = spark.createDataFrame([('<script>var players = [{"id": 1, "name": "A"}, {"id": 2}];</script>',)], "h string")
    assert [tuple(r) for r in files.embedded_array(pages, "h", "players", "id: int, name: string").collect()] == [(1, "A")]


def test_adapters(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"source": "s", "gsis_id": "g", "player_name": "N", "position": "QB", "team": "T", "pick": "12", "round": 1, "season": 2020}\n\n{"gsis_id": 5, "pick": "NA", "round": "x"}\n')
    adapters.register(spark)
    r, odd = spark.read.format("draft_lines").option("paths", str(tmp_path / "d.jsonl")).load().collect()
    assert (r.player_id, r.rank, r.value, r.captured_at) == ("g", 12, 1.0, "2020") and (odd.player_id, odd.rank, odd.value, odd.name) == ("5", None, None, None)
    assert set(adapters.REGISTRY) == {"ranking_lines", "draft_lines"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "captured_at string, x int")
    for _ in range(2):
        sinks.append_snapshot(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert {r.x for r in sinks.latest_part(spark, str(tmp_path / "a")).collect()} == {2}
    sinks.replace_parts(spark.createDataFrame([(1, 10), (2, 20)], "p int, x int"), str(tmp_path / "b"), "p")
    sinks.replace_parts(spark.createDataFrame([(2, 99)], "p int, x int"), str(tmp_path / "b"), "p")
    assert {(r.p, r.x) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {(1, 10), (2, 99)}
    with pytest.raises(ValueError):
        sinks.checked(df, ["y"])


def test_streams_equal_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(k, f"2024-01-{1 + k % 28:02d} 00:00:00", k % 5, "ab"[k % 2], float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "to_timestamp(ts) ts", "user_id", "event_type", "value")
    out, state = str(tmp_path / "latest"), str(tmp_path / "state")
    arriving = lambda: snapshots.arriving(spark, str(tmp_path / "in"), schema)
    keys = (["user_id"], "ts", "event_id", ["value", "event_type"])
    from tidemark.operators.consensus import latest

    def run(rows):
        """Adds rows, runs the stream anew from its checkpoint, and says how many keys came out."""
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        before = {p.name for p in (tmp_path / "latest" / "changes").glob("batch=*")} if (tmp_path / "latest").exists() else set()
        snapshots.keep_latest(arriving(), *keys, out, state).awaitTermination()
        new = [str(p) for p in (tmp_path / "latest" / "changes").glob("batch=*") if p.name not in before]
        return sum(spark.read.parquet(p).count() for p in new)

    want = lambda rows: {tuple(r) for r in latest(rows, *keys[:3], ["ts", "event_id", *keys[3]]).collect()}
    got = lambda: {tuple(r) for r in snapshots.current(spark, out, *keys).collect()}
    half = df.where("event_id < 40")
    assert run(half) == 5 and got() == want(half)
    one = df.where("event_id >= 40 and user_id = 2")
    old = half.where("user_id = 3")  # rows that were there already, and older ones
    one = one.union(one.limit(1).withColumns({"ts": F.lit("2024-02-01").cast("timestamp"), "event_id": F.lit(99).cast("long")}))
    assert run(one.union(old)) == 1 == len(want(half.union(one)) - want(half)) and got() == want(half.union(one))
    assert snapshots.compact(spark, out, *keys) >= 1 and got() == want(half.union(one))
    rest = df.where("event_id >= 40 and user_id <> 2")
    every = half.union(one).union(rest)
    assert run(rest) == len(want(every) - want(half.union(one))) and got() == want(every)
    df.withColumn("ts", F.when(F.col("event_id") == 1, None).otherwise(F.col("ts"))).where("event_id = 1").write.mode("append").parquet(str(tmp_path / "in"))
    snapshots.keep_latest(arriving(), *keys, out, state).awaitTermination()
    assert got() == want(every)
    snapshots.append(snapshots.arriving(spark, str(tmp_path / "in"), schema), str(tmp_path / "all"), str(tmp_path / "s2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 60 + len([0 for k in range(40) if k % 5 == 3]) + 2


def test_late_rows_are_passed_over(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"
    write = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "to_timestamp(ts) ts", "user_id", "value").write.mode("append").parquet(str(tmp_path / "in"))
    keys = (["user_id"], "ts", "event_id", ["value"])
    run = lambda: snapshots.keep_latest(snapshots.arriving(spark, str(tmp_path / "in"), schema), *keys, str(tmp_path / "out"), str(tmp_path / "state"), late="2 days").awaitTermination()
    write([(1, "2024-01-10 00:00:00", 1, 1.0)])
    run()
    write([(2, "2024-01-01 00:00:00", 2, 2.0), (3, "2024-01-09 00:00:00", 3, 3.0)])
    run()
    assert {r.user_id for r in snapshots.current(spark, str(tmp_path / "out"), *keys).collect()} == {1, 3}


def test_references_stay_as_written_where_they_are_not_read(spark):
    from tidemark.sources import elements, html

    page = '<h1>a &amp;&lt; b&amp</h1><a href="/x?a=1&amp;b">&nbsp;l</a><!-- <table><tr><td>&lt;c</td></tr></table> -->'
    df = spark.createDataFrame([(page,)], "h string")
    got = elements.elements(df, "h", ("h1", "a", "td"), references=False).orderBy("no").collect()
    assert [(r.text, r.attrs.get("href")) for r in got] == [("a &amp;&lt; b&amp", None), ("&nbsp;l", "/x?a=1&amp;b"), ("&lt;c", None)]
    assert [r.text for r in elements.elements(df, "h", ("h1", "td")).orderBy("no").collect()] == ["a &< b&", "<c"]
    text = spark.createDataFrame([("a &amp;&lt; b&amp",), ("&amp;lt; x ",)], "t string")
    assert [r[0] for r in text.select(html.closed_references(F.col("t"))).collect()] == ["a &< b&amp", "&lt; x"]
