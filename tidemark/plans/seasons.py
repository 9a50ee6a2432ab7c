"""First seasons, arcs, leagues and backtests bound to the commerce tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import identity_name
from ..functions.numeric import rounded
from ..operators import consensus, evaluation, reports, rookies, scoring, sync
from ..staging import staged
from . import commerce as c
from .oracles import ROSTER, SEASONS, ZRATES, with_
from .oracles import ZRATES  # isort: skip
from .prospects import CAREERS, COMPS, college_careers
from .scouting import BONUS, FACTORS, FORMS, POINTS, multiplied, query

CODES = {"AUTOMOBILE": 1.0, "BUILDING": 2.0, "FURNITURE": 3.0, "HOUSEHOLD": 4.0}
STATS = {"rushing_yards": "qty", "rushing_tds": "returns", "receiving_yards": "cents", "completion_rate": "returns"}


@query(with_(SEASONS, """
    db AS (SELECT player, min(season) AS debut FROM seasons GROUP BY 1),
    cd AS (SELECT s.*, debut FROM s JOIN db USING (player) WHERE position <> 'MACHINERY'),
    lt AS (SELECT player, sum(points) AS later, sum(points * pow(0.95::DOUBLE, k - 1)) AS disc, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) AS k FROM cd WHERE season > debut) GROUP BY 1)""",
    select="SELECT player, position, season, games, round(rate, 6) AS rate, round(games / 17.0::DOUBLE, 6) AS played, 0.0::DOUBLE AS passing_yards_pg, round(qty / games, 6) AS rushing_yards_pg, round(cents / games, 5) AS receiving_yards_pg, 0.0::DOUBLE AS passing_tds_pg, round(returns / games, 6) AS rushing_tds_pg, 0.0::DOUBLE AS receiving_tds_pg, returns::DOUBLE AS completion_rate, age, CASE position WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'BUILDING' THEN 2.0 WHEN 'FURNITURE' THEN 3.0 ELSE 4.0 END::DOUBLE AS position_code, coalesce(later, 0.0) AS later, round(coalesce(disc, 0)::DECIMAL(30, 9), 4)::DOUBLE AS later_discounted, coalesce(n, 0) AS later_seasons FROM cd LEFT JOIN lt USING (player) WHERE season = debut AND debut >= 1993 AND season <> 1998"))
def rookie_corpus(spark, sf_dir):
    """The year of the first order is the debut, whether or not it is a whole season."""
    debuts = c.seasons(spark, sf_dir).groupBy("player").agg(F.min("season").alias("debut"))
    r = rookies.corpus(c.played(spark, sf_dir), debuts, STATS, CODES, first_season=1993, left_out=[1998])
    return c._round(r.withColumn("later_discounted", rounded("later_discounted", 4)), rate=6, played=6, rushing_yards_pg=6, receiving_yards_pg=5, rushing_tds_pg=6)


CATEGORIES = {"volume": ("qty",), "scoring": ("returns",)}


@query(with_(SEASONS, FACTORS, FORMS, "x AS (SELECT player, season, format, unnest(['volume', 'scoring']) AS category, unnest([qty * fq * kq, returns * fr * kr + CASE WHEN position = 'BUILDING' THEN games * bonus ELSE 0 END]) AS points FROM fa, fo)", select="SELECT player, season, format, category, round(points::DECIMAL(30, 9), 4)::DOUBLE AS points FROM x WHERE points <> 0"))
def category_points(spark, sf_dir):
    r = scoring.by_category(multiplied(spark, sf_dir), POINTS, CATEGORIES, BONUS, "scoring")
    return r.withColumn("points", rounded("points", 4))


ARCS = """
ax AS (SELECT player, season, age, games, format, qty * fq * kq + returns * fr * kr + CASE WHEN position = 'BUILDING' THEN games * bonus ELSE 0 END AS total FROM fa, fo),
ay AS (SELECT * FROM ax UNION ALL SELECT player, season, age, games, '2qb', total FROM ax WHERE format = 'sf'),
ar AS (SELECT *, sum(total) OVER w / sum(games) OVER w AS r FROM ay WINDOW w AS (PARTITION BY player, format ORDER BY season ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""


@query(with_(SEASONS, FACTORS, FORMS, ARCS, select="SELECT player, format, count(*) AS n_seasons, min(age) AS first_age, round(sum(total)::DECIMAL(30, 9), 4)::DOUBLE AS career_total, round(max(total / greatest(games, 1))::DECIMAL(30, 9), 4)::DOUBLE AS peak_season, round(greatest(max(r), 0)::DECIMAL(30, 9), 4)::DOUBLE AS peak_3, round((sum(total) / sum(games))::DECIMAL(30, 9), 4)::DOUBLE AS career_mean FROM ar GROUP BY 1, 2"))
def career_arcs(spark, sf_dir):
    points = scoring.aliased(scoring.scored(multiplied(spark, sf_dir), POINTS, BONUS), {"2qb": "sf"})
    a = scoring.arcs(points)
    return a.select("player", "format", F.size("seasons").cast("long").alias("n_seasons"), F.element_at("seasons", 1)["age"].alias("first_age"), *(rounded(x, 4).alias(x) for x in ("career_total", "peak_season", "peak_3", "career_mean")))


@query(with_(SEASONS, FACTORS, FORMS, ARCS, "p AS (SELECT player, season, max(round(total, 6)) FILTER (format = 'std') AS total_a, max(round(total, 6)) FILTER (format = 'half') AS total_b FROM ay GROUP BY 1, 2)", select="SELECT * FROM p WHERE total_a IS DISTINCT FROM total_b"))
def formats_that_differ(spark, sf_dir):
    """Seasons that two formats value differently; of a format and its alias there are none."""
    points = scoring.aliased(scoring.scored(multiplied(spark, sf_dir), POINTS, BONUS), {"2qb": "sf"})
    return scoring.same_formats(points, "std", "half").union(scoring.same_formats(points, "sf", "2qb"))


LEAGUES = "lg AS (SELECT n_regionkey AS league, c_nationkey AS team, c_custkey AS player, c_mktsegment AS position FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _leagues(spark, sf_dir):
    n = c.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("league"))
    return c._roster(spark, sf_dir)[0].join(n, "team")


@query(with_(SEASONS, ROSTER, LEAGUES, "g AS (SELECT league, team, count(*) AS players, count(score) AS rated, sum(coalesce(score, 0)) AS total FROM lg LEFT JOIN sc USING (player) GROUP BY 1, 2)", select="SELECT *, round(CASE WHEN rated > 0 THEN total / rated ELSE 0 END, 5) AS mean_score, row_number() OVER (PARTITION BY league ORDER BY total DESC, team) AS power_rank, round(total - avg(total) OVER (PARTITION BY league), 4) AS above_mean FROM g"))
def leagues_report(spark, sf_dir):
    """Regions are leagues, their nations teams."""
    return c._round(reports.league_report(_leagues(spark, sf_dir), c._roster(spark, sf_dir)[1], by=["league"]), mean_score=5, above_mean=4)


@query(with_(SEASONS, ROSTER, LEAGUES, """
    sd AS (SELECT DISTINCT l_orderkey AS trade, s_nationkey AS team, l_partkey % (SELECT count(*) FROM customer) + 1 AS player FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    gt AS (SELECT trade, team, sum(coalesce(score, 0)) AS received FROM sd LEFT JOIN sc USING (player) GROUP BY 1, 2),
    dl AS (SELECT team, received * 2 - sum(received) OVER (PARTITION BY trade) AS delta FROM gt),
    d AS (SELECT c_nationkey AS team, count(*) AS n_picks, avg(score - CASE WHEN o_orderkey % 300 <= 0 THEN 100.0::DOUBLE WHEN o_orderkey % 300 > 250 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1 - (o_orderkey % 300 - 1) / 250.0::DOUBLE) END) AS draft_delta FROM orders JOIN sc ON player = o_custkey JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    t AS (SELECT team, count(*) AS n_trades, sum(delta) AS trade_delta FROM dl GROUP BY 1),
    g AS (SELECT n_regionkey AS league, n_nationkey AS team, coalesce(n_picks, 0) AS n_picks, coalesce(n_trades, 0) AS n_trades, draft_delta, trade_delta FROM nation LEFT JOIN d ON d.team = n_nationkey LEFT JOIN t ON t.team = n_nationkey),
    z AS (SELECT *, CASE WHEN draft_delta IS NULL OR count(draft_delta) OVER w < 2 THEN 0 ELSE (draft_delta - avg(draft_delta) OVER w) / CASE WHEN stddev_pop(draft_delta) OVER w = 0 THEN 1 ELSE stddev_pop(draft_delta) OVER w END END AS z_draft,
                 CASE WHEN trade_delta IS NULL OR count(trade_delta) OVER w < 2 THEN 0 ELSE (trade_delta - avg(trade_delta) OVER w) / CASE WHEN stddev_pop(trade_delta) OVER w = 0 THEN 1 ELSE stddev_pop(trade_delta) OVER w END END AS z_trade FROM g WINDOW w AS (PARTITION BY league))""",
    select="SELECT league, team, n_picks, n_trades, round(coalesce(draft_delta, 0), 4) AS draft_delta, round(coalesce(trade_delta, 0), 4) AS trade_delta, round(z_draft, 5) AS z_draft, round(z_trade, 5) AS z_trade, round((z_draft + z_trade) / 2, 5) AS skill, row_number() OVER (PARTITION BY league ORDER BY round((z_draft + z_trade) / 2, 9) DESC, team) AS skill_rank FROM z"))
def managers_by_league(spark, sf_dir):
    """Nations are teams of their region's league: their customers are picked, their suppliers trade."""
    n = c.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("league"))
    scores = staged(c._roster(spark, sf_dir)[1], "scores")
    home = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_nationkey").alias("team"))
    picks = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 300).alias("pick")).join(home, "player").join(n, "team")
    sellers = c.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"))
    many = c.table(spark, sf_dir, "customer").count()
    sides = c.table(spark, sf_dir, "lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("trade"), "team", (F.col("l_partkey") % many + 1).alias("player")).distinct()
    r = reports.manager_report(n, picks, consensus.trade_deltas(sides, scores).join(n, "team"), scores, by=["league"])
    return c._round(r.select("league", "team", "n_picks", "n_trades", "draft_delta", "trade_delta", "z_draft", "z_trade", "skill", "skill_rank"), draft_delta=4, trade_delta=4, z_draft=5, z_trade=5, skill=5)


BACKTEST = f"""
lt AS (SELECT player, sum(points) AS late, count(*) AS seasons, max(rate) AS best FROM s WHERE season > {c.CUT} GROUP BY 1),
bk AS (SELECT player, comp, distance FROM ck),
pj AS (SELECT bk.player, round((sum(coalesce(l.late, 0) / (1.0::DOUBLE + distance)) / sum(1.0::DOUBLE / (1.0::DOUBLE + distance)))::DECIMAL(30, 9), 4)::DOUBLE AS projected FROM bk LEFT JOIN lt l ON l.player = bk.comp GROUP BY 1),
bt AS (SELECT cz.player, cz.position, last_season AS class, projected, late AS actual, best AS value, seasons FROM cz JOIN pj USING (player) JOIN lt ON lt.player = cz.player),
qt AS (SELECT position, quantile_cont(value, 0.8) AS e, quantile_cont(value, 0.3) AS b FROM bt GROUP BY 1),
lb AS (SELECT bt.*, CASE WHEN value >= e THEN 'elite' WHEN seasons >= 3 AND value < b THEN 'bust' ELSE 'unknown' END AS label FROM bt JOIN qt USING (position)),
t2 AS (SELECT *, row_number() OVER (ORDER BY projected DESC, player) AS place FROM lb QUALIFY place <= 200),
rr AS (SELECT rank() OVER (ORDER BY projected) + (count(*) OVER (PARTITION BY projected) - 1) / 2.0 AS x, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0 AS y FROM lb)"""


def _backtest(spark, sf_dir):
    from ..operators import careers, prospects

    s = c.played_once(spark, sf_dir)
    p = staged(college_careers(spark, sf_dir, s), "careers")
    late = careers.with_rate(s).where(f"season > {c.CUT}").groupBy("player").agg(F.sum("points").alias("actual"), F.count("*").alias("seasons"), F.max("rate").alias("value"))
    late = staged(late, "late")
    w = F.lit(1.0) / (F.lit(1.0) + F.col("distance"))
    e = prospects.similar(p, p).join(late.select(F.col("player").alias("comp"), "actual"), "comp", "left")
    projected = e.groupBy("player").agg(rounded(F.sum(F.coalesce("actual", F.lit(0.0)) * w) / F.sum(w), 4).alias("projected"))
    rows = p.select("player", "position", F.col("last_season").alias("class")).join(projected, "player").join(late, "player")
    return evaluation.class_backtest(staged(rows, "projected"))  # read twice


@query(with_(SEASONS, ZRATES, CAREERS, COMPS, BACKTEST, select="SELECT round(count(*) FILTER (place <= 50 AND label = 'elite') / greatest(count(*) FILTER (place <= 50), 1), 6) AS hit, round(count(*) FILTER (place > n - 50 AND label = 'bust') / greatest(count(*) FILTER (place > n - 50), 1), 6) AS bust, count(*) FILTER (place <= 50) AS hit_of, count(*) FILTER (place > n - 50) AS bust_of, (SELECT round(corr(x, y), 6) FROM rr) AS rho, (SELECT count(*) FROM rr) AS n_scored FROM (SELECT *, count(*) OVER () AS n FROM t2)"))
def class_backtest(spark, sf_dir):
    return c._round(_backtest(spark, sf_dir)[0], hit=6, bust=6, rho=6)


@query(with_(SEASONS, ZRATES, CAREERS, COMPS, BACKTEST, select="SELECT class, count(*) AS n_scored, count(*) FILTER (k <= 10 AND label = 'elite') AS top_elite FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY projected DESC, player) AS k FROM lb) GROUP BY 1"))
def backtest_by_class(spark, sf_dir):
    return _backtest(spark, sf_dir)[1]


SYNC = """
ex AS (SELECT c_custkey AS player_id, c_name AS gsis_id, 'p' || (c_custkey % 700) AS full_name, c_mktsegment AS position FROM customer WHERE c_acctbal >= 0),
rc AS (SELECT c_custkey AS ord, CASE WHEN c_acctbal >= 2000 OR c_acctbal < -500 THEN c_name END AS gsis_id, 'P' || (c_custkey % 900) || CASE WHEN c_acctbal < 4000 THEN ' Jr.' ELSE '' END AS full_name, c_mktsegment AS position FROM customer),
g1 AS (SELECT gsis_id, min(player_id) AS id FROM ex GROUP BY 1),
n1 AS (SELECT full_name, position, min(player_id) AS id FROM ex GROUP BY 1, 2),
n2 AS (SELECT lower(full_name) AS norm, position, min(player_id) AS id FROM ex GROUP BY 1, 2),
hit AS (SELECT rc.*, regexp_replace(lower(rc.full_name), ' jr\\.$', '') AS norm, g1.id AS a, n1.id AS b, n2.id AS c FROM rc LEFT JOIN g1 USING (gsis_id) LEFT JOIN n1 ON n1.full_name = rc.full_name AND n1.position = rc.position LEFT JOIN n2 ON n2.norm = regexp_replace(lower(rc.full_name), ' jr\\.$', '') AND n2.position = rc.position),
nw AS (SELECT norm, position, min(ord) AS first FROM hit WHERE coalesce(a, b, c) IS NULL GROUP BY 1, 2),
ni AS (SELECT *, (SELECT max(player_id) FROM ex) + row_number() OVER (ORDER BY first) AS id FROM nw)"""


@query("WITH " + SYNC.strip() + " SELECT ord, coalesce(a, b, c, ni.id) AS player_id, coalesce(a, b, c) IS NULL AND ord = first AS created FROM hit LEFT JOIN ni ON ni.norm = hit.norm AND ni.position = hit.position AND coalesce(a, b, c) IS NULL")
def identity_sync(spark, sf_dir):
    """Customers with a balance are known; all of them come again, some by phone, some by name only."""
    t = c.table(spark, sf_dir, "customer")
    known = t.where("c_acctbal >= 0").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("gsis_id"), F.concat(F.lit("p"), F.col("c_custkey") % 700).alias("full_name"), F.col("c_mktsegment").alias("position"))
    tail = F.when(F.col("c_acctbal") < 4000, " Jr.").otherwise("")
    rows = t.select(F.col("c_custkey").alias("order"), F.when((F.col("c_acctbal") >= 2000) | (F.col("c_acctbal") < -500), F.col("c_name")).alias("gsis_id"), F.concat(F.lit("P"), F.col("c_custkey") % 900, tail).alias("full_name"), F.col("c_mktsegment").alias("position"))
    got = sync.sync(rows, known, identity_name)
    return got.records.select(F.col("order").alias("ord"), F.col("player_id").cast("long"), (F.col("step") == "created").alias("created"))
