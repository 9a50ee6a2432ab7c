"""More operators bound to the commerce tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, rules
from ..functions.numeric import rounded
from ..operators import careers, ranking, reports, scoring, scouting, similarity
from ..staging import staged
from . import commerce as c
from .oracles import EDGES, ERA, ORACLES, PAIRS, ROSTER, SEASONS, TIER, TRADES, with_


def query(sql: str) -> Callable[[c.Query], c.Query]:
    def add(f: c.Query) -> c.Query:
        ORACLES["q_" + f.__name__] = sql
        return c.query(f)

    return add


FALLBACK = {("BUILDING", "qty", 1): 1.25, ("BUILDING", "returns", 1): 0.85, ("MACHINERY", "qty", 1): 1.4}
POINTS = {name: {"qty": kq, "returns": kr} for name, (kq, kr, _) in c.FORMATS.items()}
BONUS = {name: ("BUILDING", "games", k) for name, (_, _, k) in c.FORMATS.items() if k}
FACTORS = f"""
l AS (SELECT position, {ERA.format("season")} AS era, unnest(['qty', 'returns']) AS stat, unnest([qty::DOUBLE / games, returns::DOUBLE / games]) AS x FROM s),
md AS (SELECT position, stat, era, median(x) AS med FROM l GROUP BY 1, 2, 3),
mt AS (SELECT md.position, md.stat, md.era, CASE WHEN md.med <= 1e-6 OR b.med IS NULL THEN 1.0 ELSE least(2.0, greatest(0.6, b.med / md.med)) END AS m FROM md LEFT JOIN md b ON b.position = md.position AND b.stat = md.stat AND b.era = 4 WHERE md.era > 1),
se AS (SELECT *, {ERA.format("season")} AS era FROM s),
fa AS (SELECT se.*, coalesce(q.m, CASE WHEN se.era = 1 AND se.position = 'BUILDING' THEN 1.25 WHEN se.era = 1 AND se.position = 'MACHINERY' THEN 1.4 END, 1.0)::DOUBLE AS fq, coalesce(r.m, CASE WHEN se.era = 1 AND se.position = 'BUILDING' THEN 0.85 END, 1.0)::DOUBLE AS fr
       FROM se LEFT JOIN mt q ON q.position = se.position AND q.era = se.era AND q.stat = 'qty' LEFT JOIN mt r ON r.position = se.position AND r.era = se.era AND r.stat = 'returns')"""
FORMS = "fo(format, kq, kr, bonus) AS (VALUES ('std', 2.0::DOUBLE, 15.0::DOUBLE, 0.0::DOUBLE), ('ppr', 3.0, 15.0, 0.0), ('half', 2.5, 15.0, 0.0), ('sf', 2.0, 10.0, 5.0), ('deep', 1.0, 20.0, 5.0), ('flat', 1.0, 1.0, 0.0))"


def multiplied(spark, sf_dir) -> DataFrame:
    """Seasons with each stat's factor; the first era has none of its own and falls back."""
    s = c.played(spark, sf_dir).withColumn("era", rules.era("season", c.ERA_ENDS))
    table = careers.era_ratios(s, ["qty", "returns"]).where("era > 1")
    return scoring.era_multiplied(s, table, ["qty", "returns"], FALLBACK).withColumn("games_factor", F.lit(1.0))


@query(with_(SEASONS, FACTORS, FORMS, "x AS (SELECT player, season, games, format, qty * fq * kq + returns * fr * kr + CASE WHEN position = 'BUILDING' THEN games * bonus ELSE 0 END AS total FROM fa, fo)", select="SELECT player, season, format, round(total::DECIMAL(30, 9), 4)::DOUBLE AS total, round((total / greatest(games, 1))::DECIMAL(30, 9), 4)::DOUBLE AS per_game FROM x"))
def era_points(spark, sf_dir):
    x = scoring.scored(multiplied(spark, sf_dir), POINTS, BONUS)
    return x.select("player", "season", "format", rounded("total", 4).alias("total"), rounded("per_game", 4).alias("per_game"))


@query(with_(SEASONS, FACTORS, select="SELECT player, season, 'qty' AS stat, qty::DOUBLE AS raw, round(fq, 6) AS multiplier, round(qty * fq, 5) AS adjusted FROM fa WHERE qty <> 0 UNION ALL SELECT player, season, 'returns', returns::DOUBLE, round(fr, 6), round(returns * fr, 5) FROM fa WHERE returns <> 0"))
def era_diagnostic(spark, sf_dir):
    return c._round(scoring.diagnostic(multiplied(spark, sf_dir), ["qty", "returns"]), multiplier=6, adjusted=5)


STYLE = "CASE WHEN position <> 'MACHINERY' OR per < 1.2 THEN 'pocket' WHEN per < 1.5 THEN 'mobile' ELSE 'dual' END"
LIFTED = f"""
ag AS (SELECT player, position, sum(returns) * 5.0::DOUBLE / sum(games) AS per, sum(points) AS total, max(age) AS age, sum(points) FILTER (season = last) AS pl, sum(games) FILTER (season = last) AS gl FROM (SELECT *, max(season) OVER (PARTITION BY player) AS last FROM s) GROUP BY 1, 2),
rc AS (SELECT player, sum(points) FILTER (k <= 2) / sum(games) FILTER (k <= 2) AS recent2, sum(points) FILTER (k <= 3) / sum(games) FILTER (k <= 3) AS recent3, max(rate) FILTER (k = 1) AS recent1 FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season DESC) AS k FROM s) GROUP BY 1),
p3 AS (SELECT player, greatest(max(r), 0) AS peak3 FROM (SELECT player, sum(points) OVER w / sum(games) OVER w AS r FROM s WINDOW w AS (PARTITION BY player ORDER BY season ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY 1),
ga AS (SELECT *, {STYLE} AS style, coalesce({STYLE} <> 'pocket' AND age >= 27 AND peak3 > 0 AND recent2 < peak3 * 0.85::DOUBLE, false) AS gate FROM ag JOIN rc USING (player) JOIN p3 USING (player)),
lf AS (SELECT *, CASE WHEN gate THEN 1.0::DOUBLE WHEN style = 'dual' THEN 1.1::DOUBLE WHEN style = 'mobile' THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS lift_points, CASE WHEN gate THEN 1.0::DOUBLE WHEN style = 'dual' THEN 1.4::DOUBLE WHEN style = 'mobile' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS lift_years FROM ga)"""
BANDS = {"MACHINERY": (0.65, 0.85), "BUILDING": (0.5, 0.75)}


def forms(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    """One row a career: style, rates and lifts."""
    s = c.played_once(spark, sf_dir) if s is None else s
    g = s.groupBy("player", "position").agg((F.sum("returns") * 5.0 / F.sum("games")).alias("per"), F.sum("points").alias("total"), F.max("age").alias("age"))
    g = g.join(careers.recent(s, 1), "player").join(careers.recent(s, 2), "player").join(careers.recent(s, 3), "player").join(careers.peak3(s), "player")
    style = F.when((F.col("position") != "MACHINERY") | (F.col("per") < 1.2), "pocket").when(F.col("per") < 1.5, "mobile").otherwise("dual")
    g = g.withColumn("style", style)
    points, years, gate = scoring.lifts(F.col("style"), F.col("age"), F.col("recent2"), F.col("peak3"), {"pocket": 1.0, "mobile": 1.2, "dual": 1.4}, {"pocket": 1.0, "mobile": 1.05, "dual": 1.10})
    return g.withColumns({"lift_points": points, "lift_years": years, "gate": gate})


@query(with_(SEASONS, LIFTED, select="SELECT player, position, style, gate, lift_points, lift_years, round(greatest(total, total * lift_points), 4) AS lifted, 4.0::DOUBLE + CASE WHEN position = 'BUILDING' AND age >= 30 AND recent1 >= 16 THEN 1 ELSE 0 END AS years FROM lf"))
def decline_gate(spark, sf_dir):
    g = forms(spark, sf_dir)
    years = scoring.late_runner(F.lit(4.0), F.col("position"), F.col("age"), F.col("recent1"), "BUILDING")
    return c._round(g.select("player", "position", "style", "gate", "lift_points", "lift_years", rules.one_way_lift(F.col("total"), F.col("lift_points")).alias("lifted"), years.alias("years")), lifted=4)


@query(with_(SEASONS, LIFTED, "b AS (SELECT *, CASE position WHEN 'MACHINERY' THEN 0.65::DOUBLE WHEN 'BUILDING' THEN 0.5::DOUBLE ELSE 0.55::DOUBLE END AS lo, CASE position WHEN 'MACHINERY' THEN 0.85::DOUBLE WHEN 'BUILDING' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END AS hi, greatest(0.0::DOUBLE, 31 - age)::DOUBLE AS yrs, CASE WHEN recent2 <= 0 THEN recent3 ELSE recent2 END AS r FROM lf)", select="SELECT player, round(total * least(1.0::DOUBLE, greatest(0.0::DOUBLE, yrs / 6.0::DOUBLE)) * CASE WHEN peak3 > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (r / peak3 - lo) / (hi - lo))) ELSE 1 END + r * 17.0::DOUBLE * least(yrs, 3.0::DOUBLE) * 0.9::DOUBLE, 3) AS floor FROM b"))
def proven_floor(spark, sf_dir):
    years = F.greatest(F.lit(0.0), (F.lit(31) - F.col("age")).cast("double"))
    floor = scoring.proven_floor(F.col("total"), F.col("recent2"), F.col("recent3"), F.col("peak3"), years, F.col("position"), BANDS)
    return c._round(forms(spark, sf_dir).select("player", floor.alias("floor")), floor=3)


RECORDS = "ca AS (SELECT player AS comp, max(age) AS final_age, count(*) AS seasons, max(season) AS last_season FROM s GROUP BY 1), rec AS (SELECT t.player, comp, rank, round(sim, 3) AS similarity, comp_age, final_age, seasons, last_season < 2000 AND final_age <= 30 AND seasons < 8 AS washed_out FROM top t JOIN ca USING (comp))"


def records(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    s = c.played_once(spark, sf_dir) if s is None else s
    comps = s.groupBy(F.col("player").alias("comp")).agg(F.max("age").alias("final_age"), F.count("*").alias("seasons"), F.max("season").alias("last_season"))
    return scoring.comp_records(c.edges(spark, sf_dir, s), comps, c.CURRENT)


@query(with_(SEASONS, EDGES, RECORDS, select="SELECT * FROM rec"))
def comp_records(spark, sf_dir):
    return records(spark, sf_dir)


OVERLAY = {k: POINTS[k] for k in ("std", "deep")}


@query(with_(SEASONS, EDGES, RECORDS, LIFTED, """
    of(format, kq, kr) AS (VALUES ('std', 2.0::DOUBLE, 15.0::DOUBLE), ('deep', 1.0, 20.0)),
    sp AS (SELECT player, position, season, age, games, format, qty * kq + returns * kr AS pts FROM s, of),
    fx AS (SELECT a.player AS comp, a.age AS comp_age, a.format, b.pts, row_number() OVER (PARTITION BY a.player, a.age, a.format ORDER BY b.season) - 1 AS n FROM sp a JOIN sp b ON a.player = b.player AND a.format = b.format AND b.age > a.age),
    fu AS (SELECT comp, comp_age, format, sum(pts * pow(0.95::DOUBLE, n)) AS fp, count(*) AS fs FROM fx GROUP BY 1, 2, 3),
    cmf AS (SELECT rec.player, of.format, sum(similarity * coalesce(fp, 0)) / CASE WHEN sum(similarity) = 0 THEN 1 ELSE sum(similarity) END AS comp_mean, sum(similarity * coalesce(fs, 0)) / CASE WHEN sum(similarity) = 0 THEN 1 ELSE sum(similarity) END AS years, count(*) AS n_comps
            FROM rec CROSS JOIN of LEFT JOIN fu ON fu.comp = rec.comp AND fu.comp_age = rec.comp_age AND fu.format = of.format GROUP BY 1, 2),
    rf AS (SELECT player, format, sum(pts) FILTER (k <= 3) / sum(games) FILTER (k <= 3) AS recent3 FROM (SELECT *, row_number() OVER (PARTITION BY player, format ORDER BY season DESC) AS k FROM sp) GROUP BY 1, 2),
    pf AS (SELECT player, format, greatest(max(r), 0) AS peak3 FROM (SELECT player, format, sum(pts) OVER w / sum(games) OVER w AS r FROM sp WINDOW w AS (PARTITION BY player, format ORDER BY season ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY 1, 2),
    o1 AS (SELECT lf.player, lf.position, format, comp_mean, pf.peak3, lift_points, CASE WHEN years > 0 AND greatest(1.1::DOUBLE * rf.recent3, 0.9::DOUBLE * pf.peak3) > 0 AND n_comps >= 3 THEN greatest(1.1::DOUBLE * rf.recent3, 0.9::DOUBLE * pf.peak3) * 17.0::DOUBLE * years * pow(0.95::DOUBLE, years / 2.0::DOUBLE) ELSE 0 END AS anchor
           FROM cmf JOIN rf USING (player, format) JOIN pf USING (player, format) JOIN lf USING (player)),
    o2 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (peak3 - (60.0::DOUBLE - 5.0::DOUBLE)) / 5.0::DOUBLE)) AS share FROM o1)""",
    select="SELECT player, format, round(comp_mean::DECIMAL(30, 8), 3)::DOUBLE AS comp_mean, round(anchor::DECIMAL(30, 8), 3)::DOUBLE AS anchor, round((CASE WHEN lift_points <= 1 THEN mixed ELSE greatest(mixed, mixed * lift_points) END)::DECIMAL(30, 6), 1)::DOUBLE AS score FROM (SELECT *, (1.0::DOUBLE - share) * comp_mean + share * greatest(comp_mean, anchor) AS mixed FROM o2)"))
def format_overlay(spark, sf_dir):
    once = c.played_once(spark, sf_dir)
    s = scoring.scored(once, OVERLAY, adjusted=False).select("player", "position", "season", "age", "games", "format", F.col("total").alias("points"))
    s = staged(s.withColumn("who", F.struct("player", "format")), "formats")
    keyed = s.withColumn("player", F.col("who"))
    rates = careers.recent(keyed, 3).join(careers.peak3(keyed), "player").select("player.*", "recent3", "peak3")
    ahead = careers.discounted_after(keyed, keyed.select("player", F.col("age").alias("snapshot_age")))
    futures = ahead.select(F.col("player.player").alias("comp"), F.col("player.format").alias("format"), F.col("snapshot_age").alias("comp_age"), "future_points", "future_seasons")
    lifts = forms(spark, sf_dir, once).select("player", "position", F.col("lift_points").alias("lift"))
    o = scoring.overlay(rates.join(lifts, "player"), records(spark, sf_dir, once), futures, {}, bar=60.0)
    return o.select("player", "format", rounded("comp_mean", 3).alias("comp_mean"), rounded("anchor", 3).alias("anchor"), "score")


@query(with_(SEASONS, EDGES, "pl AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY raw_sim DESC, comp) AS place FROM edges QUALIFY place <= 25), x AS (SELECT player, comp, rank FROM top EXCEPT SELECT player, comp, place FROM pl), y AS (SELECT player, comp, place FROM pl EXCEPT SELECT player, comp, rank FROM top)", select="SELECT player, count(*) FILTER (k = 'a') AS only_a, count(*) FILTER (k = 'b') AS only_b FROM (SELECT player, 'a' AS k FROM x UNION ALL SELECT player, 'b' FROM y) GROUP BY 1"))
def comps_ab(spark, sf_dir):
    targets, pool = c.targets_and_pool(spark, sf_dir)
    a, b = (e.select("player", "comp", "rank") for e in similarity.neighbours_by(targets, pool, None, [1996, None]))
    return reports.differences(a, b, "player")


@query(with_(SEASONS, select="SELECT player, CASE WHEN count(*) = 1 AND min(season) >= 2000 THEN 'rookie' ELSE 'cumulative' END AS engine FROM s GROUP BY 1"))
def engine_dispatch(spark, sf_dir):
    from ..operators import rookies

    r = careers.rollup(c.played(spark, sf_dir))
    return r.select("player", rookies.dispatched(r, c.CURRENT).alias("engine"))


@query(with_(SEASONS, select="SELECT player, round(sum(points), 2) AS career_points, count(*) AS seasons, min(season) AS first_season, max(season) AS last_season, round(avg(rate) FILTER (k <= 3), 5) AS best_rate FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rate DESC) AS k FROM s) GROUP BY 1"))
def best3_rates(spark, sf_dir):
    return c._round(scoring.best_rates(c.played(spark, sf_dir)), career_points=2, best_rate=5)


@query(with_(SEASONS, select="SELECT player, season FROM s WHERE qty >= 300 OR returns >= 5 OR games >= 12"))
def volume_qualified(spark, sf_dir):
    return c.played(spark, sf_dir).where(scouting.qualifies({"qty": 300, "returns": 5, "games": 12})).select("player", "season")


@query(with_(SEASONS, select="SELECT player, position, volume FROM (SELECT player, position, sum(CASE position WHEN 'BUILDING' THEN returns WHEN 'MACHINERY' THEN games ELSE qty END)::DOUBLE AS volume FROM s GROUP BY 1, 2) WHERE volume >= 20"))
def career_threshold(spark, sf_dir):
    return scouting.over_threshold(c.played(spark, sf_dir), {"BUILDING": "returns", "MACHINERY": "games", "AUTOMOBILE": "qty", "FURNITURE": "qty", "HOUSEHOLD": "qty"}, 20.0)


@query(with_(SEASONS, "k AS (SELECT CASE WHEN season < 1998 THEN 'old_' || player ELSE 'g' || player END AS id, season, points, player FROM s), m AS (SELECT 'old_' || c_custkey AS old, 'g' || c_custkey AS new FROM customer WHERE c_acctbal >= 0), l AS (SELECT DISTINCT 'g' || player AS id FROM s WHERE season >= 1998)", select="SELECT k.id, k.season, coalesce(l.id, k.id) AS resolved FROM k LEFT JOIN m ON m.old = k.id LEFT JOIN l ON l.id = m.new"))
def id_stitch(spark, sf_dir):
    s = c.played(spark, sf_dir)
    rows = s.select(F.when(F.col("season") < 1998, F.concat(F.lit("old_"), "player")).otherwise(F.concat(F.lit("g"), "player")).alias("id"), "season")
    known = c.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("old_"), "c_custkey").alias("old"), F.concat(F.lit("g"), "c_custkey").alias("new"))
    return scouting.stitched(rows, known, rows.where("season >= 1998"), "id")


@query("WITH m AS (SELECT CASE WHEN c_acctbal < 0 THEN 'x' || (c_custkey + 1) ELSE c_custkey::VARCHAR END AS id, c_name FROM customer) SELECT id, c_name FROM m UNION ALL SELECT 'x' || id, c_name FROM m WHERE 'x' || id NOT IN (SELECT id FROM m)")
def synthetic_keys(spark, sf_dir):
    m = c.table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x"), F.col("c_custkey") + 1)).otherwise(F.col("c_custkey").cast("string")).alias("id"), "c_name")
    return scouting.synthetic_keys(m, "id", "x")


@query("WITH o AS (SELECT o_custkey AS id, max(strftime(o_orderdate, '%Y-%m-%d')) AS d FROM orders GROUP BY 1), b AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 3000 THEN '1970-01-02' WHEN c_acctbal > 0 THEN '1970' END AS d FROM customer) SELECT b.id, CASE WHEN length(b.d) >= 10 THEN b.d ELSE coalesce(o.d, b.d) END AS birth FROM b LEFT JOIN o ON o.id = b.id")
def birth_overlay(spark, sf_dir):
    over = c.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("birth"))
    base = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 3000, "1970-01-02").when(F.col("c_acctbal") > 0, "1970").alias("birth"))
    return scouting.overlaid_dates(base, over, "id", "birth")


@query(with_(SEASONS, "a AS (SELECT player, season, CASE WHEN games > 6 THEN qty END AS qty, returns, position FROM s WHERE season <= 1998), b AS (SELECT player, season, qty * 2 AS qty, returns + 1 AS returns, CASE WHEN games > 8 THEN lower(position) END AS position FROM s WHERE season >= 1997)", select="SELECT coalesce(a.player, b.player) AS player, coalesce(a.season, b.season) AS season, coalesce(a.qty, b.qty) AS qty, coalesce(a.returns, b.returns) AS returns, coalesce(b.position, a.position) AS position FROM a FULL JOIN b ON a.player = b.player AND a.season = b.season"))
def page_overlay(spark, sf_dir):
    s = c.played(spark, sf_dir)
    a = s.where("season <= 1998").select("player", "season", F.when(F.col("games") > 6, F.col("qty")).alias("qty"), "returns", "position")
    b = s.where("season >= 1997").select("player", "season", (F.col("qty") * 2).alias("qty"), (F.col("returns") + 1).alias("returns"), F.when(F.col("games") > 8, F.lower("position")).alias("position"))
    return scouting.overlaid_pages(a, b, ["player", "season"], ["qty", "returns"], "position")


PEOPLE = "pe AS (SELECT c_custkey AS id, 'p' || (c_custkey % 700) AS name, c_mktsegment AS position, n_name AS school FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def people(spark, sf_dir) -> DataFrame:
    n = c.table(spark, sf_dir, "nation")
    cust = c.table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return cust.select(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), F.col("c_custkey") % 700).alias("name"), F.col("c_mktsegment").alias("position"), F.col("n_name").alias("school"))


@query("WITH " + PEOPLE + ", k AS (SELECT *, count(*) OVER (PARTITION BY name, position) AS n FROM pe), h AS (SELECT a.id, min(k.id) AS hit FROM pe a JOIN k ON k.name = a.name AND k.position = a.position WHERE k.n = 1 OR contains(lower(k.school) || ' university', lower(a.school)) GROUP BY 1) SELECT pe.id, pe.name, pe.position, pe.school, hit AS resolved FROM pe LEFT JOIN h ON h.id = pe.id")
def name_bridge(spark, sf_dir):
    p = people(spark, sf_dir)
    found = p.select("name", "position", F.col("id").alias("gid"), F.concat("school", F.lit(" University")).alias("college"), F.col("id").alias("seq"))
    return scouting.name_bridge(p, found, ["name", "position"], "school", "college", "gid", "seq")


@query(with_(SEASONS, "a AS (SELECT player AS row_id, position, max(season) AS season FROM s GROUP BY 1, 2), b AS (SELECT DISTINCT position, first FROM (SELECT player, position, min(season) AS first FROM s GROUP BY 1, 2)), r AS (SELECT row_id, a.position, min(abs(season - first)) <= 2 AS hit FROM a JOIN b USING (position) GROUP BY 1, 2)", select="SELECT position, count(*) AS n, round(avg(hit::INT), 6) AS covered FROM r GROUP BY 1"))
def bridge_coverage(spark, sf_dir):
    found = c.nearest_season(spark, sf_dir).join(c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("position")), "row_id")
    return c._round(scouting.coverage(found, "found", ["position"]), covered=6)


PICKS = "pk AS (SELECT id AS pick, name, position, 1996 + id % 9 AS year FROM pe)"


def picks(spark, sf_dir) -> DataFrame:
    return people(spark, sf_dir).select(F.col("id").alias("pick"), "name", "position", (F.lit(1996) + F.col("id") % 9).alias("year"))


@query(with_(SEASONS, PEOPLE, PICKS, "co AS (SELECT name, s.position, player, max(season) AS last_season FROM s JOIN pe ON id = player GROUP BY 1, 2, 3), m AS (SELECT pick, player, row_number() OVER (PARTITION BY pick ORDER BY abs(last_season - (year - 1)), last_season DESC, player) AS k FROM pk JOIN co USING (name, position) WHERE abs(last_season - (year - 1)) <= 2)", select="SELECT pk.*, player AS matched, player IS NOT NULL AS corpus_match FROM pk LEFT JOIN m ON m.pick = pk.pick AND k = 1"))
def draft_match(spark, sf_dir):
    last = c.played(spark, sf_dir).groupBy("player").agg(F.max("season").alias("last_season"))
    corpus = people(spark, sf_dir).withColumnRenamed("id", "player").join(last, "player")
    return scouting.draft_match(picks(spark, sf_dir), corpus, ["name", "position"])


@query("WITH " + PEOPLE + ", " + PICKS + ", l AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY name, position ORDER BY year DESC, pick DESC) = 1) SELECT pe.id, pe.name, pe.position, 1996 + pe.id % 9 AS class_year, CASE WHEN l.year = 1996 + pe.id % 9 THEN l.pick END AS pick FROM pe LEFT JOIN l USING (name, position)")
def draft_enrich(spark, sf_dir):
    rows = people(spark, sf_dir).select("id", "name", "position", (F.lit(1996) + F.col("id") % 9).alias("class_year"))
    return scouting.draft_enrich(rows, picks(spark, sf_dir), ["name", "position"], "class_year", ["pick"])


@query(with_(SEASONS, PEOPLE, "x AS (SELECT id, 1996 + id % 9 AS class_year, CASE WHEN id % 3 > 0 THEN id % 97 END AS pick, coalesce(sum(points), 0) AS score, name FROM pe LEFT JOIN s ON player = id GROUP BY ALL)", select="SELECT id, class_year, row_number() OVER (PARTITION BY class_year ORDER BY pick NULLS LAST, score DESC, name || '-' || id) AS place FROM x"))
def class_order(spark, sf_dir):
    score = careers.rollup(c.played(spark, sf_dir)).select(F.col("player").alias("id"), "career_points")
    rows = people(spark, sf_dir).join(score, "id", "left").select("id", (F.lit(1996) + F.col("id") % 9).alias("class_year"), F.when(F.col("id") % 3 > 0, F.col("id") % 97).alias("pick"), F.coalesce("career_points", F.lit(0.0)).alias("score"), F.concat_ws("-", "name", "id").alias("name"))
    return scouting.class_order(rows, "class_year", "pick", "score", "name").select("id", "class_year", "place")


@query(with_(SEASONS, "t AS (SELECT player, 0 AS tier, season FROM s WHERE games >= 15 UNION ALL SELECT player, 1, season FROM s WHERE returns >= 6 UNION ALL SELECT player, 2, season FROM s WHERE qty >= 100), o AS (SELECT player, min({'a': tier, 'b': season}) AS f FROM t GROUP BY 1)", select="SELECT player, f.a AS tier, f.b AS season FROM o ORDER BY f.a, f.b, player LIMIT 100"))
def priority_order(spark, sf_dir):
    s = c.played(spark, sf_dir)
    return scouting.by_priority([s.where("games >= 15"), s.where("returns >= 6"), s.where("qty >= 100")], "player", "season", 100)


@query(with_(SEASONS, select="SELECT player, sum(points) AS first3 FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) AS k FROM s) WHERE k <= 3 GROUP BY 1"))
def first_n_sum(spark, sf_dir):
    s = c.played(spark, sf_dir).withColumn("k", F.row_number().over(careers.by_season())).where("k <= 3")
    return s.groupBy("player").agg(F.sum("points").alias("first3"))


@query("WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 10) END AS v FROM customer) SELECT c_custkey, v, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY v IS NULL ORDER BY v DESC, c_custkey) END AS place FROM x")
def ordinal_ranks(spark, sf_dir):
    x = c.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 10)).cast("double").alias("v"))
    some = ranking.ranked(x.where("v is not null"), "v", "c_custkey", out="place")
    return some.union(x.where("v is null").withColumn("place", F.lit(None).cast("long")))


COLLEGE = {"pass_yds": "cents", "pass_td": "returns", "rush_yds": "qty", "rush_td": "returns", "int_thrown": "games", "rec": "games", "rec_yds": "qty", "rec_td": "returns", "games": "games"}


@query(with_(SEASONS, "g AS (SELECT *, max(season) OVER (PARTITION BY player) AS last, min(season) OVER (PARTITION BY player) AS first, ['FR', 'so ', 'JR', 'SR', '', NULL][player % 6 + 1] AS cls FROM s)", select="SELECT player, season, round(CASE WHEN position = 'BUILDING' THEN 0.04::DOUBLE * cents + 4 * returns + 0.1::DOUBLE * qty + 6 * returns - 2 * games ELSE 0.1::DOUBLE * qty + 6 * returns + games + 0.1::DOUBLE * qty + 6 * returns END / games, 5) AS points, CASE upper(trim(cls)) WHEN 'FR' THEN 19 WHEN 'SO' THEN 20 WHEN 'JR' THEN 21 WHEN 'SR' THEN 22 ELSE last - first + 19 END::DOUBLE AS age, coalesce(upper(trim(cls)) NOT IN ('FR', 'SO', 'JR', 'SR'), true) AS inferred FROM g"))
def college_seasons(spark, sf_dir):
    span = Window.partitionBy("player")
    cls = F.element_at(F.array(*(F.lit(x) for x in ("FR", "so ", "JR", "SR", "", None))), (F.col("player") % 6 + 1).cast("int"))
    g = c.played(spark, sf_dir).withColumns({"last": F.max("season").over(span), "first": F.min("season").over(span), "cls": cls})
    age, inferred = scouting.college_age(F.col("cls"), F.col("last"), F.col("first"))
    return c._round(g.select("player", "season", scouting.college_points(COLLEGE, F.col("position") == "BUILDING").alias("points"), age.alias("age"), inferred.alias("inferred")), points=5)


@query(with_(SEASONS, "t AS (SELECT player, season, qty, games, returns, list_concat(CASE WHEN qty >= 150 THEN ['passing'] ELSE [] END, CASE WHEN returns >= 1 THEN ['rushing'] ELSE [] END, CASE WHEN games >= 8 THEN ['receiving'] ELSE [] END) AS x FROM s)", select="SELECT player, season, CASE WHEN list_contains(x, 'passing') AND qty >= 250 THEN 'QB' WHEN list_contains(x, 'rushing') AND list_contains(x, 'receiving') THEN CASE WHEN games >= 2 * returns THEN 'RB' ELSE 'WR' END WHEN list_contains(x, 'rushing') THEN 'RB' WHEN list_contains(x, 'receiving') THEN 'WR' END AS position FROM t"))
def position_inferred(spark, sf_dir):
    s = c.played(spark, sf_dir)
    seen = F.array_compact(F.array(F.when(F.col("qty") >= 150, "passing"), F.when(F.col("returns") >= 1, "rushing"), F.when(F.col("games") >= 8, "receiving")))
    return s.select("player", "season", scouting.inferred_position(seen, F.floor(F.col("qty") / 5), F.col("games"), F.col("returns")).alias("position"))


LABELS = {"AUTOMOBILE": "qb/wr", "BUILDING": "FB,rb", "FURNITURE": "HB", "HOUSEHOLD": "LB te", "MACHINERY": "OL"}
SHORT = {0: "ACC(Atlantic)", 1: "MWC", 2: "Ind", 3: "Sun Belt(East)", 4: " CUSA"}


@query(with_(SEASONS, """x AS (SELECT player, CASE position WHEN 'AUTOMOBILE' THEN 'qb/wr' WHEN 'BUILDING' THEN 'FB,rb' WHEN 'FURNITURE' THEN 'HB' WHEN 'HOUSEHOLD' THEN 'LB te' WHEN 'MACHINERY' THEN 'OL' END AS raw, position, n_regionkey AS reg, sum(points) AS b, max(rate) / 3 AS peak, count(*) AS seasons FROM s JOIN nation ON n_nationkey = team GROUP BY ALL)""", select="SELECT player, CASE position WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'RB' WHEN 'HOUSEHOLD' THEN 'TE' END AS any_position, CASE position WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'RB' END AS first_position, CASE reg WHEN 0 THEN 'P5' WHEN 1 THEN 'G5_top' WHEN 2 THEN 'P5' WHEN 3 THEN 'G5_top' WHEN 4 THEN 'G5' END AS tier, CASE WHEN b >= 1800 THEN 'elite' WHEN b >= 1100 THEN 'above-avg' WHEN b >= 600 THEN 'starter' ELSE 'deep' END || ' (' || raw || ')' AS label, CASE WHEN peak >= 18 THEN 'elite' WHEN peak >= 12 THEN 'starter' WHEN seasons >= 3 AND peak < 6 THEN 'bust' ELSE 'unknown' END AS hit FROM x"))
def labels(spark, sf_dir):
    """Every career's labels: what sources write for its position and conference, what it made, its best rate."""
    of = lambda c, m: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in m.items()))
    g = careers.with_rate(c.played(spark, sf_dir)).groupBy("player", "position", "team").agg(F.sum("points").alias("b"), F.max("rate").alias("best"), F.count("*").alias("seasons"))
    n = c.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), of("n_regionkey", SHORT).alias("conf"))
    x = g.join(n, "team").withColumn("raw", of("position", LABELS))
    return x.select("player", rules.any_position(F.col("raw")).alias("any_position"), rules.first_position(F.col("raw")).alias("first_position"), rules.canonical_tier(F.col("conf")).alias("tier"), rules.comp_label(F.col("b"), F.col("raw")).alias("label"), rules.hit_label(F.col("best") / 3, F.col("seasons")).alias("hit"))


@query("WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN floor(value)::INT || '.0' ELSE '' END AS a FROM events) SELECT event_id, coalesce(CASE WHEN event_id % 3 = 1 THEN floor(value)::INT END, user_id)::INT AS first_int, year(ts) - CASE WHEN month(ts) >= 9 THEN 0 ELSE 1 END AS season, 'kind-' || regexp_replace(regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || right(event_id::VARCHAR, 6) AS slug, year(ts) - 1990 - CASE WHEN strftime(ts, '%m%d') < '0615' THEN 1 ELSE 0 END AS age FROM e")
def schema_projection(spark, sf_dir):
    e = c.table(spark, sf_dir, "events")
    e = e.withColumn("a", F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 == 1, F.concat(F.floor("value").cast("int").cast("string"), F.lit(".0"))).otherwise(""))
    return e.select("event_id", rules.first_int("a", "user_id").alias("first_int"), rules.season_of(F.col("ts")).alias("season"), names.slug(F.concat(F.lit("kind "), "event_type"), F.col("event_id")).alias("slug"), rules.age_at(F.col("ts"), F.lit("1990-06-15").cast("date")).alias("age"))


@query(with_(SEASONS, "x AS (SELECT s.team, n_regionkey, avg(points) AS strength FROM s JOIN nation ON n_nationkey = team GROUP BY 1, 2)", select="SELECT n_regionkey, round(median(strength), 5) AS med, round(stddev_pop(strength), 5) AS sd, count(*) FILTER (strength >= 250) AS strong, round(avg(strength), 5) AS mean FROM x GROUP BY 1 HAVING count(*) >= 3"))
def strength_stats(spark, sf_dir):
    n = c.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), "n_regionkey")
    x = c.played(spark, sf_dir).groupBy("team").agg(F.avg("points").alias("strength")).join(F.broadcast(n), "team")  # 25 rows
    g = x.groupBy("n_regionkey").agg(F.median("strength").alias("med"), F.stddev_pop("strength").alias("sd"), F.count_if(F.col("strength") >= 250).alias("strong"), F.avg("strength").alias("mean"), F.count("*").alias("n"))
    return c._round(g.where("n >= 3").drop("n"), med=5, sd=5, mean=5)


@query("WITH l AS (SELECT p_partkey, p_brand, unnest(['size', 'price']) AS metric, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part), w AS (SELECT *, avg(v) OVER g AS m, stddev_pop(v) OVER g AS sd, count(*) OVER g AS n FROM l WINDOW g AS (PARTITION BY p_brand, metric)) SELECT p_partkey, round(avg(CASE WHEN metric = 'size' THEN -1 ELSE 1 END * (v - m) / CASE WHEN sd <= 1e-9 OR n < 2 THEN 1 ELSE sd END) FILTER (n >= 5), 5) AS z FROM w GROUP BY 1")
def combine_z(spark, sf_dir):
    p = c.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("stack(2, 'size', cast(p_size as double), 'price', p_retailprice) as (metric, v)"))
    z = ranking.z_scores(p, "v", ["p_brand", "metric"]).join(p.groupBy("p_brand", "metric").count(), ["p_brand", "metric"])
    signed = F.when(F.col("metric") == "size", -F.col("z")).otherwise(F.col("z"))
    return z.groupBy("p_partkey").agg(F.round(F.avg(F.when(F.col("count") >= 5, signed)), 5).alias("z"))


@query(with_(SEASONS, PAIRS, "r AS (SELECT *, rank() OVER (PARTITION BY position ORDER BY early) + (count(*) OVER (PARTITION BY position, early) - 1) / 2.0 AS x, rank() OVER (PARTITION BY position ORDER BY late) + (count(*) OVER (PARTITION BY position, late) - 1) / 2.0 AS y, row_number() OVER (PARTITION BY position ORDER BY early, player) AS sr, row_number() OVER (PARTITION BY position ORDER BY late DESC, player) AS ar FROM pairs), g AS (SELECT position, count(*) AS n, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN NULL ELSE corr(x, y) END AS rho, avg(abs(sr - ar)) AS mae, CASE WHEN count(*) >= 12 THEN count(*) FILTER (sr <= 12 AND ar <= 12) / 12 END AS hit12, CASE WHEN count(*) >= 24 THEN count(*) FILTER (sr <= 24 AND ar <= 24) / 24 END AS hit24 FROM r GROUP BY 1 HAVING count(*) >= 5)", select="SELECT position, n, round(rho, 6) AS rho, round(mae, 5) AS mae, round(hit12, 6) AS hit12, round(hit24, 6) AS hit24, round(rho * rho, 6) AS r2 FROM g"))
def source_backtest(spark, sf_dir):
    return c._round(reports.source_backtest(c._ranked_pairs(spark, sf_dir), ["position"], "early", "late", "player"), rho=6, mae=5, hit12=6, hit24=6, r2=6)


@query(with_(SEASONS, "a AS (SELECT player, position, team, sum(points) AS x, max(age)::DOUBLE AS y FROM s GROUP BY 1, 2, 3)", select="SELECT position, team, round(CASE WHEN count(*) < 5 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 6) AS r, count(*) AS n FROM a GROUP BY 1, 2"))
def pearson_guard(spark, sf_dir):
    a = c.played(spark, sf_dir).groupBy("player", "position", "team").agg(F.sum("points").alias("x"), F.max("age").cast("double").alias("y"))
    return c._round(reports.pearson(a, "x", "y", ["position", "team"]), r=6)


@query(with_(SEASONS, """
    g AS (SELECT player, position, round(avg(rate), 6) AS a, round(max(rate), 6) AS b, max(age)::DOUBLE AS age, max(season) AS last_season FROM s WHERE season <= 1998 GROUP BY 1, 2),
    lt AS (SELECT player, sum(points) AS late FROM s WHERE season > 1998 GROUP BY 1),
    e AS (SELECT t.player, p.player AS comp, t.position, sqrt(0.0::DOUBLE + 1.0::DOUBLE * (t.a - p.a) * (t.a - p.a) + 0.5::DOUBLE * (t.b - p.b) * (t.b - p.b) + 4.0::DOUBLE * (t.age - p.age) * (t.age - p.age)) AS distance FROM g t JOIN g p ON t.position = p.position AND p.last_season < t.last_season),
    k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY distance, comp) AS rank FROM e QUALIFY rank <= 10),
    pj AS (SELECT k.player, position, round(sum(coalesce(c.late, 0) / (1.0::DOUBLE + distance)) / sum(1.0::DOUBLE / (1.0::DOUBLE + distance)), 6) AS projected FROM k LEFT JOIN lt c ON c.player = k.comp GROUP BY 1, 2),
    pa AS (SELECT pj.player, position, projected, coalesce(late, 0) AS actual FROM pj LEFT JOIN lt USING (player)),
    r AS (SELECT position, rank() OVER (PARTITION BY position ORDER BY projected) + (count(*) OVER (PARTITION BY position, projected) - 1) / 2.0 AS x, rank() OVER (PARTITION BY position ORDER BY actual) + (count(*) OVER (PARTITION BY position, actual) - 1) / 2.0 AS y FROM pa)""",
    select="SELECT position, round(CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 5) AS rho, count(*) AS n FROM r GROUP BY 1"))
def holdout_backtest(spark, sf_dir):
    from ..operators import evaluation

    s = careers.with_rate(c.played_once(spark, sf_dir))
    g = s.where(f"season <= {c.CUT}").groupBy("player", "position").agg(F.round(F.avg("rate"), 6).alias("a"), F.round(F.max("rate"), 6).alias("b"), F.max("age").cast("double").alias("age"), F.max("season").alias("last_season"))
    g = staged(g, "classes")
    e = similarity.nearest_before(g, {"a": 1.0, "b": 0.5, "age": 4.0}, 10)
    late = s.where(f"season > {c.CUT}").groupBy("player").agg(F.sum("points").alias("late"))
    w = F.lit(1.0) / (F.lit(1.0) + F.col("distance"))
    p = e.join(late.withColumnRenamed("player", "comp"), "comp", "left").groupBy("player").agg(F.round(F.sum(F.coalesce("late", F.lit(0.0)) * w) / F.sum(w), 6).alias("projected"))
    p = p.join(g.select("player", "position"), "player").join(late, "player", "left").select("player", "position", "projected", F.coalesce("late", F.lit(0.0)).alias("actual"))
    return c._round(evaluation.spearman(p, "projected", "actual", ["position"]), rho=5)


TEAMS = "ro AS (SELECT c_nationkey AS team, c_custkey AS player, c_mktsegment AS position FROM customer)"


@query(with_(SEASONS, ROSTER, TEAMS, "g AS (SELECT team, count(*) AS players, count(score) AS rated, sum(coalesce(score, 0)) AS total FROM ro LEFT JOIN sc USING (player) GROUP BY 1)", select="SELECT *, round(CASE WHEN rated > 0 THEN total / rated ELSE 0 END, 5) AS mean_score, row_number() OVER (ORDER BY total DESC, team) AS power_rank, round(total - avg(total) OVER (), 4) AS above_mean FROM g"))
def league_report(spark, sf_dir):
    return c._round(reports.league_report(*c._roster(spark, sf_dir)), mean_score=5, above_mean=4)


@query(with_(SEASONS, ROSTER, TEAMS, select="SELECT team, player, score, row_number() OVER (PARTITION BY team ORDER BY score DESC, player) AS place FROM ro JOIN sc USING (player) QUALIFY place <= 5"))
def top_assets(spark, sf_dir):
    return reports.top_assets(*c._roster(spark, sf_dir)).select("team", "player", "score", "place")


@query(with_(SEASONS, TEAMS, f"r AS (SELECT player, row_number() OVER (ORDER BY sum(points) DESC, player) AS rank FROM s GROUP BY player), t AS (SELECT player, {TIER} AS tier FROM r), b AS (SELECT team, position, min(tier) AS best_tier FROM ro JOIN t USING (player) GROUP BY 1, 2), k AS (SELECT DISTINCT team, p AS position FROM ro, (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) v(p))", select="SELECT team, position, best_tier FROM k LEFT JOIN b USING (team, position) WHERE best_tier IS NULL OR best_tier > 3"))
def weaknesses(spark, sf_dir):
    tiers = c.rank_tier(spark, sf_dir).select("player", "tier")
    return reports.weaknesses(c._roster(spark, sf_dir)[0], tiers, ["BUILDING", "MACHINERY", "NONE"])


@query(with_(SEASONS, ROSTER, TRADES, """
    tm AS (SELECT * FROM range(14) t(team)),
    d AS (SELECT o_custkey % 13 AS team, count(*) AS n_picks, avg(score - CASE WHEN o_orderkey % 300 <= 0 THEN 100.0::DOUBLE WHEN o_orderkey % 300 > 250 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1 - (o_orderkey % 300 - 1) / 250.0::DOUBLE) END) AS draft_delta FROM orders JOIN sc ON player = o_custkey GROUP BY 1),
    t AS (SELECT team, count(*) AS n_trades, sum(delta) AS trade_delta FROM tr GROUP BY 1),
    g AS (SELECT tm.team, coalesce(n_picks, 0) AS n_picks, coalesce(n_trades, 0) AS n_trades, draft_delta, trade_delta FROM tm LEFT JOIN d ON d.team = tm.team LEFT JOIN t ON t.team = tm.team),
    z AS (SELECT *, CASE WHEN draft_delta IS NULL OR count(draft_delta) OVER () < 2 THEN 0 ELSE (draft_delta - avg(draft_delta) OVER ()) / CASE WHEN stddev_pop(draft_delta) OVER () = 0 THEN 1 ELSE stddev_pop(draft_delta) OVER () END END AS z_draft,
                 CASE WHEN trade_delta IS NULL OR count(trade_delta) OVER () < 2 THEN 0 ELSE (trade_delta - avg(trade_delta) OVER ()) / CASE WHEN stddev_pop(trade_delta) OVER () = 0 THEN 1 ELSE stddev_pop(trade_delta) OVER () END END AS z_trade FROM g)""",
    select="SELECT team, n_picks, n_trades, round(coalesce(draft_delta, 0), 4) AS draft_delta, round(coalesce(trade_delta, 0), 4) AS trade_delta, round(z_draft, 5) AS z_draft, round(z_trade, 5) AS z_trade, round((z_draft + z_trade) / 2, 5) AS skill, row_number() OVER (ORDER BY round((z_draft + z_trade) / 2, 9) DESC, team) AS skill_rank FROM z"))
def manager_report(spark, sf_dir):
    scores = c._roster(spark, sf_dir)[1]
    picked = c.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 13).alias("team"), F.col("o_custkey").alias("player"), (F.col("o_orderkey") % 300).alias("pick"))
    teams = spark.range(14).select(F.col("id").alias("team"))
    r = reports.manager_report(teams, picked, c._trades(spark, sf_dir), scores)
    return c._round(r, draft_delta=4, trade_delta=4, z_draft=5, z_trade=5, skill=5)
