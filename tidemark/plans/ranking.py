"""Whole rankings, pools and smaller joins bound to the tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..operators import careers, consensus, evaluation, ranking, reports
from ..sources import elements, html
from ..staging import staged
from . import commerce as c
from .oracles import ORACLES, PEAK3, SEASONS, TIER, with_
from .scouting import engine_dispatch, query


@query(f"WITH d AS ({ORACLES['q_engine_dispatch']}), a AS ({ORACLES['q_penalty_stack']}), b AS ({ORACLES['q_rookie_projection']}), x AS (SELECT player, engine, final AS score FROM a JOIN d USING (player) WHERE engine = 'cumulative' UNION ALL SELECT player, engine, projection FROM b JOIN d USING (player) WHERE engine = 'rookie'), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, player) AS rank FROM x) SELECT player, engine, score, rank, {TIER} AS tier FROM r")
def engine_ranking(spark, sf_dir):
    """Both engines in one run: who has one season that was begun lately is projected by first seasons, the
    others by their careers; all are ranked and tiered together."""
    d = engine_dispatch(spark, sf_dir)
    old = c.penalty_stack(spark, sf_dir).select("player", F.col("final").alias("score")).join(d.where("engine = 'cumulative'"), "player")
    new = c.rookie_projection(spark, sf_dir).select("player", F.col("projection").alias("score")).join(d.where("engine = 'rookie'"), "player")
    both = staged(old.unionByName(new), "scores")  # ranges are sampled before they are dealt out
    return ranking.ranked(both, "score", "player", tiers=True).select("player", "engine", "score", F.col("rank").cast("long"), "tier")


@query(with_(SEASONS, f"c AS (SELECT player, position, sum(points) AS career_points FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY career_points DESC, player) AS rank FROM c)", select=f"SELECT player, position, career_points, rank, {TIER} AS tier FROM r WHERE rank <= 30"))
def top_listing(spark, sf_dir):
    """The 30 best: each task keeps 30 rows, no sort of all."""
    best = careers.rollup(c.played(spark, sf_dir)).select("player", "position", "career_points").orderBy(F.desc("career_points"), "player").limit(30)
    return ranking.ranked(best, "career_points", "player", tiers=True).select("player", "position", "career_points", F.col("rank").cast("long"), "tier")


@query(with_(SEASONS, select="SELECT player, season, position, row_number() OVER (PARTITION BY season ORDER BY position, coalesce(qty, 0) DESC, coalesce(returns, 0) DESC, player) AS place FROM s"))
def corpus_order(spark, sf_dir):
    """The order in which a season's rows are filed: position, two measures from the most, name."""
    s = c.played(spark, sf_dir)
    order = ["position", F.desc(F.coalesce("qty", F.lit(0))), F.desc(F.coalesce("returns", F.lit(0))), "player"]
    return ranking.placed(s, order, by="season").select("player", "season", "position", F.col("place").cast("long"))


@query("WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY 1) SELECT vec_id, round(coalesce(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(first, lambda x: x::DOUBLE)), 0), 6) AS cosine FROM embeddings JOIN f USING (label) WHERE embedding IS NOT NULL")
def label_cosine(spark, sf_dir):
    """Every vector against the first one of its label; one vector a label meets the others."""
    e = c.table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(cosine("embedding", "first"), 6).alias("cosine"))


@query(with_(SEASONS, "m AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 0)", select="SELECT player, season, points, name, coalesce(name, 'Unknown ' || player) AS shown FROM s LEFT JOIN m ON id = player"))
def stats_with_meta(spark, sf_dir):
    """Every season, with what is known of its player: one without an entry stays."""
    meta = c.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("player"), F.col("c_name").alias("name"))
    s = c.played(spark, sf_dir).select("player", "season", "points").join(meta, "player", "left")
    return s.withColumn("shown", F.coalesce("name", F.concat(F.lit("Unknown "), "player")))


@query(with_(SEASONS, "m AS (SELECT player, row_number() OVER (ORDER BY sum(points) DESC, player) AS model_rank FROM s GROUP BY player HAVING sum(games) >= 25), e AS (SELECT o_custkey AS player, o_totalprice AS v FROM orders), b AS (SELECT player, max(v) AS v FROM e GROUP BY 1), o AS (SELECT player, row_number() OVER (ORDER BY v DESC, player) AS best FROM b)", select="SELECT m.player, model_rank, best AS outside_rank, model_rank - best AS delta FROM m LEFT JOIN o ON o.player = m.player AND best <= 500"))
def consensus_attached(spark, sf_dir):
    """Every player of the model, with the best of the outside rows it has (an order each, so many have several)."""
    model = ranking.ranked(careers.rollup(c.played(spark, sf_dir)).where("career_games >= 25").select("player", "career_points"), "career_points", "player", out="model_rank")
    price = c.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.max("o_totalprice").alias("v"))
    best = ranking.ranked(price, "v", "player", out="outside_rank").where("outside_rank <= 500").select("player", "outside_rank")
    again = best.union(best.withColumn("outside_rank", F.col("outside_rank") + 7))  # a worse row of the same player
    return consensus.attached(model, again, "player").select("player", F.col("model_rank").cast("long"), F.col("outside_rank").cast("long"), F.col("delta").cast("long"))


POOL = """
sp AS (SELECT player, min(season) AS first, max(season) AS last, count(*) AS n, max(age) AS old FROM s GROUP BY 1)"""


@query(with_(SEASONS, POOL, select="SELECT 'long_arc' AS pool, player FROM sp WHERE last <= 1998 OR n >= 8 OR (old >= 33 AND n >= 6) UNION ALL SELECT 'broad', player FROM sp WHERE n >= 2 UNION ALL SELECT 'broad', player FROM sp WHERE n = 1 AND last < 2000"))
def comp_pools(spark, sf_dir):
    """Who may be compared with: long careers, and the broad pool of all with two seasons or an ended career.
    A player of both pools is in both: nothing is made distinct."""
    r = careers.rollup(c.played(spark, sf_dir), through=1998, current=c.CURRENT)
    tag = lambda df, name: df.select(F.lit(name).alias("pool"), "player")
    broad = r.where("n_seasons >= 2").unionByName(r.where("n_seasons = 1").where(~F.col("active")))
    return tag(r.where("long_arc"), "long_arc").unionByName(tag(broad, "broad"))


@query(with_(SEASONS, select="SELECT c_custkey AS id, c_name AS name, 'sidecar' AS origin FROM customer WHERE c_custkey NOT IN (SELECT player FROM s) UNION ALL SELECT DISTINCT player, 'Customer#' || lpad(player::VARCHAR, 9, '0'), 'main' FROM s"))
def sidecar_rows(spark, sf_dir):
    """Those who have seasons, and from a second file only those who have none."""
    main = c.played(spark, sf_dir).select(F.col("player").alias("id")).distinct()
    side = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    known = main.withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"))).withColumn("origin", F.lit("main"))
    return known.unionByName(side.join(main, "id", "left_anti").withColumn("origin", F.lit("sidecar")))


@query(with_(SEASONS, "k AS (SELECT player, position, min(season) AS first FROM s GROUP BY 1, 2)", select="SELECT k.player, k.position, first, coalesce(sum(points), 0) AS outcome, count(points) AS seasons FROM k LEFT JOIN s ON s.player = k.player AND s.season BETWEEN k.first AND k.first + 2 WHERE k.position IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') GROUP BY 1, 2, 3"))
def outcomes_of_first_three(spark, sf_dir):
    """What those whom a source ranked made in their first three years."""
    s = c.played(spark, sf_dir)
    ranked = s.groupBy("player", "position").agg(F.min("season").alias("first")).where(F.col("position").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))
    made = s.select("player", "season", "points").join(ranked.select("player", "first"), "player").where(F.col("season").between(F.col("first"), F.col("first") + 2))
    g = made.groupBy("player").agg(F.sum("points").alias("outcome"), F.count("points").alias("seasons"))
    return ranked.join(g, "player", "left").fillna(0, ["outcome", "seasons"]).select("player", "position", "first", "outcome", "seasons")


ATHLETES = with_(SEASONS, PEAK3.format(s="s"), """
    l AS (SELECT c_custkey AS player, c_mktsegment AS position, (c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0) * 10 AS ras FROM customer WINDOW w AS (PARTITION BY c_mktsegment)),
    j AS (SELECT position, ras, peak3 FROM l JOIN pk USING (player)),
    g AS (SELECT position, count(*) AS n, corr(ras, peak3) AS r FROM j GROUP BY GROUPING SETS ((position), ()))""",
    select="SELECT g.position, n, round(r, 5) AS r, CASE WHEN abs(coalesce(CASE WHEN n >= 30 THEN r END, (SELECT r FROM g WHERE position IS NULL))) >= 0.35 THEN 1.5 WHEN abs(coalesce(CASE WHEN n >= 30 THEN r END, (SELECT r FROM g WHERE position IS NULL))) >= 0.25 THEN 1.25 WHEN abs(coalesce(CASE WHEN n >= 30 THEN r END, (SELECT r FROM g WHERE position IS NULL))) >= 0.15 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM g")


@query(ATHLETES)
def athletic_weights(spark, sf_dir):
    """How a scaled score goes with what its players made, by position and overall, and the weight that follows:
    a position's own where it has 30 players, else the overall one."""
    who = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("position"), F.col("c_acctbal").alias("v"))
    score = ranking.min_max(who, "v", ["position"], out="ras").drop("v")
    j = score.join(careers.peak3(c.played(spark, sf_dir)), "player")
    g = j.groupingSets([[F.col("position")], []], F.col("position")).agg(F.count("*").alias("n"), evaluation.correlation("ras", "peak3").alias("r"))
    r = reports.weighted(g, 30)
    return c._round(r, r=5)


@query(r"WITH p AS (SELECT page_id, html FROM pages) SELECT page_id, len(regexp_extract_all(html, '<a '))::BIGINT AS links, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS head, regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1) AS first_link FROM p".replace('\\"', '"'))
def page_elements(spark, sf_dir):
    """What stands in each page, by its elements.  Only references that are closed count, and links stay as written."""
    e = elements.elements(c.table(spark, sf_dir, "pages").select("page_id", "html"), "html", tags=("a", "li", "p", "h1"), references=False)
    of = lambda tag: F.count_if(F.col("tag") == tag)
    first = lambda tag, x: F.min_by(x, F.when(F.col("tag") == tag, F.col("no")))
    g = e.groupBy("page_id").agg(of("a").alias("links"), of("li").alias("items"), of("p").alias("paragraphs"), html.closed_references(first("h1", F.col("text"))).alias("head"), first("a", F.col("attrs")["href"]).alias("first_link"))
    rows = c.table(spark, sf_dir, "pages").select("page_id").join(g, "page_id", "left")
    return rows.select("page_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("links", "items", "paragraphs")), "head", "first_link")

