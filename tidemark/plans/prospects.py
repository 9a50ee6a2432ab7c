"""Prospects and identities bound to the commerce tables, each beside the SQL that gives the same rows.

Seasons through CUT are a customer's college years, those after it the career that followed; the
region of the customer's nation is the conference, and the balance says how far along the last year was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import prospects, scoring, scouting
from ..staging import staged
from . import commerce as c
from .oracles import SEASONS, ZRATES, with_
from .scouting import PEOPLE, people, query

TIERS = ("P5", "G5_top", "G5", "FCS")
POINTS = {"AUTOMOBILE": C.ROUND_POINTS["QB"], "BUILDING": C.ROUND_POINTS["RB"], "FURNITURE": C.ROUND_POINTS["WR"], "HOUSEHOLD": C.ROUND_POINTS["TE"]}


def college(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    n = c.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.coalesce(*(F.when(F.col("n_regionkey") == k, F.lit(t)) for k, t in enumerate(TIERS))).alias("tier"))
    who = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.when(F.col("c_acctbal") >= 7500, "SR").when(F.col("c_acctbal") >= 5000, "jr").when(F.col("c_acctbal") >= 2500, "SO ").when(F.col("c_acctbal") >= 0, "FR").alias("class_year"))
    s = c.z_rates(spark, sf_dir, c.played_once(spark, sf_dir) if s is None else s).where(f"season <= {c.CUT}")
    return s.join(n, "team").join(who, "player").withColumn("volume", F.col("qty").cast("double"))


def college_careers(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    return prospects.corpus(college(spark, sf_dir, s))


CAREERS = f"""
cs AS (SELECT zr.*, CASE n_regionkey WHEN 0 THEN 'P5' WHEN 1 THEN 'G5_top' WHEN 2 THEN 'G5' WHEN 3 THEN 'FCS' END AS tier, CASE n_regionkey WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END AS factor FROM zr JOIN nation ON n_nationkey = team WHERE season <= {c.CUT}),
ca AS (SELECT *, (rate * factor) * least(1.10::DOUBLE, greatest(0.65::DOUBLE, 1 + 0.15::DOUBLE * coalesce(z, 0))) AS adj FROM cs),
cg AS (SELECT player, position, min(season) AS first_season, max(season) AS last_season, count(*)::DOUBLE AS stage, round(avg(adj)::DECIMAL(30, 11), 6)::DOUBLE AS a, round(max(adj), 6) AS b, round(arg_max(adj, season), 6) AS f, round(avg(factor)::DECIMAL(30, 11), 6)::DOUBLE AS m, arg_max(tier, season) AS tier
       FROM ca GROUP BY 1, 2 HAVING sum(qty) >= 200),
cv AS (SELECT cg.*, CASE WHEN c_acctbal >= 7500 THEN 22 WHEN c_acctbal >= 5000 THEN 21 WHEN c_acctbal >= 2500 THEN 20 WHEN c_acctbal >= 0 THEN 19 ELSE last_season - first_season + 19 END::DOUBLE AS age, c_acctbal < 0 AS age_inferred FROM cg JOIN customer ON c_custkey = player),
cz AS (SELECT *, {", ".join(f"round(({x} - avg({x}) OVER w) / CASE WHEN stddev_pop({x}) OVER w <= 1e-9 OR count(*) OVER w < 2 THEN 1 ELSE stddev_pop({x}) OVER w END, 6) AS z{x}" for x in "abfm")} FROM cv WINDOW w AS (PARTITION BY position))"""


@query(with_(SEASONS, ZRATES, CAREERS, select="SELECT player, position, first_season, last_season, stage, age, age_inferred, tier, a AS avg, b AS peak, f AS final, m AS factor, za AS z_avg, zb AS z_peak, zf AS z_final, zm AS z_factor FROM cz"))
def prospect_corpus(spark, sf_dir):
    return college_careers(spark, sf_dir).select("player", "position", "first_season", "last_season", "stage", "age", "age_inferred", "tier", "avg", "peak", "final", "factor", "z_avg", "z_peak", "z_final", "z_factor")


COMPS = """
ce AS (SELECT t.player, p.player AS comp, sqrt(0.0::DOUBLE + 3.0::DOUBLE * (t.za - p.za) * (t.za - p.za) + 2.0::DOUBLE * (t.zb - p.zb) * (t.zb - p.zb) + 2.0::DOUBLE * (t.zf - p.zf) * (t.zf - p.zf) + 1.0::DOUBLE * (t.stage - p.stage) * (t.stage - p.stage) + 20.0::DOUBLE * (t.age - p.age) * (t.age - p.age) + 1.5::DOUBLE * (t.zm - p.zm) * (t.zm - p.zm)) AS d
       FROM cz t JOIN cz p ON t.position = p.position AND t.player <> p.player AND abs(t.stage - p.stage) <= 1 AND abs(t.age - p.age) <= 2),
ck AS (SELECT player, comp, d, round(d, 6) AS distance, row_number() OVER (PARTITION BY player ORDER BY d, comp) AS rank FROM ce QUALIFY rank <= 25)"""


@query(with_(SEASONS, ZRATES, CAREERS, COMPS, select="SELECT player, comp, distance, round(1.0::DOUBLE / (1.0::DOUBLE + d), 6) AS similarity, rank FROM ck"))
def prospect_comps(spark, sf_dir):
    p = staged(college_careers(spark, sf_dir), "careers")
    return prospects.similar(p, p)


def two_pick_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An official list of those with a balance, and a board of all in debt and some of the others."""
    who = people(spark, sf_dir).join(c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")), "id")
    pick = F.col("id") % 290 + 1
    base = who.select(F.col("id").alias("pick_id"), (F.lit(c.CUT + 1) - F.col("id") % 4).alias("year"), "name", "position", pick.alias("pick"), "bal")
    return base.where("bal >= 0").drop("bal"), base.where("bal < 500").drop("bal")


PICKED = f"""
pb AS (SELECT pe.id AS pick_id, {c.CUT + 1} - pe.id % 4 AS year, name, position, pe.id % 290 + 1 AS pick, c_acctbal AS bal FROM pe JOIN customer ON c_custkey = pe.id),
pu AS (SELECT *, 0 AS src FROM pb WHERE bal >= 0 UNION ALL SELECT *, 1 FROM pb WHERE bal < 500),
pk AS (SELECT pick_id, year, name, position, pick, CASE src WHEN 0 THEN 'official' ELSE 'board' END AS pick_source FROM pu
       QUALIFY row_number() OVER (PARTITION BY year, name, position ORDER BY src, pick, pick_id) = 1)"""


@query("WITH " + PEOPLE + "," + PICKED + " SELECT pick_id, year, name, position, pick, pick_source FROM pk")
def merged_picks(spark, sf_dir):
    return prospects.all_picks(*two_pick_sources(spark, sf_dir)).select("pick_id", "year", "name", "position", "pick", "pick_source")


def named_careers(spark, sf_dir) -> DataFrame:
    who = people(spark, sf_dir).select(F.col("id").alias("player"), "name", "school")
    return staged(college_careers(spark, sf_dir).join(who, "player"), "careers")


def pro_careers(spark, sf_dir) -> DataFrame:
    s = c.played(spark, sf_dir).where(f"season > {c.CUT}")
    r = scoring.best_rates(s)
    return r.select(F.concat(F.lit("g"), "player").alias("pro_id"), F.col("career_points").alias("career"), F.round("best_rate", 6).alias("peak"), "seasons")


POINTS_SQL = "CASE position " + " ".join(f"WHEN '{p}' THEN CASE tier " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in table.items()) + " END" for p, table in POINTS.items()) + " ELSE 100.0 END::DOUBLE"
BY_TIER = lambda table: "CASE tier " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in table.items()) + " END::DOUBLE"
RECORDS = f"""
nc AS (SELECT cz.*, pe.name, pe.school FROM cz JOIN pe ON pe.id = cz.player),
mt AS (SELECT pick_id, player, row_number() OVER (PARTITION BY pick_id ORDER BY abs(last_season - (year - 1)), last_season DESC, player) AS k FROM pk JOIN nc USING (name, position) WHERE abs(last_season - (year - 1)) <= 2),
mp AS (SELECT pk.*, mt.player AS matched FROM pk LEFT JOIN mt ON mt.pick_id = pk.pick_id AND mt.k = 1),
pr AS (SELECT player, sum(points) AS career, count(*) AS seasons, round(avg(rate) FILTER (k <= 3), 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rate DESC) AS k FROM s WHERE season > {c.CUT}) GROUP BY 1),
bd AS (SELECT pe.*, count(*) OVER (PARTITION BY name, position) AS n FROM pe JOIN pr ON pr.player = pe.id),
bn AS (SELECT a.player AS comp, min(bd.id) AS named FROM nc a JOIN bd ON bd.name = a.name AND bd.position = a.position WHERE bd.n = 1 OR contains(lower(bd.school), lower(a.school)) GROUP BY 1),
cb AS (SELECT ck.*, CASE WHEN cu.c_nationkey < 15 THEN ck.comp END AS own FROM ck JOIN customer cu ON cu.c_custkey = ck.comp),
cp AS (SELECT cb.*, coalesce(o.player, n.player) AS pro, coalesce(o.career, n.career) AS career, coalesce(o.peak, n.peak) AS peak, coalesce(o.seasons, n.seasons) AS seasons, o.player IS NULL AND n.player IS NOT NULL AS by_name
       FROM cb LEFT JOIN pr o ON o.player = cb.own LEFT JOIN bn ON bn.comp = cb.comp LEFT JOIN pr n ON n.player = bn.named),
cw AS (SELECT player, sum(coalesce(career, 0) / (1.0::DOUBLE + distance)) / sum(1.0::DOUBLE / (1.0::DOUBLE + distance)) AS wc, sum(coalesce(peak, 0) / (1.0::DOUBLE + distance)) / sum(1.0::DOUBLE / (1.0::DOUBLE + distance)) AS wp,
              sum(coalesce(seasons, 0) / (1.0::DOUBLE + distance)) / sum(1.0::DOUBLE / (1.0::DOUBLE + distance)) AS wy, stddev_pop(coalesce(career, 0)) AS sd, count(pro) AS n_pro, count(*) AS n_comps, count(*) FILTER (by_name) AS n_named,
              count(*) FILTER (CASE WHEN pro IS NULL THEN false ELSE peak >= 18 END) AS n_elite FROM cp GROUP BY 1),
tr AS (SELECT mp.*, CASE WHEN pick <= 10 THEN 'R1_top10' WHEN pick <= 32 THEN 'R1' WHEN pick <= 64 THEN 'R2' WHEN pick <= 100 THEN 'R3' WHEN pick <= 150 THEN 'R4' WHEN pick <= 200 THEN 'R5_6' ELSE 'R7' END AS tier FROM mp),
pj AS (SELECT tr.*, coalesce(n_pro, 0) AS n_pro, coalesce(n_comps, 0) AS n_comps, coalesce(n_named, 0) AS n_named, coalesce(n_elite, 0) AS n_elite, coalesce(sd, 0) AS sd, CASE WHEN wc IS NULL THEN 0 ELSE least(1.0::DOUBLE, coalesce(n_pro, 0) / 8.0::DOUBLE) END AS share, wc, wp, wy, {POINTS_SQL} AS bc, {BY_TIER(C.ROUND_PEAK)} AS bp, {BY_TIER(C.ROUND_YEARS)} AS byr
       FROM tr LEFT JOIN cw ON cw.player = tr.matched),
pz AS (SELECT *, round((share * coalesce(wc, 0) + (1.0::DOUBLE - share) * bc)::DECIMAL(30, 6), 1)::DOUBLE AS projected_career, round((share * coalesce(wp, 0) + (1.0::DOUBLE - share) * bp)::DECIMAL(30, 7), 2)::DOUBLE AS projected_peak, round((share * coalesce(wy, 0) + (1.0::DOUBLE - share) * byr)::DECIMAL(30, 7), 2)::DOUBLE AS projected_years FROM pj),
cn AS (SELECT name, position, min(id) AS first_id FROM pe WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) GROUP BY 1, 2),
co AS (SELECT name, position, row_number() OVER (PARTITION BY position ORDER BY first_id) AS pos_rank, row_number() OVER (ORDER BY first_id) AS overall_rank FROM cn),
rk AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY projected_career DESC, pick_id) AS model_pos_rank, row_number() OVER (ORDER BY projected_career DESC, pick_id) AS model_overall_rank FROM pz)"""


@query(with_(SEASONS, ZRATES, CAREERS, COMPS, PEOPLE, PICKED, RECORDS, select="SELECT pick_id, year, matched, matched IS NOT NULL AS corpus_match, pick_source, projected_career, projected_peak, projected_years, round(sd::DECIMAL(30, 6), 1)::DOUBLE AS career_sd, n_pro AS n_comps_with_nfl, round(share::DECIMAL(30, 8), 3)::DOUBLE AS confidence, CASE WHEN share >= 0.999 THEN 'comp_weighted' WHEN share <= 0.001 THEN 'pick_tier_baseline_' || tier ELSE 'blend_' || printf('%.2f', share) || '_pick_tier_baseline_' || tier END AS source, n_comps, n_named, n_elite, model_pos_rank, model_overall_rank, pos_rank - model_pos_rank AS delta_pos, overall_rank - model_overall_rank AS delta_overall FROM rk LEFT JOIN co USING (name, position)"))
def prospect_records(spark, sf_dir):
    who = staged(named_careers(spark, sf_dir), "named")
    pro = staged(pro_careers(spark, sf_dir), "pro")
    home = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("comp"), "c_nationkey")
    bridge = home.where("c_nationkey < 15").select("comp", F.concat(F.lit("g"), "comp").alias("pro_id"), F.lit("id").alias("strategy"))
    everyone = people(spark, sf_dir)
    meta = everyone.withColumn("name_id", F.concat(F.lit("g"), "id")).join(pro.select(F.col("pro_id").alias("name_id")), "name_id")
    by_name = scouting.name_bridge(who.select(F.col("player").alias("comp"), "name", "position", "school"), meta, ["name", "position"], "school", "school", "name_id", "id", either=False).where("resolved is not null").select("comp", F.col("resolved").alias("name_id"))
    rich = c.table(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("id"))
    seen = everyone.join(rich, "id").groupBy("name", "position").agg((-F.min("id")).alias("worth"), F.min("id").alias("first_id"))
    consensus = c.ranking.ranked(c.ranking.ranked(seen, "worth", "first_id", by="position", out="pos_rank"), "worth", "first_id", out="overall_rank").select("name", "position", "pos_rank", "overall_rank")
    r = prospects.records(prospects.all_picks(*two_pick_sources(spark, sf_dir)), who, bridge, pro, by_name, consensus, points=POINTS)
    count = lambda f: F.size(F.filter("comps", f)).cast("long")
    return r.select("pick_id", "year", "matched", "corpus_match", "pick_source", *(f"projection.{x}" for x in ("projected_career", "projected_peak", "projected_years", "career_sd", "n_comps_with_nfl", "confidence", "source")), F.size("comps").cast("long").alias("n_comps"), count(lambda x: x["strategy"] == "name_fallback").alias("n_named"), count(lambda x: x["hit"] == "elite").alias("n_elite"), "model_pos_rank", "model_overall_rank", "delta_pos", "delta_overall")
