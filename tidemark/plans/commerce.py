"""The operators bound to the commerce tables: customers are players, order years seasons.

Stats are whole numbers, so that sums do not depend on the order of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, rules
from ..functions.numeric import ratio0, rounded
from .. import constants as C
from ..operators import careers, consensus, evaluation, identity, order_stats, penalties, ranking, rookies, similarity
from ..staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ERA_ENDS = (1996, 1998, 1999)
CUT = 1998


def query(f: Query) -> Query:
    QUERIES["q_" + f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, position, season, age, games, four stats and points.  Lines are summed by order before
    they meet the customers, so only sums are shuffled twice."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("games"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("position"), F.col("c_nationkey").alias("team"))
    s = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "season").agg(F.sum("games").alias("games"), F.sum("qty").alias("qty"), F.sum("cents").alias("cents"), F.sum("returns").alias("returns"))
    s = s.join(customers, F.col("o_custkey") == F.col("player"))
    points = (F.col("qty") * 2 + F.col("returns") * 15 + F.floor(F.col("cents") / 200000)).cast("double")
    return s.select("player", "position", "team", "season", (F.col("season") - (F.lit(1970) + F.col("player") % 8)).cast("int").alias("age"), "games", "qty", "cents", "returns", points.alias("points"))


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return careers.eligible(seasons(spark, sf_dir))


def played_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written and read again, for queries that need it several times."""
    return staged(played(spark, sf_dir), "played")


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query
def scan_filter(spark, sf_dir):
    return played(spark, sf_dir).select("player", "position", "season", "age", "games", "points")


@query
def career_rollup(spark, sf_dir):
    return careers.rollup(played(spark, sf_dir), through=1999, current=2001)


@query
def era_ratio_median(spark, sf_dir):
    s = played(spark, sf_dir).withColumn("era", rules.era("season", ERA_ENDS))
    return _round(careers.era_ratios(s, ["qty", "returns"]), med=6, multiplier=6)


FORMATS = {"std": (2.0, 15.0, 0.0), "ppr": (3.0, 15.0, 0.0), "half": (2.5, 15.0, 0.0), "sf": (2.0, 10.0, 5.0), "deep": (1.0, 20.0, 5.0), "flat": (1.0, 1.0, 0.0)}


@query
def scoring_6fmt(spark, sf_dir):
    s = played(spark, sf_dir)
    fmt = spark.createDataFrame([(k, *v) for k, v in FORMATS.items()], "format string, kq double, kr double, bonus double")
    bonus = F.when(F.col("position") == "BUILDING", F.col("bonus") * F.col("games")).otherwise(0.0)
    j = s.join(F.broadcast(fmt))  # six rows, fixed
    total = F.col("qty") * F.col("kq") + F.col("returns") * F.col("kr") + bonus
    return _round(j.select("player", "season", "format", total.alias("total"), (total / F.greatest("games", F.lit(1))).alias("per_game")), per_game=6)


@query
def peak3_rolling(spark, sf_dir):
    return _round(careers.peak3(played(spark, sf_dir)), peak3=6)


@query
def recent_n(spark, sf_dir):
    s = played(spark, sf_dir)
    last = Window.partitionBy("player").orderBy(F.desc("season"))
    r = s.withColumn("rn", F.row_number().over(last)).where("rn <= 3")
    rate = lambda n: ratio0(F.sum(F.when(F.col("rn") <= n, F.col("points"))), F.sum(F.when(F.col("rn") <= n, F.col("games"))))
    return _round(r.groupBy("player").agg(*(rate(n).alias(f"recent{n}") for n in (1, 2, 3))), recent1=6, recent2=6, recent3=6)


@query
def running_total_stage(spark, sf_dir):
    return careers.stages(played(spark, sf_dir))


@query
def percentile_strict(spark, sf_dir):
    now, done = groups_of(played(spark, sf_dir))
    values = careers.stages(now).select("player", "position", "stage", "total")
    return _round(careers.strict_percentile(careers.stages(done), values, ["position", "stage"], "total"), pct=6)


@query
def trend_slope(spark, sf_dir):
    return _round(careers.slope(played(spark, sf_dir)), slope=6)


@query
def discounted_future(spark, sf_dir):
    s = played(spark, sf_dir)
    f = careers.discounted_after(s, s.select("player", F.col("age").alias("snapshot_age")))
    return f.withColumn("future_points", rounded("future_points", 4))


CURRENT = 2001


SPAN = ["_last", "_n", "_max_age"]
IS_ACTIVE = f"_last >= {CURRENT - 1}"
IS_FINISHED = f"_last < {CURRENT - 1} and _n >= 2"


def with_span(s: DataFrame) -> DataFrame:
    """Each season with its career's last season, number of seasons and greatest age, if it has them not yet."""
    if set(SPAN) <= set(s.columns):
        return s
    span = Window.partitionBy("player")
    return s.withColumns({"_last": F.max("season").over(span), "_n": F.count("*").over(span), "_max_age": F.max("age").over(span)})


def careers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`played_once` with each career's span, so that active and finished careers are told apart without another shuffle."""
    return staged(with_span(played(spark, sf_dir)), "played")


def groups_of(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seasons of active players, seasons of finished careers of two seasons or more)."""
    s = with_span(s)
    return s.where(IS_ACTIVE).drop(*SPAN), s.where(IS_FINISHED).drop(*SPAN)


def active(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    return groups_of(played(spark, sf_dir) if s is None else s)[0]


def finished(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    return groups_of(played(spark, sf_dir) if s is None else s)[1]


def all_vectors(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    s = played_once(spark, sf_dir) if s is None else s
    return similarity.vectors(s, careers.stages(finished(spark, sf_dir, s)))


def targets_and_pool(spark, sf_dir, s: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Active players at their last season, and finished careers at all of theirs, with their spans."""
    s = careers_once(spark, sf_dir) if s is None else with_span(s)
    vectors = staged(similarity.vectors(s, careers.stages(finished(spark, sf_dir, s)), keep=SPAN), "vectors")
    targets = vectors.where(IS_ACTIVE).where("season = _last").drop(*SPAN).withColumn("n_seasons", F.col("stage"))
    pool = vectors.where(IS_FINISHED).withColumnsRenamed({"_n": "n_seasons", "_max_age": "max_age"}).drop("_last")
    return targets, pool


def edges(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    targets, pool = targets_and_pool(spark, sf_dir, s)
    return similarity.neighbours(targets, pool, old_before=1996)


@query
def vector11(spark, sf_dir):
    return _round(all_vectors(spark, sf_dir), **{v: 6 if v == "v7" else 5 for v in similarity.V})


@query
def knn_top25(spark, sf_dir):
    return _round(edges(spark, sf_dir), sim=6, raw_sim=6)


def futures(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    s = finished(spark, sf_dir, s)
    return careers.discounted_after(s, s.select("player", F.col("age").alias("snapshot_age")))


def projections(spark, sf_dir, e: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """Comps' mean, anchor and blend for every target, from its edges."""
    return blends(spark, sf_dir, similarity.comp_projection(e, futures(spark, sf_dir, s)), s)


def blends(spark, sf_dir, p: DataFrame, s: DataFrame | None = None) -> DataFrame:
    """The anchor and blend of each target in `p`, from its comps' mean and its own rates."""
    own = active(spark, sf_dir, s)
    # recent and peak rates from windows over the partitioning by player that the sums use too
    last, ahead = F.row_number().over(Window.partitionBy("player").orderBy(F.desc("season"))), careers.by_season().rowsBetween(0, 2)
    own = own.withColumns({"_k": last, "_r": ratio0(F.sum("points").over(ahead), F.sum("games").over(ahead))})
    three = lambda c: F.sum(F.when(F.col("_k") <= 3, F.col(c)))
    recent = F.sum(F.when(F.col("season") >= CURRENT - 1, F.col("games")).otherwise(0)).alias("recent_games")
    breakout = F.min_by("age", F.when(F.col("games") >= 10, F.col("season"))).alias("breakout_age")
    rates = [ratio0(three("points"), three("games")).alias("recent3"), F.greatest(F.max("_r"), F.lit(0.0)).alias("peak3")]
    p = p.join(own.groupBy("player", "position").agg(*rates, F.sum("games").alias("career_games"), F.max("season").alias("last_season"), F.max_by("games", "season").alias("last_games"), F.max("age").alias("age"), recent, breakout), "player")
    return similarity.blended(p, 24.0)


@query
def weighted_projection(spark, sf_dir):
    s = careers_once(spark, sf_dir)
    p = projections(spark, sf_dir, edges(spark, sf_dir, s), s).select("player", "comp_mean", "years", "best_comp", "n_comps", "anchor", "projection")
    return _round(p, comp_mean=3, years=5, best_comp=3, anchor=3, projection=3)


def survivals(spark, sf_dir, e: DataFrame, s: DataFrame | None = None) -> DataFrame:
    return penalties.survival(e.join(comp_careers(spark, sf_dir, s), "comp"))


def comp_careers(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    c = careers.rollup(finished(spark, sf_dir, s), through=1998)
    return c.select(F.col("player").alias("comp"), F.col("max_age").alias("comp_last_age"), F.col("n_seasons").alias("comp_n_seasons"), F.col("retired").alias("comp_retired"))


def projected_and_survived(spark, sf_dir, e: DataFrame, s: DataFrame) -> DataFrame:
    """`projections` and `survivals` of each target in one: edges meet all that is known of a comp, what it made
    after each age too, by one shuffle, and go to their target by another."""
    ahead = F.collect_list(F.struct("snapshot_age", "future_points", "future_seasons")).alias("_ahead")  # a career's seasons
    ahead = futures(spark, sf_dir, s).groupBy(F.col("player").alias("comp")).agg(ahead)
    e = e.join(comp_careers(spark, sf_dir, s).join(ahead, "comp", "left"), "comp")
    e = e.withColumn("_f", F.get(F.filter("_ahead", lambda f: f["snapshot_age"] == F.col("comp_age")), F.lit(0)))
    e = e.select("player", "sim", "rank", "comp_last_age", "comp_n_seasons", "comp_retired", "_f.future_points", "_f.future_seasons")
    g = e.repartition("player").groupBy("player").agg(*similarity.projection_sums(), *penalties.survival_rates())
    return blends(spark, sf_dir, penalties.with_survival(g), s)


@query
def survival(spark, sf_dir):
    s = careers_once(spark, sf_dir)
    return _round(survivals(spark, sf_dir, edges(spark, sf_dir, s), s), bust_rate=5, short_rate=5, survival=5)


@query
def confidence(spark, sf_dir):
    c = careers.rollup(played(spark, sf_dir))
    return _round(c.select("player", "career_games", penalties.confidence(F.col("career_games").cast("double"), F.col("position") == "MACHINERY").alias("confidence")), confidence=6)


@query
def missed_season(spark, sf_dir):
    s = played(spark, sf_dir)
    g = s.groupBy("player").agg(F.max("season").alias("last_season"), F.max_by("games", "season").alias("last_games"))
    return g.select("player", "last_season", "last_games", penalties.missed_season(F.col("last_season"), F.col("last_games"), F.lit(2001)).alias("multiplier"))


@query
def late_breakout(spark, sf_dir):
    g = played(spark, sf_dir).where("games >= 10").groupBy("player").agg(F.min_by("age", "season").alias("breakout_age"))
    return g.select("player", "breakout_age", penalties.late_breakout(F.col("breakout_age")).alias("multiplier"))


def stacked(spark, sf_dir) -> DataFrame:
    s = careers_once(spark, sf_dir)
    e = edges(spark, sf_dir, s)
    p = staged(projected_and_survived(spark, sf_dir, e, s), "projections")
    base = penalties.upper_median_of_best(p, "position", "projection", tie="player")
    p = p.join(base, "position", "left")
    conf = penalties.confidence(F.col("career_games").cast("double"), F.col("position") == "MACHINERY")
    missed = penalties.missed_season(F.col("last_season"), F.col("last_games"), F.lit(CURRENT))
    late = F.when(F.col("position") == "MACHINERY", penalties.late_breakout(F.col("breakout_age"))).otherwise(1.0)
    stale = F.col("recent_games") < C.STALE_GAMES
    final = penalties.stack(F.col("projection"), F.col("survival"), conf, F.col("baseline"), late, stale, missed)
    return p.withColumns({"late": late, "stale": stale, "missed": missed, "final": final})


@query
def penalty_stack(spark, sf_dir):
    return _round(stacked(spark, sf_dir).select("player", "position", "projection", "baseline", "survival", "late", "stale", "missed", "final"), projection=3, baseline=3, survival=5, final=3)


@query
def upper_median_top50(spark, sf_dir):
    c = careers.rollup(played(spark, sf_dir))
    return penalties.upper_median_of_best(c, "position", "career_points")


@query
def rank_tier(spark, sf_dir):
    c = careers.rollup(played(spark, sf_dir)).select("player", "position", "career_points")
    r = ranking.ranked(c, "career_points", "player", tiers=True)
    return ranking.ranked(r, "career_points", "player", by="position", out="position_rank").select("player", "position", "career_points", F.col("rank").cast("long"), "tier", F.col("position_rank").cast("long"))


STARTERS = {"AUTOMOBILE": 22.2, "BUILDING": 29.4, "FURNITURE": 42.6, "HOUSEHOLD": 13.8, "MACHINERY": 10.0}


@query
def overlay_baseline(spark, sf_dir):
    c = careers.rollup(played(spark, sf_dir)).select("player", "position", "career_points")
    base = ranking.replacement_baseline(c, "career_points", "player", STARTERS)
    o = c.join(base, "position").withColumn("value", F.col("career_points") - F.col("baseline"))
    o = ranking.ranked(ranking.ranked(o, "career_points", "player", out="base_rank"), "value", "player", out="new_rank")
    return o.select("player", "position", "value", F.col("base_rank").cast("long"), F.col("new_rank").cast("long"), (F.col("base_rank") - F.col("new_rank")).cast("long").alias("rank_delta"))


STATS = ("qty", "returns", "cents")


def rookie_profiles(spark, sf_dir) -> DataFrame:
    return rookies.profiles(careers.with_rate(played(spark, sf_dir)), STATS)


def rookie_edges(spark, sf_dir) -> DataFrame:
    """Players who began in 1997 or later against those who began before."""
    f = staged(rookie_profiles(spark, sf_dir), "rookies")
    return rookies.neighbours(f.where("season >= 1997"), f.where("season < 1997"), ROOKIE_WEIGHTS, 25, first=1995, last=2001)


ROOKIE_WEIGHTS = {"rate": 8.0, "played": 0.1, "qty_pg": 0.1, "returns_pg": 0.3, "cents_pg": 0.0000001, "age": 20.0}


@query
def rookie_profile(spark, sf_dir):
    f = rookie_profiles(spark, sf_dir).select("player", "position", "season", "age", "games", "rate", "played", "qty_pg", "returns_pg", "cents_pg", "later", "later_discounted", "later_seasons")
    return _round(f.withColumn("later_discounted", rounded("later_discounted", 4)), rate=6, played=6, qty_pg=6, returns_pg=6, cents_pg=5)


@query
def rookie_knn_widen(spark, sf_dir):
    return _round(rookie_edges(spark, sf_dir).select("player", "comp", "raw", "sim", "rank", "n_near"), raw=6, sim=6)


@query
def rookie_projection(spark, sf_dir):
    e = staged(rookie_edges(spark, sf_dir), "rookie-edges")
    f = rookie_profiles(spark, sf_dir)
    p = rookies.projection(f.where("season >= 1997"), e, {"MACHINERY": (12.0, 0.75), "BUILDING": (7.0, 0.8)})
    return _round(p.select("player", "n_comps", "comp_mean", "anchor", "confidence", "projection", "years", "bust_rate"), comp_mean=3, anchor=3, confidence=6, projection=3, years=5, bust_rate=6)


def z_rates(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    s = careers.with_rate(played(spark, sf_dir) if s is None else s)
    nation = s.groupBy("season", "team").agg(F.avg("games").alias("strength"))
    z = ranking.z_scores(nation, "strength", ["season"])
    return s.join(z.select("season", "team", "z"), ["season", "team"], "left").withColumn("adjusted", rules.schedule_adjusted(F.col("rate"), F.col("z")))


@query
def zscore_clip(spark, sf_dir):
    return _round(z_rates(spark, sf_dir).select("player", "season", "z", "adjusted"), z=6, adjusted=6)


def prospects(spark, sf_dir) -> DataFrame:
    s = z_rates(spark, sf_dir, played_once(spark, sf_dir)).where(f"season <= {CUT}")
    rates = [F.round(F.avg("adjusted"), 6).alias("mean_rate"), F.round(F.max("adjusted"), 6).alias("best_rate"), F.round(F.max_by("adjusted", "season"), 6).alias("last_rate")]
    g = s.groupBy("player", "position").agg(*rates, F.max("age").alias("age"), F.max("season").alias("last_season"))
    return ranking.z_scores_of(staged(g, "rates"), {c: f"z_{c}" for c in ("mean_rate", "best_rate", "last_rate")}, ["position"], digits=6)


@query
def prospect_knn(spark, sf_dir):
    p = staged(prospects(spark, sf_dir), "prospects")
    e = similarity.nearest_before(p, {"z_mean_rate": 3.0, "z_best_rate": 2.0, "z_last_rate": 2.0, "age": 1.5}, 10)
    return _round(e.select(F.col("player").alias("target"), "comp", "distance", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("sim"), "rank"), distance=5, sim=5)


@query
def pick_tier_blend(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 260).alias("pick"), F.floor(F.col("o_totalprice")).alias("price"))
    t = rules.pick_tier(F.col("pick"))
    base = F.coalesce(*(F.when(t == k, F.lit(v)) for k, v in (("R1_top10", 1600.0), ("R1", 1250.0), ("R2", 900.0), ("R3", 600.0), ("R4_5", 400.0), ("R6", 250.0), ("R7", 180.0))), F.lit(100.0))
    share = F.least(F.lit(1.0), (F.col("o_orderkey") % 9) / F.lit(8.0))
    blend = F.col("price") * share + base * (F.lit(1.0) - share)
    return _round(o.select("o_orderkey", t.alias("tier"), rules.expected_at_pick(F.coalesce("pick", F.lit(999))).alias("expected"), blend.alias("blend")), expected=6, blend=6)


@query
def crosswalk_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("bal", F.col("c_acctbal"))
    rows = c.select("c_custkey", F.when(F.col("bal") >= 5000, F.col("c_custkey")).alias("a"), F.when(F.col("bal").between(0, 4999), F.col("c_custkey") * 2).alias("b"), names.compact_name(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("position"))
    by_a = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("a"), F.concat(F.lit("A"), "c_custkey").alias("gid"))
    by_b = c.where("c_nationkey >= 10").select((F.col("c_custkey") * 2).alias("b"), F.concat(F.lit("B"), "c_custkey").alias("gid"))
    by_n = identity.first_wins(c.select(names.compact_name(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("position"), F.concat(F.lit("N"), "c_custkey").alias("gid")), "name", "gid")
    out = identity.cascade(rows, [(["a"], by_a), (["b"], by_b), (["name", "position"], by_n)], "gid")
    return out.select("c_custkey", "resolved")


@query
def unique_match_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    out = identity.unique_cascade(p.withColumnRenamed("id", "row_id"), p, [["brand", "type", "size"], ["brand", "size"], ["type", "size"]], "id")
    return out.select("row_id", "resolved")


@query
def nearest_season(spark, sf_dir):
    s = played(spark, sf_dir)
    rows = s.groupBy("player", "position").agg(F.max("season").alias("season")).select(F.col("player").alias("row_id"), "position", "season")
    cand = s.groupBy("player", "position").agg(F.min("season").alias("season")).select(F.col("player").alias("id"), "position", "season")
    return identity.nearest_season(rows, cand, ["position"]).select("row_id", F.col("c_id").alias("found"), F.col("delta").cast("int"))


def _model_and_outside(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = careers.rollup(played(spark, sf_dir)).where("career_games >= 25").select("player", "career_points")
    model = ranking.ranked(c, "career_points", "player", out="model_rank")
    cust = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("player"), (F.col("c_acctbal")).alias("bal"))
    outside = ranking.ranked(cust, "bal", "player", out="outside_rank").select("player", "outside_rank")
    return model, outside


@query
def consensus_rows(spark, sf_dir):
    m, o = _model_and_outside(spark, sf_dir)
    return consensus.compare(m, o, "player").select("player", F.col("model_rank").cast("long"), F.col("outside_rank").cast("long"), F.col("delta").cast("long"))


@query
def consensus_counts(spark, sf_dir):
    return consensus.counts(*_model_and_outside(spark, sf_dir), "player")


@query
def latest_snapshot(spark, sf_dir):
    return consensus.latest(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id", ["event_id", "value"])


@query
def latest_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = e.agg((F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).alias("cut"))
    e = e.join(F.broadcast(cut))  # one row
    return consensus.latest(e.where("us < cut"), ["user_id"], "us", "event_id", ["event_id", "event_type"])


def _ranked_pairs(spark, sf_dir) -> DataFrame:
    s = played(spark, sf_dir)
    early = s.where(f"season <= {CUT}").groupBy("player", "position").agg(F.sum("points").alias("early"))
    late = s.where(f"season > {CUT}").groupBy("player").agg(F.sum("points").alias("late"))
    return early.join(late, "player", "left").withColumn("late", F.coalesce("late", F.lit(0.0)))


@query
def spearman_avg_ties(spark, sf_dir):
    return _round(evaluation.spearman(_ranked_pairs(spark, sf_dir), "early", "late", ["position"]), rho=6)


@query
def hit_at_k(spark, sf_dir):
    return _round(evaluation.hit_at_k(_ranked_pairs(spark, sf_dir), "early", "late", "player", ["position"], 24), hit_rate=6)


@query
def pair_h2h(spark, sf_dir):
    r = ranking.ranked(_ranked_pairs(spark, sf_dir), "early", "player", by="position", out="m")
    g = played(spark, sf_dir).where(f"season <= {CUT}").groupBy("player").agg(F.sum("games").cast("double").alias("g"))
    r = ranking.ranked(r.join(g, "player"), "g", "player", by="position", out="o")
    return _round(evaluation.pair_wins(r, "m", "o", "late", "player", ["position"]), model_share=6)


@query
def percentile_cutoffs(spark, sf_dir):
    p = careers.peak3(played(spark, sf_dir)).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("position")), "player")
    return _round(order_stats.quantiles(p, ["position"], "peak3", {"elite": 0.8, "bust": 0.3}).drop("_n"), elite=5, bust=5)


@query
def gates(spark, sf_dir):
    h = evaluation.hit_at_k(_ranked_pairs(spark, sf_dir), "early", "late", "player", ["position"], 24)
    return h.select("position", evaluation.gate(F.col("hit_rate"), 0.2).alias("gate"))


@query
def ras_minmax(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    r = ranking.min_max(ranking.min_max(p, "size", ["p_brand"], lower_is_better=True, out="a"), "price", ["p_brand"], out="b")
    return r.select("p_partkey", F.round((F.col("a") + F.col("b")) / 2.0, 5).alias("ras"))


@query
def multi_row_collapse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.when(F.col("l_linenumber") == 3, "3TM").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 7)).alias("team"))
    return identity.combined_row(lines, "l_orderkey", "team", "at").select("l_orderkey", "at.l_linenumber", "team", "at.l_partkey", "recent_team")


@query
def full_outer_first_nonnull(spark, sf_dir):
    s = played(spark, sf_dir)
    a = s.where("games >= 6").select("player", "season", F.when(F.col("games") > 6, F.col("points")).alias("x"), F.col("games").cast("double").alias("y"))
    b = s.where("returns >= 2").select("player", "season", F.col("qty").cast("double").alias("x"))
    c = s.where("qty >= 250").select("player", "season", F.col("returns").cast("double").alias("y"), (F.col("cents") / 100).alias("z"))
    return identity.merged_first_nonnull([a, b, c], ["player", "season"], ["x", "y", "z"])


def _roster(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    roster = c.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("position"))
    scores = careers.rollup(played(spark, sf_dir)).where("career_games >= 20").select("player", F.col("career_points").alias("score"))
    return roster, scores


@query
def roster_rollup(spark, sf_dir):
    return consensus.roster_rollup(*_roster(spark, sf_dir))


@query
def power_ranks(spark, sf_dir):
    r = consensus.roster_rollup(*_roster(spark, sf_dir)).groupBy("team").agg(F.sum("total").alias("total"))
    return _round(consensus.power_ranks(r, "total", "team"), above_mean=4)


def _trades(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trade"), (F.col("l_suppkey") % 12).alias("team"), (F.col("l_partkey") % 1500 + 1).alias("player"))
    return consensus.trade_deltas(o.distinct(), _roster(spark, sf_dir)[1])


@query
def trade_deltas(spark, sf_dir):
    return _trades(spark, sf_dir)


@query
def trade_delta_z(spark, sf_dir):
    return _round(consensus.manager_skill(_trades(spark, sf_dir)), mean_delta=5, trade_z=5)


@query
def set_ops(spark, sf_dir):
    s = played(spark, sf_dir)
    a, b = s.where("season = 1996").select("player"), s.where("season = 1997").select("player")
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "player")
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "both")).union(tag(a.join(b, "player", "left_anti"), "first_only"))


@query
def html_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").cast("long").alias("total"), F.max("k").alias("most"))


@query
def grouping_overall(spark, sf_dir):
    return evaluation.position_and_overall(played(spark, sf_dir), "points")


@query
def career_length_lift(spark, sf_dir):
    s = played(spark, sf_dir)
    g = s.groupBy("player").agg(F.count("*").alias("n"), F.sum("returns").alias("ret"), F.sum("games").alias("gm"), F.floor((F.min("season") + F.max("season")) / 2).alias("mid")).where("n >= 2")
    per = F.col("ret") / F.col("gm") * 100
    style = F.when(per < 20, "low").when(per < 28, "mid").otherwise("high")
    return _round(careers.style_lifts(g, style, F.least(rules.era("mid", ERA_ENDS), F.lit(3)), "low"), lift=6)


CONFERENCES = ("Big East", "WAC", "SEC", "MAC", "American")


@query
def conference_tier(spark, sf_dir):
    """A nation plays in its region's conference; each order counts for the tier of its year."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(*(F.when(F.col("n_regionkey") == k, F.lit(x)) for k, x in enumerate(CONFERENCES))).alias("conference"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") + 12).alias("year"))
    played_in = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "year").agg(F.count("*").alias("n"))  # summed before names are met
    tiers = played_in.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tier", rules.conference_tier(F.col("conference"), F.col("year")))
    return tiers.groupBy("conference", "year", "tier").agg(F.sum("n").alias("orders"))


def _names(spark, sf_dir) -> DataFrame:
    """Whole texts on one line, accented letters among them, with the tails of names."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\t\r]", " ").alias("t"))
    tail = F.element_at(F.array(*(F.lit(s) for s in (" Žan Dončić Jr.", " III", ", Jr.", " J.R. sr", " O'Neil-Smith Őrsi", " V jr"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.trim("t"), tail).alias("name"))


for _k, _f in enumerate((names.identity_name, names.compact_name, names.prospect_name, names.bridge_name, names.draft_name, names.college_name, lambda x: names.first_and_last(x)["last"]), 1):
    QUERIES[f"q_name_normalise_{_k}"] = lambda spark, sf_dir, f=_f: _names(spark, sf_dir).select("doc_id", f(F.col("name")).alias("normal"))
