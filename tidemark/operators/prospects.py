"""College careers, what careers like them became, and the records of draft classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import clip, rounded
from ..functions.rules import schedule_adjusted
from ..staging import staged
from .ranking import ranked, z_scores_of
from .scouting import college_age, draft_match
from .similarity import first_by, first_of_equals, nearest

Z = {"avg": "z_avg", "peak": "z_peak", "final": "z_final", "factor": "z_factor"}


def factor(tier: Column) -> Column:
    """What a point is worth in a tier of conferences; without a tier as in the lowest."""
    return F.coalesce(*(F.when(tier == t, F.lit(x)) for t, x in C.CONFERENCE_FACTOR.items()), F.lit(C.CONFERENCE_FACTOR["FCS"]))


def corpus(seasons: DataFrame, min_games: int = C.MIN_GAMES, volume: float = C.PROSPECT_VOLUME) -> DataFrame:
    """One row a career: its mean, best and last season rate, adjusted for the tier and the schedule, its
    length, age, mean tier factor, and the scores of those within the position.

    seasons: player, position, season, games, rate, volume (the position's own measure, summed against
    the bar), tier, z (the schedule's strength, null for none), class_year."""
    s = seasons.where(F.col("games") >= min_games).withColumn("factor", factor(F.col("tier")))
    s = s.withColumn("adjusted", schedule_adjusted(F.col("rate") * F.col("factor"), F.coalesce("z", F.lit(0.0))))
    g = s.groupBy("player", "position").agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").cast("double").alias("stage"), F.sum("volume").alias("volume"),
        rounded(F.avg("adjusted"), 6).alias("avg"), F.round(F.max("adjusted"), 6).alias("peak"), F.round(F.max_by("adjusted", "season"), 6).alias("final"), rounded(F.avg("factor"), 6).alias("factor"),
        F.max_by("class_year", "season").alias("class_year"), F.max_by("tier", "season").alias("tier"),
    )
    age, inferred = college_age(F.col("class_year"), F.col("last_season"), F.col("first_season"))
    g = g.where(F.col("volume") >= volume).withColumns({"age": age.cast("double"), "age_inferred": inferred})
    return z_scores_of(g, Z, ["position"], digits=6)


def similar(targets: DataFrame, careers: DataFrame, k: int = C.PROSPECT_COMPS, before: bool = False, whole: int | None = None) -> DataFrame:
    """player, comp, distance, similarity, rank: the careers of the same position nearest to each target,
    within a season of its length and two years of its age, itself left out; with `before`, only those that
    had ended by the target's last season.

    A target first meets careers of its own length and age.  Others are farther away by what lengths and ages differ,
    so it meets only those whose least distance is within what it has found.  Of careers that differ in nothing that
    counts, k + 1 are offered."""
    stages, ages = C.PROSPECT_STAGES, C.PROSPECT_AGES
    keys = ["position", "at_stage", "at_age"]
    ended = lambda name: [F.col("last_season").alias(name)] if before else []
    offers = first_of_equals(careers.select(F.col("player").alias("comp"), "position", *ended("comp_season"), *C.PROSPECT_WEIGHTS), k + 1)
    offers = staged(offers.withColumns({"at_stage": F.floor("stage"), "at_age": F.floor("age")}), "offers")
    t = targets.select("player", "position", F.floor("stage").alias("at_stage"), F.floor("age").alias("at_age"), *ended("last_season"), *(F.col(c).alias(f"t_{c}") for c in C.PROSPECT_WEIGHTS))
    t = staged(t, "asked")
    may = (F.abs(F.col("t_age") - F.col("age")) <= ages) & (F.abs(F.col("t_stage") - F.col("stage")) <= stages)
    if before:
        may = may & (F.col("comp_season") < F.col("last_season"))
    e = staged(nearest(t, offers, keys, C.PROSPECT_WEIGHTS, k, may, ["player", "comp"], whole), "own")
    others = staged(elsewhere(t, offers, e.where(F.col("rank") == k).select("player", F.col("distance").alias("_bound")), stages, ages), "asked")
    if not others.isEmpty():
        far = nearest(others, offers, keys, C.PROSPECT_WEIGHTS, k, may, ["player", "comp"], whole, apart=True)
        e = first_by(e.drop("rank").union(far.select("player.player", "comp", "distance")), [F.col("distance")], k)
    return e.withColumns({"distance": F.round("distance", 6), "similarity": F.round(F.lit(1.0) / (F.lit(1.0) + F.col("distance")), 6)})


def elsewhere(targets: DataFrame, offers: DataFrame, bounds: DataFrame, stages: int, ages: int) -> DataFrame:
    """The targets for each other length and age at which a career may be as near as their bound; without a
    bound all of them.  As player they have what tells these apart."""
    sides = {"at_stage": "stage", "at_age": "age"}
    ends = offers.groupBy("position", *sides).agg(*(f(c).alias(f"_{n}_{c}") for c in sides.values() for n, f in (("lo", F.min), ("hi", F.max))))
    t = targets.join(bounds, "player", "left").withColumns({f"_own_{c}": F.col(c) for c in sides})
    for c, n in zip(sides, (stages, ages), strict=True):
        t = t.withColumn(c, F.explode(F.sequence(F.col(c) - n, F.col(c) + n)))
    t = t.where((F.col("at_stage") != F.col("_own_at_stage")) | (F.col("at_age") != F.col("_own_at_age"))).join(ends, ["position", *sides])
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"_lo_{c}") - F.col(f"t_{c}"), F.col(f"t_{c}") - F.col(f"_hi_{c}"))
    least = F.sqrt(sum((F.lit(float(C.PROSPECT_WEIGHTS[c])) * gap(c) * gap(c) for c in sides.values()), F.lit(0.0)))
    t = t.where(F.col("_bound").isNull() | (least <= F.col("_bound") * F.lit(1 + 1e-9) + F.lit(1e-9)))
    return t.withColumn("player", F.struct("player", *sides)).select(*targets.columns)


def tier_of_pick(pick: Column) -> Column:
    out = F.when(pick.isNull(), "UDFA")
    for end, label in C.ROUND_ENDS:
        out = out.when(pick <= end, label)
    return out.otherwise("R7")


def baseline(position: Column, pick: Column, points: Mapping[str, Mapping[str, float]] = C.ROUND_POINTS) -> dict[str, Column]:
    """What a pick of its place became on average: points by position and tier, peak and years by tier."""
    t = tier_of_pick(pick)
    of = lambda table, other: F.coalesce(*(F.when(t == k, F.lit(v)) for k, v in table.items()), F.lit(other))
    career = F.coalesce(*(F.when(position == p, of(table, 100.0)) for p, table in points.items()), F.lit(100.0))
    return {"base_career": career, "base_peak": of(C.ROUND_PEAK, 4.0), "base_years": of(C.ROUND_YEARS, 2.0), "base_source": F.concat(F.lit("pick_tier_baseline_"), t)}


def hit_label(peak: Column, seasons: Column) -> Column:
    return F.when(peak >= 18, "elite").when(peak >= 12, "starter").when((seasons >= 3) & (peak < 6), "bust").otherwise("unknown")


def bridged(edges: DataFrame, bridge: DataFrame, careers: DataFrame, by_name: DataFrame) -> DataFrame:
    """Comps with the professional career they went on to.

    bridge: comp, pro_id, strategy; careers: pro_id, career, peak, seasons; by_name: comp, name_id: whom its
    name leads to, for comps whose bridge leads to no career."""
    c = F.struct("career", "peak", "seasons")
    own = careers.select("pro_id", c.alias("_own"))
    e = edges.join(bridge, "comp", "left").join(own, "pro_id", "left")
    e = e.join(by_name, "comp", "left").join(careers.select(F.col("pro_id").alias("name_id"), c.alias("_named")), "name_id", "left")
    named = F.col("_own").isNull() & F.col("_named").isNotNull()
    e = e.withColumns({"pro_id": F.when(named, F.col("name_id")).otherwise(F.col("pro_id")), "strategy": F.when(named, F.lit("name_fallback")).otherwise(F.col("strategy")), "pro": F.coalesce("_own", "_named")})
    return e.withColumn("hit", F.when(F.col("pro").isNull(), "unknown").otherwise(hit_label(F.col("pro.peak"), F.col("pro.seasons")))).drop("_own", "_named", "name_id")


def projected(targets: DataFrame, comps: DataFrame, points: Mapping[str, Mapping[str, float]] = C.ROUND_POINTS) -> DataFrame:
    """`targets` (player, position, pick) with what their comps became, by weights 1 / (1 + distance), those
    without a career as nothing; the fewer comps have one, the more the pick's baseline counts."""
    w = F.lit(1.0) / (F.lit(1.0) + F.col("distance"))
    mean = lambda c: F.sum(w * F.coalesce(F.col(f"pro.{c}").cast("double"), F.lit(0.0))) / F.sum(w)
    g = comps.groupBy("player").agg(mean("career").alias("_career"), mean("peak").alias("_peak"), mean("seasons").alias("_years"), F.stddev_pop(F.coalesce("pro.career", F.lit(0.0))).alias("_sd"), F.count("pro").alias("n_comps_with_nfl"))
    r = targets.join(g, "player", "left").withColumns(baseline(F.col("position"), F.col("pick"), points))
    n = F.coalesce("n_comps_with_nfl", F.lit(0))
    share = F.when(F.col("_career").isNull(), 0.0).otherwise(clip(n / F.lit(float(C.FULL_COMPS)), 0.0, 1.0))
    blend = lambda own, base: share * F.coalesce(own, F.lit(0.0)) + (F.lit(1.0) - share) * F.col(base)
    source = F.when(share >= 0.999, "comp_weighted").when(share <= 0.001, F.col("base_source")).otherwise(F.concat(F.lit("blend_"), F.format_number(share, 2), F.lit("_"), F.col("base_source")))
    return r.withColumns(
        {
            "projected_career": rounded(blend(F.col("_career"), "base_career"), 1),
            "projected_peak": rounded(blend(F.col("_peak"), "base_peak"), 2),
            "projected_years": rounded(blend(F.col("_years"), "base_years"), 2),
            "career_sd": rounded(F.coalesce("_sd", F.lit(0.0)), 1),
            "n_comps_with_nfl": n,
            "confidence": rounded(share, 3),
            "source": source,
            "comp_career": rounded(F.coalesce("_career", F.lit(0.0)), 1),
        }
    ).drop("_career", "_peak", "_years", "_sd", "base_peak", "base_years", "base_source")


def all_picks(official: DataFrame, board: DataFrame) -> DataFrame:
    """Picks of two sources as one: of a class's namesakes at a position the official one counts, else the
    board's, whose rank stands for the pick.  Both: year, name, position, pick; others as they are."""
    both = official.withColumn("source_rank", F.lit(0)).unionByName(board.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "source_rank"]
    best = F.min_by(F.struct(*columns), F.struct("source_rank", F.col("pick").isNull(), "pick", *columns))  # by value: 999 comes before 1002
    return both.groupBy("year", "name", "position").agg(best.alias("_p"), F.min("source_rank").alias("source_rank")).select("_p.*", F.when(F.col("source_rank") == 0, "official").otherwise("board").alias("pick_source"))


def records(picks: DataFrame, careers: DataFrame, bridge: DataFrame, pro: DataFrame, by_name: DataFrame, consensus: DataFrame, k: int = C.PROSPECT_COMPS, points: Mapping[str, Mapping[str, float]] = C.ROUND_POINTS) -> DataFrame:
    """One nested record a pick: the career it is of, comps, projection, ranks and distance to the consensus.

    picks: pick_id, year, name, position, pick; careers: rows of `corpus` with name; consensus: name, position,
    pos_rank, overall_rank.  A pick is matched to the career of its name and position whose last season
    is nearest to the year before; one that isn't found is a stub with the baseline of its place."""
    m = staged(draft_match(picks, careers, ["name", "position"]), "matched")
    found = careers.join(m.select(F.col("matched").alias("player")).distinct(), "player", "left_semi")
    comps = staged(bridged(similar(found, careers, k), bridge, pro, by_name), "comps")
    # a career may be the match of several picks: comps are made once, projections once a pick
    t = m.select("pick_id", "position", "pick", "matched").withColumn("player", F.coalesce(F.col("matched").cast("string"), F.concat(F.lit("stub-"), "pick_id")))
    own = comps.withColumn("player", F.col("player").cast("string"))
    p = projected(t, own, points).select("pick_id", F.struct("projected_career", "projected_peak", "projected_years", "career_sd", "n_comps_with_nfl", "confidence", "source", "comp_career", "base_career").alias("projection"))
    listed = comps.groupBy("player").agg(F.array_sort(F.collect_list(F.struct("rank", "comp", "similarity", "distance", "pro_id", "strategy", "hit", "pro"))).alias("comps"))  # k at most
    about = careers.select(F.col("player").alias("matched"), F.struct("first_season", "last_season", "stage", "age", "age_inferred", "tier", F.struct(F.round("avg", 2).alias("avg"), F.round("peak", 2).alias("peak"), F.round("final", 2).alias("final"), F.round("factor", 3).alias("factor")).alias("production")).alias("career"))
    r = m.join(p, "pick_id").join(about, "matched", "left").join(listed.withColumnRenamed("player", "matched"), "matched", "left")
    r = r.withColumns({"comps": F.coalesce("comps", F.array().cast(listed.schema["comps"].dataType)), "_score": F.col("projection.projected_career")})
    r = ranked(r, "_score", "pick_id", by="position", out="model_pos_rank")
    r = ranked(r, "_score", "pick_id", out="model_overall_rank").drop("_score")
    r = r.join(consensus, ["name", "position"], "left")
    return r.withColumns({"delta_pos": F.col("pos_rank") - F.col("model_pos_rank"), "delta_overall": F.col("overall_rank") - F.col("model_overall_rank")})
