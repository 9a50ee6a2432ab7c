"""First seasons: profiles, the most alike first seasons of others, and what those went on to make."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import clip, inverse_distance, squared_distance
from ..functions.rules import breakout_bonus, recency_bonus
from ..staging import staged
from .careers import by_season
from .similarity import axes, beyond, directions, first_by, first_of_equals, for_members, in_cells, kinds


def profiles(seasons: DataFrame, stats: Sequence[str], rate: float = C.DISCOUNT) -> DataFrame:
    """One row per player: the first season, its stats per game, and the points of later seasons, plain
    and discounted.  All come from one partitioning by player."""
    n = F.row_number().over(by_season()) - 1
    s = seasons.withColumn("_n", n)
    first, later = F.col("_n") == 0, F.col("_n") > 0
    kept = ["position", "season", "age", "games", "rate", *stats]
    g = s.groupBy("player").agg(
        F.max(F.when(first, F.struct(*kept))).alias("_first"),
        F.coalesce(F.sum(F.when(later, F.col("points"))), F.lit(0.0)).alias("later"),
        F.coalesce(F.sum(F.when(later, F.col("points") * F.pow(F.lit(1 - rate), (F.col("_n") - 1).cast("double")))), F.lit(0.0)).alias("later_discounted"),
        F.count_if(later).alias("later_seasons"),
    )
    g = g.select("player", "_first.*", "later", "later_discounted", "later_seasons")
    games = F.greatest("games", F.lit(1))
    return g.withColumns({"played": games / F.lit(float(C.SEASON_GAMES)), **{f"{c}_pg": F.col(c) / games for c in stats}})


ROOKIE_STATS = ("passing_yards", "rushing_yards", "receiving_yards", "passing_tds", "rushing_tds", "receiving_tds")
CODES = {"QB": 1.0, "RB": 2.0, "WR": 3.0, "TE": 4.0}
ROOKIE_VECTOR = ("rate", "played", *(f"{s}_pg" for s in ROOKIE_STATS), "completion_rate", "age", "position_code")


def corpus(seasons: DataFrame, debuts: DataFrame | None = None, stats: Mapping[str, str] | None = None, codes: Mapping[str, float] = CODES, min_games: int = C.MIN_GAMES, first_season: int = 1999, left_out: Sequence[int] = (), later_needed: bool = False, min_seasons: int = 0, rate: float = C.DISCOUNT) -> DataFrame:
    """One row per player whose first season is known and long enough: the 11 numbers of ROOKIE_VECTOR, and
    what came later, plain and discounted; those who washed out after it are in, with nothing.

    seasons: player, position, season, age, games, points and stats (name in ROOKIE_STATS, or
    completion_rate -> column; what isn't named is 0).  debuts: player, debut: a player's real first season;
    where it is earlier than `first_season`, or not among the seasons, the player is left out.  A player
    without a debut starts with the earliest season.  Classes in `left_out` are not candidates."""
    named = stats or {}
    s = seasons.where(F.col("position").isin(*codes))
    s = s.join(debuts.select("player", F.col("debut").alias("_debut")), "player", "left") if debuts is not None else s.withColumn("_debut", F.lit(None).cast("int"))
    own = by_season()
    first = F.coalesce("_debut", F.min("season").over(Window.partitionBy("player")))
    s = s.withColumn("_first", first)
    at, later = F.col("season") == F.col("_first"), F.col("season") > F.col("_first")
    s = s.withColumn("_k", F.sum(F.when(later, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    kept = ["position", "season", "age", "games", "points", *dict.fromkeys(named.values())]
    g = s.groupBy("player").agg(
        F.max(F.when(at, F.struct(*kept))).alias("_own"), F.any_value("_debut").alias("_debut"),
        F.coalesce(F.sum(F.when(later, F.col("points"))), F.lit(0.0)).alias("later"),
        F.coalesce(F.sum(F.when(later, F.col("points") * F.pow(F.lit(1 - rate), F.col("_k").cast("double")))), F.lit(0.0)).alias("later_discounted"),
        F.count_if(later).alias("later_seasons"), F.count_if(F.col("games") >= min_games).alias("n_seasons"),
    )
    g = g.where("_own is not null").select("player", "_own.*", "later", "later_discounted", "later_seasons", "n_seasons", "_debut")
    g = g.where((F.coalesce("_debut", F.lit(first_season)) >= first_season) & (F.col("games") >= min_games) & (F.col("n_seasons") >= min_seasons))
    if left_out:
        g = g.where(~F.col("season").isin(*left_out))
    if later_needed:
        g = g.where("later_seasons > 0")
    games = F.greatest("games", F.lit(1))
    of = lambda k: F.coalesce(F.col(named[k]).cast("double"), F.lit(0.0)) if k in named else F.lit(0.0)
    code = F.coalesce(*(F.when(F.col("position") == p, F.lit(v)) for p, v in codes.items()), F.lit(0.0))
    vector = {"rate": F.col("points") / games, "played": games / F.lit(float(C.SEASON_GAMES)), **{f"{k}_pg": of(k) / games for k in ROOKIE_STATS}, "completion_rate": of("completion_rate"), "position_code": code}
    return g.withColumns(vector).select("player", "position", "season", "games", *ROOKIE_VECTOR, "later", "later_discounted", "later_seasons")


def dispatched(careers: DataFrame, current: int) -> Column:
    """Which engine a career goes to: one completed season, begun lately, is a rookie's."""
    return F.when((F.col("n_seasons") == 1) & (F.col("first_season") >= current - 1), "rookie").otherwise("cumulative")


def neighbours(targets: DataFrame, corpus: DataFrame, weights: Mapping[str, float], k: int = C.ROOKIE_NEIGHBOURS, window: int = 2, scale: float = C.ROOKIE_SCALE, first: int = 2015, last: int = 2022, whole: int | None = None) -> DataFrame:
    """The k first seasons of the same position that are most alike, within `window` years of age, or one
    more if fewer than k are; ranked with a bonus for what came later and for lateness.  A target of few
    games gets no bonus for what came later.

    How many candidates are near is counted by position and age.  A candidate is offered once for each age at
    which it may be met, so position and age are keys of an equi-join; groups of more than `whole` offers (40 k
    if not given) are searched in cells, where the largest bonus there can be says what a cell leaves out; where
    there are such groups, once for all targets that are equal in all but their player."""
    whole = 40 * k if whole is None else whole
    keys = ["position", "age"]

    def near(reach: int, out: str) -> DataFrame:
        at = corpus.groupBy(*keys).count().select("position", F.explode(F.sequence(F.col("age") - reach, F.col("age") + reach)).alias("age"), "count")
        return at.groupBy(*keys).agg(F.sum("count").alias(out))

    t = targets.select("player", *keys, F.col("games").alias("t_games"), *(F.col(c).alias(f"t_{c}") for c in weights))
    t = t.join(near(window, "n_near"), keys, "left").join(near(window + 1, "_wider"), keys, "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "_wider": F.coalesce("_wider", F.lit(0))})
    t = t.withColumn("reach", F.when(F.col("n_near") < k, F.lit(window + 1)).otherwise(F.lit(window)))
    c = corpus.select(F.col("player").alias("comp"), "position", F.col("age").alias("c_age"), F.col("season").alias("comp_season"), *(F.col(x).alias(f"c_{x}") for x in weights if x != "age"), "later", "later_discounted", "later_seasons")
    c = staged(first_of_equals(c, k + 1), "offers").withColumn("age", F.explode(F.sequence(F.col("c_age") - window - 1, F.col("c_age") + window + 1)))
    may = F.abs(F.col("c_age") - F.col("age")) <= F.col("reach")
    raw = inverse_distance(squared_distance([(f"t_{x}", f"c_{x}") for x in weights], weights.values()), scale)
    bonus = F.when(F.col("t_games") >= C.LIMITED_GAMES, breakout_bonus(F.col("later"))).otherwise(1.0) * recency_bonus(F.col("comp_season"), first, last)
    pick = [F.col(x) for x in ("player", "comp", "n_near", "later", "later_discounted", "later_seasons")] + [raw.alias("raw"), F.round(raw * bonus, 9).alias("sim")]
    large = staged(c.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > whole), "large")
    if large.isEmpty():
        return first_by(t.join(c, keys).where(may & (F.col("player") != F.col("comp"))).select(*pick), [F.desc("sim")], k)
    own, members = kinds(t)
    small = first_by(own.join(large, keys, "left_anti").join(c.join(large, keys, "left_anti"), keys).where(may).select(*pick), [F.desc("sim")], k + 1)
    far = c.join(large.select(*keys), keys, "left_semi")
    turn = directions(far, [f"c_{x}" for x in weights], list(weights.values()), min(3, len(weights)))
    some = axes(own.join(large.select(*keys), keys, "left_semi"), [f"t_{x}" for x in weights], turn, "_t")
    some = some.withColumn("_need", F.least(F.lit(k + 1), F.when(F.col("reach") > window, F.col("_wider")).otherwise(F.col("n_near")))).drop("_wider")
    most = far.agg(F.max(breakout_bonus(F.col("later")) * recency_bonus(F.col("comp_season"), first, last)), F.max(recency_bonus(F.col("comp_season"), first, last))).first()
    most = float(max(most[0] or 1.0, most[1] or 1.0, 1.0))
    found = in_cells(some, axes(far, [f"c_{x}" for x in weights], turn, "_c"), keys, len(turn), k + 1, may, pick, F.desc("sim"), beyond(F.greatest(F.round(raw * bonus, 9) - F.lit(1e-9), F.lit(1e-12)), scale, most))
    return for_members(small.unionByName(found), members, k).select(*small.columns)


def projection(targets: DataFrame, edges: DataFrame, by_position: Mapping[str, tuple[float, float]], default: tuple[float, float] = C.ROOKIE_CAREER) -> DataFrame:
    """Comps' discounted later points, blended 70/30 with the own rate over a position's expected career
    where that is more (capped by the best comp's plain points), shrunk by few games.

    by_position: position -> (expected seasons, discount).  A target without comps has 0 throughout."""
    w = F.sum("sim")
    w = F.when(w == 0, F.lit(1.0)).otherwise(w)
    g = edges.groupBy("player").agg((F.sum(F.col("sim") * F.col("later_discounted")) / w).alias("comp_mean"), F.max("later").alias("_best"), F.count("*").alias("n_comps"), (F.count_if(F.col("later") <= 0) / F.count("*")).alias("bust_rate"))
    pick = lambda k: F.coalesce(*(F.when(F.col("position") == p, F.lit(v[k])) for p, v in by_position.items()), F.lit(default[k]))
    r = targets.join(g, "player", "left").fillna(0, ["comp_mean", "_best", "n_comps", "bust_rate"])
    some = F.col("n_comps") > 0
    anchor = F.when(some, F.col("rate") * F.lit(float(C.SEASON_GAMES)) * pick(0) * pick(1)).otherwise(0.0)
    capped = F.when(F.col("_best") > 0, F.least(F.col("anchor"), F.lit(C.BLEND_CAP) * F.col("_best"))).otherwise(F.col("anchor"))
    share = F.lit(C.ROOKIE_COMPS_SHARE)
    r = r.withColumn("anchor", anchor).withColumn("_capped", capped)
    r = r.withColumn("confidence", F.when(some, clip(F.col("games") / F.lit(C.ROOKIE_FULL_GAMES), C.ROOKIE_FLOOR, 1.0)).otherwise(0.0))
    base = F.when(F.col("_capped") > F.col("comp_mean"), share * F.col("comp_mean") + (F.lit(1.0) - share) * F.col("_capped")).otherwise(F.col("comp_mean"))
    return r.withColumns({"projection": base * F.col("confidence"), "years": pick(0) * F.col("confidence")}).drop("_best", "_capped")
