"""Career vectors, nearest careers and what they project."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import inverse_distance, ratio0, squared_distance
from ..staging import staged
from .careers import by_season, strict_percentile, with_rate
from .order_stats import same_keys

V = [f"v{k}" for k in range(11)]


def vectors(seasons: DataFrame, long_arc: DataFrame, min_games: int = C.MIN_GAMES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (player, season): the 11 numbers that describe the career up to it.

    All come from windows over a player's seasons, so the seasons are shuffled once.
    `long_arc` holds the (position, stage, total) rows that percentiles are taken from; columns of seasons in `keep` pass."""
    upto = by_season().rowsBetween(Window.unboundedPreceding, 0)
    s = with_rate(seasons.where(F.col("games") >= min_games))
    s = s.withColumn("stage", F.row_number().over(by_season()).cast("long"))
    x = (F.col("stage") - 1).cast("double")
    s = s.withColumns(
        {
            "total": F.sum("points").over(upto),
            "all_games": F.sum("games").over(upto),
            "peak1": F.max("rate").over(upto),
            "three": F.when(F.col("stage") >= 3, ratio0(F.sum("points").over(by_season().rowsBetween(-2, 0)), F.sum("games").over(by_season().rowsBetween(-2, 0)))).otherwise(0.0),
            "two": ratio0(F.sum("points").over(by_season().rowsBetween(-1, 0)), F.sum("games").over(by_season().rowsBetween(-1, 0))),
            "sx": F.sum(x).over(upto),
            "sxx": F.sum(x * x).over(upto),
            "sy": F.sum("rate").over(upto),
            "sxy": F.sum(x * F.col("rate")).over(upto),
            "age1": F.lag("age", 1).over(by_season()),
            "rate1": F.lag("rate", 1).over(by_season()),
            "age2": F.lag("age", 2).over(by_season()),
            "rate2": F.lag("rate", 2).over(by_season()),
            "last_good": F.last(F.when(F.col("rate") != 0, F.col("rate")), ignorenulls=True).over(upto),
        }
    )
    n = F.col("stage").cast("double")
    s = s.withColumns(
        {
            "peak3": F.greatest(F.max("three").over(upto), "two", "rate", F.lit(0.0)),
            "slope": F.when(F.col("stage") > 1, F.round((n * F.col("sxy") - F.col("sx") * F.col("sy")) / (n * F.col("sxx") - F.col("sx") * F.col("sx")), 6)).otherwise(0.0),
            "back1": F.when(F.col("age1") == F.col("age") - 1, F.col("rate1")).otherwise(0.0),
            "back2": F.when(F.col("age1") == F.col("age") - 2, F.col("rate1")).when(F.col("age2") == F.col("age") - 2, F.col("rate2")).otherwise(0.0),
            "now": F.when(F.col("rate") != 0, F.col("rate")).otherwise(F.coalesce("last_good", F.lit(0.0))),
        }
    )
    s = strict_percentile(long_arc, s, ["position", "stage"], "total")
    v = [F.col("now"), F.lit(0.7) * F.col("back1"), F.lit(0.5) * F.col("back2"), ratio0("total", "all_games"), F.col("peak3"), F.col("peak1"), F.col("total") / 100.0, F.col("slope"), F.lit(10.0) * F.least(F.lit(1.0), F.col("all_games") / (F.lit(17.0) * n)), F.lit(30.0) * F.col("pct"), F.lit(0.5) * F.col("age")]
    return s.select("player", "position", "season", "age", "stage", *(c.cast("double").alias(name) for c, name in zip(v, V, strict=True)), *keep)


def snapshots(pool: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """For each candidate and age at which a target may meet it, the season to compare with: at that
    age, else a year before, else a year after; only if the candidate went on beyond that age.

    A career's n_seasons and max_age are in `spans` or, without it, in `pool`."""
    if spans is not None:
        pool = pool.select("player", "position", "season", "age", "stage", *V).join(spans.select("player", "n_seasons", "max_age"), "player")
    p = pool.select(F.col("player").alias("comp"), "position", F.col("season").alias("comp_season"), F.col("age").alias("comp_age"), F.col("stage").alias("comp_stage"), *(F.col(c).alias(f"c{c}") for c in V), F.col("n_seasons").alias("comp_seasons"), F.col("max_age").alias("comp_max_age"))
    p = p.repartition("comp")  # before each season becomes three
    p = p.withColumn("meets", F.explode(F.array(*(F.struct((F.col("comp_age") + d).alias("age"), F.lit(rank).alias("choice")) for d, rank in ((0, 0), (1, 1), (-1, 2))))))
    p = p.select("*", F.col("meets.age").alias("age"), F.col("meets.choice").alias("choice")).drop("meets").where(F.col("comp_max_age") > F.col("age"))
    first = Window.partitionBy("comp", "age").orderBy("choice")
    return p.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "choice", "comp_max_age")


def neighbours(targets: DataFrame, pool: DataFrame, spans: DataFrame | None = None, k: int = C.NEIGHBOURS, old_before: int | None = None, haircut: float = C.OLD_HAIRCUT, whole: int | None = None) -> DataFrame:
    """The k most similar careers of each target, by weighted inverse distance.

    targets: one vector row per player, with its n_seasons; pool: vector rows of candidates;
    spans: (player, n_seasons, max_age) of candidates, or None if pool has these.  A candidate must be as long (or 2 short of 9
    and more) and within one stage.  Each is offered once for each age and stage that it may meet, so
    position, age and stage are keys of an equi-join; distances are taken where pairs are made, and
    only identifiers and similarities go on to the ranking.

    A group of more than `whole` candidates (40 k if not given; below, cells save nothing) is searched in cells along the directions
    in which careers differ most (see `in_cells`), so a target meets those around it only; the result
    is the same.  Where there is such a group, targets that are equal are searched once: see `first_of_equals` and `kinds`."""
    return neighbours_by(targets, pool, spans, [old_before], k, haircut, whole)[0]


def neighbours_by(targets: DataFrame, pool: DataFrame, spans: DataFrame | None, cuts: Sequence[int | None], k: int = C.NEIGHBOURS, haircut: float = C.OLD_HAIRCUT, whole: int | None = None) -> list[DataFrame]:
    """`neighbours` for each `old_before` in `cuts`, from one search."""
    whole = 40 * k if whole is None else whole
    keys = ["position", "age", "stage"]
    p = staged(first_of_equals(snapshots(pool, spans), k + 1), "offers")
    p = p.withColumn("stage", F.explode(F.array(*(F.col("comp_stage") + d for d in (-1, 0, 1)))))
    need = F.when(F.col("n_seasons") >= 9, F.greatest(F.col("n_seasons") - 2, F.lit(3))).otherwise(F.greatest("n_seasons", F.lit(3)))
    t = targets.select("player", *keys, need.alias("need"), *V)
    may = F.col("comp_seasons") >= F.col("need")
    squared = squared_distance([(c, f"c{c}") for c in V], C.CAREER_WEIGHTS)
    raw = inverse_distance(squared, C.CAREER_SCALE)
    sims = [F.when(F.col("comp_season") < cut, raw * F.lit(haircut)).otherwise(raw) if cut is not None else raw for cut in cuts]
    pick = [*(F.col(c) for c in ("player", "comp", "comp_age", "comp_season")), raw.alias("raw_sim"), *(sim.alias(f"_sim{n}") for n, sim in enumerate(sims))]
    orders = [F.desc(f"_sim{n}") for n in range(len(sims))]
    ranks = rank_names(len(sims))

    def each(found: DataFrame, n: int, k: int) -> DataFrame:
        return found.where(F.col(ranks[n]) <= k).select("player", "comp", "comp_age", "comp_season", F.col(f"_sim{n}").alias("sim"), "raw_sim", F.col(ranks[n]).alias("rank"))

    once = (lambda df: staged(df, "found")) if len(sims) > 1 else (lambda df: df)
    sizes = p.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = staged(sizes.where(F.col("_n") > whole), "large")
    if large.isEmpty():
        found = once(first_by(t.join(p, keys).where(may & (F.col("player") != F.col("comp"))).select(*pick), orders, k))
        return [each(found, n, k) for n in range(len(sims))]
    own, members = kinds(t)
    small = first_by(own.join(large, keys, "left_anti").join(p.join(large, keys, "left_anti"), keys).where(may).select(*pick), orders, k + 1)
    own = own.join(large.select(*keys), keys, "left_semi")
    turn = directions(p.join(large, keys, "left_semi"), [f"c{v}" for v in V], C.CAREER_WEIGHTS)
    far = axes(p.join(large.select(*keys), keys, "left_semi"), [f"c{v}" for v in V], turn, "_c")
    near = axes(own, V, turn, "_t")
    held = far.groupBy(*keys, "comp_seasons").count().groupBy(*keys).agg(F.collect_list(F.struct("comp_seasons", "count")).alias("_held"))  # a career is bounded
    enough = F.aggregate(F.filter("_held", lambda h: h["comp_seasons"] >= F.col("need")), F.lit(0).cast("long"), lambda n, h: n + h["count"])
    near = near.join(held, keys).withColumn("_need", F.least(F.lit(k + 1), enough)).drop("_held").where("_need > 0")
    found = once(small.unionByName(in_cells(near, far, keys, len(turn), k + 1, may, pick, orders, [beyond(sim, C.CAREER_SCALE) for sim in sims])))
    columns = ["player", "comp", "comp_age", "comp_season", "sim", "raw_sim", "rank"]
    return [for_members(each(found, n, k + 1), members, k).select(*columns) for n in range(len(sims))]


def rank_names(n: int) -> list[str]:
    return ["rank", *(f"rank{k}" for k in range(1, n))]


def first_by(pairs: DataFrame, orders: Sequence[Column], k: int) -> DataFrame:
    """Pairs among the first k of their player by one of the orders, ties by comp, with their place by each: rank, rank1, ..."""
    places = {c: F.row_number().over(Window.partitionBy("player").orderBy(order, "comp")) for c, order in zip(rank_names(len(orders)), orders, strict=True)}
    return pairs.withColumns(places).where(functools.reduce(lambda a, b: a | b, (F.col(c) <= k for c in places)))


def first_of_equals(offers: DataFrame, k: int) -> DataFrame:
    """Of offers that are equal in all but `comp` the k with the least: ties go by comp, so no other is among the
    first k of any target."""
    equals = Window.partitionBy(*(c for c in offers.columns if c != "comp")).orderBy("comp")
    return offers.withColumn("_at", F.row_number().over(equals)).where(F.col("_at") <= k).drop("_at")


def kinds(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that are equal in all but `player` find the same, but for themselves: (one row for each kind of
    target, under its least player; each player with its kind)."""
    t = staged(targets, "targets")
    like = [c for c in t.columns if c != "player"]
    own = staged(t.groupBy(*like).agg(F.min("player").alias("player")), "kinds")
    named = [f"_g{n}" for n in range(len(like))]
    of = own.select(F.col("player").alias("_kind"), *(F.col(c).alias(n) for c, n in zip(like, named, strict=True)))
    return own, t.join(of, same_keys(like, named)).select("player", "_kind")


def for_members(found: DataFrame, members: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """What was found for each kind, for all of its members: the first k but themselves, or all if these are `apart`.

    found: player (the kind), comp, others and rank, k + 1 rows a kind at most, itself not left out."""
    columns = [c for c in found.columns if c not in ("player", "rank")]
    lists = found.groupBy(F.col("player").alias("_kind")).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_list"))
    others = F.slice(F.col("_list") if apart else F.filter("_list", lambda x: x["comp"] != F.col("player")), 1, k)
    e = members.join(lists, "_kind").select("player", F.posexplode(others).alias("_at", "_e"))
    return e.select("player", *(F.col("_e")[c].alias(c) for c in columns), (F.col("_at") + 1).alias("rank"))


def nearest(targets: DataFrame, offers: DataFrame, keys: list[str], weights: Mapping[str, float], k: int, may: Column, pick: list[str], whole: int | None = None, apart: bool = False) -> DataFrame:
    """The k offers but itself nearest to each target by weighted Euclidean distance, ties by comp: `pick`, distance, rank.
    With `apart` no target is among the offers, and players need not be comps.

    targets: keys, player and a column t_{c} for each weighted c; offers: keys, comp and the columns
    themselves, of equal ones k + 1 at least.  Groups of more than `whole` offers (40 k if not given) are searched
    in cells; where there are such groups, once for all targets that are equal in all but their player."""
    whole = 40 * k if whole is None else whole
    distance = F.sqrt(squared_distance([(f"t_{c}", c) for c in weights], weights.values()))
    pick = [*(F.col(c) for c in pick), distance.alias("distance")]
    order = F.col("distance")
    sizes = offers.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = staged(sizes.where(F.col("_n") > whole), "large")
    if large.isEmpty():
        return first_by(targets.join(offers, keys).where(may if apart else may & (F.col("player") != F.col("comp"))).select(*pick), [order], k)
    offers = staged(offers, "offers")
    own, members = kinds(targets)
    small = first_by(own.join(large, keys, "left_anti").join(offers.join(large, keys, "left_anti"), keys).where(may).select(*pick), [order], k + 1)
    far = offers.join(large.select(*keys), keys, "left_semi")
    turn = directions(far, list(weights), list(weights.values()), min(3, len(weights)))
    t = axes(own.join(large, keys), [f"t_{c}" for c in weights], turn, "_t").withColumn("_need", F.least(F.lit(k + 1), "_n")).drop("_n")
    found = in_cells(t, axes(far, list(weights), turn, "_c"), keys, len(turn), k + 1, may, pick, order, distance)
    return for_members(small.unionByName(found), members, k, apart).select(*small.columns)


def beyond(sim: Column, scale: float, most: float = 1.0) -> Column:
    """The distance from which on no inverse distance, times `most` at best, is more than sim."""
    return F.lit(scale) * (F.lit(most) / sim - F.lit(1.0)) + F.lit(1e-9)


def directions(rows: DataFrame, columns: list[str], weights, n: int = 3) -> list[list[float]]:
    """Factors by which the columns add up along the n orthogonal directions in which rows, under the
    weights, differ most.  The driver gets one row of fixed size."""
    y = [F.col(c) * F.lit(float(w) ** 0.5) for c, w in zip(columns, weights, strict=True)]
    d = len(y)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.agg(*(F.coalesce(F.avg(x), F.lit(0.0)) for x in y), *(F.coalesce(F.avg(y[i] * y[j]), F.lit(0.0)) for i, j in pairs)).first()
    mean, spread = np.array(got[:d]), np.zeros((d, d))
    for (i, j), v in zip(pairs, got[d:], strict=True):
        spread[i, j] = spread[j, i] = v
    _, basis = np.linalg.eigh(spread - np.outer(mean, mean))
    return [[float(b) * float(w) ** 0.5 for b, w in zip(basis[:, -1 - k], weights, strict=True)] for k in range(min(n, d))]


def axes(rows: DataFrame, columns: list[str], turn: list[list[float]], prefix: str) -> DataFrame:
    """`rows` with their place along each direction.  Along none are two rows farther apart than they are."""
    return rows.withColumns({f"{prefix}{k}": sum((F.col(c) * F.lit(f) for c, f in zip(columns, factors, strict=True)), F.lit(0.0)) for k, factors in enumerate(turn)})


def in_cells(targets: DataFrame, pool: DataFrame, keys: list[str], dims: int, k: int, may: Column, pick: list[Column], order: Column | list[Column], radius: Column | list[Column]) -> DataFrame:
    """The first k of each target among the rows of `pool` with its keys that it `may` meet: `pick`, by
    `order` and then comp, with their rank.

    targets: keys, player, _need (how many there are to find, k at most), _t0, _t1, ...; pool: keys, comp,
    _c0, _c1, ...: places along axes on which no two rows are farther apart than they are; radius: of a pair,
    a distance beyond which no row comes before it, and not less than its own.  With several orders and
    their radii: what is among the first k by one of them, with its rank by each (see `first_by`).

    Space is cut into cells, and twice as wide ones, and so on until one holds its group.  A target first
    meets the smallest cell around it that holds enough rows; the _need-th radius there bounds what
    it looks for, and then it meets the cells within that bound.  How wide cells are thus follows the rows
    around each target, and rounds are bounded by the logarithm of the group's extent."""
    orders, radii = (x if isinstance(x, list) else [x] for x in (order, radius))
    widest, narrowest = (f(*radii) if len(radii) > 1 else radii[0] for f in (F.greatest, F.least))
    axis = range(dims)
    x = [f"_x{a}" for a in axis]
    size = functools.reduce(lambda p, q: p * q, (F.greatest(f"_s{a}", F.lit(1e-6)) for a in axis))
    extent = F.greatest(F.lit(1e-6), *(F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in axis))
    ends = [f(f"_c{a}").alias(f"_{n}{a}") for a in axis for n, f in (("lo", F.min), ("hi", F.max), ("s", F.stddev_pop))]
    groups = pool.groupBy(*keys).agg(F.count("*").alias("_n"), *ends)
    groups = groups.withColumn("_w", F.greatest(F.pow(F.lit(float(k)) * size / F.col("_n"), F.lit(1.0 / dims)), extent * F.lit(2.0**-30)))
    groups = groups.withColumn("_top", (F.greatest(F.lit(0.0), F.ceil(F.log2(extent / F.col("_w")))) + 1).cast("int"))
    groups = staged(groups.drop("_n", *(f"_s{a}" for a in axis)), "groups")
    cell = lambda v, a: F.floor((F.greatest(f"_lo{a}", F.least(f"_hi{a}", v)) - F.col(f"_lo{a}")) / F.col("_w"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    wider = lambda df: df.withColumns({c: up(c) for c in x})
    fine = pool.join(groups, keys).withColumns({c: cell(F.col(f"_c{a}"), a) for a, c in enumerate(x)})
    fine = staged(fine.drop("_w", "_top", *(f"_{n}{a}" for a in axis for n in ("lo", "hi"))), "fine")
    left = targets.join(groups, keys).withColumns({c: cell(F.col(f"_t{a}"), a) for a, c in enumerate(x)})
    left = staged(left, "left")
    # the smallest cell with enough rows, told by counts of cells
    levels = F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_level")
    counts = fine.groupBy(*keys, *x).count().join(groups.select(*keys, "_top"), keys).select(*keys, *x, "count", levels)
    counts = wider(counts).groupBy(*keys, "_level", *x).agg(F.sum("count").alias("_n")).where(F.col("_n") >= 2 * k + 1)
    own = left.select(*keys, *x, "_top").distinct().select(*keys, *(F.col(c).alias(f"_f{c}") for c in x), *x, levels)
    start = wider(own).join(counts, [*keys, "_level", *x]).groupBy(*keys, *(F.col(f"_f{c}").alias(c) for c in x)).agg(F.min("_level").alias("_level"))
    left = staged(left.join(start, [*keys, *x], "left").withColumn("_level", F.coalesce("_level", "_top")), "left")

    on = [*keys, "_level", *x]
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes make many pairs: both sides are dealt out by number, not by size, and none is broadcast
    met = lambda a, b: a.repartition(parts, *on).hint("merge").join(b.repartition(parts, *on), on)

    def at_levels(t: DataFrame) -> DataFrame:
        return wider(fine.join(t.select(*keys, "_level").distinct(), keys))

    bounds: list[DataFrame] = []
    while not left.isEmpty():
        e = met(wider(left), at_levels(left)).where(may)
        nearest_of = Window.partitionBy(*on, "player").orderBy("_radius")  # as the join has dealt them out
        e = e.select(*on, "player", "_need", widest.alias("_radius")).withColumn("_rn", F.row_number().over(nearest_of)).where(F.col("_rn") <= k)
        b = left.join(e.where("_rn = _need").select("player", F.col("_radius").alias("_bound")), "player", "left")
        b = staged(b.withColumn("_bound", F.coalesce("_bound", F.when(F.col("_level") >= F.col("_top"), F.lit(1e300)))), "bounds")
        bounds.append(b.where("_bound is not null"))
        left = b.where("_bound is null").drop("_bound").withColumn("_level", F.col("_level") + 1)
    if not bounds:
        return first_by(targets.join(pool, keys).select(*pick), orders, k).limit(0)
    t = functools.reduce(DataFrame.unionByName, bounds).withColumn("_bound", F.col("_bound") * F.lit(1 + 1e-9) + F.lit(1e-9))
    t = t.withColumn("_level", F.least(F.col("_top"), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_bound") / F.col("_w"))).cast("int"))))
    near = at_levels(t)
    for a, c in enumerate(x):
        end = lambda v, a=a: F.floor(cell(v, a) / F.pow(F.lit(2.0), F.col("_level")))
        t = t.withColumn(c, F.explode(F.sequence(end(F.col(f"_t{a}") - F.col("_bound")), end(F.col(f"_t{a}") + F.col("_bound")))))
    t = t.drop("_w", "_top", "_need", *(f"_{n}{a}" for a in axis for n in ("lo", "hi")))
    close = functools.reduce(lambda p, q: p & q, (F.abs(F.col(f"_t{a}") - F.col(f"_c{a}")) <= F.col("_bound") for a in axis))
    return first_by(met(t, near).where(close & may & (narrowest <= F.col("_bound"))).select(*pick), orders, k)


def nearest_before(rows: DataFrame, weights: dict[str, float], k: int, by: str = "position", order: str = "last_season") -> DataFrame:
    """For every row the k nearest rows (weighted Euclidean distance, ties by player) of its group whose
    `order` is lower; fewer where there are fewer.

    Searched in cells along the directions in which rows differ most, see `in_cells`: exact, and no row
    meets its whole group.  Rows that are equal but for their player search once, and the k least of them are
    found.  Rows with a coordinate that is null or not finite are left out on both sides."""
    rows = rows.where(functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in weights)))
    rows = staged(rows.select("player", by, order, *(F.col(c).cast("double").alias(c) for c in weights)), "rows")
    times = rows.groupBy(by, order).count()
    below = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = times.select(by, order, F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_earlier"))  # a row a group and season
    turn = directions(rows, list(weights), list(weights.values()), min(3, len(weights)))
    own, members = kinds(rows)
    t = own.join(earlier, [by, order]).where("_earlier > 0").withColumn("_need", F.least(F.lit(k), "_earlier"))
    t = axes(t, list(weights), turn, "_t").select("player", by, F.col(order).cast("long").alias("_at"), "_need", *(F.col(c).alias(f"t_{c}") for c in weights), *(f"_t{a}" for a in range(len(turn))))
    # a row is offered to each later season there is, so that cells follow the rows a target may meet
    later = times.groupBy(by).agg(F.sort_array(F.collect_set(F.col(order).cast("long"))).alias("_later"))  # a group's seasons
    c = axes(first_of_equals(rows.withColumnRenamed("player", "comp"), k), list(weights), turn, "_c").join(later, by)
    c = c.withColumn("_at", F.explode(F.filter("_later", lambda at: at > F.col(order)))).drop("_later", order)
    distance = F.sqrt(squared_distance([(f"t_{x}", x) for x in weights], weights.values()))
    found = in_cells(t, c, [by, "_at"], len(turn), k, F.lit(True), [F.col("player"), F.col("comp"), distance.alias("distance")], F.col("distance"), distance)
    return for_members(found, members, k).select("player", "comp", "distance", "rank")


def comp_projection(edges: DataFrame, futures: DataFrame) -> DataFrame:
    """Similarity-weighted mean of what the neighbours went on to make, and the best of them."""
    e = edges.join(futures.select(F.col("player").alias("comp"), F.col("snapshot_age").alias("comp_age"), "future_points", "future_seasons"), ["comp", "comp_age"], "left")
    return e.select("player", "sim", "future_points", "future_seasons").repartition("player").groupBy("player").agg(*projection_sums())


def projection_sums() -> list[Column]:
    """`comp_projection` as aggregates over a target's neighbours, with future_points and future_seasons (null: none)."""
    pts, yrs = F.coalesce("future_points", F.lit(0.0)), F.coalesce("future_seasons", F.lit(0))
    w = F.sum("sim")
    w = F.when(w == 0, F.lit(1.0)).otherwise(w)
    return [(F.sum(F.col("sim") * pts) / w).alias("comp_mean"), (F.sum(F.col("sim") * yrs) / w).alias("years"), F.max(pts).alias("best_comp"), F.count("*").alias("n_comps")]


def blended(rows: DataFrame, bars: dict[str, float] | float) -> DataFrame:
    """Comps' mean blended 60/40 with an anchor for the elite, over a soft band below the bar.

    rows: comp_mean, years, best_comp, n_comps, recent3, peak3, position."""
    bar = F.lit(float(bars)) if not isinstance(bars, dict) else F.coalesce(*(F.when(F.col("position") == p, F.lit(b)) for p, b in bars.items()), F.lit(15.0))
    level = F.greatest(F.lit(1.1) * F.col("recent3"), F.lit(0.9) * F.col("peak3"))
    anchor = F.when(F.col("n_comps") >= C.BLEND_COMPS, level * F.lit(float(C.SEASON_GAMES)) * F.col("years") * F.pow(F.lit(1 - C.DISCOUNT), F.col("years") / 2.0)).otherwise(0.0)
    anchor = F.least(anchor, F.lit(C.BLEND_CAP) * F.col("best_comp"))
    share = F.lit(0.4) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("recent3") - (bar - C.BLEND_BAND)) / F.lit(C.BLEND_BAND)))
    mixed = F.col("comp_mean") * (F.lit(1.0) - share) + anchor * share
    return rows.withColumns({"anchor": anchor, "projection": F.when(anchor > F.col("comp_mean"), mixed).otherwise(F.col("comp_mean"))})
