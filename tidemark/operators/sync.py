"""Records of many sources resolved to one table of players, which grows by what it lacks.

A record is looked up by each of its ids in turn, then by its name as written, then by its name in
normal form; by name it must have the position too if the record states one.  What is found nowhere
becomes a new player, filled from the record, and is there for the records that come after it.

This is done for all records at once, in rounds.  A record that is found takes its player, unless one
before it may still give a player an id that would be found first; one that isn't found becomes a player
if none before it shares an id or a name with it.  The others look again.  The first record left is always
settled, so rounds end; two or three are usual, since whoever waits for a record finds its player next."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .ranking import placed

IDS = ("sleeper_id", "gsis_id", "mfl_id")
FILLED = ("draft_year", "draft_round", "draft_pick_overall", "draft_team", "gsis_id", "pfr_id", "college", "nfl_team", "position")


def some(x: Column) -> Column:
    """Whether a value is there: neither null nor an empty text."""
    return x.isNotNull() & (x.cast("string") != "")


@dataclass
class Synced:
    records: DataFrame  #: each record with player_id, step (how it was found, or "created") and candidates
    players: DataFrame  #: all players, filled in
    created: int


def _lookup(players: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The least id of the players with each key, and how many there are."""
    usable = functools.reduce(lambda a, b: a & b, (some(F.col(k)) for k in keys))
    return players.where(usable).groupBy(*(F.col(k).alias(f"_{place}_{k}") for k in keys)).agg(F.min("player_id").alias(f"_{place}"), F.count("*").alias(f"_{place}_n"))


def _found(records: DataFrame, players: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Records with player_id, step and candidates, null where no step finds anyone."""
    has = F.coalesce(some(F.col("position")), F.lit(False))
    steps = [(i, [i], F.lit(True)) for i in ids] + [(f"{n}_{w}", [c, "position"] if w == "in_position" else [c], has if w == "in_position" else ~has) for n, c in (("name", "full_name"), ("normal_name", "normalized_name")) for w in ("in_position", "alone")]
    hits, out = [], records
    for place, keys, when in steps:
        table = _lookup(players, keys, place)
        on = functools.reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{place}_{k}") for k in keys))
        out = out.join(table, on, "left").drop(*(f"_{place}_{k}" for k in keys))
        label = place.removesuffix("_in_position").removesuffix("_alone")
        hits.append(F.when(when & F.col(f"_{place}").isNotNull(), F.struct(F.col(f"_{place}").alias("player_id"), F.lit(label).alias("step"), F.col(f"_{place}_n").alias("candidates"))))
    return out.withColumn("_hit", F.coalesce(*hits)).select(*records.columns, "_hit.*")


def _settled(hits: DataFrame, ids: Sequence[str], filled: Sequence[str], order: str) -> DataFrame:
    """The records that none before them can still change: those found, unless one before them may give
    a player an id that is looked up earlier, and those not found that share no id and no name with
    one before them."""
    out = hits
    lost = F.col("player_id").isNull()
    for k in [*ids, "normalized_name"]:
        # found players take over the ids that are filled; new players take over all
        gives = F.lit(True) if k in filled else lost
        first = hits.where(some(F.col(k)) & gives).groupBy(F.col(k).alias("_k")).agg(F.min(order).alias(f"_first_{k}"))
        out = out.join(first, F.col(k) == F.col("_k"), "left").drop("_k")
    free = lambda k: F.coalesce(F.col(f"_first_{k}") >= F.col(order), F.lit(True))
    before = F.coalesce(F.array_position(F.array(*(F.lit(i) for i in ids)), F.col("step")), F.lit(0))
    before = F.when(before == 0, len(ids) + 1).otherwise(before)  # by name: after all ids
    settled = functools.reduce(lambda a, b: a & b, (free(i) | (before <= n + 1) for n, i in enumerate(ids)), F.lit(True))
    leads = functools.reduce(lambda a, b: a & b, (free(k) for k in [*ids, "normalized_name"]))
    return out.where(F.when(lost, leads).otherwise(settled)).select(*hits.columns)


def _filled(players: DataFrame, found: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Players with what they lack from the first of their records that has it."""
    first = [F.min_by(c, F.when(some(F.col(c)), F.col(order))).alias(f"_u_{c}") for c in columns]
    update = found.groupBy("player_id").agg(*first)
    j = players.join(update, "player_id", "left")
    return j.select(*(F.when(some(F.col(c)), F.col(c)).otherwise(F.coalesce(f"_u_{c}", c)).alias(c) if c in columns else F.col(c) for c in players.columns))


def sync(records: DataFrame, players: DataFrame, normal: Callable[[Column], Column], ids: Sequence[str] = IDS, filled: Sequence[str] = FILLED, order: str = "order") -> Synced:
    """`records` (order, a number of its own for each; ids, full_name, position and what they may fill)
    resolved to `players` (player_id, ids, full_name, position, ...).

    Of several players that fit, the least id is taken, and candidates says how many there were.  New
    players get ids beyond the largest, in the order of their records, dealt out by counts of ranges: a
    task that is run again deals out the same.  A column that records or players lack is null there.
    A record without ids and name is a player of its own, called (unknown)."""
    columns = list(dict.fromkeys(["player_id", *ids, "full_name", "position", *filled, *players.columns]))
    kind = {f.name: f.dataType for f in [*records.schema.fields, *players.schema.fields]}
    missing = lambda df, c: F.lit(None).cast(kind.get(c, "string")).alias(c)
    own = players.withColumn("player_id", F.col("player_id").cast("long")).select(*(F.col(c) if c in players.columns else missing(players, c) for c in columns if c != "normalized_name"), normal(F.col("full_name")).alias("normalized_name"))
    wanted = [c for c in dict.fromkeys([order, *ids, "full_name", "position", *filled]) if c != "player_id"]
    rows = records.select(*(F.col(c) if c in records.columns else missing(records, c) for c in wanted), normal(F.col("full_name")).alias("normalized_name"))
    own, left = staged(own, "players"), staged(rows, "records")
    last, start = own.agg(F.max("player_id")).first()[0] or 0, left.agg(F.min(order)).first()[0] or 0
    parts, made = [], []
    while True:
        hits = staged(_found(left, own, ids), "hits")
        done = staged(_settled(hits, ids, filled, order), "settled")
        known, leads = done.where("player_id is not null"), done.where("player_id is null").select(*left.columns)
        own = staged(_filled(own, known, [c for c in filled if c in columns], order), "players")
        parts.append(known)
        if not leads.isEmpty():
            # ids in the order of records until all are known, so that the least id is the first player's
            new = leads.withColumn("player_id", (F.col(order).cast("long") + F.lit(last + 1 - start)).cast("long"))
            made.append(new.select("player_id"))
            parts.append(new.select(*left.columns, "player_id", F.lit("created").alias("step"), F.lit(0).cast("long").alias("candidates")))
            new = new.withColumn("full_name", F.when(some(F.col("full_name")), F.col("full_name")).otherwise("(unknown)"))
            own = staged(own.unionByName(new.select(*(F.col(c) if c in new.columns else missing(new, c) for c in own.columns))), "players")
        left = staged(left.join(done.select(order), order, "left_anti"), "records")
        if left.isEmpty():
            break
    resolved = functools.reduce(DataFrame.unionByName, parts)
    if not made:
        return Synced(resolved, own, 0)
    final = placed(functools.reduce(DataFrame.union, made), ["player_id"], out="_n")
    final = staged(final.select(F.col("player_id").alias("_old"), (F.col("_n") + F.lit(last)).alias("_new")), "ids")

    def numbered(df: DataFrame) -> DataFrame:
        j = df.join(final, F.col("player_id") == F.col("_old"), "left")
        return j.select(*(F.coalesce("_new", "player_id").cast(kind.get("player_id", "long")).alias("player_id") if c == "player_id" else F.col(c) for c in df.columns))

    return Synced(staged(numbered(resolved), "resolved"), staged(numbered(own), "players"), final.count())


def crosswalk(rows: DataFrame, players: DataFrame, steps: Sequence[Sequence[str]], foreign: str, positions: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with player_id and outcome, how often each outcome was).

    A step counts only if it has exactly one candidate; the last step that has several makes a row
    `ambiguous`, one without any `unmatched`.  A row whose player has its `foreign` id is `already_set`; one whose position isn't
    among `positions`, or that lacks its id, is `skipped`."""
    out = rows
    for k, keys in enumerate(steps):
        one = players.groupBy(*(F.col(c).alias(f"_k_{c}") for c in keys)).agg(F.count("*").alias(f"_n{k}"), F.min(F.struct("player_id", F.col(foreign).alias("own"))).alias(f"_p{k}"))
        on = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys))
        out = out.join(one, on, "left").drop(*(f"_k_{c}" for c in keys))
    hit = F.coalesce(*(F.when(F.col(f"_n{k}") == 1, F.col(f"_p{k}")) for k in range(len(steps))))
    skip = ~some(F.col(foreign)) if positions is None else ~some(F.col(foreign)) | ~F.coalesce(F.col("position").isin(*positions), F.lit(False))
    out = out.withColumn("_hit", F.when(~F.coalesce(skip, F.lit(True)), hit))
    outcome = F.when(F.coalesce(skip, F.lit(True)), "skipped").when(F.col("_hit.own").cast("string") == F.col(foreign).cast("string"), "already_set").when(F.col("_hit").isNotNull(), "matched").when(F.coalesce(F.col(f"_n{len(steps) - 1}"), F.lit(0)) > 1, "ambiguous").otherwise("unmatched")
    out = out.withColumn("outcome", outcome).select(*rows.columns, F.col("_hit.player_id").alias("player_id"), "outcome")
    return out, out.groupBy("outcome").count()
