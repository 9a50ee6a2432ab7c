"""Resolving identities across sources: cascades of left joins, first hit wins."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row per key: the first by `order`, or the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if last else F.col(order))
    return rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cascade(rows: DataFrame, steps: list[tuple[list[str], DataFrame]], found: str, out: str = "resolved") -> DataFrame:
    """Looks `rows` up by each step's columns in turn; each step's table has one row per key."""
    hits: list[Column] = []
    for k, (keys, lookup) in enumerate(steps):
        names = {c: f"_k{k}_{c}" for c in keys}
        table = lookup.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(found).alias(f"_hit{k}"))
        on = None
        for c, n in names.items():
            on = (F.col(c) == F.col(n)) if on is None else on & (F.col(c) == F.col(n))
        rows = rows.join(table, on, "left").drop(*names.values())
        hits.append(F.col(f"_hit{k}"))
    return rows.withColumn(out, F.coalesce(*hits)).drop(*(f"_hit{k}" for k in range(len(steps))))


def unique_only(rows: DataFrame, keys: list[str], found: str) -> DataFrame:
    """Keys with exactly one candidate."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(found).alias(found)).where("_n = 1").drop("_n")


def unique_cascade(rows: DataFrame, candidates: DataFrame, steps: list[list[str]], found: str, out: str = "resolved") -> DataFrame:
    """Only exactly one candidate counts; none or several fall through to the next step."""
    return cascade(rows, [(keys, unique_only(candidates, keys, found)) for keys in steps], found, out)


def nearest_season(rows: DataFrame, candidates: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """The candidate of the same keys whose season is nearest to row's; ties go to the later one.
    Each season of the keys is offered to the seasons around it once, so no row meets all candidates."""
    one = candidates.groupBy(*keys, "season").agg(F.min("id").alias("c_id"))
    near = one.select(*keys, "season", "c_id", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("_d"))
    near = near.groupBy(*keys, (F.col("season") + F.col("_d")).alias("season")).agg(F.min(F.struct(F.abs("_d").alias("delta"), "_d", "c_id")).alias("_near"))
    j = rows.join(near, [*keys, "season"], "left").withColumns({"c_id": F.col("_near.c_id"), "delta": F.col("_near.delta")})
    w = Window.partitionBy("row_id").orderBy(F.col("delta").asc_nulls_last(), F.desc(F.col("season") - F.col("_near._d")), "c_id")
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_near")


def merged_first_nonnull(tables: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Union of keys; for each column the first table's value that is not null."""
    parts = [t.select(*keys, F.lit(k).alias("_at"), *(F.col(c) if c in t.columns else F.lit(None).cast("double").alias(c) for c in columns)) for k, t in enumerate(tables)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in columns))


def combined_row(rows: DataFrame, key: str, team: str, order: str, pattern: str = r"^\d+TM$") -> DataFrame:
    """Of several rows per key the combined one (else the first), with the last single team."""
    is_all = F.col(team).rlike(pattern)
    g = rows.groupBy(key).agg(F.min_by(F.struct("*"), F.struct((~is_all).cast("int"), F.col(order))).alias("_row"), F.max_by(F.when(~is_all, F.col(team)), F.when(~is_all, F.col(order))).alias("recent_team"))
    return g.select("_row.*", "recent_team")


def fill_only(base: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Upsert that never overwrites: what is missing is filled, new keys are added."""
    u = update.select(key, *(F.col(c).alias(f"_u_{c}") for c in columns))
    return base.join(u, key, "full_outer").select(key, *(F.coalesce(c, f"_u_{c}").alias(c) for c in columns))


SKILL = ("QB", "RB", "WR", "TE")


def player_dimension(files: list[DataFrame], key: str, position: str, skill: tuple[str, ...] = SKILL) -> DataFrame:
    """One row per player of several files in turn, each with an `order` of its rows: the last one of a
    skill position, else the first."""
    both = files[0].withColumn("_at", F.struct(F.lit(0).alias("file"), F.col("order").cast("long").alias("row")))
    for k, f in enumerate(files[1:], 1):
        both = both.unionByName(f.withColumn("_at", F.struct(F.lit(k).alias("file"), F.col("order").cast("long").alias("row"))), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("order", "_at")]
    good = F.col(position).isin(*skill)
    row = F.struct(*columns)
    g = both.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.when(good, F.col("_at"))).alias("_good"), F.min_by(row, F.col("_at")).alias("_first"))
    return g.select(F.coalesce("_good", "_first").alias("_row")).select("_row.*")


def crosswalk_maps(rows: DataFrame, found: str, ids: list[str], name: str, order: str = "order") -> dict[str, DataFrame]:
    """A lookup for each id (the last row wins) and one for the name with its position (the first wins);
    rows without a usable id to find are left out."""
    usable = rows.where(F.col(found).isNotNull() & ~F.trim(F.upper(found)).isin("", "NA"))
    filled = lambda c: F.col(c).isNotNull() & ~F.trim(F.upper(c)).isin("", "NA")
    maps = {c: usable.where(filled(c)).groupBy(c).agg(F.max_by(found, order).alias(found)) for c in ids}
    maps[name] = usable.where(filled(name)).groupBy(name, "position").agg(F.min_by(found, order).alias(found))
    return maps


def imported(rankings: DataFrame, players: DataFrame, name: Column, keys: list[str], captured_at: str) -> tuple[DataFrame, DataFrame]:
    """(ranking rows stamped with captured_at, rows for players that `players` lacks): by the
    normalised name and the other keys."""
    stamped = rankings.withColumn("match_name", name).withColumn("captured_at", F.lit(captured_at).cast("timestamp"))
    new = stamped.select("match_name", *keys).distinct().join(players.select("match_name", *keys), ["match_name", *keys], "left_anti")
    return stamped, new


def synced(records: DataFrame, players: DataFrame, steps: list[list[str]], found: str, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with the player they resolve to, players with what was missing filled in, records that
    need a new player): each step's columns are tried in turn, the player with the least id first."""
    lookups = [(keys, players.where(functools.reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).agg(F.min(found).alias(found))) for keys in steps]
    out = cascade(records, lookups, found)
    known = out.where("resolved is not null")
    update = known.groupBy(F.col("resolved").alias(found)).agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))
    return out, fill_only(players, update, found, columns), out.where("resolved is null").drop("resolved")
