"""A model's ranking beside an outside one, and what leagues and managers make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import z_scores


def compare(model: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """Inner rows with the difference of ranks (model less outside).  Duplicate outside rows keep the best rank."""
    best = outside.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("outside_rank").alias("outside_rank"))
    return model.join(best, key).withColumn("delta", F.col("model_rank") - F.col("outside_rank"))


def attached(model: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """Every row of the model, with the best outside rank of its key and the difference, null without one."""
    best = outside.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("outside_rank").alias("outside_rank"))
    return model.join(best, key, "left").withColumn("delta", F.col("model_rank") - F.col("outside_rank"))


def counts(model: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """Matched, only in the model, only outside: one full outer join."""
    m, o = model.select(key).distinct().withColumn("m", F.lit(1)), outside.where(F.col(key).isNotNull()).select(key).distinct().withColumn("o", F.lit(1))
    j = m.join(o, key, "full_outer")
    return j.agg(F.count_if(F.col("m").isNotNull() & F.col("o").isNotNull()).alias("matched"), F.count_if(F.col("o").isNull()).alias("model_only"), F.count_if(F.col("m").isNull()).alias("outside_only"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest snapshot of each key, by a combining aggregate rather than a sort."""
    newest = F.max_by(F.struct(*columns), F.struct(at, tie))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def roster_rollup(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """(team, position): total, rated, unrated and best player; unscored players count as unrated."""
    j = roster.join(scores, "player", "left")
    return j.groupBy("team", "position").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count("score").alias("rated"), F.count_if(F.col("score").isNull()).alias("unrated"), F.max_by("player", F.when(F.col("score").isNotNull(), F.struct("score", "player"))).alias("best"))


def power_ranks(teams: DataFrame, total: str, tie: str) -> DataFrame:
    """Teams of one league: rank by total and distance from the mean."""
    w = Window.orderBy(F.desc(total), tie)  # a league has some dozens of teams
    return teams.withColumn("power_rank", F.row_number().over(w)).withColumn("above_mean", F.col(total) - F.avg(total).over(Window.partitionBy()))


def trade_deltas(sides: DataFrame, scores: DataFrame) -> DataFrame:
    """sides: (trade, team, player received).  Each team's received score less what all others received."""
    got = sides.join(scores, "player", "left").groupBy("trade", "team").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("received"))
    whole = got.groupBy("trade").agg(F.sum("received").alias("all"))
    return got.join(whole, "trade").select("trade", "team", (F.col("received") * 2 - F.col("all")).alias("delta"))


def manager_skill(deltas: DataFrame) -> DataFrame:
    """Mean trade delta of each team and its standard score among all with trades."""
    g = deltas.groupBy("team").agg(F.count("*").alias("trades"), F.avg("delta").alias("mean_delta"))
    return z_scores(g.withColumn("_all", F.lit(1)), "mean_delta", ["_all"], "trade_z").drop("_all")
