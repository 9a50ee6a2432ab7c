"""League and manager reports, and how well sources and projections foretold outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import expected_at_pick, weight_of_correlation
from .evaluation import correlation
from .order_stats import average_ranks
from .ranking import ranked


def top_assets(roster: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best scored players of each team."""
    w = Window.partitionBy("team").orderBy(F.desc("score"), "player")
    return roster.join(scores, "player").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def weaknesses(roster: DataFrame, tiers: DataFrame, positions: list[str], worst: int = 3) -> DataFrame:
    """Teams and positions whose best player is below the `worst` best tiers, or who have none."""
    teams = roster.select("team").distinct().withColumn("position", F.explode(F.array(*(F.lit(p) for p in positions))))
    best = roster.join(tiers, "player").groupBy("team", "position").agg(F.min("tier").alias("best_tier"))
    return teams.join(best, ["team", "position"], "left").where(F.col("best_tier").isNull() | (F.col("best_tier") > worst))


def league_report(roster: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per team: players, rated ones, total, mean of the rated, place, and distance from the mean team.

    by: the columns that tell leagues apart (platform and league, say), none for a single league.  Teams
    of one league are placed together: a league has some dozens."""
    g = roster.join(scores, "player", "left").groupBy(*by, "team").agg(F.count("*").alias("players"), F.count("score").alias("rated"), F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    g = g.withColumn("mean_score", F.when(F.col("rated") > 0, F.col("total") / F.col("rated")).otherwise(0.0))
    league = Window.partitionBy(*by)
    return g.withColumns({"power_rank": F.row_number().over(league.orderBy(F.desc("total"), "team")), "above_mean": F.col("total") - F.avg("total").over(league)})


def manager_report(teams: DataFrame, picks: DataFrame, deltas: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per team: what its picks scored over what their places promised, what its trades brought, both as
    standard scores among those of its league who have any, and their mean as skill.

    teams: team; picks: team, player, pick; deltas: team, delta (one row a trade's side); all with the
    columns `by` that tell leagues apart, none for a single league."""
    keys = [*by, "team"]
    d = picks.join(scores, "player").where(F.col("team").isNotNull())
    d = d.groupBy(*keys).agg(F.count("*").alias("n_picks"), F.avg(F.col("score") - expected_at_pick(F.col("pick"))).alias("draft_delta"))
    t = deltas.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.sum("delta").alias("trade_delta"))
    g = teams.join(d, keys, "left").join(t, keys, "left").fillna(0, ["n_picks", "n_trades"])
    league = Window.partitionBy(*by)  # some dozens of teams

    def z(value: str) -> Column:
        n, sd = F.count(value).over(league), F.stddev_pop(value).over(league)
        return F.when(F.col(value).isNull() | (n < 2), 0.0).otherwise((F.col(value) - F.avg(value).over(league)) / F.when(sd == 0, 1.0).otherwise(sd))

    g = g.withColumns({"z_draft": z("draft_delta"), "z_trade": z("trade_delta")})
    g = g.withColumn("skill", F.round((F.col("z_draft") + F.col("z_trade")) / 2.0, 9)).fillna(0.0, ["draft_delta", "trade_delta"])
    return g.withColumn("skill_rank", F.row_number().over(league.orderBy(F.desc("skill"), "team")))


def pick_details(picks: DataFrame, scores: DataFrame) -> DataFrame:
    """Each pick with what its place promised and by how much its player beat it; null for a player without a score."""
    expected = expected_at_pick(F.col("pick"))
    return picks.join(scores, "player", "left").withColumns({"expected": F.round(expected, 2), "delta": F.round(F.col("score") - expected, 2)})


def source_backtest(rows: DataFrame, by: list[str], rank: str, actual: str, item: str, least: int = 5) -> DataFrame:
    """Per source: n, Spearman (average ties), its square, mean error of ordinal ranks, and hits among
    the first 12 and 24; sources with fewer than `least` rows are left out, as are hits beyond n."""
    key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    r = ranked(rows.withColumns({"_group": key, "_low": -F.col(rank)}), "_low", item, by="_group", out="_s")
    r = ranked(r, actual, item, by="_group", out="_a")
    r = average_ranks(average_ranks(r, rank, by, "_x"), actual, by, "_y")
    hit = lambda k: F.when(F.count("*") >= k, F.count_if((F.col("_s") <= k) & (F.col("_a") <= k)) / F.lit(k))
    rho = correlation("_x", "_y")
    g = r.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"), F.avg(F.abs(F.col("_s") - F.col("_a"))).alias("mae"), hit(12).alias("hit12"), hit(24).alias("hit24"))
    return g.where(F.col("n") >= least).withColumn("r2", F.col("rho") * F.col("rho"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """Correlation; 0 for fewer than `least` rows or no spread."""
    none = (F.count("*") < least) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return rows.groupBy(*by).agg(F.when(none, 0.0).otherwise(correlation(x, y)).alias("r"), F.count("*").alias("n"))


def weighted(correlations: DataFrame, least: int) -> DataFrame:
    """Rows (position, null for all; n; r) with the weight that follows from r: the position's own where it
    has `least` rows, else that of all."""
    whole = correlations.where("position is null").select(F.col("r").alias("_all")).limit(1)
    r = correlations.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")  # one row
    own = F.when(F.col("n") >= least, F.col("r"))
    return r.withColumn("weight", weight_of_correlation(F.coalesce(own, "_all"))).drop("_all")


def differences(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Per key how many rows only one of two results of the same query has; rows are dealt out by key once."""
    both = a.select(*a.columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*a.columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    rows = both.repartition(by).groupBy(*a.columns).agg((F.sum("_a") - F.sum("_b")).alias("_more"))
    some = rows.where("_more <> 0").groupBy(by)
    return some.agg(F.sum(F.greatest("_more", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("_more"), F.lit(0))).alias("only_b"))
