"""How well a ranking foretold an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .order_stats import average_ranks, quantiles, top


def correlation(x: str, y: str) -> Column:
    """An aggregate; null without spread, where corr() would divide by zero."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 2) -> DataFrame:
    """Rank correlation with average ties; 0 for fewer than `least` rows or no spread."""
    rows = staged(rows.select(*by, x, y), "pairs")  # read three times
    r = average_ranks(average_ranks(rows, x, by, "_rx"), y, by, "_ry")
    rho = F.when((F.count("*") < least) | (F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0), 0.0).otherwise(correlation("_rx", "_ry"))
    return r.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


def hit_at_k(rows: DataFrame, predicted: str, actual: str, tie: str, by: list[str], k: int) -> DataFrame:
    """The share of the k predicted best that are among the k actual best.  Only those meet."""
    p = top(rows, by, [F.desc(predicted), tie], k, "_p").select(*by, tie)
    a = top(rows, by, [F.desc(actual), tie], k, "_a").select(*by, tie)
    hits = p.join(a, [*by, tie]).groupBy(*by).agg(F.count("*").alias("_hits"))
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return n.join(hits, by, "left").select(*by, (F.coalesce("_hits", F.lit(0)) / F.least(F.lit(k), F.col("_n"))).alias("hit_rate"))


def pair_wins(rows: DataFrame, model: str, other: str, actual: str, item: str, by: list[str], most: int = 5) -> DataFrame:
    """Of pairs close in the model's ranks on which the two rankings disagree, the share that the model
    has right.  Ranks are keys: each item meets the `most` ranks that follow it, not its whole group."""
    a = rows.select(*by, F.col(model).alias("ma"), F.col(other).alias("oa"), F.col(actual).alias("ya"), F.explode(F.sequence(F.col(model) + 1, F.col(model) + most)).alias("mb"))
    b = rows.select(*by, F.col(model).alias("mb"), F.col(other).alias("ob"), F.col(actual).alias("yb"))
    j = a.join(b, [*by, "mb"]).where((F.col("ya") != F.col("yb")) & (F.col("oa") > F.col("ob")))
    return j.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg((F.col("ya") > F.col("yb")).cast("double")).alias("model_share"))


def position_label(value: Column, seasons: Column, elite: Column, bust: Column, least: int = 3) -> Column:
    """A career's label by the cuts of its position."""
    return F.when(value >= elite, "elite").when((seasons >= least) & (value < bust), "bust").otherwise("unknown")


def class_backtest(rows: DataFrame, elite: float = 0.8, bust: float = 0.3, top_n: int = 50, out_of: int = 200, class_top: int = 10) -> tuple[DataFrame, DataFrame]:
    """How a projection did: (one row of figures, one row for each class).

    rows: player, position, class, projected, actual, value (what labels go by) and seasons.  Labels go by
    the quantiles of the position.  Figures: the share of the elite among the `top_n` projected best, the share of
    busts among the last `top_n` of the best `out_of`, and the correlation of ranks; for a class, how
    many of its `class_top` projected best became elite.  Only the first rows leave their tasks."""
    cuts = quantiles(rows, ["position"], "value", {"_elite": elite, "_bust": bust}).drop("_n")
    r = rows.join(cuts, "position", "left")
    r = staged(r.withColumn("label", position_label(F.col("value"), F.col("seasons"), F.col("_elite"), F.col("_bust"))).drop("_elite", "_bust"), "labelled")
    best = r.orderBy(F.desc("projected"), "player").limit(out_of)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("projected"), "player")))  # out_of rows
    n = F.count("*").over(Window.partitionBy())
    placed = placed.withColumn("_n", n)
    last = F.col("place") > F.col("_n") - top_n
    share = lambda kind, where: F.coalesce(F.try_divide(F.count_if(where & (F.col("label") == kind)), F.count_if(where)), F.lit(0.0))
    figures = placed.agg(share("elite", F.col("place") <= top_n).alias("hit"), share("bust", last).alias("bust"), F.count_if((F.col("place") <= top_n)).alias("hit_of"), F.count_if(last).alias("bust_of"))
    rho = spearman(r.withColumn("_all", F.lit(1)), "projected", "actual", ["_all"]).select("rho", F.col("n").alias("n_scored"))
    figures = figures.withColumn("_k", F.lit(1)).join(rho.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")  # a row each
    few = top(r, ["class"], [F.desc("projected"), "player"], class_top, "_place").groupBy("class").agg(F.count_if(F.col("label") == "elite").alias("top_elite"))
    return figures, r.groupBy("class").agg(F.count("*").alias("n_scored")).join(few, "class")


def appended(spark, figures: DataFrame, path: str, at: str) -> DataFrame:
    """The track record at `path` with these figures added under the time `at`; what was there stays."""
    figures.withColumn("run_at", F.lit(at).cast("timestamp")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def gate(value: Column, target: Column | float, higher: bool = True, soft: float = 0.05) -> Column:
    t = target if isinstance(target, Column) else F.lit(target)
    short = (t - value) / t if higher else (value - t) / t
    return F.when(short <= 0, "pass").when(short <= soft, "soft_fail").otherwise("hard_fail")


def position_and_overall(rows: DataFrame, value: str, by: str = "position") -> DataFrame:
    """One row per position and one with a null position over all, from one pass."""
    return rows.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
