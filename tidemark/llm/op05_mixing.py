"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times that its documents must appear, on average, for the mix
to reach the source's target share.  A uniform number hashed from seed and document is put
through the inverse of the Poisson distribution with that rate; the document is repeated so
many times, and all copies are dealt out and sorted by a hash of seed, document and copy.

Cases: a null source is a source of its own, and so is the empty name; a null or empty text
counts one character, so that no size is zero; repeated rows are drawn alike and stay together
in count; a null id is drawn like the text "null".  A source without a target weight has
rate zero.  An empty table gives an empty result.  Columns of the input stay, but one named like
an added column is replaced by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, staged

SEED = 17
TEMPER = 0.7
EPOCHS = 1.0
FEW_SOURCES = 50_000  # a table of so many sources' rates is broadcast, a larger one is joined by shuffle


def uniform(*parts: Column) -> Column:
    """48 bits of a hash as a number between 0 and 1, ends excluded."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str | None, float] | None, temper: float, epochs: float) -> DataFrame:
    """_source, _rate and _cdf (ascending, from 0 repeats on) of each source."""
    size = F.greatest(F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(1)).cast("double")
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("_source")).agg(F.sum(size).alias("_size"))
    if weights is None:
        wanted = sizes.withColumn("_want", F.pow("_size", F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_named string, _want double")
        wanted = sizes.join(given, F.col("_source").eqNullSafe(F.col("_named")), "left").drop("_named").fillna(0.0, ["_want"])
    total = wanted.agg(F.sum("_size").alias("_all"), F.sum("_want").alias("_wants"))
    rate = F.coalesce(F.try_divide(F.col("_want") * F.col("_all") * F.lit(epochs), F.col("_wants") * F.col("_size")), F.lit(0.0))
    rates = wanted.join(F.broadcast(total)).select("_source", rate.alias("_rate"))  # one row of totals
    most = F.ceil(F.col("_rate") + 10 * F.sqrt("_rate") + 20).cast("int")
    steps = rates.select("_source", "_rate", F.explode(F.sequence(F.lit(0), most)).alias("_k"))
    upto = Window.partitionBy("_source").orderBy("_k")  # a source has as many rows as repeats are likely
    steps = steps.withColumn("_log", F.col("_k") * F.log(F.greatest("_rate", F.lit(1e-300))) - F.col("_rate") - F.sum(F.log(F.greatest("_k", F.lit(1)).cast("double"))).over(upto))
    steps = steps.withColumn("_sum", F.sum(F.when((F.col("_rate") == 0) & (F.col("_k") == 0), 1.0).otherwise(F.exp("_log"))).over(upto))
    return steps.groupBy("_source").agg(F.first("_rate").alias("_rate"), F.array_sort(F.collect_list("_sum")).alias("_cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temper: float = TEMPER, epochs: float = EPOCHS, seed: int = SEED, keys: bool = True) -> DataFrame:
    """Every copy of every document, in a global random order.  With `keys`: repeat_no (from 1),
    repeats, and mix_key, by which copies are dealt out and sorted."""
    rates = staged(source_rates(docs, source_col, text_col, weights, temper, epochs), "rates")
    if rates.count() <= FEW_SOURCES:
        rates = F.broadcast(rates)
    kept = [c for c in docs.columns if not (keys and c in ("repeat_no", "repeats", "mix_key"))]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_of"))
    rows = rows.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    u = uniform(F.lit(seed), F.col("_id"))
    rows = rows.select("_row", "_id", F.size(F.filter("_cdf", lambda c: c <= u)).cast("long").alias("repeats")).where("repeats > 0")
    rows = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:mix"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("repeat_no").cast("string")).cast("binary"))
    rows = rows.withColumn("mix_key", key).repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
    return rows.select("_row.*", *(["repeat_no", "repeats", "mix_key"] if keys else []))
