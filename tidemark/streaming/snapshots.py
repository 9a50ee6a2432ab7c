"""Snapshots as a stream: files arrive, rows are appended, the latest of each key is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.consensus import latest
from ..sources.refresh import existing


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Appends all that has arrived, each row once, and ends."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str = "ts", by: str = "event_type", late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Counts by event-time window; rows later than `late` are left out, and state is bounded by it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Holds the newest row of each key, and gives a row out only when it changes.

    Rows are compared by time, then by tie; an older row, or one that came before, changes nothing.  What a
    task holds is a row for each key that it has just seen; the rest is in the state store."""

    def __init__(self, keys: list[str], at: str, tie: str, columns: list[str], state: T.StructType) -> None:
        self.keys, self.held, self.state = keys, [at, tie, *columns], state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.newest.get()
        best = tuple(old) if old is not None else None
        for r in rows:
            new = tuple(r[c] for c in self.held)
            if new[0] is not None and new[1] is not None and (best is None or new[:2] > best[:2]):
                best = new
        if best is not None and (old is None or best[:2] != tuple(old)[:2]):
            self.newest.update(best)
            yield Row(**dict(zip([*self.keys, *self.held], [*key, *best], strict=True)))

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], late: str | None = None) -> DataFrame:
    """A stream of the keys whose newest row changed, with that row.

    Rows without a time or a tie are passed over.  With `late`, so are rows older than the newest of all
    by more than that, whatever their key."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that this kind of state needs
    named = [at, tie, *columns]
    times = [c for c in named if isinstance(stream.schema[c].dataType, T.TimestampType)]
    if late is not None:
        stream = stream.withWatermark(at, late)
    # times go through state as microseconds, which are the same in every time zone
    held = {c: f"_{c}_us" if c in times else c for c in named}
    rows = stream.select(*keys, *([at] if late is not None else []), *(F.unix_micros(c).alias(h) if c in times else F.col(c) for c, h in held.items()))
    kind = {f.name: f for f in rows.schema.fields}
    state = T.StructType([kind[h] for h in held.values()])
    out = T.StructType([kind[c] for c in (*keys, *held.values())])
    new = rows.groupBy(*keys).transformWithState(Newest(keys, held[at], held[tie], [held[c] for c in columns], state), out, "Update", "EventTime" if late is not None else "None")
    return new.select(*keys, *(F.timestamp_micros(h).alias(c) if c in times else F.col(c) for c, h in held.items()))


def keep_latest(stream: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], out: str, state: str, late: str | None = None) -> StreamingQuery:
    """A table of the newest row of each key, as the changes that each batch made: see `current`.

    A batch writes its changed keys only, in a folder of its own, which a batch that is run again
    replaces."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    changes = newest_changes(stream, keys, at, tie, columns, late)
    return changes.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, keys: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row of each key: the last compaction, and what has changed since."""
    base, since = existing(spark, f"{out}/compacted"), existing(spark, f"{out}/changes")
    if since is None:
        raise FileNotFoundError(f"no changes at {out}")
    rows = since.select(*keys, at, tie, *columns, "batch")
    if base is not None:
        last = base.agg(F.max("through")).first()[0]
        rows = rows.where(F.col("batch") > last).drop("batch").unionByName(base.where(F.col("through") == last).select(*keys, at, tie, *columns))
    return latest(rows, keys, at, tie, [at, tie, *columns])


def compact(spark: SparkSession, out: str, keys: list[str], at: str, tie: str, columns: list[str]) -> int:
    """Writes the present table as one version; returns the batch through which it goes.  Older versions
    and changes stay for those who still read them."""
    last = existing(spark, f"{out}/changes").agg(F.max("batch")).first()[0]
    current(spark, out, keys, at, tie, columns).write.mode("overwrite").parquet(f"{out}/compacted/through={last}")
    return last
