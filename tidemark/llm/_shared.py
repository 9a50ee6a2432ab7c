"""Helpers shared by the text operators: tables, staging, Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


Batches = Iterator[pa.RecordBatch]
BatchFn = Callable[[Batches], Batches]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session, whose executors are in the
    driver's process, may leave it unset; it then has a temporary folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        where = _own[app]
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(Arrow's file system, path in it) of a folder as Hadoop names it: a path, file:/path, or a
    store's URI (hdfs, s3, s3a, s3n, gs, abfs, abfss)."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", uri)
    if not scheme:
        return fs.LocalFileSystem(), uri
    if scheme[1].lower() == "file":
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    if scheme[1].lower() in ("s3a", "s3n"):
        uri = "s3" + uri[len(scheme[1]) :]
    return fs.FileSystem.from_uri(uri)


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folders of a step that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        store, path = store_of(folder)
        if "/tidemark/" in path:
            store.delete_dir(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other
    column of the input can clash with an internal one."""
    return df.select(*(F.col(f"`{col}`").alias(name) for name, col in names.items()))


def rows_in_arrow(df: DataFrame, run: BatchFn) -> DataFrame:
    """Rows of `df` that `run` lets through, whatever the columns' names are."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this process keeps for an operator from task to task; what it kept for others is let go."""
    others = [d for name, d in _kept.items() if name != operator and d]
    for d in others:
        d.clear()
    if others:
        give_back()
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Memory that was freed goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


HOT = 100_000


def hot_from(total: int) -> int:
    """Keys with more rows than this are hot; of `total` rows there are at most HOT such keys."""
    return max(1_000, total // HOT)


def join_one(rows: DataFrame, one: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` with the one row that `one` has for each key.  `weight` counts a key's rows, of `total`:
    the rows of hot keys stay where they are and meet a broadcast of at most HOT rows, the others are
    shuffled, so no task gets all rows of a hot key.  With how="left" rows without a partner stay."""
    hot = F.broadcast(one.where(F.col(weight) > hot_from(total)).drop(weight))
    rest = one.where(F.col(weight) <= hot_from(total)).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on, how))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string of a column; null counts as empty.  One is copied at a time."""
    a = column.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1].tolist() if len(a) else [0]
    valid = a.is_valid().to_pylist() if a.null_count else itertools.repeat(True)
    data = memoryview(a.buffers()[2] or b"")
    for (lo, hi), ok in zip(itertools.pairwise(offsets), valid, strict=False):
        yield bytes(data[lo:hi]) if ok else b""


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`.  What is held back
    is the last, unfinished group only, so memory follows the largest group."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        last = np.ones(rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            last &= v == v[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        kept, rows = rest.to_batches(), rest.num_rows
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def tidy(run: BatchFn) -> BatchFn:
    """The same; when a task ends, its memory goes back, so that the next stage has it."""

    def tidied(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
