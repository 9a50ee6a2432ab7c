"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every block of documents (a stretch of one task's rows) sends the sorted fingerprints of each
owner's range, Golomb coded, to that owner; the owner answers with one bit a fingerprint: seen
elsewhere or not.  Each block's bits are written beside its fingerprints.  A second scan has them
at hand row by row, so only suspects (bit set, or equal to another of their block) leave their
tasks; their whole texts are shuffled and grouped byte by byte.  If the second scan deals out rows
otherwise than the first, which fingerprints tell, rows without a bit of their own are suspects.

Cases: a null text counts as empty, empty texts are equal to each other.  Repeated rows
(same id and text) are rows of one group and all are returned; rows with a null id form
groups like any other and are never preferred to a row with an id.  An empty table gives
an empty result.  Columns of any name may stand beside the two that are read."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, kept, new_path, partitions, rows_in_arrow, staged, store_of, utf8

BLOCK_ROWS = 1 << 17
OWNER_ROWS = 1 << 22  # at most so many fingerprints come to an owner
HOT = 100_000  # groups of more rows than all rows / HOT (10,000 at least) are broadcast: fewer than HOT
NEAR = 4  # marks of 2**NEAR tasks lie in one folder


def golomb_encode(sorted_values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(k, unary stream, remainder stream) of ascending distinct uint64: gaps are coded with
    the Golomb parameter 2**k nearest to 0.69 of the mean gap.  Quotients (a zero for each
    unit, then a one) and k-bit remainders are kept apart, so both decode as arrays."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    mean = float(sorted_values[-1]) / len(sorted_values)
    k = min(63, max(0, int(math.floor(math.log2(max(1.0, 0.69 * mean))))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = (gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rest, axis=1)[:, 64 - k :]
    return k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - k :] = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
    low = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum((high << np.uint64(k)) | low, dtype=np.uint64)


def owner_of(fp: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of equal width, so a sorted list splits into slices."""
    return ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


BLOCKS = "block long, docs array<struct<doc_id: long, rank: int, sha: binary>>, packets array<struct<owner: int, first: int, n: int, k: int, unary: binary, rest: binary>>"
DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("rank", pa.int32()), ("sha", pa.binary())]))
PACKET = pa.list_(pa.struct([("owner", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())]))
MARKED = "block long, docs array<struct<doc_id: long, sha: binary, suspect: boolean>>, prints binary, bits binary"
MARK = pa.list_(pa.struct([("doc_id", pa.int64()), ("sha", pa.binary()), ("suspect", pa.bool_())]))


def packets_of(distinct: np.ndarray, owners: int) -> list[dict]:
    """Each owner's part of ascending fingerprints, coded; `first` is where it begins."""
    to = owner_of(distinct, owners)
    cuts = np.concatenate((np.flatnonzero(np.diff(to, prepend=np.uint64(owners))), [len(to)]))
    packets = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        k, unary, rest = golomb_encode(distinct[lo:hi])
        packets.append({"owner": int(to[lo]), "first": lo, "n": hi - lo, "k": k, "unary": unary, "rest": rest})
    return packets


def own_marks(folder: str, columns: list[str]) -> pa.Table | None:
    """The rows that were written for blocks of this task, from a folder of write_marks()."""
    store, root = store_of(folder)
    task = TaskContext.get().partitionId()
    path = f"{root}/near={task >> NEAR}"
    if store.get_file_info(path).type.name != "Directory":
        return None
    return pq.read_table(path, columns=columns, filesystem=store, partitioning=None, filters=[("block", ">=", task << 32), ("block", "<", (task + 1) << 32)]).sort_by("block")


def write_marks(marks: DataFrame) -> str:
    """Writes rows about blocks where their tasks find them; returns the folder."""
    folder = new_path(marks.sparkSession, "marks")
    marks.withColumn("near", F.shiftright("block", 32 + NEAR)).repartition("near").write.partitionBy("near").parquet(folder)
    return folder


def answers_of(packets: DataFrame) -> DataFrame:
    """block, first, n and bits: which of the packets' fingerprints other packets have too."""
    return packets.groupBy("owner").applyInArrow(_answer, "block long, first int, n int, bits binary")


def owners_for(n: int, spark: SparkSession) -> int:
    return max(math.ceil(n / OWNER_ROWS), min(partitions(spark), math.ceil(n / 4096)), 1)


def shas_of(column: pa.Array) -> list[bytes]:
    return [hashlib.sha256(x.lower()).digest() for x in utf8(column)]  # bytes.lower changes A-Z only


def prints_of(shas: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)


def _send(owners: int) -> BatchFn:
    def block(number: int, ids: list, shas: list[bytes]) -> pa.RecordBatch:
        distinct, where, times = np.unique(prints_of(shas), return_inverse=True, return_counts=True)
        rank = np.where(times[where] > 1, -1 - where, where)  # below zero: equal to another of its block
        packets = packets_of(distinct, owners)
        docs = [{"doc_id": i, "rank": r, "sha": s} for i, r, s in zip(ids, rank.tolist(), shas, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs], DOC), pa.array([packets], PACKET)], ["block", "docs", "packets"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("exact")
        number, ids, shas = TaskContext.get().partitionId() << 32, [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            shas += shas_of(b.column(1))
            if len(ids) >= BLOCK_ROWS:
                yield block(number, ids, shas)
                number, ids, shas = number + 1, [], []
        if ids:
            yield block(number, ids, shas)

    return run


def _answer(t: pa.Table) -> pa.Table:
    """An owner's side: a bit for each fingerprint of each packet, set if another packet has it too."""
    rows = t.to_pylist()
    lists = [golomb_decode(r["n"], r["k"], r["unary"], r["rest"]) for r in rows]
    distinct, times = np.unique(np.concatenate(lists), return_counts=True)
    bits = [np.packbits(times[np.searchsorted(distinct, x)] > 1).tobytes() for x in lists]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "first": pa.array([r["first"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _mark(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's side: which of its documents are suspects, in the order of its rows."""
    held = docs.column("docs").combine_chunks().flatten()
    rank, shas = held.field("rank").to_numpy(), held.field("sha")
    at = np.where(rank < 0, -1 - rank, rank)
    seen = np.zeros(int(at.max(initial=0)) + 1, bool)
    for r in answers.to_pylist():
        seen[r["first"] : r["first"] + r["n"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n"]]
    suspect = (rank < 0) | seen[at]
    marks = pa.StructArray.from_arrays([held.field("doc_id"), shas, pa.array(suspect)], names=["doc_id", "sha", "suspect"])
    prints = prints_of(shas.to_pylist()).tobytes()
    lists = pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), marks)
    return pa.table({"block": docs.column("block"), "docs": lists, "prints": pa.array([prints], pa.binary()), "bits": pa.array([np.packbits(suspect).tobytes()], pa.binary())})


def mark(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, int]:
    """(doc_id, sha and suspect of every row; the folder of each task's marks; the number of rows)."""
    spark = docs.sparkSession
    docs = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = docs.count()
    sent = staged(docs.mapInArrow(_send(owners_for(n, spark)), BLOCKS), "blocks")
    answers = answers_of(sent.select("block", F.inline("packets")))
    marked = staged(sent.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_mark, MARKED), "marked")
    return marked.select(F.inline("docs")), write_marks(marked.select("block", "prints", "bits")), n


def _with_mark(folder: str, at: int, want: bool) -> BatchFn:
    """The rows that are suspects, or are not."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        prints, bits = np.zeros(0, np.uint64), np.zeros(0, bool)
        if (t := own_marks(folder, ["block", "prints", "bits"])) is not None:
            prints = np.frombuffer(b"".join(t.column("prints").to_pylist()), np.uint64)
            bits = np.concatenate([bits, *(np.unpackbits(np.frombuffer(x, np.uint8), count=len(p) // 8).astype(bool) for x, p in zip(t.column("bits").to_pylist(), t.column("prints").to_pylist(), strict=True))])
        row = 0
        for b in batches:
            own = prints_of(shas_of(b.column(at)))
            suspect = np.ones(len(own), bool)
            known = slice(row, min(row + len(own), len(prints)))
            n = max(0, known.stop - known.start)
            suspect[:n] = bits[known][:n] | (prints[known][:n] != own[:n])
            row += len(own)
            keep = suspect == want
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def suspects(docs: DataFrame, folder: str, text_col: str, want: bool = True) -> DataFrame:
    """The rows of `docs` that the marks in `folder` call suspects (or, with want=False, the others)."""
    return rows_in_arrow(docs, _with_mark(folder, docs.columns.index(text_col), want))


def lowered(text_col: str) -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, *mark(docs, id_col, text_col), id_col, text_col)


def _groups(docs: DataFrame, marked: DataFrame, folder: str, n: int, id_col: str, text_col: str) -> DataFrame:
    rows = columns_as(docs, doc_id=id_col, text=text_col)
    same = suspects(rows, folder, "text").select(F.col("doc_id").cast("long"), lowered("text").cast("binary").alias("text"))
    # equal bytes, not equal hashes, make a group: the whole text is the grouping key
    groups = same.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = staged(groups.select(F.unhex(F.sha2("text", 256)).alias("group_sha"), "keep_id", "group_size"), "groups")
    least = max(10_000, n // HOT)
    hot = F.broadcast(groups.where(F.col("group_size") > least))  # fewer than HOT rows
    rest = groups.where(F.col("group_size") <= least)
    some, own = marked.where("suspect"), F.col("sha") == F.col("group_sha")
    columns = ["doc_id", "sha", "keep_id", "group_size"]
    joined = some.join(hot, own).select(*columns).union(some.join(hot, own, "left_anti").join(rest, own).select(*columns))
    alone = marked.where("not suspect").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return joined.union(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of equal texts the one with the largest id, and of equal rows one.
    Rows that are no suspects are not shuffled."""
    marked, folder, n = mark(docs, id_col, text_col)
    kept = _groups(docs, marked.where("suspect"), folder, n, id_col, text_col).where("kept")
    kept = staged(kept.select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha")).distinct(), "kept")
    again = suspects(docs, folder, text_col).select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    again = again.withColumn("sha", F.unhex(F.sha2(lowered("text"), 256)))
    again = again.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    again = again.dropDuplicates(["id", "sha"]).select("row.*")
    return suspects(docs, folder, text_col, want=False).union(again)
