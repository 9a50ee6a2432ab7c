"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation that makes sign codes balanced is learned on at most SAMPLE different vectors; every
vector is coded.  Codes are looked up in tables keyed by the label and a choice of whole blocks of
the code: two codes that differ in at most RADIUS bits meet in at least one table, others by
chance.  Tables hold codes only; rows with a partner at most MOST bits away then get their
vectors, and pairs are reranked by the cosine in double precision.  A pair that meets in several
tables counts in the first only, so links are counted in place and pairs are never written out:
tables give each vector's number of links and a spanning forest.

Equal vectors of one label are one node with a multiplicity.  Vectors of other lengths than
the sample's share a bucket for each label and length and are compared exactly.

Cases: vectors that are null, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are kept.  Repeated rows count as separate equal vectors; with a
repeated id the id is kept once for all its rows.  A row with a null id has a null component
unless it reaches an id, and is not kept.  An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, join_one, staged, whole_groups
from .buckets import GROUP, Forest, group_ids, grouped, pairs
from .components import connected_components
from .op03_simhash import block_masks, choose_extra, labelled

SAMPLE = 20_000
RADIUS = 7
MOST = 3 * RADIUS
CAP = 512
THRESHOLD = 0.98
ROUNDS = 50


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions of unit vectors, turned so that signs lose least."""
    mean = x.mean(axis=0)
    _, basis = np.linalg.eigh(np.cov((x - mean).T) + 1e-12 * np.eye(x.shape[1]))
    basis = basis[:, ::-1][:, : min(bits, x.shape[1])]
    v = (x - mean) @ basis
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, basis @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (x - mean) @ projection >= 0
    padded = np.zeros((len(x), 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(">u8").ravel().astype(np.uint64)


def _vectors(single: bool) -> BatchFn:
    """Usable vectors as bytes, in their own precision, with a digest; others with nulls."""
    kind = np.float32 if single else np.float64

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw = [], []
            column = b.column(2)
            values = column.flatten()
            absent = values.is_null().to_numpy(zero_copy_only=False)
            flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            ok = np.isfinite(flat) & ~absent
            sizes = [0 if n is None else n for n in column.value_lengths().to_pylist()]
            hi = 0
            for label, n in zip(b.column(1).to_pylist(), sizes, strict=True):
                lo, hi = hi, hi + n
                if label is not None and n and ok[lo:hi].all() and flat[lo:hi].any():
                    raw.append(data := flat[lo:hi].tobytes())
                    keys.append(hashlib.blake2b(data, digest_size=16).digest())
                else:
                    raw.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "key", "vec"])

    return run


def _matrix(raw: list[bytes], single: bool) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32 if single else np.float64).reshape(len(raw), -1).astype(np.float64)


def _scaled(raw: list[bytes], single: bool) -> np.ndarray:
    """Vectors times a power of two each, which changes no digit, so that squares neither overflow nor vanish."""
    x = _matrix(raw, single)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(raw: list[bytes], single: bool) -> np.ndarray:
    x = _scaled(raw, single)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(mean: np.ndarray, projection: np.ndarray, single: bool, beside: bool = False) -> BatchFn:
    """The code of the first column's vectors, in its place or (beside) with it."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_pylist()
            usual = np.array([len(r) == (4 if single else 8) * len(mean) for r in raw], bool)
            code = np.zeros(len(raw), np.uint64)
            if usual.any():
                code[usual] = codes(_unit([r for r, u in zip(raw, usual, strict=True) if u], single), mean, projection)
            kept = 0 if beside else 1
            yield pa.RecordBatch.from_arrays([*b.columns[kept:], pa.array(code.view(np.int64))], [*b.schema.names[kept:], "code"])

    return run


def _first_tables(differ: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The first table in which codes with these differing bits meet."""
    first = np.full(len(differ), -1)
    for k, mask in enumerate(tables):
        first[(first < 0) & (differ & mask == 0)] = k
    return first


def _meeting(masks: list[int]) -> BatchFn:
    """Rows of buckets that have a partner whose code is near and that meets them here first."""
    tables = np.array(masks, np.uint64)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP, 1 << 14):
            code, at = t.column("code").to_numpy().view(np.uint64), t.column("t").to_numpy()
            met = np.zeros(len(code), bool)
            for i, j in pairs(group_ids(t), t.column("chunk").to_numpy(), t.column("c1").to_numpy(), t.column("c2").to_numpy(), 1 << 18):
                open_ = ~(met[i] & met[j])
                i, j = i[open_], j[open_]
                differ = code[i] ^ code[j]
                near = np.bitwise_count(differ) <= MOST
                i, j, differ = i[near], j[near], differ[near]
                here = _first_tables(differ, tables) == at[i]
                met[i[here]] = met[j[here]] = True
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(met)) for c in ("node", "t", "bucket")], ["node", "t", "bucket"])

    return run


def _rerank(masks: list[int], threshold: float, single: bool) -> BatchFn:
    tables = np.array(masks, np.uint64)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP, 1 << 12):
            code, at = t.column("code").to_numpy().view(np.uint64), t.column("t").to_numpy()
            ids, times = t.column("node").to_numpy(), t.column("times").to_numpy()
            raw = t.column("vec").to_pylist()
            width = np.array([len(r) for r in raw])
            links, forest, found = np.zeros(len(ids), np.int64), Forest(len(ids)), []
            vectors = {w: (np.cumsum(width == w) - 1, _scaled([r for r in raw if len(r) == w], single)) for w in set(width.tolist())}
            norms = {w: np.sqrt(np.einsum("ij,ij->i", v, v)) for w, (_, v) in vectors.items()}
            for i, j in pairs(group_ids(t), t.column("chunk").to_numpy(), t.column("c1").to_numpy(), t.column("c2").to_numpy(), 1 << 18):
                differ = code[i] ^ code[j]
                near = np.bitwise_count(differ) <= MOST
                i, j = i[near], j[near]
                first = _first_tables(differ[near], tables)
                here = (first == at[i]) & (width[i] == width[j])
                i, j = i[here], j[here]
                for w, (row, v) in vectors.items():
                    own = width[i] == w
                    for s in range(0, int(own.sum()), 1 << 14):
                        a, b = i[own][s : s + (1 << 14)], j[own][s : s + (1 << 14)]
                        cos = np.einsum("ij,ij->i", v[row[a]], v[row[b]]) / (norms[w][row[a]] * norms[w][row[b]])
                        a, b = a[cos >= threshold], b[cos >= threshold]
                        np.add.at(links, a, times[b])
                        np.add.at(links, b, times[a])
                        found.append(forest.add(a, b))
            some = np.flatnonzero(links)
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (some[:0], some[:0])
            a = np.concatenate((ids[some], ids[i]))
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[j], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate((links[some], np.zeros(len(i), np.int64))), pa.int64())], ["a", "b", "n"])

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    rows = columns_as(vectors, vec_id=id_col, label=label_col, embedding=vector_col).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    rows = staged(rows.mapInArrow(_vectors(single), "vec_id long, label string, key binary, vec binary"), "vectors")
    used = rows.where("key is not null")
    named = used.groupBy("label", "key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"), F.first("vec").alias("vec"))
    named = staged(named.withColumn("node", F.xxhash64("label", "key")), "named")
    sizes = named.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    mean, projection = _learned(named, sizes[0] or 0, single)
    nodes = named.select("vec", "node", "label", F.length("vec").alias("size")).mapInArrow(_code(mean, projection, single), "node long, label string, size int, code long")
    masks = block_masks(radius, choose_extra(sizes[1] or 1, radius, 200))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = nodes.select("node", "code", "label", "size", F.posexplode(F.array(*(F.lit(m) for m in signed))).alias("t", "mask"))
    tables = tables.select("node", "code", "t", F.xxhash64("t", "label", "size", F.col("code").bitwiseAND(F.col("mask"))).alias("bucket"))
    meeting = grouped(tables, "node", cap).mapInArrow(_meeting(masks), "node long, t int, bucket long").distinct()
    whole = named.select("vec", "node", "times").mapInArrow(_code(mean, projection, single, beside=True), "vec binary, node long, times long, code long")
    meeting = staged(meeting.join(whole, "node"), "meeting")
    met = staged(grouped(meeting, "node", cap).mapInArrow(_rerank(masks, threshold, single), "a long, b long, n long"), "links")

    links = met.groupBy("a").agg(F.sum("n").alias("links"))
    parts = connected_components(met.where("b is not null").select("a", "b"))
    groups = labelled(named.select("label", "key", "node", "times"), named.select("node", "first_id", F.lit(1).cast("long").alias("n")), parts)
    label = groups.join(links, F.col("node") == F.col("a"), "left").select("label", "key", "times", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    linked = join_one(used.select("vec_id", "label", "key"), staged(label, "labels"), ["label", "key"], "times", used.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _learned(named: DataFrame, n: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rotation, from the SAMPLE different vectors of least hash; a bound on the hash lets few more
    than those leave their partitions."""
    h = F.pmod(F.xxhash64("key", F.lit(SAMPLE)), F.lit(1 << 30))
    bound = int((1 << 30) * min(1.0, 1.2 * SAMPLE / max(n, 1)))
    sample = [r.vec for r in named.where(h < bound).orderBy(h, "key").select("vec").limit(SAMPLE).collect()]
    size = 4 if single else 8
    usual = max({len(r) for r in sample}, key=[len(r) for r in sample].count) if sample else size
    x = _unit([r for r in sample if len(r) == usual], single) if sample else np.eye(1)
    return learn_rotation(x) if len(x) > 1 else (np.zeros(usual // size), np.eye(usual // size)[:, :64])
