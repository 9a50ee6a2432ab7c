"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into `radius + extra` blocks; two that differ in at most `radius` bits
agree in at least `extra` whole blocks, so they meet in a bucket keyed by some choice of
`extra` blocks.  `extra` grows with the number of distinct fingerprints, so that buckets stay
small.  Documents with one fingerprint are one node; buckets give a spanning forest of their
links, never all pairs, and connected components finish the work.

Cases: null and empty texts, and texts of white space, have fingerprint zero, linked like any
other; fewer words than a shingle make one shingle of all; repeated rows share a node and are
all returned; a null id is returned with a null component unless an id is reachable.  An empty
table gives an empty result.  Only the two named columns are read."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, join_one, kept, partitions, staged, tidy, utf8, whole_groups
from .bitmaps import bitmap, has, with_bit
from .buckets import GROUP, Forest, group_ids, grouped, pairs
from .components import connected_components
from .op01_exact_dedup import PACKET, answers_of, own_marks, owners_for, packets_of, write_marks

SEED = 42
PIECE = 1 << 16
CAP = 1024


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 of each word shingle of a text that is lower-cased here; repeats included."""
    words = text.lower().split()  # bytes.split parts at space and 9 to 13, bytes.lower changes A-Z
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > words_each:
        starts, ends = starts[: len(words) - words_each + 1], ends[words_each - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def simhash(text: bytes, words_each: int) -> int:
    """64 bits; one is set if it is set in more than half the shingles' hashes."""
    h = shingle_hashes(text, words_each)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), PIECE):
        ones += np.unpackbits(h[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(words_each: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in batches:
            fp = np.array([simhash(x, words_each) for x in utf8(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def block_masks(radius: int, extra: int) -> list[int]:
    """A mask for each choice of `extra` of the `radius + extra` blocks."""
    n = radius + extra
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - (1 << lo)) for lo, hi in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, extra)]


def choose_extra(n: int, radius: int, most_tables: int = 500) -> int:
    """The number of agreeing blocks whose tables cost least: rows made, and pairs met by chance."""

    def cost(extra: int) -> float:
        return math.comb(radius + extra, extra) * n * (1 + 0.01 * n / 2 ** (64 * extra / (radius + extra)))

    return min((e for e in range(1, 8) if e == 1 or math.comb(radius + e, e) <= most_tables), key=cost)


def _links(masks: list[int], radius: int) -> BatchFn:
    """Edges of a spanning forest of each group's links."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP):
            fp = t.column("fp").to_numpy().view(np.uint64)
            group, chunk = group_ids(t), t.column("chunk").to_numpy()
            forest, found = Forest(len(fp)), []
            for i, j in pairs(group, chunk, t.column("c1").to_numpy(), t.column("c2").to_numpy()):
                apart = forest.label[i] != forest.label[j]
                i, j = i[apart], j[apart]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
                found.append(forest.add(i[near], j[near]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int, cap: int = CAP) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` that connect all within `radius` bits of each other."""
    n = nodes.count()
    masks = block_masks(radius, choose_extra(max(n, 1), radius))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    rows = nodes.select("fp", F.posexplode(F.array(*(F.lit(m) for m in signed))).alias("t", "mask"))
    rows = rows.select("fp", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    return grouped(rows, "fp", cap).mapInArrow(_links(masks, radius), "a long, b long")


def fingerprints(docs: DataFrame, words_each: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_fingerprints(words_each), "doc_id long, fp long")


def near_groups(docs: DataFrame, words_each: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    prints = staged(fingerprints(docs, words_each, id_col, text_col), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    parts = connected_components(links(nodes.select("fp"), radius))
    rows = labelled(prints.select("doc_id", F.col("fp").alias("node")), nodes.withColumnRenamed("fp", "node"), parts)
    return rows.withColumnRenamed("node", "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(rows: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """`rows` (with a `node` each) and the component_id: the smallest first_id of all nodes of the
    component.  `nodes` has node, first_id and n, the number of its rows."""
    label = nodes.join(parts.withColumnRenamed("node", "part"), F.col("node") == F.col("part"), "left").select("node", "first_id", "n", F.coalesce("component", "node").alias("component"))
    label = staged(label, "components")
    total = label.agg(F.count("*"), F.sum("n")).first()
    smallest = label.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("many"))
    label = join_one(label.select("node", "n", "component"), smallest, ["component"], "many", total[0])
    label = staged(label.select("node", "component_id", "n"), "labels")
    return join_one(rows, label, ["node"], "n", total[1] or 0)


# ---- groups by real similarity of shingle sets

WIDE = 4  # 64-bit words of a wide fingerprint
LIMIT = 69  # of 256 bits: a Jaccard similarity of 0.8 has 39 that differ, give or take 6
LEAST = 64  # sets of fewer shingles are not judged by their fingerprints, which scatter more
SLOTS = 22  # bits of a hash that say which counter counts it
PIECES = 64  # in which counters are sent and summed
FEW_GONE = 500_000  # so many ids and hashes of rows that go are broadcast
BLOCK_HASHES = 1 << 19  # of prefixes, in a block
SETS = 256  # sets of one candidate group that are compared in one task
NEAREST = 8  # pairs of two parts at a shared hash that are compared before all are


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a hash is mixed from those of its words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(words_each, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for at in range(k):
        h = (h ^ each[at : at + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def wide_simhash(h: np.ndarray) -> bytes:
    """256 bits like simhash(), of a set of hashes: each one is spread to four words."""
    if not len(h):
        return bytes(8 * WIDE)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), PIECE // WIDE):
        part = h[at : at + PIECE // WIDE]
        spread = np.empty((len(part), WIDE), np.uint64)
        for k in range(WIDE):
            x = part + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            spread[:, k] = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.add.reduce(np.unpackbits(spread.view(np.uint8), axis=1), axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(h)).tobytes()


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS)).astype(np.int64)


def prefix(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(0.8 n) + 1 of a set's n hashes, in an order that is the same for all sets.
    Two sets with a Jaccard similarity of 0.8 share one of theirs, whatever the order."""
    n = len(h)
    return h[np.lexsort((h, counts[slot_of(h)]))[: n - (4 * n + 4) // 5 + 1]] if n else h


def _counters(words_each: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        counts = np.zeros(1 << SLOTS, np.uint32)
        for b in batches:
            for x in utf8(b.column(0)):
                counts[slot_of(shingle_set(x, words_each))] += 1
        for piece, part in enumerate(counts.reshape(PIECES, -1)):
            if part.any():
                part = part.astype(np.min_scalar_type(part.max()))
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([packed], pa.binary())], ["piece", "width", "counts"])

    return run


def _summed(batches: Batches) -> Iterator[pa.RecordBatch]:
    each, sums = (1 << SLOTS) // PIECES, {}
    for b in batches:
        for piece, width, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            part = np.frombuffer(pa.decompress(packed, decompressed_size=each * width, codec="zstd", asbytes=True), f"u{width}")
            sums[piece] = sums.get(piece, np.zeros(each, np.uint64)) + part
    for piece, total in sums.items():
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "counts"])


def shingle_counts(docs: DataFrame, words_each: int) -> np.ndarray:
    """In how many documents, of all there are, a shingle of each slot occurs.  The driver gets 16 MB, whatever the input."""
    sent = docs.select("text").mapInArrow(tidy(_counters(words_each)), "piece int, width int, counts binary")
    summed = sent.repartition(PIECES, "piece").mapInArrow(tidy(_summed), "piece int, counts binary").toArrow()
    counts = np.zeros((PIECES, (1 << SLOTS) // PIECES), np.uint32)
    for piece, total in zip(summed.column("piece").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        counts[piece] = np.frombuffer(total, np.uint32)
    return counts.reshape(-1)


def _sets(words_each: int, counts) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sets = [shingle_set(x, words_each) for x in utf8(part.column(1))]
                node = list(map(node_of, sets))
                first = [prefix(h, counts.value).view(np.int64) for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(wide_simhash, sets), pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "th", "node", "n", "fp", "prefix"])

    return run


def _members(words_each: int, asked) -> BatchFn:
    """The sets of documents of which the bitmap has the key."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for b in batches:
            own = b.filter(pa.array(has(asked.value, b.column(0).to_numpy())))
            for lo in range(0, own.num_rows, 1024):
                sets = [shingle_set(x, words_each) for x in utf8(own.column(1).slice(lo, 1024))]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"])

    return run


def node_of(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


# Which prefix hashes occur in several rows: the exchange of compressed fingerprints of exact dedup.

def _blocks(batches: Batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(number, node of each hash, its place in its prefix, different hashes, which of them each is, how often each occurs, check)
    of blocks of whole rows; where rows are cut into blocks does not depend on batches."""
    number, nodes, lists, held = TaskContext.get().partitionId() << 32, [], [], 0

    def block() -> tuple:
        h = np.concatenate(lists)
        distinct, where, times = np.unique(h.view(np.uint64), return_inverse=True, return_counts=True)
        many = [len(x) for x in lists]
        return number, np.repeat(np.array(nodes, np.int64), many), np.concatenate([np.arange(n) for n in many]), distinct, where, times, xxhash.xxh64_intdigest(h.tobytes()) >> 1

    for b in batches:
        prefixes = b.column(1)
        values, cuts = prefixes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(prefixes.value_lengths().to_numpy()))).tolist()
        for node, (lo, hi) in zip(b.column(0).to_pylist(), itertools.pairwise(cuts), strict=True):
            if lo == hi:
                continue
            nodes.append(node)
            lists.append(values[lo:hi].copy())
            held += hi - lo
            if held >= BLOCK_HASHES:
                yield block()
                number, nodes, lists, held = number + 1, [], [], 0
    if lists:
        yield block()


def _sent(owners: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for number, _, _, distinct, _, _, check in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([check], pa.int64()), pa.array([packets_of(distinct, owners)], PACKET)], ["block", "check", "packets"])

    return run


def _meet(folder: str) -> BatchFn:
    """(node, bucket, at) of each hash that another row has too, with its place in the prefix.  If a block is not the one that was sent,
    all its hashes are taken to be shared."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        checks, answers = {}, {}
        if (t := own_marks(folder, ["block", "first", "n", "bits", "check"])) is not None:
            for r in t.to_pylist():
                if r["check"] is not None:
                    checks[r["block"]] = r["check"]
                else:
                    answers.setdefault(r["block"], []).append(r)
        for number, nodes, places, distinct, where, times, check in _blocks(batches):
            shared = times > 1
            for r in answers.pop(number, []) if checks.get(number) == check else []:
                shared[r["first"] : r["first"] + r["n"]] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
            if checks.get(number) != check:
                shared[:] = True
            keep = shared[where]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(distinct[where[keep]].view(np.int64)), pa.array(places[keep], pa.int32())], ["node", "bucket", "at"])

    return run


def meeting(rows: DataFrame) -> DataFrame:
    """(node, bucket, at) of rows (node, prefix) that share a hash of their prefix with another row.  Hashes
    are sent compressed to the owners of their ranges, which send back a bit for each."""
    spark = rows.sparkSession
    n = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    sent = staged(rows.mapInArrow(tidy(_sent(owners_for(n, spark))), "block long, check long, packets array<struct<owner: int, first: int, n: int, k: int, unary: binary, rest: binary>>"), "blocks")
    answers = answers_of(sent.select("block", F.inline("packets"))).withColumn("check", F.lit(None).cast("long"))
    checks = sent.select("block", F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("bits"), "check")
    return rows.mapInArrow(tidy(_meet(write_marks(answers.union(checks)))), "node long, bucket long, at int")


def _prefixes(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, prefix), once for each node.  Rows that are alone with their set stay where they are; the
    others are few after exact dedup, and are found by a broadcast while they are."""
    several = staged(nodes.where("times > 1").select("node"), "several")
    rows = prints.select("node", "prefix")
    if several.count() > FEW_GONE:
        return staged(rows.groupBy("node").agg(F.any_value("prefix").alias("prefix")), "prefixes")
    several = F.broadcast(several)
    one = rows.join(several, "node", "left_semi").groupBy("node").agg(F.any_value("prefix").alias("prefix"))
    return rows.join(several, "node", "left_anti").union(staged(one, "prefixes"))


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, fp: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes and fingerprints allow a similarity of 0.8.  With `at`, the place of the hash that they share:
    if none before it is shared, what follows it bounds what they share; a similar pair also meets at its first one."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    go = 5 * low >= 4 * high
    if at is not None:
        go &= 9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (low + high)
    i, j, low = i[go], j[go], low[go]
    go = (np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= LIMIT) | (low < LEAST)
    return i[go], j[go]


def _candidates(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket's possible pairs."""
    for t in whole_groups(batches, GROUP):
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
        node, n, at = (t.column(c).to_numpy() for c in ("node", "n", "at"))
        forest, found = Forest(len(fp)), []
        for i, j in pairs(group_ids(t), t.column("chunk").to_numpy(), t.column("c1").to_numpy(), t.column("c2").to_numpy(), 1 << 18):
            apart = forest.label[i] != forest.label[j]
            found.append(forest.add(*_possible(i[apart], j[apart], n, fp, at)))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])


def _verified(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Edges that connect all sets of a group with a Jaccard similarity of 0.8 or more; sets with one
    label are connected already."""
    for t in whole_groups(batches, GROUP, 1 << 10):
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
        node, n, group = t.column("node").to_numpy(), np.array([len(h) for h in sets]), group_ids(t)
        first: dict[tuple[int, int], int] = {}
        up = [first.setdefault(key, k) for k, key in enumerate(zip(group.tolist(), t.column("label").to_pylist(), strict=True))]
        a, b = [], []

        def root(x: int, up: list[int] = up) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i, j in pairs(group, t.column("chunk").to_numpy(), t.column("c1").to_numpy(), t.column("c2").to_numpy(), 1 << 16):
            for x, y in zip(*(v.tolist() for v in _possible(i, j, n, fp)), strict=True):
                p, q = root(x), root(y)
                if p == q:
                    continue
                both = np.sort(np.concatenate((sets[x], sets[y])))
                shared = int((both[1:] == both[:-1]).sum())
                if 5 * shared >= 4 * (len(both) - shared):
                    up[max(p, q)] = min(p, q)
                    a.append(node[x])
                    b.append(node[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets_of(docs: DataFrame, chosen: DataFrame, words_each: int) -> DataFrame:
    """The rows of `chosen` with the set of their document.  A bitmap says which documents to read; few
    rows are broadcast, so that no set is shuffled to meet its row."""
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, "key"))
    found = docs.select(F.xxhash64("doc_id", "th").alias("key"), "text").mapInArrow(tidy(_members(words_each, asked)), "node long, hashes binary")
    return found.join(F.broadcast(chosen) if chosen.count() <= FEW_GONE else chosen, "node")


def _between(nearest: int | None) -> BatchFn:
    """The possible pairs of different parts that a hash brings together: of two parts the `nearest` by fingerprint (`more`
    says that there are others), or all."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP):
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
            node, n, at, label = (t.column(c).to_numpy() for c in ("node", "n", "at", "label"))
            group = group_ids(t)
            for i, j in pairs(group, t.column("chunk").to_numpy(), t.column("c1").to_numpy(), t.column("c2").to_numpy(), 1 << 20):
                apart = label[i] != label[j]
                i, j = _possible(i[apart], j[apart], n, fp, at)
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                more = np.zeros(len(i), bool)
                if nearest and len(i):
                    low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                    by = np.lexsort((np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1), high, low, group[i]))
                    key = np.stack((group[i], low, high))[:, by]
                    new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
                    first, which = np.flatnonzero(new), np.cumsum(new) - 1
                    own = np.arange(len(by)) - first[which] < nearest
                    more = (np.diff(np.append(first, len(by))) > nearest)[which[own]]
                    i, j = i[by[own]], j[by[own]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], label[i], label[j], more)], ["a", "b", "la", "lb", "more"])

    return run


def _alike(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The pairs with a Jaccard similarity of 0.8 or more."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(5 * shared >= 4 * (len(both) - shared))
        yield b.select(["la", "lb", "a", "b"]).filter(pa.array(keep, pa.bool_()))


def links_between(docs: DataFrame, left: DataFrame, met: DataFrame, words_each: int) -> DataFrame:
    """Edges (a, b) that connect the parts (`label`) of open groups.  Similar sets share a hash of their prefixes, so
    sets meet by hashes that two parts have, not by group.  The NEAREST pairs of two parts at each hash are compared
    first; only if there were others, all pairs of parts that are still apart are."""
    rows = left.select("node", "n", "fp", "key", "label").join(met.select("node", F.col("bucket").alias("h"), "at"), "node")

    def several(rows: DataFrame) -> DataFrame:
        rows = staged(rows, "shared")
        return staged(rows.join(rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h"), "h", "left_semi"), "shared")

    def compared(rows: DataFrame, nearest: int | None) -> tuple[DataFrame, bool]:
        e = grouped(rows.select(F.col("h").alias("bucket"), "node", "n", "fp", "at", "label"), "node", CAP).mapInArrow(tidy(_between(nearest)), "a long, b long, la long, lb long, more boolean")
        e = staged(e.groupBy("a", "b").agg(F.any_value("la").alias("la"), F.any_value("lb").alias("lb"), F.max("more").alias("more")), "pairs")
        met = e.select("la", "lb", "a", "b").join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("la", "lb", "a", "b", "ha", "hb")
        return staged(met.mapInArrow(tidy(_alike), "la long, lb long, a long, b long"), "links"), not e.where("more").isEmpty()

    rows = several(rows)
    sets = staged(_sets_of(docs, rows.select("node", "key").distinct(), words_each).select("node", "hashes"), "members")
    edges, more = compared(rows, NEAREST)
    if not more:
        return edges.select("a", "b")
    merged = connected_components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "part")
    rows = rows.join(merged, F.col("label") == F.col("part"), "left").withColumn("label", F.coalesce("component", "label")).drop("part", "component")
    return edges.union(compared(several(rows), None)[0]).select("a", "b")


def verified_links(docs: DataFrame, chosen: DataFrame, met: DataFrame, words_each: int) -> DataFrame:
    """Edges (a, b) that connect all sets of a candidate group (`bucket`) with a similarity of 0.8 or more.

    A group is dealt out in chunks of SETS sets; the one whose node names the group is in all of them.
    Chunks compare their own sets, which for copies of one text is all there is to do.  Only groups
    that are still in several parts go on, see `links_between`."""
    sizes = chosen.groupBy("bucket").agg(F.count("*").alias("many")).where(F.col("many") > SETS).withColumn("n_chunks", F.ceil(F.col("many") / SETS).cast("int"))
    chosen = staged(chosen.join(sizes, "bucket", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1))), "sized")
    dealt = _sets_of(docs, chosen, words_each).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("bucket"), F.sequence(F.lit(0), F.col("n_chunks") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select("bucket", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"), "chunk", "node", F.col("node").alias("label"), "fp", "hashes")
    dealt = dealt.repartition(partitions(docs.sparkSession), *GROUP).sortWithinPartitions(*GROUP)
    edges = staged(dealt.mapInArrow(tidy(_verified), "a long, b long"), "links")

    large = chosen.where("n_chunks > 1")
    if large.isEmpty():
        return edges
    # chunks have one set in common and give forests, so a group has as many parts as it has sets more than edges
    tied = edges.join(large.select(F.col("node").alias("a"), "bucket"), "a").groupBy("bucket").agg(F.count("*").alias("ties"))
    open_ = large.groupBy("bucket").agg(F.any_value("many").alias("many")).join(tied, "bucket", "left").where(F.col("many") - F.coalesce("ties", F.lit(0)) > 1)
    left = staged(large.join(open_.select("bucket"), "bucket", "left_semi"), "open")
    if left.isEmpty():
        return edges
    own = edges.join(left.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")
    parts = connected_components(own).withColumnRenamed("node", "part")
    left = staged(left.join(parts, F.col("node") == F.col("part"), "left").select("node", "n", "fp", "key", F.coalesce("component", "node").alias("label")), "parts")
    return edges.union(links_between(docs, left, met, words_each))


def similar_groups(docs: DataFrame, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id over links of documents whose sets of shingles have a Jaccard similarity
    of at least 0.8.  Texts without a shingle have one empty set and are a group."""
    return _similar(docs, words_each, id_col, text_col).select("doc_id", "component_id")


def _similar(docs: DataFrame, words_each: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (the text's hash), component_id.

    Sets that share one of their rarest shingles (see prefix()) meet, which all such pairs do.  If
    sizes and 256-bit fingerprints allow it, they become candidates; components of candidates hold
    every pair that is looked for, and in them the sets themselves are compared."""
    spark = docs.sparkSession
    docs = columns_as(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    counts = spark.sparkContext.broadcast(shingle_counts(docs, words_each))
    prints = staged(docs.mapInArrow(tidy(_sets(words_each, counts)), "doc_id long, th long, node long, n long, fp binary, prefix array<long>"), "sets")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times"), F.any_value(F.struct("doc_id", "th")).alias("one"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"))
    nodes = staged(nodes, "nodes")

    met = staged(meeting(_prefixes(prints, nodes)), "meeting")
    rows = staged(met.join(nodes.select("node", "n", "fp"), "node"), "candidates")
    loose = connected_components(grouped(rows, "node", CAP).mapInArrow(tidy(_candidates), "a long, b long")).withColumnRenamed("node", "part")

    # the set of one document for each node that has a candidate
    chosen = staged(nodes.join(loose, F.col("node") == F.col("part")).select(F.col("component").alias("bucket"), "node", "n", "fp", F.xxhash64("one.doc_id", "one.th").alias("key")), "chosen")
    parts = connected_components(verified_links(docs, chosen, met, words_each))

    return labelled(prints.select("doc_id", "th", "node"), nodes.select("node", "first_id", F.col("times").alias("n")), parts).select("doc_id", "th", "component_id")


def keep_one_of_each(docs: DataFrame, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the smallest id of their group; a text goes by its id and its hash, so
    another text with the same id is judged by its own group.  Rows with a null id stay."""
    gone = _similar(docs, words_each, id_col, text_col).where("doc_id is not null and not (doc_id <=> component_id)")
    gone = staged(gone.select("doc_id", "th", F.xxhash64("doc_id", "th").alias("key")).distinct(), "gone")
    own = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(f"`{text_col}`")]
    held = docs.select(F.struct("*").alias("row"), *(c.alias(name) for c, name in zip(own, ("id", "of"), strict=True)), F.xxhash64(*own).alias("own"))
    same = (F.col("id") == F.col("doc_id")) & (F.col("of") == F.col("th"))
    if gone.count() <= FEW_GONE:
        return held.join(F.broadcast(gone), same, "left_anti").select("row.*")
    # too many to broadcast: a bitmap tells most of the rows that stay, the others are shuffled
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(gone, "key"))
    some = with_bit(held, "own", asked, True).join(gone, same, "left_anti")
    return with_bit(held, "own", asked, False).union(some).select("row.*")
