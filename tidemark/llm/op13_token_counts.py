"""Token counts of documents, without keeping or shuffling any token.

Texts are split into pre-tokens, which a byte-level BPE encodes apart from each other, and the
counts of their tokens are looked up in two tiers.

Tier one is a hash table of frequent pre-tokens and how many tokens each has, a few hundred
kilobytes that are broadcast.  Every task summarises the pre-tokens of its documents in SUMMARY
counters; summaries are merged, a bounded number at a time, into one.  All documents count, and no
pre-token that makes up more than a SUMMARY-th of them all is missing from it, while no task and
not the driver ever holds more than FAN summaries.  Pre-tokens themselves are never dealt out by key.

Tier two is a cache in each worker process: what the table lacks is encoded by the tokenizers library
once for as long as the cache holds it.  Which tier answers changes the speed only.

A pre-token is found in the table by its bytes: the hash gives the slot, the bytes there decide.

Cases: a null or empty text has no bytes and no tokens; special tokens' strings within texts count as
the library takes them by default; repeated rows are each returned; null ids are returned as null; an
empty table gives an empty result and an empty table of pre-tokens.  Only the named columns are read.
With a tokenizer that is not a plain byte-level BPE, whole texts are encoded."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import buffers, bytes_of, distinct, gathered, piece_starts, slices
from ._shared import Batches, BatchFn, columns_as, kept, staged, tidy
from .op08_token_file import Library
from .op10_bpe import Words

SUMMARY = 1 << 14  # counters
FAN = 32  # summaries merged at a time
HELD = 1 << 18  # different pre-tokens counted before they are cut to SUMMARY counters
CACHED = 1 << 18  # pre-tokens in a worker's cache
CACHED_BYTES = 1 << 25
LIMIT = 1024


def pre_tokens(words: Words, data: np.ndarray, texts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(pre-tokens of the different pieces of a slice, the piece of each, the piece at each start, starts)."""
    starts = piece_starts(data, texts)
    pieces, which = distinct(data, starts)
    plain, others, found = words.of(pieces)
    split = pa.array([w.encode() for ws in found for w in ws], pa.large_binary())
    piece = np.concatenate((plain, np.repeat(others, [len(ws) for ws in found]))).astype(np.int64)
    return pa.concat_arrays([pieces.take(pa.array(plain)), split]), piece, which, starts


def cut(words: pa.Array, n: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
    """At most `most` counters: the next largest count is taken from all, what is left above zero stays.
    A word's count falls short by at most a (most + 1)-th of all that was counted."""
    if len(n) > most:
        n = n - np.partition(n, -most - 1)[-most - 1]
        live = np.flatnonzero(n > 0)
        words, n = words.take(pa.array(live)), n[live]
    return words, n


def added(words: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    t = pa.table({"word": words, "n": pa.array(n, pa.int64())}).group_by("word").aggregate([("n", "sum")])
    return t.column("word").combine_chunks(), t.column("n_sum").to_numpy()


def _as_row(part: int, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (words.cast(pa.binary()), pa.array(n, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *lists], ["part", "words", "counts"])


def _summary(special: list[str], most: int) -> BatchFn:
    """One row for a task: the counters of its documents' pre-tokens."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("token_counts")
        words, total, held, rows = Words(special), (pa.array([], pa.large_binary()), np.zeros(0, np.int64)), [], 0
        for b in batches:
            for data, texts in slices(b.column(0)):
                if not len(data):
                    continue
                tokens, piece, which, _ = pre_tokens(words, data, texts)
                held.append((tokens, np.bincount(which, minlength=int(piece.max()) + 1)[piece]))
                rows += len(tokens)
                if rows > HELD:
                    total, held, rows = _gather([total, *held], most), [], 0
        total = _gather([total, *held], most)
        if len(total[0]):
            yield _as_row(TaskContext.get().partitionId(), *total)

    return tidy(run)


def _gather(parts: list[tuple[pa.Array, np.ndarray]], most: int) -> tuple[pa.Array, np.ndarray]:
    return cut(*added(pa.concat_arrays([w for w, _ in parts]), np.concatenate([n for _, n in parts])), most)


def _merge(most: int, fan: int) -> Callable[[pa.Table], pa.Table]:
    """The summaries of one group as one."""

    def run(t: pa.Table) -> pa.Table:
        total = (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        for b in t.to_batches():
            for k in range(b.num_rows):
                total = _gather([total, (b.column("words")[k].values.cast(pa.large_binary()), b.column("counts")[k].values.to_numpy())], most)
        return pa.Table.from_batches([_as_row(t.column("part")[0].as_py() // fan, *total)])

    return run


def frequent_pre_tokens(docs: DataFrame, special: list[str], text_col: str = "text", most: int = SUMMARY, fan: int = FAN) -> tuple[list[bytes], list[int]]:
    """(pre-tokens, lower bounds of their counts): `most` at most, over all documents."""
    schema = "part long, words array<binary>, counts array<long>"
    rows = staged(columns_as(docs, text=text_col).mapInArrow(_summary(special, most), schema), "summaries")
    while (last := rows.agg(F.max("part")).first()[0]) is not None and (last >= fan or rows.count() > 1):
        rows = staged(rows.groupBy(F.floor(F.col("part") / fan)).applyInArrow(_merge(most, fan), schema), "summaries")
    one = rows.first()
    return ([bytes(w) for w in one.words], list(one.counts)) if one else ([], [])


MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; all go on in step, eight bytes at a time."""
    size = np.diff(at)
    h, live, k = size.astype(np.uint64) * MIX, np.arange(len(size)), 0
    padded = np.append(data, np.zeros(8, np.uint8))
    while len(live := live[size[live] > k]):
        left = np.minimum(size[live] - k, 8)
        word = np.zeros(len(live), np.uint64)
        for d in range(8):
            word |= np.where(d < left, padded[np.minimum(at[live] + k + d, len(data))], 0).astype(np.uint64) << np.uint64(8 * d)
        x = (h[live] ^ word) * MIX
        h[live] = x ^ x >> np.uint64(31)
        k += 8
    return h


class LengthTable:
    """Numbers by byte strings: open addressing with linear probing in a power of two of slots, the
    strings in one block of bytes."""

    def __init__(self, words: list[bytes], numbers: list[int]) -> None:
        self.numbers = np.array(numbers, np.int32)
        self.data, self.at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
        self.mask = (1 << (2 * len(words) + 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        slot, live = self._home(self.data, self.at), np.arange(len(words), dtype=np.int32)
        while len(live):  # of those that want a free slot the first gets it, the others go on
            free = self.slots[slot[live]] < 0
            took = live[free][np.unique(slot[live[free]], return_index=True)[1]]
            self.slots[slot[took]] = took
            live = live[self.slots[slot[live]] != live]
            slot[live] = (slot[live] + 1) & self.mask

    def _home(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (hashes(data, at) & np.uint64(self.mask)).astype(np.int64)

    def get(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for those that aren't here."""
        data, at = buffers(words)
        out, slot, live, size, own = np.full(len(words), -1, np.int64), self._home(data, at), np.arange(len(words)), np.diff(at), np.diff(self.at)
        while len(live):
            entry = self.slots[slot[live]]
            live, entry = live[entry >= 0], entry[entry >= 0]
            long = size[live] == own[entry]
            i, e = live[long], entry[long]
            same = np.zeros(len(live), bool)
            if len(i):
                n = size[i]
                differ = gathered(data, at[i], n) != gathered(self.data, self.at[e], n)
                upto = np.concatenate(([0], np.cumsum(differ)))
                ends = np.cumsum(n)
                same[long] = upto[ends] == upto[ends - n]
            out[live[same]] = self.numbers[entry[same]]
            live = live[~same]
            slot[live] = (slot[live] + 1) & self.mask
        return out


class Counter:
    """Counts tokens by the table, then by a cache over the library; one for each worker process."""

    def __init__(self, table: LengthTable, path: str) -> None:
        self.table, self.library = table, Library(path)
        self.words = Words(special_tokens(path)) if self.library.cut else None
        self.cache: dict[bytes, int] = {}
        self.held = 0

    def _missed(self, words: pa.Array) -> np.ndarray:
        """How many tokens each of some different pre-tokens has, by the cache or the library."""
        keys = words.to_pylist()
        new = [k for k, w in enumerate(keys) if w not in self.cache]
        if new:
            if len(self.cache) + len(new) > CACHED or self.held > CACHED_BYTES:
                self.cache, self.held = {}, 0
                new = list(range(len(keys)))
            missing = words.take(pa.array(new))
            _, _, count = self.library.memo.fill(missing)
            self.cache.update(zip(missing.to_pylist(), count.tolist(), strict=True))
            self.held += int(pc.sum(pc.binary_length(missing)).as_py())
        return np.array([self.cache[w] for w in keys], np.int64)

    def lengths(self, words: pa.Array) -> np.ndarray:
        n = self.table.get(words)
        missed = np.flatnonzero(n < 0)
        if len(missed):
            found = words.take(pa.array(missed)).dictionary_encode()
            n[missed] = self._missed(found.dictionary)[found.indices.to_numpy()]
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        if not self.library.cut:
            return np.array([len(self.library.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()], np.int64)
        parts = [np.zeros(0, np.int64)]
        for data, at in slices(texts):
            if not len(data):
                parts.append(np.zeros(len(at) - 1, np.int64))
                continue
            tokens, piece, which, starts = pre_tokens(self.words, data, at)
            per = np.bincount(piece, weights=self.lengths(tokens)).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(per[which])))
            parts.append(np.diff(upto[np.searchsorted(starts, at)]))
        return np.concatenate(parts)


def special_tokens(path: str) -> list[str]:
    return [t["content"] for t in json.loads(open(path, encoding="utf-8").read())["added_tokens"]]


def _counted(shared, limit: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        table, path, key = shared.value
        state = kept("token_counts")
        if state.get("key") != key:
            state.clear()
            state.update(key=key, counter=Counter(table, path))
        for b in batches:
            n = state["counter"].counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bytes_of(b.column(1))[1]), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tidy(run)


class TokenCounts:
    """Tier one fitted to a corpus, for counting with it; any documents may then be counted."""

    def __init__(self, docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> None:
        library = Library(tokenizer_path)
        words = frequent_pre_tokens(docs, special_tokens(tokenizer_path), text_col)[0] if library.cut else []
        count = library.memo.fill(pa.array(words, pa.large_binary()))[2].tolist() if words else []
        self.shared = docs.sparkSession.sparkContext.broadcast((LengthTable(words, count), tokenizer_path, uuid.uuid4().hex))

    def counts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
        """doc_id, n_bytes, n_tokens, over_limit."""
        rows = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        return rows.mapInArrow(_counted(self.shared, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
