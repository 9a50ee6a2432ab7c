"""Periodic runs of words: found, listed, and collapsed to their first period.

A run is a stretch of consecutive words whose smallest period q (words q apart are identical)
fits in it at least `repeats` times, of `min_length` words or more, that no neighbouring word
extends.

Masking comes first.  The part of a run that repeats at distance q has at least k words, where k
is the least of max(min_length, repeats * q) - q over all q, so every word of a run is within
k consecutive words that occur again in its document.  Words outside such repeated k-grams can't
join runs; stretches of the others, the segments, are searched by Main and Lorentz: a segment is
halved, runs across its middle are found from common extensions on both sides of it, and the
halves are searched in turn.  All nodes of one depth, of all documents of a slice, go in step.
Common extensions come from exact names of all stretches of 1, 2, 4, ... words, so no hash
decides (the k-grams' hashes only choose what is searched; a collision lets too much through).

Nothing is shuffled.  A task holds a slice of texts of about 4 MB, or one longer text, and some
hundred bytes for each of its words that survive.

Cases: a null or empty text, and one of white space only, has no words, no runs and an empty
collapsed text; repeated rows are each returned; null ids are returned as null; an empty table
gives an empty result.  Of runs that share both ends only the smallest period counts.  Only the
named columns are read, whatever others are called."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._pieces import binary, distinct, gathered, slices
from ._shared import Batches, BatchFn, kept, tidy

MIN_LENGTH = 6
REPEATS = 4
RUNS = "array<struct<start:long,length:long,period:long>>"
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def least_overlap(min_length: int, repeats: int) -> int:
    """The fewest words of a run that occur again a period later."""
    return min(max(min_length, repeats * q) - q for q in range(1, min_length + 1))


class Words:
    """The words of a slice of texts, each followed by one space, one text after the other."""

    def __init__(self, data: np.ndarray, texts: np.ndarray) -> None:
        solid = ~BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        some = texts[:-1][texts[:-1] < len(data)]
        begins[some] = solid[some]
        starts = np.flatnonzero(begins)
        #: the first word of each text, and the end
        self.first = np.searchsorted(starts, texts)
        upto = np.concatenate(([0], np.cumsum(solid)))
        size = np.diff(np.append(upto[starts], upto[-1]))
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        self.bytes = np.full(int(self.at[-1]), 32, np.uint8)
        own = np.ones(len(self.bytes), bool)
        own[self.at[1:] - 1] = False
        self.bytes[own] = data[solid]
        self.ids = distinct(self.bytes, self.at[:-1])[1].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        #: where the word in each place is found
        self.source = np.arange(len(starts))
        self.text = np.repeat(np.arange(len(texts) - 1), np.diff(self.first))

    def loop(self, t: int, seed: int) -> None:
        """From word a on, text t repeats the p words that begin there, as the seed says."""
        lo, hi = int(self.first[t]), int(self.first[t + 1])
        n = hi - lo
        if n:
            a = seed % n
            p = 1 + (n - a) // (3 + seed % 8)
            self.source[lo + a : hi] = lo + a + np.arange(n - a) % p

    def joined(self, t: int, keep: np.ndarray) -> np.ndarray:
        """The bytes of the kept words of text t with one space between them."""
        lo, hi = int(self.first[t]), int(self.first[t + 1])
        source, keep = self.source[lo:hi], keep[lo:hi]
        if keep.all() and (hi == lo or (source[0] == lo and (np.diff(source) == 1).all())):
            return self.bytes[self.at[lo] : max(self.at[lo], self.at[hi] - 1)]
        source = source[keep]
        return gathered(self.bytes, self.at[source], self.at[source + 1] - self.at[source])[:-1]


def repeated_grams(ids: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Whether each word is within k consecutive words that occur again in its text."""
    n = len(ids) - k + 1
    covered = np.zeros(len(ids) + 1, np.int64)
    if n > 1:
        h = np.zeros(n, np.uint64)
        for d in range(k):
            h = (h ^ ids[d : d + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ text[:n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        whole = np.flatnonzero(text[:n] == text[k - 1 :])
        order = whole[np.argsort(h[whole])]
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(n, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again = np.flatnonzero(again)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + k, -1)
    return np.cumsum(covered[:-1]) > 0


class Extensions:
    """Common extensions of places in segments, by names of all stretches of 2**j words: equal names,
    equal stretches."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.begin, self.end = begin, end
        place = np.arange(len(ids))
        longest = int((end - begin).max(initial=1))
        #: the name of the stretch of 2**j words from each place, in row j
        self.names = np.full((longest.bit_length(), len(ids)), -1, np.int32)
        self.names[0] = np.unique(ids, return_inverse=True)[1]
        for j in range(1, len(self.names)):
            fit = np.flatnonzero(place + (1 << j) <= end)
            below = self.names[j - 1].astype(np.int64)
            self.names[j, fit] = np.unique(below[fit] << 32 | below[fit + (1 << j - 1)], return_inverse=True)[1]

    def equal(self, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretches of 2**j words from a and b, which lie in their segment, are equal."""
        return self.names[j, a] == self.names[j, b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on; a < b, of one segment."""
        n, end, last = np.zeros(len(a), np.int64), self.end[a], len(self.end) - 1
        for j in range(len(self.names) - 1, -1, -1):
            fits = b + n + (1 << j) <= end
            n += (fits & (self.names[j][np.minimum(a + n, last)] == self.names[j][np.minimum(b + n, last)])).astype(np.int64) << j
        return n

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b; a < b, of one segment."""
        n, begin = np.zeros(len(a), np.int64), self.begin[a]
        for j in range(len(self.names) - 1, -1, -1):
            x, y = a - n - (1 << j), b - n - (1 << j)
            n += ((x >= begin) & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])).astype(np.int64) << j
        return n


def main_lorentz(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs within segments, sorted by start, then period.
    `begin` and `end` are those of each place's segment."""
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    ext = Extensions(ids, begin, end)
    lo = np.unique(begin)
    hi = end[lo]
    aside = min(repeats // 2, 2)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lo := lo[(wide := hi - lo >= min_length)]):
        hi = hi[wide]
        mid = (lo + hi) // 2
        most = (hi - lo) // repeats
        own = np.repeat(np.arange(len(lo)), most)
        p = np.arange(len(own)) - np.repeat(np.cumsum(most) - most, most) + 1
        m, j = mid[own], np.frexp(p)[1].astype(np.int64) - 1
        # a run across the middle has `aside` periods on one side of it: right of it, then left of it
        for x, inside in ((m, m + aside * p <= hi[own]), (m - aside * p, m - aside * p >= lo[own])):
            x, q, i = x[inside], p[inside], j[inside]
            if aside == 2:
                same = ext.equal(i, x, x + q) & ext.equal(i, x + q - (1 << i), x + 2 * q - (1 << i))
                x, q = x[same], q[same]
            start, stop = x - ext.behind(x, x + q), x + q + ext.ahead(x, x + q)
            long = stop - start >= np.maximum(min_length, repeats * q)
            found.append((start[long], stop[long], q[long]))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    if not found:
        return none, none, none
    start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def runs_of(words: Words, min_length: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, period) of the runs of a slice's texts, sorted."""
    ids = words.ids[words.source]
    live = np.flatnonzero(repeated_grams(ids, words.text, least_overlap(min_length, repeats)))
    breaks = np.ones(len(live), bool)
    breaks[1:] = (np.diff(live) > 1) | (np.diff(words.text[live]) > 0)
    first = np.flatnonzero(breaks)
    n = np.diff(np.append(first, len(live)))
    start, stop, period = main_lorentz(ids[live], np.repeat(first, n), np.repeat(first + n, n), min_length, repeats)
    return live[start], live[start] + stop - start, period


def _slice(data: np.ndarray, texts: np.ndarray, seeds: list[int | None], min_length: int, repeats: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    words = Words(data, texts)
    for t, seed in enumerate(seeds):
        if seed is not None:
            words.loop(t, seed)
    start, stop, period = runs_of(words, min_length, repeats)
    gone = np.zeros(len(words.ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, stop, -1)
    keep = np.cumsum(gone[:-1]) == 0
    parts = [words.joined(t, keep) for t in range(len(texts) - 1)]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    collapsed = binary(np.concatenate(parts) if parts else data[:0], ends[:-1]).cast(pa.large_string()).cast(pa.string())
    at = words.first
    own = words.text[start] if len(start) else np.zeros(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - at[own], stop - start, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(texts))), pa.int32()), runs), collapsed


def _collapse(min_length: int, repeats: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("runs")
        for b in batches:
            lo = 0
            for data, texts in slices(b.column(1)):
                n = len(texts) - 1
                runs, collapsed = _slice(data, texts, b.column(2).slice(lo, n).to_pylist(), min_length, repeats)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), runs, collapsed], ["doc_id", "runs", "collapsed"])
                lo += n

    return tidy(run)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: Column | None = None, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """doc_id, runs (first word, length and period of each, by start, then period) and the text without
    the words that any run holds after its first period, one space between words.

    `loop` (a long, null for most) names documents whose words repeat by rule before they are
    searched: from word loop % n on, the 1 + (n - loop % n) / (3 + loop % 8) words that begin there.
    It plants runs of known place for tests at any scale."""
    if min_length < 2 or repeats < 2:
        raise ValueError("a run has two periods and two words at least")
    seed = (F.lit(None) if loop is None else loop).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), seed.alias("seed"))
    return rows.mapInArrow(_collapse(min_length, repeats), f"doc_id long, runs {RUNS}, collapsed string")


def planted(id_col: str = "doc_id") -> Column:
    """The loop of one document in ten, by the checksum of its id."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    return F.when(h % 10 == 0, F.floor(h / 10))


def run_digests(collapsed: DataFrame) -> DataFrame:
    """For each row of `collapse_runs`: the number of runs, the longest run (ties: smallest start, then
    period), and digests of the list of runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return collapsed.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
