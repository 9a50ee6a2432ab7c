"""Removal of repeated 100-byte strings by suffix arrays built with induced sorting.

Anchors bring together what may be equal.  The anchor of a 100-byte window is its 24-byte string
of least hash, so equal windows have equal anchors; a run of windows with one anchor is a
segment.  Anchors that occur once cannot lie in a repeat.  Of a segment that occurs several times,
all but the first occurrence are repeats.  Different segments of one anchor are laid out in shards,
and each shard's suffix array says which of their windows are equal:

* suffixes are classified (smaller or larger than the next one);
* leftmost-smaller (LMS) substrings are sorted and named, then recursively pairs of them, fours,
  and so on, until all differ or they are longer than the strings looked for;
* the array of all suffixes is induced from the sorted LMS suffixes in two linear passes, a bucket
  of one first byte at a time;
* permuted common prefixes with the suffix before give the groups of equal windows.

Two bitmaps of fixed size (of anchors that repeat, of documents that are concerned) spare most of
the shuffling while the input is small; they admit some rows too many, never too few, and with
ever larger input they spare less.

The windows of an anchor with more than HOT different segments go to no shard: the first occurrence
of each window's bytes is found by a minimum, which is combined before the shuffle, and all other
windows of those segments are repeats.  So no shard grows with a group's size.

Cases: null and empty texts, and all under 100 bytes, are kept whole.  Rows with equal ids or null
ids are documents of their own, in the order of id (null last) and of the text's hash; equal rows
are ordered at random, so one of them keeps its text.  An empty table gives an empty result.
Only the two named columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, partitions, staged, utf8, whole_groups
from .bitmaps import bitmap, has

LENGTH = 100
GRAM = 24
PIECE = 1 << 18
TOGETHER = 1 << 18
SHARD = 1 << 20
HOT = 20_000


# ---- anchors and segments

def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on, by doubling."""
    p, step, h = 0xD6E8FEB86659FD93, 1, b.astype(np.uint64) + np.uint64(1)
    spans = {1: (h, p)}
    while 2 * step <= k:
        h = h[:-step] * np.uint64(p) + h[step:]
        p, step = p * p % 2**64, 2 * step
        spans[step] = (h, p)
    out, have = None, 0
    for step in sorted(spans, reverse=True):
        if have + step <= k:
            h, p = spans[step]
            out = h if out is None else out[: len(out) - step] * np.uint64(p) + h[have : have + len(out) - step]
            have += step
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def segments(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's hash, anchor's place) of all segments of the texts that
    lie in `data` from `starts` to `ends`, each of at least LENGTH bytes."""
    h = gram_hashes(np.frombuffer(data, np.uint8), GRAM)
    width = LENGTH - GRAM + 1
    # the place in the low bits: of equal hashes the leftmost is least
    low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new[starts[starts < len(new)]] = True
    stop = ends - LENGTH + 1  # one past the last window of each text
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stop, -1)
    inside = np.cumsum(inside)[: len(anchor)] > 0
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    return first, last, h[anchor[first]], anchor[first]


def _pieces(key: int, text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(document, offset, bytes): a long text in pieces whose windows are its windows, each once."""
    for s in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield key, s, text[s : s + PIECE + LENGTH - 1]


def _batches_of_segments(batches: Batches) -> Iterator[tuple]:
    """(documents, offsets of their bytes, starts in data, data, segments) for some texts at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple:
        data = b"".join(x[2] for x in held)
        ends = np.cumsum([len(x[2]) for x in held])
        starts = ends - np.array([len(x[2]) for x in held])
        first, last, h, at = segments(data, starts, ends)
        own = np.searchsorted(starts, first, "right") - 1
        return np.array([x[0] for x in held], np.int64)[own], np.array([x[1] for x in held])[own] - starts[own], data, first, last, h, at

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            if len(text) < LENGTH:
                continue
            for piece in _pieces(key, text):
                held.append(piece)
                size += len(piece[2])
                if size >= TOGETHER:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _context_hashes(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(data[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64)


def _own_repeats(doc: np.ndarray, h: np.ndarray, ck: np.ndarray) -> np.ndarray:
    """Segments that the same document has before, as a mask."""
    mixed = h ^ (ck * np.uint64(0x9E3779B97F4A7C15)) ^ (doc.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.zeros(len(h), bool)
    if len(np.unique(mixed)) < len(mixed):
        order = np.lexsort((np.arange(len(h)), ck, h, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1]) & (ck[order][1:] == ck[order][:-1])
        again[order[1:][same]] = True
    return again


def _anchors(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Each document's anchors: a segment that it repeats, however often, counts twice."""
    for doc, _, data, first, last, h, _ in _batches_of_segments(batches):
        again = _own_repeats(doc, h, _context_hashes(data, first, last))
        twice = np.unique(np.stack((doc[again].view(np.uint64), h[again])), axis=1)[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h[~again], twice)).view(np.int64))], ["h"])


def _segments(bitmap) -> BatchFn:
    """(h, ck, doc, start, n) of segments whose anchor may repeat; repeats within a document have no h."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        marked = bitmap.value
        for doc, shift, data, first, last, h, _ in _batches_of_segments(batches):
            maybe = has(marked, h)
            doc, shift, first, last, h = doc[maybe], shift[maybe], first[maybe], last[maybe], h[maybe]
            ck = _context_hashes(data, first, last)
            again = _own_repeats(doc, h, ck)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), mask=again), pa.array(ck.view(np.int64)), pa.array(doc), pa.array((first + shift).astype(np.int64)), pa.array((last - first + 1).astype(np.int32))], ["h", "ck", "doc", "start", "n"])

    return run


# ---- documents by bitmap

def _with_bit(words, want: bool) -> BatchFn:
    """Documents of which the bitmap has (or has not) the key."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = has(words.value, _mixed(b.column(0).to_numpy())) == want
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def _mixed(key: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) for k in key.tolist()], np.uint64)


# ---- the suffix array

def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last letter is the only 0."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # of runs of equal letters
    small = np.repeat(t[ends] < t[np.minimum(ends + 1, n - 1)], np.diff(ends, prepend=-1))
    small[-1] = True
    return small


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def name_lms(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring.  Seven 9-bit letters make a word; beyond a substring's end
    stands a letter larger than any, since there the suffix is of the larger class."""
    end = np.concatenate((lms[1:], [len(t) - 1]))
    size = end - lms + 1
    padded = np.concatenate((t.astype(np.uint64), np.zeros(8, np.uint64)))

    def word(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for x in range(7 * k, 7 * k + 7):
            beyond = np.where(which < len(lms) - 1, np.uint64(511), np.uint64(0))  # the text's end is less than any
            letter = np.where(x < size[which], padded[np.minimum(lms[which] + x, len(padded) - 1)], beyond)
            out = (out << np.uint64(9)) | letter
        return out

    every = np.arange(len(lms))
    rank, k = _rank(word(every, 0)), 1
    longer = every[size > 7]
    while len(longer):
        sub = np.zeros(len(lms), np.int64)
        sub[longer] = 1 + _rank(word(longer, k))
        rank = _rank(rank * (int(sub.max()) + 1) + sub)
        k += 1
        longer = longer[size[longer] > 7 * k]
    return rank


def sort_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS positions in the order of their suffixes, to `depth` bytes at least."""
    rank = name_lms(t, lms)
    step, m = 1, len(lms)
    while 2 * step <= depth and rank.max(initial=0) + 1 < m:  # an LMS substring takes two bytes or more
        after = np.zeros(m, np.int64)
        after[: max(0, m - step)] = rank[step:] + 1
        rank = _rank(rank * (m + 1) + after)
        step *= 2
    return lms[np.argsort(rank, kind="stable")]


def induce(t: np.ndarray, small: np.ndarray, lms_sorted: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted LMS suffixes: larger suffixes from the left, smaller ones from
    the right.  All suffixes of a bucket are taken at once; those that put their predecessor into
    their own bucket make a further wave."""
    n = len(t)
    count = np.bincount(t, minlength=511)
    ends = np.cumsum(count)
    heads = ends - count
    large_count = np.bincount(t[~small], minlength=511)
    letters = np.flatnonzero(count)
    sa = np.full(n, -1, np.int32)
    lms_of = {int(c): x for c in letters if len(x := lms_sorted[t[lms_sorted] == c])} if len(lms_sorted) < 4096 else None
    if lms_of is None:
        first = t[lms_sorted]  # sorted, since the suffixes are
        cuts = np.searchsorted(first, np.arange(512))
        lms_of = {int(c): lms_sorted[cuts[c] : cuts[c + 1]] for c in letters if cuts[c + 1] > cuts[c]}
    none = np.zeros(0, np.int64)

    def put(items: np.ndarray, place: np.ndarray, backwards: bool) -> None:
        """Items, in the order of the scan, to the next free places of their buckets."""
        if not len(items):
            return
        c = t[items]
        order = np.argsort(c.astype(np.uint8) if c.max() < 256 else c, kind="stable")
        items, c = items[order], c[order]
        begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        times = np.diff(np.concatenate((begin, [len(c)])))
        within = np.arange(len(c)) - np.repeat(begin, times)
        if backwards:
            sa[place[c] - 1 - within] = items
            place[c[begin]] -= times
        else:
            sa[place[c] + within] = items
            place[c[begin]] += times

    place = heads.copy()
    for c in letters.tolist():
        done = heads[c]
        while done < place[c]:  # waves within the bucket
            before = sa[done : place[c]] - 1
            done = place[c]
            own = before[before >= 0]
            own = own[(t[own] == c) & ~small[own]]
            sa[done : done + len(own)] = own
            place[c] += len(own)
        before = np.concatenate((sa[heads[c] : place[c]], lms_of.get(c, none))) - 1
        before = before[before >= 0]
        put(before[(t[before] > c) & ~small[before]], place, False)

    place = ends.copy()
    for c in letters[::-1].tolist():
        done = ends[c]
        while done > place[c]:
            before = sa[place[c] : done][::-1] - 1
            done = place[c]
            own = before[before >= 0]
            own = own[(t[own] == c) & small[own]]
            sa[done - len(own) : done] = own[::-1]
            place[c] -= len(own)
        scan = np.concatenate((sa[place[c] : ends[c]][::-1], sa[heads[c] : heads[c] + large_count[c]][::-1])) - 1
        scan = scan[scan >= 0]
        put(scan[(t[scan] < c) & small[scan]], place, True)
    sa[0] = n - 1  # the end of the text, which no suffix induces
    return sa


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of `t` (letters 0 to 510, the last one and no other 0), in order to `depth` letters at least."""
    t = np.asarray(t, np.int32)
    if len(t) == 1:
        return np.zeros(1, np.int32)
    small = classify(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    return induce(t, small, sort_lms(t, lms, depth))


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place of the text, the letters (at most `most`) that its suffix shares with the one
    before it in the array."""
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate((np.asarray(t, np.int32), -1 - np.arange(8, dtype=np.int32)))
    words = np.zeros(n + 1, np.uint64)
    for k in range(7):
        words = (words << np.uint64(9)) | (padded[k : k + n + 1] & 511).astype(np.uint64)
    plcp = np.zeros(n, np.int32)
    for s in range(0, n, 1 << 17):  # a stretch of the text at a time bounds what is held
        live = s + np.flatnonzero(phi[s : s + (1 << 17)] >= 0)
        k = 0
        while len(live) and k < most:
            a, b = live + k, phi[live] + k
            inside = (a < n) & (b < n)
            differ = np.where(inside, words[np.minimum(a, n)] ^ words[np.minimum(b, n)], ~np.uint64(0))
            same = differ == 0
            d = differ[~same]
            shared = np.zeros(len(d), np.int32)
            for x in range(6, -1, -1):  # letters shared before the first that differs
                shared += (shared == 6 - x) & ((d >> np.uint64(9 * x)) & np.uint64(511) == 0)
            plcp[live[~same]] = k + shared
            live, k = live[same], k + 7
        plcp[live] = most
    return np.minimum(plcp, most)


# ---- shards

def repeated_windows(texts: list[bytes], windows: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """For each text, which of its first `windows` windows occur earlier: in a text of lower
    `order`, or before in the same text."""
    size = np.array([len(x) for x in texts]) + 1
    begin = np.cumsum(size) - size
    t = np.zeros(int(size.sum()) + 1, np.int32)
    t[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t[:-1] += 2
    t[begin + size - 1] = 1  # parts texts, below any byte
    sa = suffix_array(t)
    shared = permuted_prefixes(t, sa)[sa]
    text = np.append(np.repeat(np.arange(len(texts), dtype=np.int32), size), np.int32(0))
    offset = np.arange(len(t), dtype=np.int32) - begin.astype(np.int32)[text]
    is_window = offset < windows[text]
    is_window[-1] = False
    group = np.cumsum(shared < LENGTH, dtype=np.int32)
    here = is_window[sa]
    place, group = sa[here], group[here]
    by = np.lexsort((offset[place], order[text[place]], group))
    place, group = place[by], group[by]
    repeat = np.zeros(len(t), bool)
    repeat[place[1:]] = group[1:] == group[:-1]
    return [repeat[b : b + w] for b, w in zip(begin.tolist(), windows.tolist(), strict=True)]


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shards(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows, from shards of whole anchors."""
    for t in whole_groups(batches, ["h"], 1 << 13):
        h, docs, starts, n = (t.column(c).to_numpy() for c in ("h", "doc", "start", "n"))
        texts = t.column("text").to_pylist()
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.cumsum([len(x) + 1 for x in texts])
        cut = [0]
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True):
            if size[hi - 1] - (size[cut[-1] - 1] if cut[-1] else 0) > SHARD and lo > cut[-1]:
                cut.append(lo)
        cut.append(len(h))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            order = np.empty(hi - lo, np.int64)
            order[np.lexsort((starts[lo:hi], docs[lo:hi]))] = np.arange(hi - lo)
            rows = []
            for k, mask in enumerate(repeated_windows(texts[lo:hi], n[lo:hi], order)):
                a, b = _ranges(mask)
                rows += [(docs[lo + k], starts[lo + k] + x, y - x) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if rows:
                d, s, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(w, pa.int32())], ["doc", "start", "n"])


def _lists(column: pa.ListArray) -> tuple[list[int], dict[str, np.ndarray]]:
    """Where each row's list begins, and the fields of all lists' structs."""
    values = column.values
    return column.offsets.to_pylist(), {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}


def _cut(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The bytes of segments, from documents joined with a list of them."""
    names = ["h", "doc", "start", "n", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for b in batches:
        rows = []
        cuts, fields = _lists(b.column(2))
        h, start, size = (fields[f].tolist() for f in ("h", "start", "n"))
        for d, (key, text) in enumerate(zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True)):
            for x in range(cuts[d], cuts[d + 1]):
                at, n = start[x], size[x]
                rows.append((h[x], key, at, n, text[at : at + n + LENGTH - 1]))
            if len(rows) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _windows(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The windows of hot segments, from documents joined with a list of them; of equal ones that are
    held at a time only the first."""
    first: dict[bytes, tuple[int, int]] = {}

    def out() -> pa.RecordBatch:
        docs, starts = zip(*first.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(list(first), pa.binary())], ["doc", "start", "w"])

    for b in batches:
        cuts, fields = _lists(b.column(2))
        start, size = (fields[f].tolist() for f in ("start", "n"))
        for d, (key, text) in enumerate(zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True)):
            for x in range(cuts[d], cuts[d + 1]):
                for k in range(start[x], start[x] + size[x]):
                    w = text[k : k + LENGTH]
                    if w not in first or (key, k) < first[w]:
                        first[w] = (key, k)
                if len(first) > 1 << 14:
                    yield out()
                    first.clear()
    if first:
        yield out()


def _finish(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Each document's result: all repeated segments less first occurrences, and the shards' ranges
    and hot segments, less the first occurrences of hot windows."""
    for b in batches:
        rows = []
        cuts, fields = _lists(b.column(2))
        for d, (key, text) in enumerate(zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True)):
            gone = np.zeros(max(0, len(text) - LENGTH + 1), bool)
            kinds, start, size = (fields[f][cuts[d] : cuts[d + 1]] for f in ("kind", "start", "n"))
            # segments that occur several times, first occurrences among them, ranges found in shards and hot segments, first hot windows
            for kind in (0, 1, 2, 3):
                own = kinds == kind
                for x, n in zip(start[own].tolist(), size[own].tolist(), strict=True):
                    gone[x : x + n] = kind in (0, 2)
            a, e = _ranges(gone)
            e = e + LENGTH - 1
            if len(a) > 1:  # ranges of bytes that touch or overlap are one
                apart = np.flatnonzero(a[1:] > e[:-1])
                a, e = a[np.concatenate(([0], apart + 1))], e[np.concatenate((apart, [len(e) - 1]))]
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), e.tolist(), strict=True):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            rows.append((key, len(text), int((e - a).sum()), len(a), kept.hexdigest(), a.tolist(), e.tolist()))
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text, doc_id) with a key of its own for each row, in the order that decides which
    occurrence is earlier.  Ids that are all different are their own keys."""
    ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return docs.select(F.col("doc_id").alias("key"), "text", "doc_id")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    spark = docs.sparkSession
    # a row's place is that in its range and the size of the ranges before
    r = staged(docs.repartitionByRange(partitions(spark), *order).withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = r.groupBy("p").count().select(F.col("p").alias("q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("p").orderBy(*order))
    rows = r.withColumn("n", own).join(F.broadcast(starts), F.col("p") == F.col("q"))
    return staged(rows.select((F.col("start") + F.col("n") - 1).cast("long").alias("key"), "text", "doc_id"), "keyed")


def _per_doc(ranges: DataFrame, *columns: str) -> DataFrame:
    """A list of structs for each document; it is bounded by the document's length."""
    return ranges.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("list"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed
    spans' starts and ends in bytes."""
    spark: SparkSession = docs.sparkSession
    docs = _keyed(columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    texts = docs.select("key", "text")

    anchors = texts.mapInArrow(_anchors, "h long").groupBy("h").count().where("count > 1").select("h")
    anchors = staged(anchors, "anchors")
    marked = spark.sparkContext.broadcast(bitmap(anchors, "h"))
    found = texts.mapInArrow(_segments(marked), "h long, ck long, doc long, start long, n int")
    # both kinds of rows come from one pass: those without an anchor repeat within their document
    repeats = staged(found.join(anchors.withColumnRenamed("h", "anchor"), F.col("h") == F.col("anchor"), "left").where("h is null or anchor is not null").select("h", "ck", "doc", "start", "n"), "segments")

    firsts = repeats.where("h is not null").groupBy("h", "ck").agg(F.min(F.struct("doc", "start", "n")).alias("f"), F.count("*").alias("times"))
    firsts = staged(firsts.select("h", "f.doc", "f.start", "f.n", "times"), "firsts")
    several = firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumnRenamed("h", "anchor")
    wanted = firsts.join(several, F.col("h") == F.col("anchor")).select("doc", "h", "start", "n", (F.col("kinds") > HOT).alias("hot"))
    wanted = staged(wanted, "wanted")
    key_hash = lambda df, c: df.select(F.xxhash64(c).alias("x"))

    def with_texts(part: DataFrame) -> tuple[DataFrame, object]:
        asked = spark.sparkContext.broadcast(bitmap(key_hash(part, "doc"), "x"))
        some = texts.mapInArrow(_with_bit(asked, True), "key long, text string")
        return some.join(_per_doc(part, "h", "start", "n"), F.col("key") == F.col("doc")).select("key", "text", "list"), asked

    marked.unpersist()
    cut, asked = with_texts(wanted.where("not hot"))
    cut = cut.mapInArrow(_cut, "h long, doc long, start long, n int, text binary")
    # of equal segments only the first is here, so an anchor's rows are different texts
    shards = cut.repartition(partitions(spark), "h").sortWithinPartitions("h")
    inner = staged(shards.mapInArrow(_shards, "doc long, start long, n int"), "inner").withColumn("kind", F.lit(2))
    asked.unpersist()
    hot = wanted.where("hot").select("doc", "h", "start", "n")
    if not hot.isEmpty():
        cut, asked = with_texts(hot)
        first = cut.mapInArrow(_windows, "doc long, start long, w binary").groupBy("w").agg(F.min(F.struct("doc", "start")).alias("f"))
        first = staged(first.select("f.doc", "f.start"), "first")
        asked.unpersist()
        inner = inner.union(hot.select("doc", "start", "n", F.lit(2))).union(first.select("doc", "start", F.lit(1), F.lit(3)))

    ranges = repeats.select("doc", "start", "n", F.lit(0).alias("kind")).union(firsts.select("doc", "start", "n", F.lit(1).alias("kind"))).union(inner.select("doc", "start", "n", "kind"))
    touched = spark.sparkContext.broadcast(bitmap(key_hash(repeats.where("h is null").select("doc").union(repeats.where("h is not null").select("doc")), "doc"), "x"))
    result = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"
    joined = docs.mapInArrow(_with_bit(touched, True), "key long, text string, doc_id long").join(_per_doc(ranges, "start", "n", "kind"), F.col("key") == F.col("doc"), "left")
    changed = joined.select("doc_id", "text", "list").mapInArrow(_finish, result)
    alone = docs.mapInArrow(_with_bit(touched, False), "key long, text string, doc_id long").select("doc_id", "text", F.lit(None).cast("array<struct<start: long, n: int, kind: int>>").alias("list")).mapInArrow(_finish, result)
    return changed.union(alone).withColumnRenamed("key", "doc_id")
