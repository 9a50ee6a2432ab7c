"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's most frequent words, counted over all documents, and the ids that they encode
to are compiled into an automaton that shares prefixes and suffixes; transitions carry
numbers whose sum along a word is its place in the table of ids.  The automaton is one
bounded block of bytes, broadcast and memory-mapped by every worker.  Words outside it are
merged exactly, by the vocabulary's ranks.

Cases: a null or empty text has no ids and decodes to an empty text; texts may hold special
tokens' strings, which are encoded as the library does; repeated rows are each returned; null
ids are returned as null; an empty table gives an empty result and an empty lexicon.  Only the
named columns are read."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import KIND, LETTER, Memo, buffers, distinct, gathered, ids_of_texts, piece_starts, slices, whole_in_pieces
from ._shared import Batches, BatchFn, columns_as, kept, staged, tidy

LEXICON_WORDS = 1 << 15
KNOWN = 1 << 19  # pieces remembered in a worker
COUNTED = 1 << 19  # rows of counts held before they are sent on
STEP = 1 << 15  # words merged in step
LONG = 64  # bytes; longer words are merged one by one
BITS = 24
NEVER = 1 << 62  # the rank of a pair that does not merge
# fixed value: the byte-level pre-tokenizer's pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        ids = model["vocab"]
        self.start = np.array([ids[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        spelling = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in ids.items()}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or not whole_in_pieces([t["content"]]):
                raise ValueError("special tokens that strip, stand alone or hold white space are not handled")
            self.special[t["content"]] = t["id"]
            spelling[t["id"]] = t["content"].encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << BITS | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        # a pair of ids as one number, its rank, and by rank the id that it merges to
        self.keys, self.ranks, self.merged = np.append(keys[order], NEVER), np.append(order, NEVER), np.array([ids[a + b] for a, b in pairs], np.int64)
        n = max(spelling, default=0) + 1
        self.spelling = pa.array([spelling.get(i, b"") for i in range(n)], pa.large_binary())
        self.names = pa.array([b"%d," % i for i in range(n)], pa.large_binary())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of ids; NEVER for those that do not merge."""
        key = a << BITS | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has), for a bounded number of words at a time."""
        parts, total = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for lo in range(0, len(words), STEP):
            ids, begin, count = self._merge(words.slice(lo, STEP))
            parts.append((ids, begin + total, count))
            total += len(ids)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In each word the pair of lowest rank, leftmost first, is merged until none is left; all words
        go on in step."""
        data, at = buffers(words)
        size = np.diff(at)
        begin, count, parts, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 0
        long = np.flatnonzero(size > LONG)
        for k in long.tolist():
            ids = self._merge_long(self.start[data[at[k] : at[k + 1]]].tolist())
            begin[k], count[k] = total, len(ids)
            parts.append(np.array(ids, np.int64))
            total += len(ids)
        short = np.flatnonzero((size > 0) & (size <= LONG))
        ids = self.start[gathered(data, at[short], size[short])]
        own = np.repeat(short, size[short])
        rank = np.full(len(ids), NEVER)
        within = np.flatnonzero(own[1:] == own[:-1])
        rank[within] = self.rank(ids[within], ids[within + 1])
        while len(ids):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            n = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            done = best == NEVER
            if done.any():
                begin[own[first[done]]], count[own[first[done]]] = total + np.cumsum(n[done]) - n[done], n[done]
                ended = np.repeat(done, n)
                parts.append(ids[ended])
                total += len(parts[-1])
                ids, own, rank, best, n = ids[~ended], own[~ended], rank[~ended], best[~done], n[~done]
                if not len(ids):
                    break
            at_best = np.flatnonzero(rank == np.repeat(best, n))
            at_best = at_best[np.diff(own[at_best], prepend=-1) != 0]
            ids[at_best] = self.merged[best]
            keep = np.ones(len(ids), bool)
            keep[at_best + 1] = False
            ids, own, rank = ids[keep], own[keep], rank[keep]
            new = at_best - np.arange(len(at_best))  # one id of each word before is gone
            rank[new] = NEVER
            for left in (new, new - 1):
                ok = left[(left >= 0) & (left < len(ids) - 1)]
                ok = ok[own[ok] == own[ok + 1]]
                rank[ok] = self.rank(ids[ok], ids[ok + 1])
        return np.concatenate(parts).astype(np.uint32), begin, count

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one word of any length, with a heap and links."""
        n = len(ids)
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, a, b) for k, (r, a, b) in enumerate(zip(first, ids, ids[1:], strict=False)) if r != NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            best, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt < 0 or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = int(self.merged[best]), -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0:
                    pair = (ids[x], ids[y])
                    if pair not in known:
                        known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if known[pair] != NEVER:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return [i for i in ids if i >= 0]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of (word, ids) as bytes.  Words are added in order; a state whose words are
    all in is replaced by an equal one already kept, so suffixes are shared."""
    entries = sorted(entries)
    # a state: [final, {byte: state}]; kept states are numbered and never change
    kept: dict[tuple, int] = {}
    made: list[tuple[bool, list[tuple[int, int]], int]] = []

    def keep(state: list) -> int:
        edges = list(state[1].items())
        key = (state[0], *edges)
        if key not in kept:
            kept[key] = len(made)
            made.append((state[0], edges, state[0] + sum(made[to][2] for _, to in edges)))
        return kept[key]

    path: list[list] = [[False, {}]]
    last = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([last, word]))
        for k in range(len(last), same, -1):
            path[k - 1][1][last[k - 1]] = keep(path.pop())
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1][last[k - 1]] = keep(path.pop())
    root = keep(path[0])

    final, labels, targets, sums, first = [], [], [], [], [0]
    for is_final, edges, _ in made:
        final.append(is_final)
        skipped = int(is_final)  # words that end here come before longer ones
        for byte, to in edges:
            labels.append(byte)
            targets.append(to)
            sums.append(skipped)
            skipped += made[to][2]
        first.append(len(labels))
    ids = [i for _, word_ids in entries for i in word_ids]
    ends = np.cumsum([0, *(len(w) for _, w in entries)])
    parts = [np.array(x, np.uint32).tobytes() for x in (first, targets, sums, ends, ids)] + [bytes(labels), bytes(final)]
    head = np.array([root, *(len(p) for p in parts)], np.uint32).tobytes()
    return head + b"".join(parts)


class Lexicon:
    """Looks words up in a memory-mapped automaton."""

    def __init__(self, data) -> None:
        head = np.frombuffer(data, np.uint32, 8).tolist()
        at, parts = 32, []
        for n, kind in zip(head[1:], [np.uint32] * 5 + [np.uint8] * 2, strict=True):
            parts.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
            at += n
        self.root, (first, self.targets, self.sums, self.ends, self.ids, labels, self.final) = head[0], parts
        # edges are in the order of their states and labels
        self.edges = np.append(np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64))) << 8 | labels, NEVER)

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """From a file in this worker's temporary folder, written once and shared by its processes; a
        file with other contents is written anew."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(blob).hexdigest()}")
        if not os.path.exists(path) or open(path, "rb").read() != blob:
            fd, part = tempfile.mkstemp(dir=os.path.dirname(path))
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            os.replace(part, path)
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the sorted words of the lexicon, or -1: all words go through
        the automaton in step, a byte at a time."""
        data, at = buffers(words)
        size = np.diff(at)
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, k = np.arange(len(words)), 0
        while len(live := live[size[live] > k]):
            key = state[live] << 8 | data[at[live] + k]
            edge = np.searchsorted(self.edges, key)
            ok = self.edges[edge] == key
            state[live[~ok]] = -1
            live, edge = live[ok], edge[ok]
            place[live] += self.sums[edge]
            state[live] = self.targets[edge]
            k += 1
        return np.where((state < 0) | (self.final[state] == 0), -1, place)

    def get(self, word: bytes) -> list[int] | None:
        place = int(self.find(pa.array([word], pa.large_binary()))[0])
        return None if place < 0 else self.ids[self.ends[place] : self.ends[place + 1]].tolist()


class Words:
    """Pieces of texts as words, which are the pre-tokenizer's tokens, and special tokens."""

    def __init__(self, special: list[str]) -> None:
        import regex

        self.findall, self.special = regex.compile(PATTERN).findall, frozenset(special)
        some = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self.parts, self.held = re.compile(f"({some})") if special else None, some

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(indices of pieces that are a word each, indices of the others, the others' words)."""
        data, at = buffers(pieces)
        size = np.diff(at)
        letters = np.add.reduceat(KIND[data[at[0] : at[-1]]] == LETTER, at[:-1] - at[0]) if len(size) else size
        plain = (letters == size) | ((letters == size - 1) & (letters > 0) & (data[at[:-1]] == 32)) | (size == 1)
        if self.parts:
            plain &= ~pc.match_substring_regex(pieces, self.held).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~plain)
        found = []
        for x in pieces.take(pa.array(others)).to_pylist():
            text = x.decode()
            parts = self.parts.split(text) if self.parts else [text]
            found.append([w for p in parts for w in ([p] if p in self.special else self.findall(p))])
        return np.flatnonzero(plain), others, found


def _summed(words: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"word": words, "n": pa.array(n, pa.int64())}).group_by("word").aggregate([("n", "sum")])


def _count(special: list[str]) -> BatchFn:
    """Counts of words, combined within the task; a full table of counts is sent on and begun anew."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kept("bpe")
        words, held, rows = Words(special), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            t = _summed(t.column(0).combine_chunks(), t.column(1).to_numpy())
            pieces, n = t.column(0).combine_chunks(), t.column(1).to_numpy()
            plain, others, found = words.of(pieces)
            more = pa.array([w.encode() for ws in found for w in ws], pa.large_binary())
            t = _summed(pa.concat_arrays([pieces.take(pa.array(plain)), more]), np.concatenate((n[plain], np.repeat(n[others], [len(ws) for ws in found]))))
            yield from pa.table({"word": t.column("word").cast(pa.binary()), "n": t.column("n_sum")}).combine_chunks().to_batches(1 << 16)

        for b in batches:
            for data, texts in slices(b.column(0)):
                if len(data):
                    pieces, which = distinct(data, piece_starts(data, texts))
                    held.append(pa.table({"word": pieces, "n_sum": pa.array(np.bincount(which, minlength=len(pieces)), pa.int64())}))
                    rows += len(pieces)
                    if rows > COUNTED:
                        yield from flush()
                        held, rows = [], 0
        if held:
            yield from flush()

    return run


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS, special: list[str] | None = None) -> list[bytes]:
    """The words that occur at least so often that no more than `most` do, of all documents.

    A histogram of counts (one bar for each of the low counts, 64 for each doubling of higher ones)
    gives the bound, so no more than `most` words leave their partitions."""
    counts = columns_as(docs, text=text_col).mapInArrow(tidy(_count(special or [])), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("bar", F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")), "words")
    room, least = most, None
    for r in sorted(counts.groupBy("bar").count().collect(), reverse=True):  # 4,096 bars at most
        room -= r["count"]
        if room < 0:
            break
        least = r.bar
    return [] if least is None else sorted(bytes(r.word) for r in counts.where(F.col("bar") >= least).select("word").collect())


def bounded(runs: Iterable[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same runs of texts' ids, in parts of about `most` ids; a longer text is alone."""
    for ids, count in runs:
        ends, lo = np.cumsum(count), 0
        while lo < len(count):
            first = int(ends[lo] - count[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, first + most, "right")))
            yield ids[first : int(ends[hi - 1])], count[lo:hi]
            lo = hi


class Encoder:
    """Encodes texts by the lexicon, else by merging; one for each worker process."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.v, self.lexicon, self.words = vocabulary, lexicon, Words(list(vocabulary.special))
        self.memo = Memo(self._fill, KNOWN)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has): by the lexicon, or by merging."""
        place = self.lexicon.find(words)
        found, other = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids, at, n = self.v.merge_all(words.take(pa.array(other)))
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ends = self.lexicon.ends.astype(np.int64)
        begin[found], count[found] = ends[place[found]], ends[place[found] + 1] - ends[place[found]]
        begin[other], count[other] = len(self.lexicon.ids) + at, n
        for s in self.v.special:
            if len(own := np.flatnonzero(pc.equal(words, pa.scalar(s.encode(), pa.large_binary())).to_numpy(zero_copy_only=False))):
                begin[own], count[own] = len(self.lexicon.ids) + len(ids), 1
                ids = np.append(ids, np.uint32(self.v.special[s]))
        return np.concatenate((self.lexicon.ids, ids)), begin, count

    def _fill(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain, others, found = self.words.of(pieces)
        words = pa.concat_arrays([pieces.take(pa.array(plain)), pa.array([w.encode() for ws in found for w in ws], pa.large_binary())])
        ids, at, n = self.word_ids(words)
        begin, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        count[plain] = n[: len(plain)]
        per = np.array([len(ws) for ws in found], np.int64)
        upto = np.concatenate(([0], np.cumsum(n[len(plain) :])))
        ends = np.cumsum(per)
        count[others] = upto[ends] - upto[ends - per]
        order = np.concatenate((plain, others))
        begin[order] = np.cumsum(count[order]) - count[order]
        return gathered(ids, at, n), begin, count

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in turn, how many each has), for runs of texts of bounded size."""
        for data, at in slices(texts):
            yield ids_of_texts(self.memo, data, at)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
        """The text of each run of ids; bytes that are no UTF-8 give the replacement character."""
        data, at = buffers(self.v.spelling.take(pa.array(ids)))
        cuts = at[np.concatenate(([0], np.cumsum(count)))].tolist()
        raw = memoryview(data)
        for lo, hi in itertools.pairwise(cuts):
            yield str(raw[lo:hi], "utf-8", "replace").encode()

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(ids, digest of the ids, digest of the text that they decode to) of each text."""
        for ids, count in bounded(self.encode(texts)):
            data, at = buffers(self.v.names.take(pa.array(ids)))
            cuts = at[np.concatenate(([0], np.cumsum(count)))].tolist()
            raw = memoryview(data)
            for n, (lo, hi), back in zip(count.tolist(), itertools.pairwise(cuts), self.decode(ids, count), strict=True):
                yield n, hashlib.sha256(raw[lo : max(lo, hi - 1)]).hexdigest(), hashlib.sha256(back).hexdigest()


def _encoder(shared) -> Encoder:
    blob, path = shared.value
    encoders, key = kept("bpe"), hashlib.sha256(blob).hexdigest() + path
    if key not in encoders:
        encoders.clear()
        encoders[key] = Encoder(Vocabulary(path), Lexicon.mapped(blob))
    return encoders[key]


def _apply(shared, make) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            yield make(encoder, b)

    return tidy(run)


def _digests(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
    got = list(encoder.digests(b.column(1)))
    n, ids, plain = zip(*got, strict=True) if got else ((), (), ())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
    got = list(encoder.encode(b.column(1)))
    ids = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint32)
    ends = np.cumsum(np.concatenate([n for _, n in got])) if got else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])


def _texts(encoder: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
    lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
    texts = encoder.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() for x in texts], pa.string())], ["doc_id", "text"])


class Bpe:
    """A lexicon fitted to a corpus, for encoding and decoding with it."""

    def __init__(self, docs: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> None:
        v = Vocabulary(vocabulary_path)
        words = [w for w in frequent_words(docs, text_col, most, list(v.special)) if w.decode() not in v.special]
        ids, begin, count = v.merge_all(pa.array(words, pa.large_binary()))
        blob = compile_lexicon((w, ids[b : b + n].tolist()) for w, b, n in zip(words, begin.tolist(), count.tolist(), strict=True))
        self.shared = docs.sparkSession.sparkContext.broadcast((blob, vocabulary_path))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return columns_as(docs, doc_id=id_col, text=text_col).mapInArrow(_apply(self.shared, _ids), "doc_id long, ids array<int>")

    def decode(self, ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        return columns_as(ids, doc_id=id_col, ids=ids_col).mapInArrow(_apply(self.shared, _texts), "doc_id long, text string")

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding again."""
        return columns_as(docs, doc_id=id_col, text=text_col).mapInArrow(_apply(self.shared, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
