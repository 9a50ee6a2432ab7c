"""Pieces of texts that a byte-level BPE encodes apart from each other, many texts at once.

The pre-tokenizer's pattern ends a token before a single space that stands between two solid
characters (those that are not white space), between an ASCII letter and a punctuation mark, and
on both sides of a single line feed between solid characters.  So texts may be cut there, the
different pieces encoded alone and their ids strung together; pieces repeat far more than texts do.

Everything works on the UTF-8 bytes of a batch: cuts are found with numpy, different pieces with
Arrow's dictionary encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 22
# fixed values: white space beyond ASCII, as UTF-8
BLANK_TWO = [0xC285, 0xC2A0]
BLANK_THREE = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
LETTER, MARK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[list(b".,;:!?")] = MARK


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the end); null counts as empty."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for runs of texts of about `most` bytes together; a longer text is alone."""
    data, offsets = bytes_of(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The parts of `data` that begin at `starts`, as an Arrow array without a copy."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of binary values without nulls."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def _at(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    return data[np.clip(p, 0, len(data) - 1)].astype(np.int64)


def solid_before(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is not white space."""
    one = _at(data, p - 1)
    ok = one > 32
    wide = np.flatnonzero(one >= 0x80)
    if len(wide):
        two = _at(data, p[wide] - 2) << 8 | one[wide]
        ok[wide] = ~(np.isin(two, BLANK_TWO) | np.isin(_at(data, p[wide] - 3) << 16 | two, BLANK_THREE))
    return ok


def solid_from(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is not white space."""
    one = _at(data, p)
    ok = one > 32
    wide = np.flatnonzero(np.isin(one, (0xC2, 0xE1, 0xE2, 0xE3)))
    if len(wide):
        two = one[wide] << 8 | _at(data, p[wide] + 1)
        ok[wide] = ~(np.isin(two, BLANK_TWO) | np.isin(two << 8 | _at(data, p[wide] + 2), BLANK_THREE))
    return ok


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin, in the bytes of texts that begin at `texts` (its last value is the end)."""
    if not len(data):
        return np.zeros(0, np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[texts] = True
    for byte, beyond in ((32, False), (10, True)):
        p = np.flatnonzero(data == byte)
        p = p[(p > 0) & (p < len(data) - 1)]
        p = p[solid_before(data, p) & solid_from(data, p + 1)]
        begins[p] = True
        if beyond:
            begins[p + 1] = True
    kind = KIND[data]
    begins[1:-1] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
    return np.flatnonzero(begins[:-1])


def whole_in_pieces(words: list[str]) -> bool:
    """Whether no text is cut within one of these words."""
    return all(w.split() == [w] and len(piece_starts(np.frombuffer(w.encode(), np.uint8), np.array([0]))) == 1 for w in words)


def gathered(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of `values`, one after the other."""
    parts = []
    for lo in range(0, len(begin), 1 << 17):
        n = count[lo : lo + (1 << 17)]
        ends = np.cumsum(n)
        parts.append(values[np.repeat(begin[lo : lo + (1 << 17)] - ends + n, n) + np.arange(int(ends[-1]))])
    return np.concatenate(parts) if parts else values[:0]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(different pieces, which of them each piece is)."""
    found = pc.dictionary_encode(binary(data, starts))
    return found.dictionary, found.indices.to_numpy()


Fill = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Memo:
    """Ids of pieces, by what `fill` makes of many at once: (ids, where each piece's begin, how many it has).
    When more than `most` pieces are held, only those of the present batch are kept."""

    def __init__(self, fill: Fill, most: int) -> None:
        self.fill, self.most = fill, most
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in begin, count and ids; pieces are different."""
        if len(self.known) > self.most:
            self.clear()
        place = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            missing = pieces.take(pa.array(new))
            ids, begin, count = self.fill(missing)
            place[new] = len(self.known) + np.arange(len(new))
            self.begin = np.concatenate((self.begin, len(self.ids) + begin))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, ids))
            self.known = pa.concat_arrays([self.known, missing])
        return place

    def strung(self, place: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        return gathered(self.ids, self.begin[place], self.count[place])


def ids_of_texts(memo: Memo, data: np.ndarray, texts: np.ndarray, cut: bool = True, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn, each followed by `end_id` if that is given; how many each text has)."""
    starts = piece_starts(data, texts) if cut else np.unique(texts[:-1][np.diff(texts) > 0])
    which = np.zeros(0, np.int64)
    if len(starts):
        pieces, which = distinct(data, starts)
        which = memo.learn(pieces)[which]
    ids = memo.strung(which)
    upto = np.concatenate(([0], np.cumsum(memo.count[which])))
    bounds = upto[np.searchsorted(starts, texts)]
    count = np.diff(bounds)
    if end_id is not None:
        ids = np.insert(ids, bounds[1:], np.uint32(end_id))
        count = count + 1
    return ids, count
