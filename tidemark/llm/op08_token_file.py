"""Token ids in files of patched frame-of-reference blocks.

A block holds up to BLOCK ids: its minimum is subtracted, the rest is packed at the width that
a percentile of the values needs, and the few values that need more go to an exception list of
positions and high bits.  A file holds many blocks; its footer indexes where each block starts,
and which documents begin at which id.

Layout, little-endian: magic "TMPF1\\0\\0\\0"; blocks; footer; footer length u64; magic again.
A block: count u32, minimum u32, width u8, exceptions u32, packed bits, positions u32 each, high
bits u32 each.  The footer: number of blocks, number of documents, then u64 block starts, i64
document ids (with a u8 flag each for null) and u64 starts of the documents' ids in the file.

Cases: null and empty texts have the end id only; repeated rows are documents of their own,
null ids sort first; an empty table writes no file and gives an empty result.  Only the two
named columns are read."""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pieces import Memo, buffers, ids_of_texts, slices, solid_before, solid_from, whole_in_pieces
from ._shared import Batches, BatchFn, columns_as, kept, new_path, partitions, shared_dir, staged, store_of

MAGIC = b"TMPF1\0\0\0"
BLOCK = 1 << 14
PERCENTILE = 90
END_ID = 2
FILE_IDS = 1 << 24
KNOWN = 1 << 20  # pieces remembered in a worker
TOGETHER = 1 << 14  # bytes of pieces that are encoded together


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width, `width` bits each: bit k of all values, then bit k + 1."""
    return b"".join(np.packbits((values >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(width))


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= np.unpackbits(planes[k], count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    over = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.percentile(over, PERCENTILE, method="higher")).bit_length()
    odd = np.flatnonzero(over >> np.uint32(width)) if width < 32 else np.zeros(0, int)
    high = (over[odd] >> np.uint32(width)).astype("<u4")
    packed = pack_bits(over & np.uint32((1 << width) - 1), width) if width else b""
    return struct.pack("<IIBI", len(ids), low, width, len(odd)) + packed + odd.astype("<u4").tobytes() + high.tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    n, low, width, odd = struct.unpack_from("<IIBI", data, at)
    at += struct.calcsize("<IIBI")
    packed = width * ((n + 7) // 8)
    out = unpack_bits(data[at : at + packed], n, width) if width else np.zeros(n, np.uint32)
    at += packed
    where = np.frombuffer(data, "<u4", odd, at)
    out[where] |= np.frombuffer(data, "<u4", odd, at + 4 * odd) << np.uint32(width)
    return out + np.uint32(low)


class Writer:
    """Documents' ids into one file."""

    def __init__(self, out) -> None:
        self.out, self.blocks, self.docs, self.starts = out, [], [], []
        self.held: list[np.ndarray] = []
        self.n = self.waiting = 0
        out.write(MAGIC)
        self.at = len(MAGIC)

    def extend(self, docs: list[int | None], ids: np.ndarray, count: np.ndarray) -> None:
        """Documents with `count` ids each, which follow each other in `ids`."""
        self.docs += docs
        self.starts += (self.n + np.cumsum(count) - count).tolist()
        self.held.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 1 << 18:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for s in range(0, whole, BLOCK):
            data = encode_block(ids[s : min(s + BLOCK, whole)])
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        footer = struct.pack("<QQ", len(self.blocks), len(self.docs)) + np.array(self.blocks, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class Reader:
    """Reads a file's footer; ids come block by block."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        source.seek(size - 16)
        n, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.end = size - 16 - n
        source.seek(self.end)
        footer = source.read(n)
        blocks, docs = struct.unpack_from("<QQ", footer)
        self.blocks = np.frombuffer(footer, "<u8", blocks, 16)
        at = 16 + 8 * blocks
        ids, known = np.frombuffer(footer, "<i8", docs, at), np.frombuffer(footer, np.uint8, docs, at + 8 * docs)
        self.docs = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.starts = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        lo = int(self.blocks[k])
        hi = int(self.blocks[k + 1]) if k + 1 < len(self.blocks) else self.end
        self.source.seek(lo)
        return decode_block(self.source.read(hi - lo))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document, in the file's order."""
        held, done, k = np.zeros(0, np.uint32), 0, 0
        for d, doc in enumerate(self.docs):
            lo = int(self.starts[d])
            hi = int(self.starts[d + 1]) if d + 1 < len(self.docs) else None
            parts = [held[lo - done :]]
            got = done + len(held)
            while k < len(self.blocks) and (hi is None or got < hi):
                parts.append(self.block(k))
                got += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            done = lo
            yield doc, held if hi is None else held[: hi - lo]

    def one(self, d: int) -> np.ndarray:
        """The ids of the document at place d, by the block index alone."""
        lo, hi = int(self.starts[d]), int(self.starts[d + 1]) if d + 1 < len(self.docs) else None
        last = len(self.blocks) - 1 if hi is None else min((hi - 1) // BLOCK, len(self.blocks) - 1)
        ids = np.concatenate([self.block(k) for k in range(lo // BLOCK, last + 1)])
        at = lo - lo // BLOCK * BLOCK
        return ids[at:] if hi is None else ids[at : at + hi - lo]


class Library:
    """The tokenizers library over whole texts; a piece is given to it once while it is remembered.

    Pieces that begin with a space are strung together and others are parted by line feeds, since
    the library's pattern cuts there; the bytes that ids stand for tell which ids are whose.  With a
    tokenizer that is not a plain byte-level one, texts are not cut and each is encoded alone."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        first, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True) and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        self.cut = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) and whole_in_pieces([t["content"] for t in added])
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for word, i in vocabulary.items():
            self.size[i] = len(word)  # a letter for each byte
        for t in added:
            self.size[t["id"]] = len(t["content"].encode())
        self.memo = Memo(self._fill, KNOWN)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _strung(self, pieces: pa.Array, mark: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each piece has) of pieces that are encoded together, each with `mark` behind
        it; None if ids do not end where pieces do."""
        if mark:
            pieces = pc.binary_join_element_wise(pieces, pa.scalar(mark, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        data, at = buffers(pieces)
        ends = at[1:]
        stops = np.unique(np.append(np.searchsorted(ends, np.arange(at[0] + TOGETHER, ends[-1], TOGETHER)), len(ends) - 1))
        texts = [data[lo:hi].tobytes().decode() for lo, hi in itertools.pairwise([int(at[0]), *ends[stops].tolist()])]
        ids = np.concatenate(self._ids(texts))
        upto = at[0] + np.cumsum(self.size[ids])
        last = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
        if upto[-1] != ends[-1] or (upto[last] != ends).any() or (mark and (self.size[ids[last]] != len(mark)).any()):
            return None
        return ids, np.diff(last, prepend=-1)

    def _fill(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, count, parts, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        rest = np.arange(len(pieces))
        if self.cut:
            data, at = buffers(pieces)
            lo, hi = at[:-1], at[1:]
            ends_solid = solid_before(data, hi)
            spaced = ends_solid & (data[lo] == 32) & (hi - lo > 1) & solid_from(data, lo + 1)
            parted = ends_solid & solid_from(data, lo)
            rest = np.flatnonzero(~spaced & ~parted)
            for own, mark in ((np.flatnonzero(spaced), b""), (np.flatnonzero(parted), b"\n")):
                got = self._strung(pieces.take(pa.array(own)), mark) if len(own) else None
                if got is None:
                    rest = np.concatenate((rest, own))
                    continue
                ids, n = got
                begin[own], count[own] = total + np.cumsum(n) - n, n - len(mark)
                parts.append(ids)
                total += len(ids)
        for s in range(0, len(rest), 1 << 12):
            own = rest[s : s + (1 << 12)]
            got = self._ids([x.decode() for x in pieces.take(pa.array(own)).to_pylist()])
            count[own] = n = np.array([len(x) for x in got])
            begin[own] = total + np.cumsum(n) - n
            parts += got
            total += int(n.sum())
        return np.concatenate(parts), begin, count

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in turn, how many each has), for runs of texts of bounded size."""
        for data, at in slices(texts):
            if not self.cut:
                self.memo.clear()
            yield ids_of_texts(self.memo, data, at, self.cut, end_id)


def _write(folder: str, vocabulary_path: str, end_id: int) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        libraries, task = kept("tokens"), TaskContext.get()
        if vocabulary_path not in libraries:
            libraries.clear()
            libraries[vocabulary_path] = Library(vocabulary_path)
        lib = libraries[vocabulary_path]
        store, root = store_of(folder)
        number, writer, done = 0, None, []

        def finish() -> None:
            writer.close()
            path = f"{root}/{task.partitionId():06d}-{number:04d}.tmpf"
            store.move(part, path)  # an attempt's file gets its name only when whole; attempts write the same bytes
            done.append((path, task.partitionId(), number, writer.n))

        for b in batches:
            docs, at = b.column(0).to_pylist(), 0
            for ids, count in lib.encode(b.column(1), end_id):
                upto = np.cumsum(count)
                lo = 0
                while lo < len(count):  # a file takes whole documents until it has FILE_IDS ids
                    if writer is None:
                        part = f"{root}/_{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
                        writer = Writer(store.open_output_stream(part))
                    first = int(upto[lo] - count[lo])
                    hi = min(len(count), int(np.searchsorted(upto, first + FILE_IDS - writer.n)) + 1)
                    writer.extend(docs[at + lo : at + hi], ids[first : int(upto[hi - 1])], count[lo:hi])
                    lo = hi
                    if writer.n >= FILE_IDS:
                        finish()
                        writer, number = None, number + 1
                at += len(count)
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["path", "task", "number", "n_ids"])

    return run


def write_token_files(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents in ascending id order; returns one row per file:
    path, task and number (its place in the order), n_ids, start (ids in all files before it)."""
    spark = docs.sparkSession
    docs = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    folder = new_path(spark, "tokens")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    ordered = docs.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = staged(ordered.mapInArrow(_write(folder, vocabulary_path, end_id), "path string, task int, number int, n_ids long"), "files")
    # sums by task, then within the task: a task has few files, and there are as many tasks as partitions
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("ids"))
    before = tasks.select(F.col("task").alias("of"), F.coalesce(F.sum("ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("own", F.coalesce(own, F.lit(0))).join(before, F.col("task") == F.col("of")).select("path", "task", "number", "n_ids", (F.col("before") + F.col("own")).alias("start"))


def _read(uri: str) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(uri)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    reader = Reader(f)
                    got = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())) for (d, ids), at in zip(reader.documents(), reader.starts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    spark = files.sparkSession
    dealt = files.select("path", "start").repartition(partitions(spark), "path")
    return dealt.mapInArrow(_read(shared_dir(spark)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(data: bytes) -> list[tuple[int | None, list[int]]]:
    """All documents of a file held in memory."""
    return [(d, x.tolist()) for d, x in Reader(pa.BufferReader(data)).documents()]


def write_ids(docs: list[tuple[int | None, list[int]]]) -> bytes:
    out = io.BytesIO()
    out.close, w = lambda: None, Writer(out)
    for d, ids in docs:
        w.extend([d], np.array(ids, np.uint32), np.array([len(ids)]))
    w.close()
    return out.getvalue()
