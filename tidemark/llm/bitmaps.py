"""Bitmaps of hashes, of fixed size: rows that surely have no partner are told map-side.

A bitmap admits some rows too many, never too few; the more hashes it holds, the more it admits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn

WORDS = 1 << 20  # of 64 bits


def has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    return (words[(h % np.uint64(WORDS)).astype(np.int64)] >> (h >> np.uint64(58))) & np.uint64(1) > 0


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash; at most WORDS rows come to the driver, whatever the input."""
    word = F.pmod(F.col(column), F.lit(WORDS))
    rows = hashes.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, 58) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(WORDS, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def with_bit(rows: DataFrame, key: str, words, want: bool) -> DataFrame:
    """The rows whose hash in `key` has (or has not) its bit in the broadcast bitmap."""
    at = rows.columns.index(key)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = has(words.value, b.column(at).to_numpy()) == want
            if keep.any():
                yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)
