"""Comparing rows that share a bucket, without a cross join and without one task per bucket.

A bucket of more than `cap` rows is cut into chunks, and each pair of chunks becomes a
group of its own, so no task sees more than about two chunks of one bucket and every
pair of rows still meets exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions

GROUP = ["bucket", "c1", "c2"]


def grouped(rows: DataFrame, row_hash: str, cap: int) -> DataFrame:
    """Rows with a long `bucket` column, dealt out and sorted by (bucket, c1, c2).
    A row of chunk c is in the groups (c1, c2) that hold c; `chunk` says which it is."""
    large = rows.groupBy("bucket").count().where(F.col("count") > cap).select("bucket", F.ceil(F.col("count") / cap).cast("int").alias("n_chunks"))
    dealt = (
        rows.join(large, "bucket", "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64(row_hash), F.col("n_chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn("c1", F.least("chunk", "other"))
        .withColumn("c2", F.greatest("chunk", "other"))
        .drop("n_chunks", "other")
    )
    return dealt.repartition(partitions(rows.sparkSession), *GROUP).sortWithinPartitions(*GROUP)


def group_ids(t) -> np.ndarray:
    """A number for each run of equal (bucket, c1, c2)."""
    new = np.zeros(t.num_rows, bool)
    for k in GROUP:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def pairs(group: np.ndarray, chunk: np.ndarray, c1: np.ndarray, c2: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, a bounded number at a time; in a group of two
    different chunks only pairs across them, so that no pair comes twice."""
    n = len(group)
    live, lag, i_s, j_s, held = np.arange(n), 1, [], [], 0
    while len(live):
        live = live[live + lag < n]
        live = live[group[live] == group[live + lag]]
        if not len(live):
            break
        j = live + lag
        ok = (c1[live] == c2[live]) | (chunk[live] != chunk[j])
        i_s.append(live[ok])
        j_s.append(j[ok])
        held += len(i_s[-1])
        if held >= most:
            yield np.concatenate(i_s), np.concatenate(j_s)
            i_s, j_s, held = [], [], 0
        lag += 1
    if held:
        yield np.concatenate(i_s), np.concatenate(j_s)


class Forest:
    """Labels of rows under union; keeps only edges that join two trees."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges that joined two trees; every tree ends with one label."""
        used_i, used_j = [], []
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # one edge for each higher label: its root hangs below a smaller one, so no cycle can arise
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], np.diff(high[order]) != 0))]
            used_i.append(i[first])
            used_j.append(j[first])
            parent = np.arange(len(self.label))
            parent[high[first]] = low[first]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]
        none = np.zeros(0, int)
        return (np.concatenate(used_i), np.concatenate(used_j)) if used_i else (none, none)
