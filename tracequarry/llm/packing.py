"""Filling containers of fixed capacity with items, little room left over.

Each part of the items is packed by the sum-of-squares rule: an item goes to the fill level
that leaves the least sum of squared counts of partly filled containers, so that no level
gathers many of them. A part's containers that stay below `full_enough` are opened and their
items packed again, in fewer parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm import bpe
from tracequarry.session import cut

_PLACED = "id long, piece int, size int, bin long"


class Levels:
    """Counts of open containers by fill level, and the containers of each level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> int:
        """Number of the container for an item of 1 to `capacity`.

        Moving a container from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h] + 1); a new one (level 0) by 2 N[size] + 1, a filled one
        (level capacity) no longer counts. Equal changes go to the fullest level.
        """
        n, c = self.counts, self.capacity
        level = 0
        best = 0 if size == c else 2 * int(n[size]) + 1
        if size < c:
            here = n[1 : c - size + 1]
            change = 2 * (n[1 + size : c + 1] - here + 1)
            change[-1] = 1 - 2 * here[-1]
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            k = c - size - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = k + 1
        if level:
            which = self.at[level].pop()
            n[level] -= 1
        else:
            which, self.opened = self.opened, self.opened + 1
        if level + size < c:
            self.at[level + size].append(which)
            n[level + size] += 1
        return which


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers of items in the given order."""
    levels = Levels(capacity)
    return [levels.place(s) for s in sizes]


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """Packs each Spark partition on its own; `bin` is unique by the level's and partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(capacity)
        for batch in batches:
            if batch.num_rows:
                first = (level << 54) + (batch.column(3)[0].as_py() << 32)
                bins = [first + levels.place(s) for s in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.int64())], names=["id", "piece", "size", "bin"])

    return items.select("id", "piece", "size", F.spark_partition_id().alias("part")).mapInArrow(run, _PLACED)


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, size): an item of at most `capacity` is one piece, a larger one is cut into full pieces and a rest."""
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = (F.col("size") % capacity).cast("int")
    cuts = F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return sized.where((F.col("size") > 0) & F.col("id").isNotNull()).select("id", F.posexplode(cuts).alias("piece", "size"))


def fill_containers(sized: DataFrame, capacity: int, part_items: int = 20_000, full_enough: float = 0.98) -> DataFrame:
    """(id, piece, size, bin): which container takes each item.

    sized: id (long, unique), size (int). Items of null or no size, or without an id, fill
    nothing and are left out; an item larger than `capacity` is cut into pieces of capacity and
    a rest, all others stay whole; no container holds more than `capacity`. Items are spread by
    hash into parts of about `part_items`, so the number of tasks follows the data and no id or
    size can gather in one of them; a part's order is by hash, too, hence the same on every
    run. Repacking ends with a single part, or where it no longer lessens the parts.
    """
    items = cut(pieces_of(sized, capacity))
    left, done, level = items.count(), [], 0
    parts = max(1, -(-left // part_items))
    while True:
        spread = items.repartition(parts, F.xxhash64("id", "piece", F.lit(level))).sortWithinPartitions(F.xxhash64("id", "piece"), "id", "piece")
        placed = cut(_packed(spread, capacity, level))
        if parts > 1:
            loose = placed.groupBy("bin").agg(F.sum("size").alias("fill")).where(F.col("fill") < full_enough * capacity).select("bin")
            again = cut(placed.join(loose, "bin", "left_semi").select("id", "piece", "size"))
            left = again.count()
            fewer = -(-left // part_items)
        if parts == 1 or fewer >= parts:
            done.append(placed)
            break
        done.append(placed.join(loose, "bin", "left_anti").select("id", "piece", "size", "bin"))
        if not left:
            break
        items, parts, level = again, fewer, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def pack_documents(docs: DataFrame, capacity: int, path: str = bpe.BYTE_BPE_50K) -> DataFrame:
    """(doc_id, piece, size, bin) of documents measured in tokens; texts of no token fill nothing."""
    sized = bpe.count_tokens(docs, path=path).select(F.col("doc_id").alias("id"), F.col("tokens").alias("size"))
    return fill_containers(sized, capacity).withColumnRenamed("id", "doc_id")
