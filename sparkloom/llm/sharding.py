"""Sharding by best-fit-decreasing bin packing.

Rows of equal text form one indivisible group. Groups, sorted by size, enter the bin with the least
remaining room that still holds them, found in a balanced tree of remaining capacities. With a given
number of shards the smallest capacity is sought for which the packing needs no more bins; with a
given capacity the packing minimises the bins.

The packing itself is sequential, so what enters it is bounded: groups of equal size are
interchangeable, and only (size, number of groups) leaves Spark. There are at most sqrt(2 * bytes)
different sizes, in practice as many as different lengths of text. Best fit puts equal items into the
same bin until it is full, so a class enters in runs, one step for each bin it touches. The runs are
dealt back to the groups by their rank within the class; a large class is ranked in buckets.

Slots within a shard are dealt without sorting a whole shard in one task: rows fall into many
buckets by hash, each bucket is numbered by itself, and the buckets' counts give the offsets.

Defined cases: a null text has 0 bytes and equals other null texts and empty ones; a group larger
than the others' share fills a shard of its own, and the shards are as equal as that allows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Rows that are numbered in one group, about; larger sets are numbered in buckets.
PER_BUCKET = 400_000


class Room:
    """Remaining capacities, kept in order: a two-level balanced tree of (room, bin).

    Leaves hold up to 2 * HALF entries and split when full, so finding, taking and putting back
    cost O(log n) and a bounded move.
    """

    HALF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]

    def add(self, room: int, bin_: int) -> None:
        k = max(0, bisect_left(self.least, (room, bin_)) - 1)
        insort(self.leaves[k], (room, bin_))
        if len(self.leaves[k]) > 2 * self.HALF:
            right = self.leaves[k][self.HALF :]
            del self.leaves[k][self.HALF :]
            self.leaves.insert(k + 1, right)
            self.least.insert(k + 1, right[0])

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin of least room that still holds ``size``, taken out; None if there is none."""
        k = max(0, bisect_left(self.least, (size, -1)) - 1)
        for leaf in self.leaves[k:]:
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                return leaf.pop(i)
        return None


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Runs (class, items, bin) in order; classes are (size, items) by decreasing size and fit the capacity."""
    room, out, bins = Room(), [], 0
    for at, (size, left) in enumerate(classes):
        while left:
            found = room.take(size)
            if found is None:
                found, bins = (capacity, bins), bins + 1
            # of equal items the next one fits the same bin best until that is full
            n = min(left, found[0] // size)
            room.add(found[0] - n * size, found[1])
            out.append((at, n, found[1]))
            left -= n
    return out


def pack(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """A packing into at most ``shards`` bins: of least capacity, as found by widening steps and halving."""
    total = sum(size * n for size, n in classes)
    low = max([*(size for size, _ in classes[:1]), -(-total // shards), 1])
    fits = lambda runs: max((b for _, _, b in runs), default=0) < shards
    step, best = 0, best_fit_decreasing(classes, low)
    if fits(best):
        return best
    while not fits(best):
        step = max(1, 2 * step)
        best = best_fit_decreasing(classes, low + step)
    short, high = low + step // 2, low + step
    while high - short > 1:
        middle = (short + high) // 2
        runs = best_fit_decreasing(classes, middle)
        if fits(runs):
            high, best = middle, runs
        else:
            short = middle
    return best


def numbered(rows: DataFrame, by: list[str], order: str, count: Column | int) -> DataFrame:
    """rows with ``at``: 0, 1, ... within each value of ``by`` (of ``count`` rows), without a task for a whole one."""
    buckets = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(count) / PER_BUCKET) if isinstance(count, int) else F.ceil(count / PER_BUCKET))
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(order), buckets)), "to-number")
    counts = rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(cut(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*by, "bucket", "offset"), "offsets"), 60)
    own = Window.partitionBy(*by, "bucket").orderBy(order)
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(offsets, [*by, "bucket"])
    return ranked.withColumn("at", (F.col("offset") + F.col("own")).cast("long")).drop("own", "offset", "bucket")


def packed(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot; equal texts share a shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.substring(digest, 1, 16).alias("of"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = cut(rows.groupBy("of").agg(F.sum("size").alias("total")), "groups")
    found = groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("total", ascending=False)
    classes = list(zip(found["total"].tolist(), found["n"].tolist(), strict=True))
    if capacity is None:
        runs = pack(classes, shards)
    else:
        if classes and classes[0][0] > capacity:
            raise ValueError(f"a group of {classes[0][0]} bytes is larger than a shard")
        runs = best_fit_decreasing(classes, capacity)
    where = _runs(docs.sparkSession, classes, runs)
    whole = small(where.where("n = of_class").select("total", "shard"), 32)
    parts = small(where.where("n < of_class").select("total", "start", "n", "of_class", "shard"), 60)
    split = groups.join(small(where.where("start = 0 and n < of_class").select("total", "of_class"), 32), "total")
    split = numbered(split, ["total"], "of", F.col("of_class")).drop("of_class")
    split = split.join(parts, (split["total"] == parts["total"]) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n")))
    placed = groups.join(whole, "total").select("of", "shard").unionByName(split.select("of", "shard"))
    placed = rows.join(cut(placed, "placed-groups"), "of").select("doc_id", "size", "text_crc32", "shard", "row")
    numbers = numbered(placed, ["shard"], "row", max(rows.count(), 64 * PER_BUCKET))
    return numbers.select("doc_id", "size", "text_crc32", "shard", F.col("at").alias("slot"))


def _runs(spark: SparkSession, classes: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> DataFrame:
    """(total, start, n, of_class, shard): ranks start to start + n of a class go to the shard."""
    out, last, start = [], -1, 0
    for at, n, shard in runs:
        start = start if at == last else 0
        out.append((classes[at][0], start, n, classes[at][1], shard))
        last, start = at, start + n
    names = ["total", "start", "n", "of_class", "shard"]
    columns = np.array(out, dtype=np.int64).reshape(-1, len(names)).T
    frame = pa.table([pa.array(c) for c in columns], names)  # as Arrow it needs no Python workers
    return cut(spark.createDataFrame(frame, "total long, start long, n long, of_class long, shard long").withColumn("shard", F.col("shard").cast("int")), "runs")


def write_shards(docs: DataFrame, path: str, shards: int | None = 8, capacity: int | None = None) -> None:
    """One folder for each shard. Rows meet their shard by doc_id, which must be unique here."""
    where = packed(docs, shards, capacity).select("doc_id", "shard", "slot")
    docs.join(where, "doc_id").write.partitionBy("shard").parquet(path)
