"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

``LineIndex`` keeps, for every distinct line key, how many documents hold it (the exact table), and
for every shard of keys a cuckoo filter of the keys that at least ``min_docs`` documents hold. New
documents add to the counts, deleted documents subtract from them; keys that cross the threshold
enter or leave their shard's filter, so a deletion undoes an insertion.

A filter alone would sometimes drop a rare line. Each shard therefore also stores the *exceptions*:
those of its counted keys that the filter wrongly reports. Filter and exceptions together decide
every indexed line exactly, in one pass over the text, which is never shuffled.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; each row counts
as one document, also when its doc_id is null or repeated; repeated lines in one document count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, byte_values, cut, id_and_text

SLOTS = 4
KEYS_PER_SHARD = 200_000


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit key digests as two columns of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def fingerprint(h2: np.ndarray) -> np.ndarray:
    """16-bit fingerprints; 0 marks an empty slot."""
    return ((h2 >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def jump(fp: np.ndarray) -> np.ndarray:
    """What takes a fingerprint from one of its two buckets to the other."""
    x = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(20)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets, found from each other."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, SLOTS)
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def holding(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = fingerprint(h2)
        first = (h1 >> np.uint64(24)) & self.mask
        return fp, first, first ^ (jump(fp) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h1, h2)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False when the filter is too full; build a larger one then."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            at = a
            for kick in range(500):
                row = self.table[at]
                free = np.flatnonzero(row == 0)
                if not len(free) and kick == 0:
                    at = b
                    row = self.table[at]
                    free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = fp
                    break
                slot = (kick + fp) % SLOTS
                row[slot], fp = fp, int(row[slot])
                at = at ^ (int(jump(np.array([fp], dtype=np.uint16))[0]) & int(self.mask))
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only for keys that were inserted before."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


FILTERS = "shard long, frequent long, slots binary, exceptions binary"


def shard_filter(shards: int, min_docs: int):
    """Of one shard: the new filter from the old one and the keys that crossed the threshold."""

    def build(refs: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if refs.empty:
            return pd.DataFrame(columns=["shard", "frequent", "slots", "exceptions"])
        h1, h2 = (refs[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        now, before = refs["n_docs"].to_numpy() >= min_docs, refs["was"].to_numpy() >= min_docs
        made = CuckooFilter(np.frombuffer(old["slots"].iloc[0], dtype=np.uint16).copy()) if len(old) else None
        if made is not None:
            made.delete(h1[before & ~now], h2[before & ~now])
            if not made.insert(h1[now & ~before], h2[now & ~before]):
                made = None
        room = int(now.sum())
        while made is None:
            made = CuckooFilter.holding(room)
            if not made.insert(h1[now], h2[now]):
                made, room = None, 2 * max(1, room)
        wrong = ~now & (refs["n_docs"].to_numpy() > 0) & made.contains(h1, h2)
        return pd.DataFrame(
            {
                "shard": [int(refs["shard"].iloc[0])],
                "frequent": [int(now.sum())],
                "slots": [made.table.tobytes()],
                "exceptions": [np.stack([h1[wrong], h2[wrong]], axis=1).tobytes()],
            }
        )

    return build


class LineIndex:
    """Reference counts and filters of the documents inserted so far, less those deleted."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES):
        self.spark, self.min_docs, self.min_chars, self.broadcast_bytes = spark, min_docs, max(1, min_chars), broadcast_bytes
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 0

    def _counts(self, docs: DataFrame) -> DataFrame:
        least = self.min_chars

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[bytes] = []
                for text in byte_values(batch.column(0)):
                    found += {k for k in line_keys(text)[1] if k and (least == 1 or len(k.decode("utf-8", "replace")) >= least)}
                h = digests(found).view("<i8") if found else np.zeros((0, 2), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], ["h1", "h2"])

        rows = id_and_text(docs).select("text").mapInArrow(keys, "h1 long, h2 long")
        return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))

    def _merge(self, delta: DataFrame) -> None:
        parts = [delta.select("h1", "h2", "n", F.lit(0).cast("long").alias("was"))]
        if self.refs is not None:
            parts.append(self.refs.select("h1", "h2", F.col("n_docs").alias("n"), F.col("n_docs").alias("was")))
        merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        refs = cut(merged.select("h1", "h2", F.col("n").alias("n_docs"), "was"), "line-refs")
        wanted = 64
        while wanted * KEYS_PER_SHARD < refs.count():
            wanted *= 2
        old = self.filters
        if wanted > self.shards:  # other shards: every filter is built anew
            self.shards, old = wanted, None
        shards = self.shards
        sharded = refs.withColumn("shard", F.col("h1").bitwiseAND(shards - 1))
        if old is None:
            sharded = sharded.withColumn("was", F.lit(0).cast("long"))
            old = self.spark.createDataFrame([], FILTERS)
        build = shard_filter(shards, self.min_docs)
        self.filters = cut(sharded.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(build, FILTERS), "line-filters")
        self.refs = refs.where("n_docs > 0")

    def insert(self, docs: DataFrame) -> LineIndex:
        self._merge(self._counts(docs))
        return self

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back documents that were inserted before."""
        self._merge(self._counts(docs).withColumn("n", -F.col("n")))
        return self

    def _blocks(self) -> list[list[int]]:
        """Shards whose filters and exceptions together stay within the size to broadcast."""
        sizes = self.filters.select("shard", (F.length("slots") + 5 * F.length("exceptions")).alias("size")).orderBy("shard").collect()
        blocks: list[list[int]] = []
        room = 0
        for r in sizes:
            if not blocks or room + r["size"] > self.broadcast_bytes:
                blocks.append([])
                room = 0
            blocks[-1].append(r["shard"])
            room += r["size"]
        return blocks

    def drop_frequent(self, docs: DataFrame) -> DataFrame:
        """doc_id, text without the lines that are frequent in the index, n_lines, n_dropped.

        One pass for each block of filters; a key belongs to one shard, hence to one block, so the
        passes drop disjoint sets of lines. Between passes the shorter text is written out.
        """
        out = id_and_text(docs).select("doc_id", "text", F.lit(None).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
        blocks = self._blocks()
        for k, block in enumerate(blocks or [[]]):
            out = self._pass(out, block)
            if k + 1 < len(blocks):
                out = cut(out, "line-pass")
        return out

    def _pass(self, docs: DataFrame, block: list[int]) -> DataFrame:
        rows = self.filters.where(F.col("shard").isin(block)).collect() if block else []
        shards = max(1, self.shards)
        start, mask = np.full(shards, -1, dtype=np.int64), np.zeros(shards, dtype=np.uint64)
        at, parts = 0, []
        for r in rows:
            slots = np.frombuffer(r["slots"], dtype=np.uint16).reshape(-1, SLOTS)
            start[r["shard"]], mask[r["shard"]] = at, len(slots) - 1
            at += len(slots)
            parts.append(slots)
        slots = np.concatenate(parts) if parts else np.zeros((1, SLOTS), dtype=np.uint16)
        wrong = np.concatenate([np.frombuffer(r["exceptions"], dtype="<u8").reshape(-1, 2) for r in rows]) if rows else np.zeros((0, 2), dtype="<u8")
        held = self.spark.sparkContext.broadcast((slots, start, mask, wrong))
        least = self.min_chars

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, start, mask, wrong = held.value
            never = set(map(bytes, wrong))
            for batch in batches:
                docs = [line_keys(t) for t in byte_values(batch.column(1))]
                h = digests([k for _, keys in docs for k in keys])
                h1, h2 = h[:, 0], h[:, 1]
                shard = h1 & np.uint64(shards - 1)
                fp = fingerprint(h2)
                first = (h1 >> np.uint64(24)) & mask[shard]
                other = first ^ (jump(fp) & mask[shard])
                base = start[shard]
                hit = np.zeros(len(h), dtype=bool)
                for where in (first, other):
                    hit |= (slots[np.maximum(base, 0) + where.astype(np.int64)] == fp[:, None]).any(axis=1)
                hit &= base >= 0
                at, texts, dropped = 0, [], []
                for lines, keys in docs:
                    mine = np.flatnonzero(hit[at : at + len(lines)])
                    gone = {int(i) for i in mine if keys[i] and bytes(h[at + i]) not in never and (least == 1 or len(keys[i].decode("utf-8", "replace")) >= least)}
                    texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else b"\n".join(lines))
                    dropped.append(len(gone))
                    at += len(lines)
                before, n = batch.column(3).to_pylist(), batch.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                        pa.array([x if x is not None else len(lines) for x, (lines, _) in zip(n, docs, strict=True)], pa.int64()),
                        pa.array([a + b for a, b in zip(before, dropped, strict=True)], pa.int64()),
                    ],
                    ["doc_id", "text", "n_lines", "n_dropped"],
                )

        return docs.mapInArrow(apply, "doc_id long, text string, n_lines long, n_dropped long")
