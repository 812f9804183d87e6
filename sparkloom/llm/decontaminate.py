"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The n-grams of the benchmark's items become a sorted array of 64-bit hashes over word numbers. Each
training text is scanned once: its words become numbers, a rolling hash covers every window, the
array is searched, and each hit is verified word by word. Hit words are the spans to remove.

The set is broadcast only within a size bound. Beyond it, the windows of the items become a table: a
scan of the texts keeps the windows that a bitmap of fixed size allows (any item's window passes), and
these are joined to the table by hash and verified on their words. Either way hits are those of the
whole benchmark on the whole text, by row, so that the benchmark's size changes no result.

Defined cases: texts without words (null, empty) have no hits and items without words no windows;
item_ids are taken as text; repeated items count under each of their ids; items without an id mark
words but are not counted; rows that repeat a doc_id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, byte_values, cut, free_name, id_and_text

#: Words are digits, letters and all beyond ASCII; upper-case ASCII letters become lower-case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Windows:
    """Windows of the items: their hashes, word numbers and items, by window length."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - n + 1) if ids else 0):
                of = found.setdefault(tuple(ids[at : at + n]), set())
                if item is not None:
                    of.add(item)
        self.by_length = {}
        for length in sorted({len(w) for w in found}):
            own = np.array([w for w in found if len(w) == length], dtype=np.int64)
            h = self.roll(own.ravel(), length)[:: length] if length else own
            order = np.argsort(h, kind="stable")
            self.by_length[length] = (h[order], own[order], [found[tuple(w)] for w in own[order].tolist()])

    def roll(self, ids: np.ndarray, length: int) -> np.ndarray:
        """Hash of every run of ``length`` numbers."""
        m = len(ids) - length + 1
        h = np.zeros(max(0, m), dtype=np.uint64)
        for j in range(length):
            h = (h ^ ids[j : j + m].astype(np.uint64)) * self.MIX
            h ^= h >> np.uint64(29)
        return h

    def hits(self, text: bytes | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, numbers of hit words, and items with occurring windows."""
        of = words(text)
        ids = np.array([self.number.get(w, 0) for w in of], dtype=np.int64)
        mark = np.zeros(len(ids), dtype=bool)
        items: set[str] = set()
        known = np.r_[0, np.cumsum(ids > 0)]
        for length, (hashes, windows, of_items) in self.by_length.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)  # only known words
            if not len(at):
                continue
            h = self.roll(ids, length)[at]
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(right > left).tolist():
                start = int(at[i])
                for k in range(int(left[i]), int(right[i])):
                    if (windows[k] == ids[start : start + length]).all():
                        mark[start : start + length] = True
                        items |= of_items[k]
        return len(ids), np.flatnonzero(mark), items


#: Bits of the bitmap that thins candidate windows, at most, and probes of a window.
BITMAP_BITS = 1 << 28
PROBES = 3


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _fits(items: DataFrame, n: int, bound: int) -> bool:
    """An item's windows take about n numbers of 8 bytes and as much again for each byte of text."""
    return (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * 8 * (n + 4))).first()[0] or 0) <= bound


def _broadcast(items: DataFrame, n: int) -> Broadcast:
    held = [(r["item_id"], None if r["text"] is None else r["text"].encode()) for r in items.collect()]
    return items.sparkSession.sparkContext.broadcast(Windows(held, n))


FOUND = "doc_id long, n_words long, hit_words array<int>, items array<string>"


def _scan(docs: DataFrame, held: Broadcast) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.hits(t) for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([m.tolist() for _, m, _ in found], pa.list_(pa.int32())), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "hit_words", "items"],
            )

    return id_and_text(docs).mapInArrow(scan, FOUND)


def _windows(rows: DataFrame, key: str, of: Callable[[int], list[int]], bitmap: Broadcast | None = None) -> DataFrame:
    """(key, n_words, at, size, h, gram) of windows of the sizes that ``of`` gives for a text's number of words; those
    that the bitmap allows, if there is one. One row with a null ``at`` stands for the text itself."""
    kind = rows.schema[key].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for name, text in zip(keys, byte_values(batch.column(1)), strict=True):
                w = words(text)
                out: list[tuple] = [(name, len(w), None, None, None, None)]
                for size in of(len(w)):
                    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
                    h = np.array([xxhash.xxh64_intdigest(g, size) for g in grams], dtype=np.uint64)
                    allowed = range(len(h)) if bits is None else np.flatnonzero(_allowed(bits, h)).tolist()
                    out += [(name, len(w), i, size, int(h[i].astype(np.int64)), grams[i]) for i in allowed]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary())],
                    [key, "n_words", "at", "size", "h", "gram"],
                )

    return rows.select(key, "text").mapInArrow(explode, f"{key} {kind}, n_words long, at long, size int, h long, gram binary")


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, a row for each probe."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + step * np.arange(PROBES, dtype=np.uint64)[:, None]) % np.uint64(bits)


def _allowed(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _probes(h, 8 * len(bitmap))
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _bitmap(windows: DataFrame) -> Broadcast:
    """Bits of all the items' windows; as many as 16 for each window, up to the bound."""
    bits = 1 << 12
    while bits < min(BITMAP_BITS, 16 * windows.count()):
        bits *= 2

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probes(batch.column(0).to_numpy().astype(np.int64).view(np.uint64), bits).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(np.left_shift(1, (at & np.uint64(31)).astype(np.int64)))], ["word", "bit"])

    set_ = windows.select("h").mapInArrow(probes, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    held = np.zeros(bits // 32, dtype="<u4")
    held[set_["word"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64).astype("<u4")
    return windows.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def _joined(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """__row, n_words, hit_words, items of every row (__row, text), by joining windows."""
    windows = cut(_windows(items, "item_id", lambda m: [min(m, n)] if m else []).where("h is not null").select("h", "size", "gram", "item_id"), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    met = cut(_windows(rows, "__row", lambda m: [s for s in sizes if s <= m], _bitmap(windows)), "candidates")
    table = windows.groupBy("h", "size", "gram").agg(F.collect_set("item_id").alias("own"))  # one row for each window
    hits = met.where("h is not null").join(table, ["h", "size", "gram"])
    words_of = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (F.col("at") + i).cast("int"))
    hits = hits.groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words_of)))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("items"))
    return met.where("at is null").select("__row", "n_words").join(cut(hits, "hits"), "__row", "left")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, bound: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, hit_words (numbers of the hit words), items; one row for each row of docs."""
    items = _items(benchmark)
    if _fits(items, n, bound):
        return _scan(docs, _broadcast(items, n))
    rows = cut(id_and_text(docs).withColumn("__row", F.monotonically_increasing_id()), "rows")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return _joined(rows, items, n).join(rows.select("__row", "doc_id"), "__row").select("doc_id", "n_words", none("hit_words", "array<int>"), none("items", "array<string>"))


def remove_spans(text: bytes | None, mark: np.ndarray) -> bytes | None:
    """The text without its hit words and what stands between two hit words in a row."""
    if text is None or not len(mark):
        return text
    folded = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.r_[0, folded.view(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.split(mark, np.flatnonzero(np.diff(mark) > 1) + 1)
    out, at = [], 0
    for run in runs:
        out.append(text[at : starts[run[0]]])
        at = int(ends[run[-1]])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans", most: float = 0.5, bound: int = BROADCAST_BYTES) -> DataFrame:
    """docs, all columns, without benchmark passages.

    ``spans`` cuts hit words out of the text, and drops a document of which more than ``most`` of the
    words are hit (little but benchmark would be left); ``documents`` drops every document with a hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    schema = docs.schema
    at = schema.fieldNames().index("text")
    stays = lambda total, hit: not hit or (remove == "spans" and hit <= most * total)
    items = _items(benchmark)
    several, width = not _fits(items, n, bound), len(schema)
    if several:
        row, total_, mark_ = (free_name(docs, x) for x in ("__row", "__n", "__mark"))
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = _joined(rows.select(F.col(f"`{row}`").alias("__row"), F.col("text").cast("string").alias("text")), items, n)
        found = cut(found.where("hit_words is not null").select(F.col("__row").alias(row), F.col("n_words").alias(total_), F.col("hit_words").alias(mark_)), "marks")
        source = rows.join(found, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], total_, mark_)
    else:
        source, held = docs, _broadcast(items, n)

    def marks(batch: pa.RecordBatch, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
        if several:
            for total, mark in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                yield total or 0, np.array(mark or [], dtype=np.int64)
        else:
            for text in texts:
                yield held.value.hits(text)[:2]

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = byte_values(batch.column(at)), []
            for i, (total, mark) in enumerate(marks(batch, list(texts))):
                keep.append(stays(total, len(mark)))
                if keep[-1] and len(mark):
                    texts[i] = remove_spans(texts[i], mark)
            columns = list(batch.columns)[:width]
            columns[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(scrub, schema)


def report(found: DataFrame) -> DataFrame:
    """The digest of find_hits, one row for each document."""
    names = F.array_sort("items")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )

