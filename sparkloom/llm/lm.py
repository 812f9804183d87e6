"""Language-model scoring by stupid backoff, over n-gram counts of the whole corpus.

S(w | v) = c(v w) / c(v) where the bigram occurs at least ``min_count`` times, else ``backoff`` * c(w) / N.
A document's log score is the sum of log S over its words (the first word has c(w) / N; a word that the
corpus lacks counts as met once). All counts are exact, at any size of the corpus and its vocabulary.

Documents are exploded to bigrams, dealt by the bigram's hash; where they meet, grouping gives the
bigram count table, which is joined back to the occurrences, and what the join finds is summed per
document. Three lists decide which way a bigram takes, never what it counts:

* The most frequent words (at most ``size``) are numbered and broadcast. Two of them make a 40-bit
  bigram. These travel packed, one row for each bucket of bigrams and slice of documents: sorted
  bigrams by byte plane, 16-bit document numbers, and the steps between document ids. (As rows of their
  own they took 5.9 times the input in disk and 1145 CPU seconds a GB.) A bucket, of about two million
  bigrams, counts and joins its own.
* Other words keep their 63-bit hash. Their bigrams are rows (word, word, doc, n), counted and joined as
  DataFrames, and the words' counts are joined from the unigram table.
* Bigrams of two of the ``hot`` most frequent words are counted with a map-side combine and broadcast
  (at most hot * hot counts). Any other bigram has a word of less than 1/hot of the corpus.

Defined cases: null and empty texts have no words and a sum of 0; rows that repeat a doc_id (or have
none) are scored as one document, and no bigram spans two rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, id_and_text

#: Words that are numbered and broadcast, at most; a number has 20 bits. No score depends on it.
SIZE = 1 << 19
#: Words whose bigrams with each other are counted beforehand. No score depends on it.
HOT = 1024
#: Words that a task holds at a time, about (a longer text is held by itself), and its most rows.
SLICE_WORDS = 500_000
SLICE_ROWS = 20_000
#: Bigrams of a bucket, about.
PER_BUCKET = 2_000_000
#: Words that a task remembers.
CACHE = 300_000
NO_ID = np.iinfo(np.int64).min


def word_keys(words: list[bytes]) -> np.ndarray:
    """63 bits of each word's XXH64, as negative numbers: positive ones number the frequent words."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    return -(h >> np.uint64(1)).astype(np.int64) - 1


def unigram_counts(docs: DataFrame) -> DataFrame:
    """(word, n): count of every word of the corpus, by ``word_keys``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(word_keys(list(held))), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in byte_values(batch.column(0)):
                held.update((text or b"").lower().split())
                if len(held) > 400_000:
                    yield flush()
        yield flush()

    rows = id_and_text(docs).select("text").mapInArrow(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """The most frequent words: keys in order, their numbers from 1 on by falling count, and log counts by number."""

    keys: np.ndarray
    numbers: np.ndarray
    logs: np.ndarray
    total: int


def frequent_words(unigrams: DataFrame, size: int = SIZE) -> Frequent:
    """The words of at least t occurrences, for a t that leaves at most ``size`` of them."""
    if size >= 1 << 20:
        raise ValueError("word numbers have 20 bits")
    level = F.floor(F.log2("n") * 16)
    levels = sorted(unigrams.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    fits = np.cumsum([r["words"] for r in levels]) <= size
    least = levels[int(fits.sum()) - 1]["level"] if fits.any() else None
    kept = unigrams.where(level >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "n": []}, dtype=np.int64)
    keys, n = kept["word"].to_numpy(np.int64), kept["n"].to_numpy(np.int64)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    by_key = np.argsort(keys)
    return Frequent(keys[by_key], (by_key + 1).astype(np.int32), np.r_[0.0, np.log(n)], int(sum(r["n"] for r in levels)))


class Numberer:
    """Words of a text as numbers (frequent words) or negative keys (others), with a bounded memory of words seen."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        self.cache: dict[bytes, int] = {}

    def _numbers(self, words: list[bytes]) -> list[int]:
        keys, f = word_keys(words), self.frequent
        if not len(f.keys):
            return keys.tolist()
        at = np.minimum(np.searchsorted(f.keys, keys), len(f.keys) - 1)
        return np.where(f.keys[at] == keys, f.numbers[at], keys).tolist()

    def __call__(self, text: bytes | None) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        words = (text or b"").lower().split()
        new = list(set(words).difference(cache))
        if new:
            cache.update(zip(new, self._numbers(new), strict=True))
        return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))


def numbered(docs: DataFrame, frequent: Broadcast, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc, ids): the words of every row, written once; NO_ID for a null doc_id."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Numberer(frequent.value)

        def rows(names: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([names, ids], ["doc", "ids"])

        for batch in batches:
            names = batch.column(0).fill_null(int(NO_ID))
            start, held, words = 0, [], 0
            for at, value in enumerate(batch.column(1)):
                text = value.as_buffer()
                held.append(of(text.to_pybytes() if text is not None else None))
                words += len(held[-1])
                if words >= slice_words:
                    yield rows(names[start : at + 1], held)
                    start, held, words = at + 1, [], 0
            if held:
                yield rows(names[start:], held)

    return cut(id_and_text(docs).mapInArrow(number, "doc long, ids array<long>"), "numbered")


def slices(batches: Iterator[pa.RecordBatch], slice_words: int = SLICE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, words and sizes of consecutive slices of batches of (doc, ids)."""
    for batch in batches:
        names, ids = batch.column(0).to_numpy(), batch.column(1)
        offsets, flat, start = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False), 0
        while start < len(names):
            end = int(np.searchsorted(offsets, offsets[start] + slice_words, "left"))
            end = min(max(end, start + 1), start + SLICE_ROWS, len(names))
            yield names[start:end], flat[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1])
            start = end


def bigrams(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, second words and the numbers of the texts of all bigrams."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    same = of[1:] == of[:-1]
    return flat[:-1][same], flat[1:][same], of[1:][same]


def counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of several columns, in order of the first, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.r_[at, len(order)])


def _planes(values: np.ndarray, width: int) -> bytes:
    """64-bit values by byte plane, the lowest ``width`` of them, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _values(planes: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<i8").ravel().astype(np.int64)


def pack(keys: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as five byte planes, and the 16-bit document numbers in their order."""
    return _planes(keys, 5), docs.astype("<u2").tobytes()


def unpack(keys: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _values(keys, 5), np.frombuffer(docs, dtype="<u2").astype(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Document ids as the byte planes of their steps, which are small where ids are in order."""
    return _planes(np.diff(ids, prepend=0), 8)


def unpack_ids(ids: bytes) -> np.ndarray:
    return np.cumsum(_values(ids, 8))


#: What packed bigrams are for: only counted, only scored, or both.
COUNTED, SCORED, BOTH = 0, 1, 2


class Counts:
    """What the corpus gives: unigrams and its numbered words (DataFrames), frequent words and hot bigrams (broadcast)."""

    def __init__(self, corpus: DataFrame, size: int = SIZE, hot: int = HOT, slice_words: int = SLICE_WORDS):
        self.hot, self.slice_words, spark = hot, slice_words, corpus.sparkSession
        self.unigrams = cut(unigram_counts(corpus), "unigrams")
        frequent = frequent_words(self.unigrams, size)
        self.total, self.frequent = frequent.total, spark.sparkContext.broadcast(frequent)
        self.words = numbered(corpus, self.frequent, slice_words)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, flat, sizes in slices(batches, slice_words):
                v, w, _ = bigrams(flat, sizes)
                near = (np.minimum(v, w) > 0) & (np.maximum(v, w) <= hot)
                keys, n = np.unique(v[near] << 20 | w[near], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        both = self.words.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
        self.hot_bigrams = spark.sparkContext.broadcast((both["key"].to_numpy(np.int64), both["n"].to_numpy(np.int64)))

    def packed(self, words: DataFrame, side: int) -> DataFrame:
        """(bucket, side, docs, keys, at): the bigrams of frequent words that are not hot, packed."""
        hot, slice_words, buckets = self.hot, self.slice_words, max(32, self.total // PER_BUCKET)

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, flat, sizes in slices(batches, slice_words):
                v, w, of = bigrams(flat, sizes)
                far = (np.minimum(v, w) > 0) & (np.maximum(v, w) > hot)
                keys, of = v[far] << 20 | w[far], of[far]
                bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.lexsort((keys, bucket))
                keys, of, bucket = keys[order], of[order], bucket[order]
                ends = np.flatnonzero(np.diff(bucket, append=-1))
                rows: list[list] = [[], [], [], []]
                for a, b in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist(), strict=False):
                    own, at_own = np.unique(of[a:b], return_inverse=True)
                    for out, x in zip(rows, (int(bucket[a]), pack_ids(names[own]), *pack(keys[a:b], at_own)), strict=True):
                        out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "docs", "keys", "at"])

        rows = words.mapInArrow(explode, "bucket long, docs binary, keys binary, at binary")
        return rows.withColumn("side", F.lit(side))

    def frequent_gains(self, words: DataFrame, min_count: int, backoff: float) -> DataFrame:
        """(doc, value): what the packed bigrams add to the backed-off scores, a row for each bucket and document."""
        held = self.frequent

        def join(bucket: pd.DataFrame) -> pd.DataFrame:
            f, keys, ids, sides = held.value, [], [], []
            for docs_, keys_, at, side in zip(bucket["docs"], bucket["keys"], bucket["at"], bucket["side"], strict=True):
                key, at_own = unpack(keys_, at)
                keys.append(key)
                ids.append(unpack_ids(docs_)[at_own])
                sides.append(np.full(len(key), side))
            key, of, side = np.concatenate(keys), np.concatenate(ids), np.concatenate(sides)
            values, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse[side != SCORED], minlength=len(values))
            gain = np.log(np.maximum(1, n)) + np.log(f.total / backoff) - f.logs[values >> 20] - f.logs[values & ((1 << 20) - 1)]
            each = np.where(n >= min_count, gain, 0.0)[inverse]
            docs_, at_doc = np.unique(of[side != COUNTED], return_inverse=True)
            return pd.DataFrame({"doc": docs_, "value": np.bincount(at_doc, weights=each[side != COUNTED], minlength=len(docs_))})

        rows = self.packed(words, BOTH) if words is self.words else self.packed(words, SCORED).unionByName(self.packed(self.words, COUNTED))
        return rows.groupBy("bucket").applyInPandas(join, "doc long, value double")

    def rare(self, words: DataFrame) -> DataFrame:
        """(v, w, doc, n) of every bigram with a word that is not frequent."""
        slice_words = self.slice_words

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, flat, sizes in slices(batches, slice_words):
                v, w, of = bigrams(flat, sizes)
                far = np.minimum(v, w) < 0
                (of, v, w), n = counted(of[far], v[far], w[far])
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(names[of]), pa.array(n.astype(np.int32))], ["v", "w", "doc", "n"])

        return words.mapInArrow(explode, "v long, w long, doc long, n int").repartition("v", "w")

    def rare_gains(self, words: DataFrame, min_count: int, backoff: float) -> DataFrame:
        """(doc, word, value): what those bigrams add, less the log counts of words that are not frequent: value times each."""
        held = self.frequent

        @F.pandas_udf("double")
        def gain(v: pd.Series, w: pd.Series, n: pd.Series) -> pd.Series:
            f = held.value
            return pd.Series(np.log(n.to_numpy()) + np.log(f.total / backoff) - f.logs[np.maximum(v.to_numpy(), 0)] - f.logs[np.maximum(w.to_numpy(), 0)])

        met = self.rare(words)
        corpus = met if words is self.words else self.rare(self.words)
        counts = corpus.groupBy("v", "w").agg(F.sum("n").alias("c")).where(F.col("c") >= min_count)
        counts = counts.select("v", "w", gain("v", "w", "c").alias("gain"))
        part = lambda word, value: F.struct(word.cast("long").alias("word"), value.cast("double").alias("value"))
        off = [part(F.when(F.col(c) < 0, F.col(c)), F.when(F.col(c) < 0, -F.col("n")).otherwise(0)) for c in ("v", "w")]
        parts = F.explode(F.array(part(F.lit(None), F.col("n") * F.col("gain")), *off)).alias("p")
        return met.join(counts, ["v", "w"]).select("doc", parts).groupBy("doc", "p.word").agg(F.sum("p.value").alias("value"))

    def known_part(self, words: DataFrame, min_count: int, backoff: float) -> DataFrame:
        """(doc, word, n_tokens, value): of each document (word is null) the backed-off score of all words and the gains of
        hot bigrams, up to the counts of its other words; and how often it needs the log count of each of these."""
        held, hot, hot_bigrams, slice_words = self.frequent, self.hot, self.hot_bigrams, self.slice_words

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = held.value
            hot_keys, hot_n = hot_bigrams.value
            for names, flat, sizes in slices(batches, slice_words):
                of = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.bincount(of, weights=f.logs[np.maximum(flat, 0)], minlength=len(sizes)).astype(np.float64)
                sums += sizes * np.log(backoff / max(1, f.total)) - np.log(backoff) * (sizes > 0)
                v, w, at = bigrams(flat, sizes)
                near = (np.minimum(v, w) > 0) & (np.maximum(v, w) <= hot)
                v, w, at = v[near], w[near], at[near]
                if len(hot_keys):
                    place = np.minimum(np.searchsorted(hot_keys, v << 20 | w), len(hot_keys) - 1)
                    n = np.where(hot_keys[place] == (v << 20 | w), hot_n[place], 0)
                    gain = np.where(n >= min_count, np.log(np.maximum(n, 1)) + np.log(f.total / backoff) - f.logs[v] - f.logs[w], 0.0)
                    sums += np.bincount(at, weights=gain, minlength=len(sizes)).astype(np.float64)
                (doc, word), n = counted(of[flat < 0], flat[flat < 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[names, names[doc]]),
                        pa.array(np.r_[np.zeros(len(sizes), dtype=np.int64), word], mask=np.r_[np.ones(len(sizes), dtype=bool), np.zeros(len(word), dtype=bool)]),
                        pa.array(np.r_[sizes, np.zeros(len(word), dtype=np.int64)].astype(np.int64)),
                        pa.array(np.r_[sums, n.astype(np.float64)]),
                    ],
                    ["doc", "word", "n_tokens", "value"],
                )

        return words.mapInArrow(known, "doc long, word long, n_tokens long, value double")


def score(docs: DataFrame, counts: Counts | None = None, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum of log S); by the counts of docs themselves, if none are given."""
    words = numbered(docs, counts.frequent, counts.slice_words) if counts else None
    counts = counts or Counts(docs)
    words = counts.words if words is None else words
    known = cut(counts.known_part(words, min_count, backoff), "known")
    found = cut(counts.rare_gains(words, min_count, backoff), "rare-bigrams")
    every = known.unionByName(found.withColumn("n_tokens", F.lit(0).cast("long")))
    plain = counts.frequent_gains(words, min_count, backoff).withColumn("n_tokens", F.lit(0).cast("long"))
    needed = every.where("word is not null and value <> 0").join(counts.unigrams.withColumnRenamed("n", "c"), "word", "left")
    needed = needed.select("doc", "n_tokens", (F.col("value") * F.log(F.coalesce("c", F.lit(1)))).alias("value"))
    summed = every.where("word is null").drop("word").unionByName(needed).unionByName(plain).groupBy("doc").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("value").alias("log_prob"))
    return summed.select(F.when(F.col("doc") != int(NO_ID), F.col("doc")).alias("doc_id"), "n_tokens", "log_prob")

