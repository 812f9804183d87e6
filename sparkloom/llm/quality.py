"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (its lines). Every passage is encoded by what its characters and words
look like, a small network embeds it, gated attention weighs the embeddings, and the weighted sum gives
the document's score. Attention learns from document labels alone which passages matter.

The network is trained in numpy on a bounded sample of labelled documents, whole ones: by hash, at most
``max_documents``, and of these each that still fits ``max_passages`` passages together; one that doesn't
is passed over. Scoring reads every passage of every document, as training does.
Labels, language, source and doc_id are never inputs of a score.

Defined cases: null and empty texts are one empty passage; labels without document, without value or
doc_id are left out, and contradictory ones are averaged; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, free_name, id_and_text

MAX_DOCUMENTS = 6000
MAX_PASSAGES = 300_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 16
#: Texts that are scored at once, and their bytes unless one alone has more.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20

#: Classes of bytes: upper, lower, digit, space, sentence marks, quotes and brackets, other symbols, non-ASCII, control.
CLASSES = 9


def _classes() -> np.ndarray:
    of = np.full(256, 6, dtype=np.uint8)
    of[65:91], of[97:123], of[48:58] = 0, 1, 2
    of[[32, 9, 10, 11, 12, 13]] = 3
    of[[ord(c) for c in ".,;:?!"]] = 4
    of[[ord(c) for c in "\"'()[]{}-"]] = 5
    of[128:] = 7
    of[[c for c in range(32) if c not in (9, 10, 11, 12, 13)]] = 8
    return of


LUT = _classes()
FEATURES = CLASSES + 8


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin."""
    whole = [(t or b"").split(b"\n") for t in texts]
    starts = np.cumsum([0, *(len(p) for p in whole)])[:-1]
    passages = [p for ps in whole for p in ps]
    sizes = np.array([len(p) for p in passages], dtype=np.int64)
    codes = LUT[np.frombuffer(b"\n".join(passages) + b"\n", dtype=np.uint8)]
    at = np.cumsum(np.r_[0, sizes + 1])[:-1]
    x = np.zeros((len(passages), FEATURES), dtype=np.float32)
    n = np.maximum(1, sizes)
    for k in range(CLASSES):
        x[:, k] = np.add.reduceat((codes == k).astype(np.int32), at) / n
    x[:, 3] -= 1 / n  # the line's end
    repeats, distinct, length, marked = [], [], [], []
    for p in passages:
        w = p.split()
        m = max(1, len(w))
        length.append(len(w))
        repeats.append(sum(map(eq, w, w[1:])) / m)
        distinct.append(len(set(w)) / m if w else 1.0)
        marked.append(1.0 - sum(map(bytes.isalpha, w)) / m)
    words = np.array(length, dtype=np.float32)
    x[:, CLASSES] = np.log1p(sizes) / 8
    x[:, CLASSES + 1] = np.log1p(words) / 6
    x[:, CLASSES + 2] = repeats
    x[:, CLASSES + 3] = distinct
    x[:, CLASSES + 4] = (np.array(distinct) < 0.3) & (words > 8)
    x[:, CLASSES + 5] = np.minimum(3, sizes / np.maximum(1, words) / 8)
    x[:, CLASSES + 6] = marked
    x[:, CLASSES + 7] = sizes == 0
    return x, starts


@dataclass
class Network:
    """Encoder, gated attention and output weights; ``shift`` and ``scale`` standardise the features."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.shift) / self.scale, starts)[0]


def forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ p["we"] + p["be"])
    t, g = np.tanh(h @ p["wv"]), 1 / (1 + np.exp(-np.clip(h @ p["wu"], -30, 30)))
    e = (t * g) @ p["wa"]
    bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["wo"] + p["bo"], -30, 30)))
    return y, h, t, g, a, z, bag


def train(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Network:
    """Full-batch Adam on the log loss."""
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - shift) / scale).astype(np.float64)
    rng, d, k = np.random.default_rng(seed), x.shape[1], HIDDEN
    p = {"we": rng.normal(0, d**-0.5, (d, k)), "be": np.zeros(k), "wv": rng.normal(0, k**-0.5, (k, k)), "wu": rng.normal(0, k**-0.5, (k, k)), "wa": rng.normal(0, k**-0.5, k), "wo": rng.normal(0, k**-0.5, k), "bo": np.zeros(1)}
    m, v = ({n: np.zeros_like(w) for n, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y, h, t, g, a, z, bag = forward(p, x, starts)
        dy = (y - labels) / len(labels)
        dz = np.outer(dy, p["wo"])
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dgate = np.outer(de, p["wa"])
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["wv"].T + dg @ p["wu"].T
        pre = dh * (1 - h * h)
        grad = {"we": x.T @ pre, "be": pre.sum(axis=0), "wv": h.T @ dt, "wu": h.T @ dg, "wa": (t * g).T @ de, "wo": z.T @ dy, "bo": np.array([dy.sum()])}
        for n, w in p.items():
            gr = grad[n] + decay * w
            m[n] = 0.9 * m[n] + 0.1 * gr
            v[n] = 0.999 * v[n] + 0.001 * gr * gr
            w -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return Network(shift, scale, p)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES) -> Network | None:
    """Train on labelled documents of the folds 1 to 4, the first ones by hash that meet both bounds. None without labels
    of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents), "label-sample")
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sized = rows.groupBy("doc_id").agg(F.xxhash64("doc_id").alias("h"), F.sum(F.coalesce(breaks, F.lit(1))).alias("n")).collect()  # bounded by the sample
    left, taken = max_passages, []
    for r in sorted(sized, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:  # one that is too long is passed over, and ends nothing
            left -= r["n"]
            taken.append(r["doc_id"])
    if len(taken) < len(sized):
        few = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(taken, pa.int64())}), "doc_id long")  # as Arrow it needs no Python workers
        rows = rows.join(F.broadcast(few), "doc_id", "left_semi")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, starts = encode(byte_values(batch.column(1)))
            ends = [*starts[1:].tolist(), len(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.ascontiguousarray(x[a:b]).tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary())], ["quality", "bag"])

    bags = sorted((r["quality"], bytes(r["bag"])) for r in rows.select("quality", "text").mapInArrow(passages, "quality double, bag binary").collect())
    if len({y >= 0.5 for y, _ in bags}) < 2:
        return None
    parts = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for _, b in bags]
    return train(np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1], np.array([y for y, _ in bags]))


def slices(texts: list[bytes | None], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[list[bytes | None]]:
    """Texts in order, a bounded number and size of them at a time."""
    own, held = [], 0
    for text in texts:
        if own and (len(own) >= rows or held + len(text or b"") > size):
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text or b"")
    if own:
        yield own


def with_score(docs: DataFrame, network: Network | None, name: str = "score") -> DataFrame:
    """docs, all columns, and the score of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is None or not batch.num_rows:
                y = np.full(batch.num_rows, 0.5)
            else:
                texts = byte_values(batch.column(at))
                y = np.concatenate([held.value.score(*encode(part)) for part in slices(texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = with_score(id_and_text(docs), fit(docs, labels)).select("doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    name = free_name(docs, "__quality")
    return with_score(docs, fit(docs, labels), name).where(F.col(f"`{name}`") >= threshold).drop(name)
