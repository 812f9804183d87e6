"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each sender (a partition of the fingerprint table) sorts its distinct 64-bit fingerprints, splits
them by owner, and sends every owner the Golomb-Rice coded gaps: a little over log2(range / count)
bits each instead of 64. An owner compares what it received and answers every sender with a bitmap,
one bit for each fingerprint in the order sent: set if another sender holds it too. Only rows whose
bit is set, or whose fingerprint repeats within their own sender, are suspects; only suspects' texts
are shuffled, and there equal bytes are what counts, not equal hashes.

Of equal texts the row with the largest doc_id stays. Defined cases: a null text counts as empty; a
null doc_id is smaller than any other; of rows that repeat both doc_id and text one row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, small

#: Fingerprints that one owner compares, about.
PER_OWNER = 500_000
#: Fingerprints of one sender and message at most; larger partitions send several.
PER_SENDER = 1_000_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Rice parameter and code of sorted distinct unsigned numbers (the first gap from zero): the remainders' bits of
    all gaps come first, then their quotients in unary, so that both are read without a loop."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // max(1, len(values)) if len(values) else 1
    k = max(0, min(57, mean.bit_length() - 1))
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    return k, np.packbits(np.r_[rest.ravel(), unary]).tobytes()


def golomb_decode(k: int, n: int, blob: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))
    rest = bits[: n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)
    stops = np.flatnonzero(bits[n * k :] == 0)[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest.sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def _send(owners: int):
    """Messages of one sender: its distinct fingerprints, by owner."""
    width = (1 << 64) // owners

    def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for sender, own in pdf.groupby("sender", sort=False):
                held.setdefault(int(sender), []).append(own["h"].to_numpy(np.int64).view(np.uint64))
        for sender, parts in held.items():
            h = np.unique(np.concatenate(parts))
            of = np.minimum(h // np.uint64(width), np.uint64(owners - 1)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            rows = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True):
                k, blob = golomb_encode(h[a:b] - np.uint64(int(of[a]) * width))
                rows.append((int(of[a]), sender, k, b - a, blob))
            yield pd.DataFrame(rows, columns=["owner", "sender", "k", "n", "blob"])

    return messages


def _own(owner: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps for the senders: which of their fingerprints another sender holds too."""
    parts = [golomb_decode(k, n, blob) for k, n, blob in zip(owner["k"], owner["n"], owner["blob"], strict=True)]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    often = values[counts > 1]
    return pd.DataFrame({"sender": owner["sender"], "owner": owner["owner"], "bits": [np.packbits(np.isin(p, often)).tobytes() for p in parts]})


def _suspects(owners: int):
    """Fingerprints of one sender that a bitmap, or the sender itself, marks."""
    width = (1 << 64) // owners

    def marked(rows: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        of = np.minimum(values // np.uint64(width), np.uint64(owners - 1)).astype(np.int64)
        mark = counts > 1
        for owner, bits in zip(maps["owner"], maps["bits"], strict=True):
            own = np.flatnonzero(of == owner)
            mark[own] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: len(own)].astype(bool)
        return pd.DataFrame({"h": values[mark].view(np.int64)})

    return marked


def equal_texts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    texts = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # several senders for a partition that holds more rows than a message should
    row = F.monotonically_increasing_id()
    rows = cut(rows.withColumn("row", row).withColumn("sender", F.floor(F.col("row") / PER_SENDER)), "fingerprints")
    owners = max(8, -(-rows.count() // PER_OWNER))
    sent = rows.select("sender", "h").mapInPandas(_send(owners), "owner long, sender long, k int, n long, blob binary")
    bitmaps = sent.groupBy("owner").applyInPandas(_own, "sender long, owner long, bits binary")
    suspects = rows.select("sender", "h").groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_suspects(owners), "h long")
    wanted = small(cut(suspects.distinct(), "suspects"), 16)

    # equal bytes, not equal hashes: one copy of each suspect text leaves a task
    checked = texts.withColumn("h", F.xxhash64("text")).join(wanted, "h", "left_semi")
    checked = checked.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"))
    checked = checked.select("h", F.unhex(F.sha2("text", 256)).alias("digest"), "n").groupBy("h", "digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    verified = cut(checked, "verified")
    if verified.where("texts > 1").limit(1).count():
        raise ArithmeticError("different texts share both a 64-bit hash and a SHA-256")
    groups = rows.join(wanted, "h", "left_semi").groupBy("h", "digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.join(verified.where("n > 1").select("h", "digest"), ["h", "digest"], "left_semi"), "copies")
    out = rows.join(small(groups, 80), ["h", "digest"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
