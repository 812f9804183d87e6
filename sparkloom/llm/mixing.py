"""Mixing sources to target weights, with DataFrame operations only.

Tokens are counted per source, targets shared out by weight, and each document is emitted
floor(rate) times plus once more with a probability equal to the rate's fraction, by a hash of the
document and the seed: a rerun takes the same documents, on any number of machines.

Defined cases: a null text has size 0; null sources are one source, the last; a source of size 0
gets target 0 and none of its documents; rows that repeat doc_id and text share one draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, small

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, size: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source, by rounds of sharing.

    In each round the free sources share by weight what the full ones leave; those that come out above
    their cap are full from then on.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(ranked) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int"))
    now = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"), F.lit(False).alias("full"))
    now = cut(now, "sources")
    budget = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        used, free = now.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
        if not free:
            each = 0.0
            break
        each = max(0.0, budget - used) / free
        over = ~F.col("full") & (F.col("weight") * each > F.col("cap"))
        if not now.where(over).limit(1).count():
            break
        now = cut(now.withColumn("full", F.col("full") | over), "sources")
    return now.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * each).alias("target"))


def copies(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: what the mix takes of each document."""
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))
    sized = cut(sized, "sizes")
    of = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    of = small(of.withColumnRenamed("source", "__source"), 100)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    joined = sized.join(of, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    extra = draw(F.col("doc_id"), F.col("size"), seed) < rate - F.floor(rate)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor(rate) + extra.cast("long")).alias("copies"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. The text is counted, then read again, never shuffled
    unless there are too many sources to broadcast."""
    sized = docs.select("source", words_of(F.col("text")).alias("size"))
    of = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    own, per, copy = (free_name(docs, x) for x in ("__source", "__rate", "__copy"))
    of = small(of.select(F.col("source").alias(own), rate.alias(per)), 100)
    joined = docs.join(of, F.col("source").eqNullSafe(F.col(own)), "left")
    extra = draw(F.col("doc_id"), words_of(F.col("text")), seed) < F.col(per) - F.floor(per)
    n = (F.floor(per) + extra.cast("long")).cast("int")
    taken = joined.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
