"""From documents to shards: five stages, each one of the operators in ``sparkloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, mixing, quality, sharding, simhash
from sparkloom.llm.common import new_path, remove, scratch, table

#: Bytes of texts that go to a Python worker at once. Spark's own bound, 64 MB, takes a multiple of that in each task: in the
#: buffers of the JVM, in the worker, and in what the worker makes of them. Results do not depend on it.
BATCH_BYTES = 1 << 20
#: Bytes of texts that a task holds back as it writes Parquet, and that it reads at once; Spark's own bound is 128 MB. A page
#: stays small enough for the heap's regions, and a batch of the reader holds so many rows, not 4096 whole texts.
GROUP_BYTES, PAGE_BYTES, READ_ROWS = 8 << 20, 256 << 10, 512


def in_small_batches(spark: SparkSession) -> None:
    """From here on in the session, as stages run only when their result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))
    spark.conf.set("parquet.page.size", str(PAGE_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    in_small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays."""
    in_small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that are mostly benchmark go."""
    in_small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    in_small_batches(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document copy."""
    in_small_batches(spark)
    return sharding.packed(docs, shards=8)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier, SimHash, and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark):  # what a stage writes on its way goes once its result is there
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:  # so does the stage before it: the result reads the last one alone
            remove(spark, before)
        before = path
    return docs
