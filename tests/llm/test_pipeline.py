"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from sparkloom.llm import quality, sharding, simhash
from sparkloom.llm.common import cut, table
from tests.llm.test_operators import hits_brute, targets_brute, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input, then what each stage returned, written and read again."""
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_rejected_documents_go(spark, stages):
    good = {r["doc_id"] for r in quality.classify(stages[0], table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert set(texts(stages[1])) == good and 0 < len(good) < stages[0].count()


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {i: set(simhash.shingles((t or "").encode(), 5)) for i, t in before.items()}
    top = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {i: low if x == high else x for i, x in top.items()}
    assert set(after) == set(top.values())


def test_no_benchmark_stays(spark, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    hit = {i: hits_brute(t, items, 10) for i, t in before.items()}
    assert {i: t for i, t in after.items() if not hit[i][1]} == {i: t for i, t in before.items() if not hit[i][1]}
    assert set(after) == {i for i, (n, mark, _) in hit.items() if len(mark) <= 0.5 * n}
    assert all(len(words(after[i])) < len(words(before[i])) for i in after if hit[i][1])


def test_sources_meet_their_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["doc_id"]] += 1
    goal = targets_brute(dict(sizes))
    for r in before:
        rate = goal[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate) <= taken[r["doc_id"]] <= int(rate) + 1


def test_shards_hold_every_copy(stages):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in stages[4].collect())
    rows, slots = stages[5].collect(), defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages_in_turn(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "size").collect())) == Counter(map(tuple, stages[5].select("doc_id", "size").collect()))


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """A stage's Python gets a few MB at once, whatever the table holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = [(i, f"{i} " * 25_000) for i in range(150)]  # 12 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    try:
        spark.conf.unset(key)
        corpus_pipeline.one_of_each(spark, docs.limit(3), SF)
        assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_stages_write_and_read_in_bounded_pieces(spark, tmp_path):
    """No row group of a stage's result holds more than a bound of texts, however large the task's part."""
    rows = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1000), i -> sha2(concat(id, ':', i), 256)), ' ') AS text", "'a' AS source")
    path = str(tmp_path / "mixed")
    mixed = corpus_pipeline.mixed(spark, cut(rows, "long-texts"), SF)
    mixed.coalesce(1).write.parquet(path)
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("mixed/*.parquet")]
    groups = [f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)]
    assert sum(groups) > 4 * corpus_pipeline.GROUP_BYTES and max(groups) < 1.5 * corpus_pipeline.GROUP_BYTES


def test_runs_reach_spark_without_python_workers(spark, monkeypatch):
    monkeypatch.setattr(sharding, "cut", lambda df, name: df)
    runs = sharding._runs(spark, [(9, 2), (4, 3)], [(0, 2, 1), (1, 2, 0), (1, 1, 1)])
    assert sorted(map(tuple, runs.collect())) == [(4, 0, 2, 3, 0), (4, 2, 1, 3, 1), (9, 0, 2, 2, 1)]
    assert "ExistingRDD" not in runs._jdf.queryExecution().executedPlan().toString()
    assert sharding._runs(spark, [], []).count() == 0
