"""Thin queries over the training-data operators, and their DuckDB counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, infill, lm, mixing, packing, pii, quality, secret, sharding, simhash, whitening
from .common import cut, table
from .lines import LineIndex


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = LineIndex(spark, min_docs=10, min_chars=1).insert(docs).drop_frequent(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    mean = F.col("log_prob") / F.nullif(F.col("n_tokens"), F.lit(0))
    return scored.select("doc_id", "n_tokens", F.round(mean, 4).alias("score"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, lanes=1, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.equal_texts(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"), share=1.5, most=2.0, weights=(3.0, 1.0, 2.0))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret.digest(secret.secrets(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.packed(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain=90, spm=20)
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.component_rows(table(spark, sf_dir, "embeddings"), components=8)
    # a long holds the deviation of up to about 10**7 vectors; beyond, the operator's decimal does
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_infill": op12_infill,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, {_LOW.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM lines),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op2_lm_scoring": rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
pairs AS (
  SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens),
bigrams AS (SELECT before, word, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY before, word),
scored AS (
  SELECT p.doc_id,
    CASE WHEN p.before IS NULL THEN ln(w.n / (SELECT count(*) FROM tokens))
         WHEN b.n >= 2 THEN ln(b.n / v.n)
         ELSE ln(0.4 * w.n / (SELECT count(*) FROM tokens)) END AS s
  FROM pairs p JOIN counts w ON p.word = w.word
  LEFT JOIN counts v ON p.before = v.word
  LEFT JOIN bigrams b ON p.before = b.before AND p.word = b.word)
SELECT d.doc_id, count(s)::BIGINT AS n_tokens, round(avg(s), 4) AS score
FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
""",
    "op4_exact_dedup": """
WITH groups AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.n::BIGINT AS group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN groups g ON coalesce(d.text, '') = g.t
""",
    "op5_decontamination": rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
hit AS (
  SELECT d.doc_id, d.i, d.size, win.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)) d
  JOIN win ON d.size = win.size AND d.gram = win.gram),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(m.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN marked m USING (doc_id) LEFT JOIN items t USING (doc_id)
""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
ranked AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS each
  FROM sources),
level AS (SELECT each FROM ranked WHERE each * weight <= cap ORDER BY cap / weight, source LIMIT 1),
goal AS (SELECT r.source, r.source_size, CASE WHEN l.each IS NULL THEN r.cap ELSE least(r.cap, r.weight * l.each) END AS target FROM ranked r, level l),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, coalesce(g.target / nullif(g.source_size, 0), 0) AS rate,
         ('0x' || substr(md5('7:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
    "op12_infill": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM units),
cuts AS (
  SELECT doc_id, text, n,
         CASE WHEN n = 0 OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1 : least(k1, k2)], '') AS a, array_to_string(u[least(k1, k2) + 1 : greatest(k1, k2)], '') AS b,
         array_to_string(u[greatest(k1, k2) + 1 : n], '') AS c FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cuts
""",
}
