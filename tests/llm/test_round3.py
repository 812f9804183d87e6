"""Packing, infilling and whitening, against plain versions and by their invariants."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import infill, packing, quality, queries, simhash, whitening

SMALL = "/root/testdata/sf0.001"


def texts_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as ids", "1 as length", "2 as row", "'y' as draws", "3 as at") if extra else df


# packing -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_fill_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        capacity = rng.randint(0, 60)
        best = max(s for take in itertools.product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * m for k, m in zip(counts, take, strict=True))) <= capacity)
        used = packing.fill(counts, capacity)
        assert sum(k * m for k, m in used.items()) == best
        assert all(m <= counts[k] for k, m in used.items())


def test_choices_take_every_piece_once():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 257), 120)}
    for slack in (0, 5):
        found, rest = packing.choices(counts, 256, slack)
        assert all(256 - slack <= sum(k * m for k, m in taken.items()) <= 256 for _, taken in found)
        total = dict.fromkeys(counts, 0)
        for times, taken in found:
            for k, m in taken.items():
                total[k] += times * m
        assert {k: total[k] + rest.get(k, 0) for k in counts} == counts


def check_packing(rows, docs, tokenizer, window):
    """Every id in one piece, every sequence gapless, no padding but at the powers of two."""
    expected = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            ids = expected[d][at : at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(expected[d])
            assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
            at += r["length"]
        assert at == len(expected[d])
    short = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
        short += at < window
    assert short <= 11 and sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_of_the_table(spark, tokenizer, window):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(5)
    rows = packing.packed(docs, window=window).collect()
    check_packing(rows, [tuple(r) for r in docs.collect()], tokenizer, window)


def test_packing_of_odd_texts(spark, tokenizer):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(0, 30)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "<|endoftext|> x"), (103, "né  漢字\n\n\t" * 500), (104, "a" * 5000), (105, "one two. " * 40000), (106, "one two. " * 40000)]
    rows = packing.packed(texts_of(spark, docs, extra=True).repartition(4), window=128).collect()
    check_packing(rows, docs, tokenizer, 128)


def test_packing_of_equal_lengths_none_of_which_fit_together(spark, tokenizer):
    docs = [(i, "word " * 70) for i in range(40)]
    rows = packing.packed(texts_of(spark, docs), window=128).collect()
    check_packing(rows, docs, tokenizer, 128)


def test_packing_keeps_whole_what_fits(spark):
    docs = [(i, " word" * (39 if i % 2 else 87)) for i in range(40)]  # 39 and 87 words with their ends fill 128
    one = packing.packed(texts_of(spark, docs), window=128)
    lengths = {r["length"] for r in one.collect()}
    assert len(lengths) == 2 and one.count() == 40


def test_packing_with_repeated_ids_and_none(spark):
    assert packing.packed(texts_of(spark, [])).count() == 0
    rows = packing.packed(texts_of(spark, [(1, "same"), (1, "same"), (None, "same")])).collect()
    assert sum(r["length"] for r in rows) == 6
    made = packing.sequences(packing.packed(texts_of(spark, [(1, "same"), (2, "other words")]), window=16)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in made)


def test_segments_make_the_same_ids(tokenizer):
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    text = "It's one, two;  three\n four (five) été 12 345 \n\n six don't I'LL end.\nNext one" * 7
    whole = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for size in (1, 5, 50, 10**6):
        parts = list(packing.segments(text, size))
        assert "".join(parts) == text and b"".join(map(encoder._segment, parts)) == whole


def test_op11_query(spark):
    rows = queries.op11_packing(spark, SMALL).collect()
    ids = {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in packing.packed(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows} == ids


# infilling -----------------------------------------------------------------------------------------


def plain_infill(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    i, j = sorted(x % (n + 1) for x in h[:2])
    a, b, c = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def odd_texts(rng):
    alphabet = ["a", "bc", "PS", "M", "<", ">", "<P", "P>", "<S>", "é", "漢", "𝄞", " ", "\n", "\0", "7"]
    docs = [(i, "".join(rng.choices(alphabet, [5, 5, 2, 2, 2, 2, 0.2, 0.2, 0.03, 2, 2, 2, 3, 1, 1, 1], k=rng.randint(0, 80)))) for i in range(300)]
    return docs + [(500, None), (501, ""), (None, "no id <"), (7, "seven again"), (7, "seven again"), (502, "<" * 40 + "P" + ">" * 3), (503, "x" * 100), (504, "<P>")]


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_infill_in_pieces_of_any_size(spark, piece):
    docs = odd_texts(random.Random(4))
    made = infill.fill_in_middle(texts_of(spark, docs, extra=True).repartition(3), piece=piece)
    rows = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("restored")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:1] + tuple(r)[1:6] for r in rows), key=key) == sorted((plain_infill(*d) for d in docs), key=key)
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t in docs)


def test_functions_of_pieces_compose():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["a", "P", "<", ">", "é", " "], k=rng.randint(0, 12))).encode()
        i, j = sorted(rng.randint(0, len(text)) for _ in range(2))
        a, b, c = map(infill.summed, (text[:i], text[i:j], text[j:]))
        assert a.then(b).then(c) == a.then(b.then(c)) == infill.summed(text)


def test_giant_text(spark):
    docs = [(i, ("word <é> " * 300000)[: 2_000_000 + i]) for i in range(3)] + [(9, "short")]
    rows = infill.fill_in_middle(texts_of(spark, docs)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(plain_infill(*d) for d in docs)


def test_op12_query(spark):
    rows = queries.op12_infill(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        _, n, form, a, b, output = plain_infill(r["doc_id"], docs[r["doc_id"]])
        digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], n, form, a, b, digest(output), digest(docs[r["doc_id"]]))
    assert infill.fill_in_middle(texts_of(spark, [])).count() == 0


# whitening -----------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    y = off / n
    covariance = y.T @ y / n
    values, directions = np.linalg.eigh(covariance)
    return (off * off).sum(axis=1), y @ directions[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / np.trace(covariance)


def test_op13_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    deviation, white, explained = plain_whitening([r["embedding"] for r in table])
    rows = queries.op13_whitening(spark, SMALL).collect()
    assert len(rows) == 8 * len(table)
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    found = np.zeros((len(table), 8))
    for r in rows:
        i, k = at[r["vec_id"]], r["component"] - 1
        found[i, k] = r["whitened"]
        assert r["deviation"] == deviation[i] and r["n"] == len(table) and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[k] - 1) < 1e-9
    signs = np.sign((found * white[:, :8]).sum(axis=0))
    assert np.allclose(found, white[:, :8] * signs, atol=1e-7)


def test_whitening_drops_and_defined_cases(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (107, [None, None, None])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as v", "3 as whitened").repartition(4)
    rows = whitening.component_rows(df).collect()
    assert len(rows) == 90 and {r["vec_id"] for r in rows} == set(range(30)) and {r["n"] for r in rows} == {30}
    deviation, _, _ = plain_whitening([v for _, v in good])
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == dict(enumerate(deviation.tolist()))
    empty = spark.createDataFrame(bad[:5], "vec_id long, embedding array<double>")
    assert whitening.component_rows(empty).count() == 0


def test_whitening_without_variance_and_beyond_a_long(spark):
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)] + [(None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = whitening.component_rows(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows) and {r["n"] for r in rows} == {5}
    assert max(r["identity_error"] for r in rows) < 1e-12
    same = whitening.component_rows(spark.createDataFrame([(1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    large = whitening.component_rows(spark.createDataFrame([(1, [1e14]), (2, [-1e14])], "vec_id long, embedding array<double>")).collect()
    assert {int(r["deviation"]) for r in large} == {(2 * 1024 * 10**14) ** 2}
    assert sorted(round(r["whitened"], 9) for r in large) == [-1.0, 1.0]


# near-dedup's second index, and the classifier's sample ----------------------------------------------


def shared_components(docs, words, similarity):
    """Smallest doc_id that links of ``similarity`` reach, by comparing all texts."""
    sets = {d: set(simhash.shingles((t or "").encode(), words)) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        both = len(x & y)
        if (not x and not y) or (x and y and both >= similarity * (len(x) + len(y) - both)):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_long_posting_lists_lose_no_link(spark, block):
    """A passage in most texts, near copies of one text, and pairs about the limit; lists longer than a block."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, base = [word() for _ in range(40)], [word() for _ in range(120)]
    docs = []
    for _ in range(25):
        docs.append([*passage, *[word() for _ in range(rng.randint(0, 14))]])
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        docs.append(copy)
    docs += [[*base[:60], *[word() for _ in range(60)]] for _ in range(5)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(90, None), (91, ""), (92, "one")]
    found = simhash.near_duplicates(texts_of(spark, docs), 5, 4, 56, 3, block=block, sure_bits=28, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == shared_components(docs, 5, 0.8)
    everything = np.zeros(simhash.COUNTERS, bool)
    everything[::2] = True  # any order of shingles gives the same links
    kept = simhash.common_shingles
    try:
        simhash.common_shingles = lambda *_: everything
        found = simhash.near_duplicates(texts_of(spark, docs), 5, 4, 56, 3, block=block, sure_bits=28, similarity=0.8)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == shared_components(docs, 5, 0.8)
    finally:
        simhash.common_shingles = kept


@pytest.mark.parametrize("where", [0, 1, 2])
def test_a_huge_labelled_text_is_passed_over(spark, where):
    """Whichever place by hash the text has that alone passes the bound, the others train."""
    docs = [(i, ("Plain sentence number %d reads well.\n" % i if i % 2 else "zz zz zz zz 11 ## zz zz zz zz zz\n") * 3) for i in range(1, 60)]
    ids = spark.createDataFrame([(i,) for i, _ in docs], "doc_id long")
    order = [r["doc_id"] for r in ids.where(quality.fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id")).collect()]
    huge = order[[0, len(order) // 2, -1][where]]
    docs = [(i, "line\n" * 400 if i == huge else t) for i, t in docs]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    network = quality.fit(texts_of(spark, docs), labels, max_passages=300)
    assert network is not None
    scores = {r["doc_id"]: r["score"] for r in quality.with_score(texts_of(spark, docs), network).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i, _ in docs if i != huge)
    assert quality.fit(texts_of(spark, docs), labels, max_passages=1) is None


def test_forward_pass_one_document_at_a_time():
    rng = np.random.default_rng(2)
    k, d = quality.HIDDEN, quality.FEATURES
    shapes = {"we": (d, k), "be": k, "wv": (k, k), "wu": (k, k), "wa": k, "wo": k, "bo": 1}
    p = {n: rng.normal(size=shape) for n, shape in shapes.items()}
    bags = [rng.normal(size=(n, d)) for n in (1, 4, 2)]
    found = quality.forward(p, np.concatenate(bags), np.array([0, 1, 5]))[0]
    for y, x in zip(found, bags, strict=True):
        h = [np.tanh(v @ p["we"] + p["be"]) for v in x]
        e = [float((np.tanh(v @ p["wv"]) / (1 + np.exp(-(v @ p["wu"])))) @ p["wa"]) for v in h]
        a = [np.exp(v) / sum(np.exp(e)) for v in e]
        z = sum(w * v for w, v in zip(a, h, strict=True))
        assert y == pytest.approx(1 / (1 + np.exp(-(z @ p["wo"] + p["bo"][0]))))


# what the queries return ---------------------------------------------------------------------------

CONTRACT = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op12_infill": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_return_what_their_contract_names(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    assert {c: kinds.get(c) for c in (p.split()[0] for p in CONTRACT[name].split(", "))} == dict(p.split() for p in CONTRACT[name].split(", "))
    rows = found.collect()
    per_document = name not in ("op11_packing", "op13_whitening")
    if per_document:
        assert sorted(r["doc_id"] for r in rows) == list(range(200))
    for column in (c for c in kinds if c.endswith("sha256")):
        assert all(re.fullmatch("[0-9a-f]{64}", r[column]) for r in rows)
    if name == "op3_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows)
    if name == "op10_sharding":
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in rows} == {"bytes"}


def test_texts_that_share_a_passage_are_not_written_as_pairs(spark, monkeypatch):
    """Long unrelated texts with one passage in common: every table on the way stays in proportion to them."""
    from sparkloom.llm import simhash

    rng, n = np.random.default_rng(5), 48
    passage = " ".join(f"common{k}" for k in range(24))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 1500)) + " " + passage for _ in range(n)]
    texts += [texts[0] + " once more", texts[1] + " once more"]  # near copies
    rows, cut = {}, simhash.cut

    def counted(df, name):
        done = cut(df, name)
        rows[name] = done.count()
        return done

    monkeypatch.setattr(simhash, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(range(n))
    assert rows["met"] >= n  # the passage is met
    assert max(rows.values()) < n * (n - 1) // 2


def test_texts_just_below_the_similarity_are_not_written_as_pairs(spark, monkeypatch):
    """Texts that share 0.798 of their shingles with each other, which bitmaps can't tell from 0.8, and a few that share more."""
    n = 48
    base = " ".join(f"shared{k}" for k in range(804))  # 800 shingles; 101 more with the words of each text
    texts = [base + " " + " ".join(f"own{i}x{k}" for k in range(101)) for i in range(n)]
    texts += [texts[i] + " " + " ".join(f"more{i}x{k}" for k in range(40)) for i in (0, 7, 31)]
    rows, cut = {}, simhash.cut

    def counted(df, name):
        done = cut(df, name)
        rows[name] = rows.get(name, 0) + done.count()
        return done

    monkeypatch.setattr(simhash, "cut", counted)
    found = simhash.near_duplicates(texts_of(spark, list(enumerate(texts))), 5, 4, 56, 3, sure_bits=28, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i for i in range(n)} | {n: 0, n + 1: 7, n + 2: 31}
    assert rows["clusters"] >= n  # they meet
    assert rows["apart"] < n * (n - 1) // 4  # 1,128 pairs


def test_verified_links_in_blocks(spark):
    """Whatever the size of blocks, links join the components that all similar pairs of a group join."""
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    for _ in range(54):
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        texts.append(copy)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame = texts_of(spark, docs)
    nodes = simhash.fingerprints(frame, 5, 4, distinct=True).groupBy("fp0", "fp1", "fp2", "fp3").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("first")).localCheckpoint()
    ids = sorted(r["node"] for r in nodes.collect())
    chain = spark.createDataFrame([(b, a) for a, b in zip(ids, ids[1:], strict=False)], "a long, b long")
    none = spark.createDataFrame([], "node long, component long")
    want = shared_components([d for d in docs if d[0] in ids], 5, 0.8)
    for block, shingles in ((2048, 1 << 19), (7, 1 << 19), (2048, 300)):
        edges = {(r["a"], r["b"]) for r in simhash.linked(chain, nodes, none, frame, 5, 4, 0.8, block, shingles).collect()}
        top = {i: i for i in ids}
        for a, b in edges:
            low, high = sorted((top[a], top[b]))
            top = {i: low if x == high else x for i, x in top.items()}
        assert top == want
