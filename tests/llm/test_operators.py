"""Each operator against a brute-force version, on the awkward cases its docstring defines."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, exact, lm, mixing, pii, quality, secret, sharding, simhash
from sparkloom.llm.components import components
from sparkloom.llm.lines import CuckooFilter, LineIndex, digests

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, row string, h string, copies int"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 3}", 0, 5, "x", None, "h", 9) for i, t in zip(ids, texts, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = [None, "", " \n\t", "One two\nthree", "one TWO\nthree", LONG, LONG, "Ünï çödé\nOne two", "\n\n", "a" * 50_000, "x@" * 5_000, "1" * 30_000, "-" * 1000]
    rows = rows_of(texts)
    return frame(spark, [*rows, *rows[3:7], *rows_of([None, "One two\nthree"], [None, None])])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return (t or "").encode().lower().split()


# 1 -------------------------------------------------------------------------------------------------


def lines_brute(rows, least, chars=1):
    strip = " \t\n\x0b\x0c\r"
    low = lambda x: x.encode().lower().decode()
    held = Counter(k for t in rows for k in {low(x.strip(strip)) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := low(x.strip(strip))) >= chars and held[k] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [2, 3])
def test_lines(odd, least):
    texts = [r["text"] for r in odd.collect()]
    index = LineIndex(odd.sparkSession, min_docs=least).insert(odd)
    got = Counter((r["text"], r["n_lines"], r["n_dropped"]) for r in index.drop_frequent(odd).collect())
    assert got == lines_brute(texts, least)


def test_lines_blocks_and_reversal(spark, docs):
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = LineIndex(spark, min_docs=3, broadcast_bytes=2000).insert(a)
    first = sorted(map(tuple, index.drop_frequent(a).collect()))
    index.insert(b)
    assert len(index._blocks()) > 1
    got = Counter((r["text"], r["n_lines"], r["n_dropped"]) for r in index.drop_frequent(docs).collect())
    assert got == lines_brute([r["text"] for r in docs.collect()], 3)
    index.delete(b)
    assert sorted(map(tuple, index.drop_frequent(a).collect())) == first
    index.delete(a)
    assert index.refs.count() == 0
    assert all(not any(bytes(r["slots"])) for r in index.filters.collect())


def test_cuckoo_filter():
    h = digests([str(i).encode() for i in range(20_000)])
    held = CuckooFilter.holding(20_000)
    assert held.insert(h[:, 0], h[:, 1]) and held.contains(h[:, 0], h[:, 1]).all()
    held.delete(h[:10_000, 0], h[:10_000, 1])
    assert held.contains(h[10_000:, 0], h[10_000:, 1]).all()
    assert held.contains(h[:10_000, 0], h[:10_000, 1]).mean() < 0.01
    assert not CuckooFilter(np.zeros((4, 4), dtype=np.uint16)).insert(h[:, 0], h[:, 1])


# 2 -------------------------------------------------------------------------------------------------


def lm_brute(rows, corpus):
    """Sums of log S by document, counts from corpus."""
    c1, c2 = Counter(), Counter()
    for _, t in corpus:
        w = words(t)
        c1.update(w)
        c2.update(zip(w, w[1:], strict=False))
    total, out = sum(c1.values()), {}
    for doc, t in rows:
        w = words(t)
        value = 0.0
        for i, x in enumerate(w):
            if i and c2[w[i - 1], x] >= 2:
                value += np.log(c2[w[i - 1], x] / c1[w[i - 1]])
            else:
                value += np.log((0.4 if i else 1.0) * max(1, c1[x]) / total)
        n, before = out.get(doc, (0, 0.0))
        out[doc] = (n + len(w), before + value)
    return out


def lm_same(got, want):
    got = {r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in got.collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(got[k][1] == pytest.approx(v, rel=1e-9, abs=1e-6) for k, (_, v) in want.items())


@pytest.mark.parametrize("size,hot,slice_words", [(lm.SIZE, 1024, 500_000), (60, 8, 40), (0, 0, 1000)])
def test_lm(odd, docs, size, hot, slice_words):
    """The lists of frequent words and hot bigrams, and the slices, change no score."""
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        lm_same(lm.score(df, lm.Counts(df, size, hot, slice_words)), lm_brute(rows, rows))


def test_lm_of_other_documents(spark, docs):
    corpus = docs.where("doc_id % 3 <> 0")
    texts = ["words that nobody wrote", None, "the the the of", "in the"]
    others = docs.where("doc_id % 3 = 0").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    of = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for counts in (lm.Counts(corpus), lm.Counts(corpus, 200, 16)):
        lm_same(lm.score(others, counts), lm_brute(of(others), of(corpus)))


def test_lm_slices(odd):
    assert len(lm.frequent_words(lm.unigram_counts(odd), 50).keys) <= 50
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3, 4, 5], "ids": [[7, 8], [], [], [9] * 50, [7]]})
    got = [(a.tolist(), len(b), c.tolist()) for a, b, c in lm.slices(iter([batch, batch.slice(3)]), 40)]
    assert got == [([1, 2, 3, 4], 52, [2, 0, 0, 50]), ([5], 1, [1]), ([4], 50, [50]), ([5], 1, [1])]


def test_lm_packing():
    keys, of = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 5000)), np.arange(5000) % 977
    ids = np.array([7, -3, 1 << 62, lm.NO_ID, 0, 5], dtype=np.int64)
    assert lm.unpack_ids(lm.pack_ids(ids)).tolist() == ids.tolist() and len(lm.unpack_ids(lm.pack_ids(ids[:0]))) == 0
    a, b = lm.unpack(*lm.pack(keys, of))
    assert (a == keys).all() and (b == of).all()


# 3 -------------------------------------------------------------------------------------------------


def fp_brute(t):
    w = words(t)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps, ids, bits):
    left, out = set(fps), {}
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            x = queue.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= bits}
            left -= near
            group |= near
            queue += near
        least = min((i for f, i in zip(fps, ids, strict=True) if f in group and i is not None), default=None)
        out |= dict.fromkeys(group, least)
    return out


def test_simhash(odd, docs):
    for df in (odd.where("length(text) < 1000 or text is null"), docs):
        rows = df.select("doc_id", "text").collect()
        fps = [fp_brute(r["text"]) for r in rows]
        want = components_brute(fps, [r["doc_id"] for r in rows], 3)
        got = Counter(tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fp0", "component_id").collect())
        assert got == Counter((r["doc_id"], f - (1 << 64) if f >> 63 else f, want[f]) for r, f in zip(rows, fps, strict=True))


@pytest.mark.parametrize("wide", [0, 1 << 40])
def test_simhash_links_in_blocks(spark, wide):
    """Random fingerprints around a few centres: every component is found, in small blocks and by either key width."""
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp0 long")
    found = simhash.links(nodes, 1, 3, 5, block=16, wide_from=wide)
    of = {r["node"]: r["component"] for r in components(found).collect()}
    plain = [f % (1 << 64) for f in fps]
    want = components_brute(plain, list(range(len(fps))), 3)
    assert {i: of.get(i, i) for i in range(len(fps))} == {i: want[f] for i, f in enumerate(plain)}


def test_key_families():
    from itertools import combinations

    for shared, width in ((5, 3), (5, 4), (3, 3)):
        family = simhash.key_family(shared, width)
        assert all(any(set(k) <= set(x) for k in family) for x in combinations(range(8), shared))


def test_near_copies_go(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(20)]
    texts = list(base)
    for t in base:
        w = t.split()
        w[100] = "changed"
        texts.append(" ".join(w))
    kept = simhash.drop_near_duplicates(frame(spark, rows_of(texts)))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_near_copies_match_brute_force(spark):
    """Pairs of about 0.8, and families of three where only two are near enough: no link is lost."""
    rng = np.random.default_rng(3)
    texts = []

    def changed(w, at):
        return [f"x{rng.integers(0, 1 << 40)}" if i in at else x for i, x in enumerate(w)]

    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        texts += [base, changed(base, {20, 60, 100, 140})]  # 180 shingles of 220
        first = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        second = changed(first, {10, 40, 70, 100, 130, 160})
        texts += [first, second, changed(second, {20, 55, 85, 115})]
    for text in texts[:10]:
        texts.append(changed(text, {5, 25, 45, 65, 85, 105}))  # below 0.8
    texts = [" ".join(w) for w in texts]
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = [low if x == high else x for x in top]
    kept = simhash.drop_near_duplicates(frame(spark, rows_of(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(top))


# 4 -------------------------------------------------------------------------------------------------


def test_equal_texts(odd):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["text"] or ""].append(r["doc_id"])
    got = [tuple(r) for r in exact.equal_texts(odd).select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
    want = []
    for t, ids in texts.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(got) == Counter(want)
    kept = exact.equal_texts(odd).where("kept").collect()
    assert len(kept) == len(texts) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_golomb(n):
    for top in (1 << 40, 1 << 63):
        x = np.unique(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
        k, blob = exact.golomb_encode(x)
        assert (exact.golomb_decode(k, len(x), blob) == x).all()
        assert n < 1000 or len(blob) * 8 / n < np.log2(top / n) + 3


# 5 -------------------------------------------------------------------------------------------------


def hits_brute(text, items, n):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    w, mark, found = low(text), set(), set()
    for item, t in items:
        v = low(t)
        for i in range(max(1, len(v) - n + 1) if v else 0):
            g = v[i : i + n]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    mark |= set(range(at, at + len(g)))
                    found.add(item)
    return len(w), sorted(mark), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("bound", [1 << 20, 400])
def test_decontamination(spark, bound):
    items = [(1, "One two three four"), (2, "zwei, drei"), (3, ""), (None, "alpha beta gamma delta"), (10, "one TWO three four five"), (4, None), (5, "one two three four")]
    texts = ["so ONE two-three four. Five! six", None, "", "zwei drei vier", "alpha beta gamma delta one two", "nothing here", LONG + " zwei; drei", "two three four five six"]
    items = [(f"item-{i}" if i else None, t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["hit_words"], r["items"]) for r in decontaminate.find_hits(frame(spark, rows_of(texts)), bench, n=3, bound=bound).collect()}
    assert got == {i: hits_brute(t, items, 3) for i, t in enumerate(texts)}
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(frame(spark, rows_of(texts)), bench, n=3, most=0.9, bound=bound).collect()}
    assert left[0] == "so ! six".replace("!", "! ").replace("!  ", "! ") or left[0] == "so ! six"
    assert 5 in left and left[1] is None and "zwei" not in left[6]
    gone = decontaminate.decontaminate(frame(spark, rows_of(texts)), bench, n=3, remove="documents", bound=bound)
    assert sorted(r["doc_id"] for r in gone.collect()) == [1, 2, 5]


@pytest.mark.parametrize("bound", [1 << 20, 400])
def test_decontamination_by_the_whole_benchmark(spark, bound):
    """Blocks change nothing: the share is that of all items, spans of different items may overlap, and a cut makes no new hits."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(4))) for k in range(8)] + [(8, "i0w2 i0w3 tail more"), (9, "left right top end")]
    whole = [t for _, t in items[:8]]
    texts = ["clean " * 10 + " ".join(whole), "a b c d e f g h " + whole[0] + " tail more z", "start left right " + whole[3] + " top end stop " + "word " * 9, "dup " + whole[1] + " one two three four five", None]
    docs = frame(spark, rows_of(texts, [0, 1, 2, 3, 4]) + rows_of(["dup x y z " + whole[2] + " six seven"], [3]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, bench, n=4, bound=bound).collect())
    want = ["a b c d e f g h  z", "start left right  top end stop " + "word " * 9, "dup  one two three four five", "dup x y z  six seven"]
    assert got == Counter([(1, want[0]), (2, want[1]), (3, want[2]), (3, want[3]), (4, None)])
    found = Counter((r["doc_id"], r["n_words"], tuple(r["hit_words"]), tuple(r["items"])) for r in decontaminate.find_hits(docs, bench, n=4, bound=bound).collect())
    assert found == Counter((r["doc_id"], *(x if isinstance(x, int) else tuple(x) for x in hits_brute(r["text"], items, 4))) for r in docs.collect())


# 6 -------------------------------------------------------------------------------------------------

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def pii_brute(text):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, odd, docs):
    extra = ["mail a.b@c-d.e.f_x@y.zz, @q.r, a@b, x@y.1", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (234) 555-1234. +12 +123456789012345678 ++4 5678 901", "é 10.0.0.1 ü a@b.c"]
    plain = odd.where("length(text) < 10000 or text is null")
    for df in (frame(spark, rows_of(extra)), plain, docs):
        got = Counter((r["doc_id"], tuple(tuple(s) for s in r["base"])) for r in pii.personal_data(df).collect())
        assert got == Counter((r["doc_id"], tuple(pii_brute(r["text"]))) for r in df.collect())


def test_personal_data_long_runs(odd):
    assert pii.personal_data(odd).count() == odd.count()


def test_personal_data_bootstrap(spark):
    texts = [f"please write to user{i}@mail.example.com today" for i in range(12)]
    texts += ["please write to user77(at)mail today", "version 2.0 of the 3rd text", None, ""]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(frame(spark, rows_of(texts)))).collect()}
    assert got[12]["n_email"] == 0 and got[12]["spans"] == "email:16:30"
    assert got[13]["spans"] == "" and got[14]["spans"] == ""
    assert got[0]["n_email"] == 1 and got[0]["spans"] == "email:16:38"


def pii_added_brute(rows, rounds=3, confident=0.8, seeds=3):
    """Added spans by document, by a plain version of the graph's rounds."""
    seen = []
    for doc, text in rows:
        text = text or ""
        base = pii_brute(text)
        for m in re.finditer(r"(?<![^ \t-\r])[^ \t-\r]*[0-9@][^ \t-\r]*", text):
            lead = re.match(r"[\"'(\[<]*", m[0]).end()
            value = re.sub(r"[\"'),.;:!?\]>]*$", "", m[0][lead:])
            if not value:
                continue
            a = m.start() + lead
            b = a + len(value)
            kind, x, y = next((s for s in base if s[1] < b and a < s[2]), (None, a, b))
            if kind and not a <= x < b:
                continue
            value = text[x:y]
            w = ["\u00b6", "\u00b6", *re.sub(r"[ \t-\r]*[\n\r][ \t-\r]*", " \u00b6 ", text[: m.start()]).lower().split()]
            seen += [(doc, a, b, value, c, kind) for c in (" ".join(w[-2:]), w[-1]) if c != "\u00b6"]
    edges, score, sure = {(c, v, k) for _, _, _, v, c, k in seen}, {}, {}
    kinds = list(PII)
    believed = {}
    for _ in range(rounds):
        sure = {}
        for c in {c for c, _, _ in edges}:
            for f in kinds:
                own = [float(k == f) if k else believed.get((v, f), 0.0) for c2, v, k in edges if c2 == c]
                if sum(x >= confident for x in own) >= seeds:
                    sure[c, f] = sum(own) / (len(own) + (0.25 if " " in c else 1.0))
        score = {}
        for c, v, k in edges:
            for f in kinds:
                if k is None and (c, f) in sure:
                    score[v, f] = score.get((v, f), 1.0) * max(1e-6, 1.0 - sure[c, f])
        believed = {x: 1.0 - p for x, p in score.items()}
    out = defaultdict(set)
    for doc, a, b, v, c, k in seen:
        fits = [(believed.get((v, f), 0.0), f) for f in kinds if sure.get((c, f), 0.0) >= confident and believed.get((v, f), 0.0) >= confident]
        if k is None and fits:
            out[doc].add((max(fits)[1], a, b))
    return out


def test_personal_data_added_spans(spark):
    """Planted identifiers after one word, at a line's start, after a break or another identifier, and support by discovery."""
    texts = [f"Phone: +1 555 000 {1000 + i}, thanks" for i in range(14)]
    texts += ["Phone: 555-1234 or later", "ring\nPhone: 555-9876", "Phone:\n555-4321 x"]
    texts += [f"card no {4111111111111111 if i % 2 else 5500005555555559} user{i}@a.example.org end" for i in range(8)] + ["card no X-77-Y user9(at)b end", "the 3 of 4 words", "version 2.0", None, ""]
    texts += [f"write to me{i}@x.example.net ok" for i in range(12)] + ["write to me(at)x9 ok", "write to me(at)x9 and mailbox me(at)x9", *[f"mailbox q{i}(at)x{i}" for i in range(3)]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: {tuple(s) for s in r["added"]} for r in pii.personal_data(frame(spark, rows_of(texts))).collect()}
    want = pii_added_brute(rows)
    assert {k: s for k, s in got.items() if s} == dict(want)
    assert len([k for k, s in want.items() if s]) >= 4 and {("phone", 7, 15)} == want[14]


# 7 -------------------------------------------------------------------------------------------------


def targets_brute(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        each = (budget - sum(full.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * each > most * sizes[s]]
        if not over:
            return full | {s: w[s] * each for s in free}
        full |= {s: most * sizes[s] for s in over}


def test_mixing(odd, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "source", "text").collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(words(r["text"]))
        want = targets_brute(dict(sizes))
        got = mixing.copies(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["copies"] <= 2
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.copies(df).collect()))
        assert mixing.mix(df).count() == sum(r["copies"] for r in got)
        assert mixing.mix(df).columns == df.columns


def test_mixing_meets_targets(docs):
    got = mixing.copies(docs.select("doc_id", "text", F.concat(F.lit("s"), F.col("doc_id") % 2).alias("source"))).collect()
    for s in ("s0", "s1"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.2)


# 8 -------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
    none = quality.classify(odd, labels.where("false"))
    assert none.where("score <> 0.5").count() == 0


def test_clashing_names(odd):
    """Columns called like the operators' own stay as they are."""
    labels = odd.sparkSession.createDataFrame([(3, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    df = odd.where("length(text) < 1000 or text is null").select("*", *[F.lit("mine").alias(c) for c in ("__rate", "__source", "__copy", "__gone", "__quality", "__row", "__n", "__mark")])
    bench = odd.sparkSession.createDataFrame([(1, "one two three four")], "item_id long, text string")
    for out in (mixing.mix(df), simhash.drop_near_duplicates(df), quality.keep_good(df, labels), decontaminate.decontaminate(df, bench, n=3), decontaminate.decontaminate(df, bench, n=3, bound=100)):
        assert out.columns == df.columns and out.where("__rate <> 'mine' or __row <> 'mine' or __gone <> 'mine'").count() == 0


def test_training_sample_is_whole_documents(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, starts, y: seen.append((len(x), len(y))))
    quality.fit(docs, labels)
    quality.fit(docs, labels, max_passages=500)
    quality.fit(docs, labels, max_documents=50)
    known = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    lines = [(r["text"] or "").count("\n") + 1 for r in docs.collect() if r["doc_id"] in known]
    assert seen[0] == (sum(lines), len(lines)) and seen[1][0] <= 500 and 0 < seen[1][1] < len(lines) and seen[2][1] == 50


def test_attention_gradient_learns():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(rng.integers(1, 9), 4)) for _ in range(300)]
    y = np.array([float((b[:, 0] > 1.2).any()) for b in bags])
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    got = quality.train(np.concatenate(bags), starts, y).score(np.concatenate(bags), starts)
    assert ((got > 0.5) == y).mean() > 0.9


# 9 -------------------------------------------------------------------------------------------------


def secrets_brute(text):
    text, out = text or "", []
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, odd, docs):
    extra = ["é PassWord = 'abcdefgh1' token:short api_key=\"x/y+z==12345\" secret  =  token=abcdefghij", "AKIAABCDEFGHIJKL AKIA12 ü" + "0123456789abcdef" * 3, "apiKey: 0123456789abcdef0123456789abcdef"]
    for df in (frame(spark, rows_of(extra)), odd, docs):
        got = Counter((r["doc_id"], r["base_sha256"]) for r in secret.digest(secret.secrets(df)).collect())
        assert got == Counter((r["doc_id"], hashlib.sha256(secrets_brute(r["text"]).encode()).hexdigest()) for r in df.collect())


def test_secret_novelty(spark):
    code = "const client = connect(server, user);\nauthorization bearer {}\nreturn client.open(server, user)\n"
    texts = [code.format("Zk3vQ9xT7pLm2RwY8sDf4GhJ6nBc"), code.format("server1server1server1server1"), None]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret.secrets(frame(spark, rows_of(texts))).collect()}
    assert got == {0: ["novel"], 1: [], 2: []}


def test_secrets_on_neighbouring_lines(spark):
    """Key blocks, values on the line after their name, and keys of letters alone are reported."""
    rng = np.random.default_rng(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    drawn = lambda n, of: "".join(of[i] for i in rng.integers(0, len(of), n))
    body = [drawn(64, letters + "0123456789+/") for _ in range(12)]
    value, alone, far = drawn(40, letters + "0123456789"), drawn(40, letters), drawn(40, letters + "0123456789")
    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(body) + "\n-----END RSA PRIVATE KEY-----\n" + "plain words here\n" * 30 + far,
        f"client_secret:\n  {value}\n",
        f"use the credential {alone} here",
        "the secretary wrote the words of the report and the words of the report",
        None,
    ]
    got = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in secret.secrets(frame(spark, rows_of(texts))).collect()}
    assert got == {0: body, 1: [value], 2: [alone], 3: [], 4: []}


# 10 ------------------------------------------------------------------------------------------------


def test_sharding(odd, docs):
    for df, even in ((odd, False), (docs, True)):
        got = sharding.packed(df, shards=8).collect()
        assert len(got) == df.count() and all(0 <= r["shard"] < 8 for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        assert Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
        where = defaultdict(set)
        loads = Counter()
        for r in got:
            where[r["size"], r["text_crc32"]].add(r["shard"])
            loads[r["shard"]] += r["size"]
        assert all(len(s) == 1 for s in where.values())
        if even:
            assert max(loads.values()) < 1.02 * sum(loads.values()) / 8 and len(loads) == 8


def bfd_brute(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[b] -= s
        out.append(b)
    return out


def test_best_fit_decreasing():
    """Classes of equal sizes are packed as their items would be one by one."""
    rng = np.random.default_rng(4)
    for top in (6, 60, 60, 60):
        sizes = sorted(rng.integers(1, top, 400).tolist(), reverse=True)
        classes = sorted(Counter(sizes).items(), reverse=True)
        got = [b for _, n, b in sharding.best_fit_decreasing(classes, 100) for _ in range(n)]
        assert got == bfd_brute(sizes, 100)
        runs = sharding.pack(classes, 7)
        loads = Counter()
        for at, n, b in runs:
            loads[b] += n * classes[at][0]
        assert len(loads) <= 7 and max(loads.values()) <= sum(sizes) / 7 + top


def test_sharding_packs_every_group(spark, monkeypatch):
    """Many small groups, some of several rows, get the bins of best-fit decreasing; large classes are ranked in buckets."""
    monkeypatch.setattr(sharding, "PER_BUCKET", 40)
    rng = np.random.default_rng(8)
    texts = [f"{i}-".ljust(int(k), "x") for i, k in enumerate(rng.integers(8, 40, 3000))]
    texts += texts[:300]
    got = sharding.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=None, capacity=5000).collect()
    sizes = Counter()
    for t in texts:
        sizes[t] += len(t) + 1
    want = bfd_brute(sorted(sizes.values(), reverse=True), 5000)
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    of = Counter()
    for size, b in zip(sorted(sizes.values(), reverse=True), want, strict=True):
        of[b] += size
    assert loads == of and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fixed_capacity(docs):
    got = sharding.packed(docs, shards=None, capacity=120_000).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 120_000 and len(loads) <= 1.1 * sum(loads.values()) / 120_000 + 1


# empty tables ---------------------------------------------------------------------------------------


def test_empty_tables(spark, odd):
    none = odd.where("doc_id < -5")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    index = LineIndex(spark).insert(none)
    frames = [
        index.drop_frequent(none), lm.score(none), simhash.near_duplicates(none), simhash.drop_near_duplicates(none), exact.equal_texts(none),
        decontaminate.find_hits(none, bench), decontaminate.decontaminate(none, bench), pii.digest(pii.personal_data(none)), mixing.copies(none), mixing.mix(none),
        quality.classify(none, labels), secret.digest(secret.secrets(none)), sharding.packed(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert decontaminate.find_hits(odd, bench).where("size(hit_words) > 0").count() == 0
    assert index.drop_frequent(odd).count() == odd.count()
