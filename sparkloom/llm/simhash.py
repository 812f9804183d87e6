"""SimHash near-dedup: byte-position inverted index with count filtering.

Fingerprints are split into bytes. If two differ in at most ``max_bits`` bits, at least
``8 - max_bits`` of the eight bytes of a lane agree in place. The inverted index posts each distinct
fingerprint under the values of small sets of byte positions, chosen so that any pair with the
guaranteed number of agreeing bytes meets under at least one of them. Within a posting list the
agreeing bytes of each pair are tallied, pairs that reach the minimum are kept and verified bit by
bit, and only the links of a spanning forest leave the task: the components are the same, and a
posting list of m fingerprints gives at most m - 1 rows.

Long posting lists are dealt out: their fingerprints fall into blocks, and each pair of blocks is a
group of its own, so a task holds a few thousand fingerprints at a time whatever the group's size.
Equal fingerprints meet once before all this, so exact copies cost nothing further.

Defined cases: a text without words (null, empty, only spaces) has fingerprint zero and is linked
like any other; rows with a null doc_id take part, but never give a component its id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each_bytes, free_name, id_and_text, small
from .components import components

#: Fingerprints of a posting list that meet in one group; longer lists are dealt out in blocks.
BLOCK = 2048
#: From so many distinct fingerprints on, keys take one more byte, so that chance meetings stay rare.
WIDE_FROM = 1 << 26
#: Counters that tell very common shingles, which come last in every text's order, and the rows they travel in. Any order
#: gives the same links.
COUNTERS = 1 << 20
COUNTER_ROWS = 64
#: 64-bit words of a shingle set's parity bitmap: of the one that goes with every posting, and of the one of candidate pairs.
PARITY, WIDE_PARITY = 8, 64
#: Shingles of one block of a group whose texts are compared in a task; a part holds two blocks.
SHINGLES = 1 << 19


def shingles(text: bytes | None, words: int) -> list[bytes]:
    w = (text or b"").lower().split()
    if not w:
        return []
    return [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]


def gram_hashes(grams: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")


def lane_hashes(h: np.ndarray, lanes: int) -> np.ndarray:
    """Independent words for each hash: itself if there is one lane, else mixes of it."""
    if lanes == 1:
        return h.reshape(-1, 1)
    x = h[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is 1 if set in over half of the shingles' hashes."""
    total = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), 20_000):  # very long texts in pieces
        raw = np.ascontiguousarray(lane_hashes(hashes[at : at + 20_000], lanes)).view(np.uint8)
        bits = np.unpackbits(raw.reshape(-1, 8 * lanes), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            total += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, distinct: bool = False, grams: bool = False) -> DataFrame:
    """doc_id and fp0 (fp1, ...) of every row; of distinct shingles if so asked, and with their hashes."""
    names = [f"fp{k}" for k in range(lanes)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, kept = [], []
            for text in each_bytes(batch.column(1)):
                found = shingles(text, words)
                h = gram_hashes(list(set(found)) if distinct else found)
                words_.append(simhash(h, lanes))
                if grams:
                    kept.append(np.unique(h).view("<i8"))
            fps = np.array(words_, dtype="<u8").reshape(-1, lanes).view("<i8")
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(lanes))]
            if grams:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "grams"][: len(columns)])

    fields = ["doc_id long", *(f"{n} long" for n in names), *["grams array<long>"] * grams]
    return id_and_text(docs).mapInArrow(of, ", ".join(fields))


def key_family(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` of 8 byte positions such that any ``shared`` positions contain one of them."""
    if width == 3 and shared >= 5:  # of five positions, three lie in the same half
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    left, out = set(combinations(range(8), shared)), []
    while left:
        best = max(combinations(range(8), width), key=lambda k: sum(set(k) <= set(x) for x in left))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


def _key(number: int, positions: tuple[int, ...]) -> Column:
    """The posting list of a lane's bytes at the positions. Hashes that meet by chance fail the tally."""
    mask = sum(255 << 8 * p for p in positions)
    return F.xxhash64(F.lit(number), F.col("lane"), F.col("bytes").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def _trees(fps: np.ndarray, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    left = np.ones(len(fps), dtype=bool)
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            at = queue.pop()
            rest = np.flatnonzero(left)
            diff = fps[rest] ^ fps[at]
            tally = (np.ascontiguousarray(diff).view(np.uint8).reshape(len(rest), -1, 8) == 0).sum(axis=2).max(axis=1)
            few = np.bitwise_count(diff).sum(axis=1) <= max_bits
            near = rest[(tally >= min_bytes) & few]
            left[near] = False
            queue += near.tolist()
            edges += [(at, x) for x in near.tolist()]
    return edges


def forest(fps: np.ndarray, max_bits: int, min_bytes: int, sure_bits: int | None = None) -> list[tuple[int, int, bool]]:
    """Spanning forest of the fingerprints (m x lanes) that agree in enough bytes and differ in few bits.

    With ``sure_bits`` edges of up to so many bits come first (and are marked True); the others only join
    what those leave apart.
    """
    sure = _trees(fps, max_bits if sure_bits is None else sure_bits, min_bytes)
    out = [(a, b, True) for a, b in sure]
    if sure_bits is None or len(sure) == len(fps) - 1:
        return out
    top = list(range(len(fps)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in sure:
        top[find(b)] = find(a)
    for a, b in _trees(fps, max_bits, min_bytes):
        if find(a) != find(b):
            top[find(b)] = find(a)
            out.append((a, b, False))
    return out


def spread(nodes: DataFrame) -> DataFrame:
    """Few rows from which many are made, dealt to as many tasks as a shuffle has."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")


def links(nodes: DataFrame, lanes: int, max_bits: int, min_bytes: int, block: int = BLOCK, wide_from: int = WIDE_FROM, sure_bits: int | None = None) -> DataFrame:
    """(a, b, sure): links between distinct fingerprints that keep every component together; all are sure
    unless ``sure_bits`` leaves those of more bits to be verified."""
    width = 3 if min_bytes <= 3 or nodes.count() < wide_from else 4
    names = [f"fp{k}" for k in range(lanes)]
    family = key_family(min_bytes, width)
    keys = [_key(i, p) for i, p in enumerate(family)]
    carried = names if lanes == 1 else ["spread"]
    nodes = nodes.withColumn("spread", F.xxhash64(*names))  # blocks follow the fingerprints, so that reruns agree
    split = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.col(n).alias("bytes")) for k, n in enumerate(names)])).alias("of")
    posted = spread(nodes).select("node", *carried, split).select("node", *carried, "of.*").select("node", *carried, F.explode(F.array(*keys)).alias("key"))
    posted = posted.repartition("key")  # one exchange for both uses
    held = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posted.join(held, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    met = met.withColumn("mine", F.pmod(F.xxhash64(*carried), F.col("blocks")))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("part", F.least("mine", "with") * F.col("blocks") + F.greatest("mine", "with"))
    met = met.select("key", "part", "node", *carried)
    if lanes > 1:  # long fingerprints travel only for those that meet
        met = met.join(nodes.select("node", *names), "node")
    dealt = met.select("key", "part", "node", *names).repartition("key", "part").sortWithinPartitions("key", "part", *names)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(whole: pd.DataFrame) -> pd.DataFrame:
            node = whole["node"].to_numpy()
            fps = np.ascontiguousarray(whole[names].to_numpy(np.int64)).view(np.uint64)
            key, part = whole["key"].to_numpy(), whole["part"].to_numpy()
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[new[1:], len(whole)]
            out: list[tuple[int, int, bool]] = []
            two = new[ends - new == 2]
            diff = fps[two] ^ fps[two + 1] if len(two) else np.zeros((0, lanes), dtype=np.uint64)
            tally = (np.ascontiguousarray(diff).view(np.uint8).reshape(len(two), lanes, 8) == 0).sum(axis=2).max(axis=1)
            bits = np.bitwise_count(diff).sum(axis=1)
            ok = (tally >= min_bytes) & (bits <= max_bits)
            pairs = np.stack([two[ok], two[ok] + 1, bits[ok] <= (max_bits if sure_bits is None else sure_bits)], axis=1)
            for a, b in zip(new.tolist(), ends.tolist(), strict=True):
                if b - a > 2:
                    out += [(a + x, a + y, s) for x, y, s in forest(fps[a:b], max_bits, min_bytes, sure_bits)]
            every = np.concatenate([pairs, np.array(out, dtype=np.int64).reshape(-1, 3)]).astype(np.int64)
            both = np.sort(node[every[:, :2]].reshape(-1, 2), axis=1)
            return pd.DataFrame({"a": both[:, 1], "b": both[:, 0], "sure": every[:, 2] > 0}).drop_duplicates()

        rest: pd.DataFrame | None = None  # the last group may go on in the next batch
        for batch in batches:
            whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if whole.empty:
                continue
            last = (whole["key"] == whole["key"].iloc[-1]) & (whole["part"] == whole["part"].iloc[-1])
            cut_at = int(np.argmax(last.to_numpy()))
            rest = whole.iloc[cut_at:].reset_index(drop=True)
            if cut_at:
                yield found(whole.iloc[:cut_at].reset_index(drop=True))
        if rest is not None and len(rest):
            yield found(rest)

    return dealt.mapInPandas(near, "a long, b long, sure boolean").distinct()


def _grams(ends: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """(node, grams): the hashes of the distinct shingles of these nodes' texts; no other texts are read."""
    names = [f"fp{k}" for k in range(lanes)]
    ends = cut(ends.join(nodes, "node").where("first IS NOT NULL").select("node", *names, "first"), "ends")
    texts = id_and_text(docs).join(small(ends.select(F.col("first").alias("doc_id")).distinct(), 16), "doc_id", "left_semi")
    grams = fingerprints(texts, words, lanes, distinct=True, grams=True).dropDuplicates(names)
    return cut(ends.join(grams, names).select("node", "grams"), "grams")


def similar(edges: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, lanes: int, similarity: float) -> DataFrame:
    """(a, b) of the edges whose texts share ``similarity`` of their distinct shingles; only such texts are read."""
    grams = _grams(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), nodes, docs, words, lanes)
    both = edges.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= similarity * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def _thinned(edges: DataFrame) -> DataFrame:
    """(a, b): of the edges, sure and other ones, each node's to its first and its last neighbour. Every posting list has
    a forest of its own, so a large group of copies has many times more edges than nodes; what this leaves
    apart the index of shingles joins."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sure"))
    ends = both.groupBy("a", "sure").agg(F.array(F.min("b"), F.max("b")).alias("ends")).select("a", F.explode("ends").alias("b"))
    return cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "thinned")


def common_shingles(docs: DataFrame, words: int, least: int = BLOCK) -> np.ndarray:
    """For each counter whether more than ``least`` texts' shingles fall on it, beyond what chance accounts for."""
    width = COUNTERS // COUNTER_ROWS

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            for text in each_bytes(batch.column(1)):
                h = np.unique(gram_hashes(shingles(text, words)))
                np.add.at(n, (h % np.uint64(COUNTERS)).astype(np.int64), 1)
        if n.any():
            rows = np.minimum(n, 65535).astype("<u2").reshape(COUNTER_ROWS, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_ROWS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(n, dtype="<u2").astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["at", "n"])

    out = np.zeros((COUNTER_ROWS, width), dtype=np.uint32)
    for r in id_and_text(docs).mapInArrow(of, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").collect():
        out[r["at"]] = np.frombuffer(r["n"], dtype="<u4")
    return out.ravel() > least + 4 * out.mean()


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """A bit for each of 64 * words classes of hashes: whether an odd number of them falls there."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def prefixes(docs: DataFrame, common: np.ndarray, words: int, lanes: int, similarity: float) -> DataFrame:
    """doc_id, fp0 (fp1, ...), size, p0 ... and wide (parity of the shingles in each bit) and prefix of every row with words.

    prefix holds the first shingles in one order of all: by hash, the very common ones last; so many that two sets
    sharing ``similarity`` have one in common.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)
    names = [*(f"fp{k}" for k in range(lanes)), "size", *(f"p{k}" for k in range(PARITY))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for batch in batches:
            rows, ids, kept, wide = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), each_bytes(batch.column(1)), strict=True):
                h = np.unique(gram_hashes(list(set(shingles(text, words)))))
                if not len(h):
                    continue
                order = np.argsort(last[(h % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")  # h is sorted
                rows.append(np.r_[simhash(h, lanes), np.uint64(len(h)), parities(h, PARITY)])
                wide.append(parities(h, WIDE_PARITY).view("<i8"))
                ids.append(i)
                kept.append(h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]].view("<i8"))
            whole = np.array(rows, dtype="<u8").reshape(-1, len(names)).view("<i8")
            columns = [pa.array(np.ascontiguousarray(whole[:, k])) for k in range(len(names))]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (wide, kept)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, *lists], ["doc_id", *names, "wide", "prefix"])

    return id_and_text(docs).mapInArrow(of, ", ".join(["doc_id long", *(f"{x} long" for x in names), "wide array<long>", "prefix array<long>"]))


def _across(group: np.ndarray, component: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of different components whose sizes and parities allow the similarity, by first members; none that has it is left out."""
    for k, a in enumerate(group[:-1].tolist()):
        b = group[k + 1 :]
        b = b[component[b] != component[a]]
        b = b[np.minimum(size[b], size[a]) >= similarity * np.maximum(size[b], size[a]) - 1e-6]
        both = size[b] + size[a]
        differ = np.bitwise_count(parity[b] ^ parity[a]).sum(axis=1)  # no more than shingles in one set only
        b = b[differ <= (1 - similarity) / (1 + similarity) * both + 1e-6]
        if len(b):
            yield a, b


def _clusters(group: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """The members of a group that some pair holds, those that pairs connect together."""
    first = group[0]
    label = np.arange(len(group))
    for a, b in pairs:
        ends = np.r_[a, b] - first
        old = np.unique(label[ends])
        label[np.isin(label, old[1:])] = old[0]
    order = np.argsort(label, kind="stable")
    parts = np.split(group[order], np.flatnonzero(np.diff(label[order])) + 1)
    return [p for p in parts if len(p) > 1]


def _joining(group: np.ndarray, label: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Of the pairs as few as connect all that the pairs and equal labels connect; the group's labels are made equal on the way."""
    for a, b in pairs:
        own, at = np.unique(label[b], return_index=True)
        new = own != label[a]
        yield from ((a, x) for x in b[at[new]].tolist())
        label[group[np.isin(label[group], own[new])]] = label[a]


def _ends(node: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.sort(node[np.array(edges, dtype=np.int64).reshape(-1, 2)], axis=1)
    return pd.DataFrame({"a": both[:, 1], "b": both[:, 0]}).drop_duplicates()


def _groups(whole: pd.DataFrame, by: list[str]) -> list[np.ndarray]:
    new = np.zeros(max(0, len(whole) - 1), dtype=bool)
    for c in by:
        x = whole[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.split(np.arange(len(whole)), np.flatnonzero(new) + 1)


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str], found: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is found in sorted rows and the groups of equal ``by`` in them, which are whole."""
    rest: pd.DataFrame | None = None  # the last group may go on in the next batch
    for batch in batches:
        whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if whole.empty:
            continue
        *full, last = _groups(whole, by)
        rest = whole.iloc[last[0] :].reset_index(drop=True)
        if full:
            yield found(whole.iloc[: last[0]].reset_index(drop=True), full)
    if rest is not None and len(rest):
        yield found(rest, _groups(rest, by))


def _dealt_long(met: DataFrame, block: int) -> DataFrame:
    """(key, part, node) of long posting lists, so that any two nodes of different components meet in some part.

    Most lists are long because of one component, whose nodes need not meet each other: they are dealt to blocks, and
    the others, while they fit a block, go to each of these. Else every pair of blocks is a part.
    """
    sizes = met.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.max("own").alias("held"))
    rows = met.join(main, "key")
    few = F.col("n") - F.col("held") <= block
    blocks = F.ceil(F.when(few, F.col("held")).otherwise(F.col("n")) / block).cast("long")
    mine = F.pmod(F.xxhash64("node"), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    pairs = F.transform(every, lambda other: F.least(mine, other) * blocks + F.greatest(mine, other))
    parts = F.when(few & (F.col("component") == F.col("main")), F.array(mine)).when(few, every).otherwise(pairs)
    return rows.select("key", F.explode(parts).alias("part"), "node")


def apart(nodes: DataFrame, parts: DataFrame, docs: DataFrame, words: int, lanes: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect every two nodes of different components (parts) that may share ``similarity`` of their
    shingles, directly or over others; of a group of such nodes no more than a forest for each posting list.

    Nodes meet under each shingle of their prefixes, so no such pair is left out. Nodes without doc_id have no text.
    """
    names = [f"fp{k}" for k in range(lanes)]
    carried = ["size", *(f"p{k}" for k in range(PARITY)), "component"]
    owned = nodes.where("first IS NOT NULL").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = prefixes(docs, common_shingles(docs, words, block), words, lanes, similarity).withColumnRenamed("doc_id", "first")
    of = cut(of.join(owned, [*names, "first"]).select("node", *carried, "wide", "prefix").dropDuplicates(["node"]), "prefixes")
    posted = spread(of.select("node", "component", "prefix")).select("node", "component", F.explode("prefix").alias("key")).repartition("key")  # one exchange for both uses
    held = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "n")
    met = cut(posted.join(held, "key"), "met")
    short = met.where(F.col("n") <= block).select("key", F.lit(0).cast("long").alias("part"), "node")
    met = short.unionByName(_dealt_long(met.where(F.col("n") > block), block))
    dealt = met.join(of.select("node", *carried), "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def partnered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(whole: pd.DataFrame, groups: list[np.ndarray]) -> pd.DataFrame:
            node, component, size = (whole[c].to_numpy() for c in ("node", "component", "size"))
            parity = np.ascontiguousarray(whole[carried[1:-1]].to_numpy(np.int64)).view(np.uint64)
            members: dict[int, np.ndarray] = {}
            for group in groups:
                for held in _clusters(group, _across(group, component, size, parity, similarity)):
                    own = node[held]  # sorted
                    members[xxhash.xxh64_intdigest(own.tobytes(), 42)] = own
            keys = np.repeat(np.array(list(members), dtype="<u8").view("<i8"), np.array([len(x) for x in members.values()], dtype=np.int64))
            return pd.DataFrame({"cluster": keys, "node": np.concatenate([np.zeros(0, dtype=np.int64), *members.values()])})

        return _whole_groups(batches, ["key", "part"], found)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(whole: pd.DataFrame, groups: list[np.ndarray]) -> pd.DataFrame:
            node, component, size = (whole[c].to_numpy() for c in ("node", "component", "size"))
            parity = np.stack(whole["wide"].to_list()).view(np.uint64)
            label = np.arange(len(whole))  # components have to be told apart as they are, whatever edges connect
            edges = [e for group in groups for e in _joining(group, label, _across(group, component, size, parity, similarity))]
            return _ends(node, edges)

        return _whole_groups(batches, ["cluster"], found)

    # Wide bitmaps travel with the members of clusters, which grow with the input, and not with pairs of them. Texts that
    # share much meet under many shingles: equal clusters go on once.
    held = cut(dealt.mapInPandas(partnered, "cluster long, node long").distinct(), "clusters")
    again = held.join(of.select("node", "component", "size", "wide"), "node").repartition("cluster").sortWithinPartitions("cluster", "node")
    return again.mapInPandas(near, "a long, b long").distinct()


def linked(edges: DataFrame, nodes: DataFrame, parts: DataFrame, docs: DataFrame, words: int, lanes: int, similarity: float, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """(a, b): links between texts that share ``similarity`` of their distinct shingles, as few as join all components (parts)
    that such links between connected nodes of the edges join.

    Texts of a group that edges connect are compared in the task that holds their shingles, so no pair leaves it that
    joins nothing. Large groups are dealt out in blocks, each pair of which is a part.
    """
    of = cut(components(edges).withColumnRenamed("component", "group"), "groups")
    of = of.join(_grams(of.select("node"), nodes, docs, words, lanes), "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = cut(of, "grouped")
    held = of.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("grams")).alias("grams"))
    blocks = held.where("n > 1").select("group", F.ceil(F.greatest(F.col("n") / block, F.col("grams") / shingles)).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), "blocks")
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
    dealt = of.join(blocks, "group").select("group", F.explode(each).alias("part"), "node", "component", "grams")
    dealt = dealt.repartition("group", "part").sortWithinPartitions("group", "part", "node")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(whole: pd.DataFrame, groups: list[np.ndarray]) -> pd.DataFrame:
            node, label = whole["node"].to_numpy(), whole["component"].to_numpy().copy()
            grams = [x.view(np.uint64) for x in whole["grams"]]
            size = np.array([len(x) for x in grams])
            parity = np.stack([parities(x, WIDE_PARITY) for x in grams])
            edges: list[tuple[int, int]] = []
            for group in groups:
                number = np.unique(np.concatenate([grams[i] for i in group]), return_inverse=True)[1]
                start = np.r_[0, np.cumsum(size[group])]
                held = dict(zip(group.tolist(), np.split(number, start[1:-1]), strict=True))
                mark = np.zeros(len(number), dtype=bool)

                def alike() -> Iterator[tuple[int, np.ndarray]]:
                    for a, b in _across(group, label, size, parity, similarity):  # noqa: B023
                        mark[held[a]] = True  # noqa: B023
                        at = np.r_[0, np.cumsum(size[b])[:-1]]
                        shared = np.add.reduceat(mark[np.concatenate([held[x] for x in b.tolist()])], at, dtype=np.int64)  # noqa: B023
                        mark[held[a]] = False  # noqa: B023
                        yield a, b[shared >= similarity * (size[a] + size[b] - shared)]

                edges += _joining(group, label, alike())
            return _ends(node, edges)

        return _whole_groups(batches, ["group", "part"], found)

    return dealt.mapInPandas(verified, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, lanes: int = 1, max_bits: int = 3, min_bytes: int | None = None, block: int = BLOCK, wide_from: int = WIDE_FROM, sure_bits: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """doc_id, fp0 (fp1, ...), component_id of every row.

    With one lane and up to 5 bits no link is lost. With more bits than bytes (as for texts that
    share 0.8 of their shingles) ``min_bytes`` is set by hand, and the index finds most such links.
    With ``sure_bits`` shingles are distinct and all links are verified on the texts' shingles (in the
    index's forests those of up to so many bits come first); then every other pair between the components
    so far that may share ``similarity`` of them: none is lost or added. Rows without doc_id have no links
    then, other than to equal fingerprints.
    """
    least = 8 - max_bits if min_bytes is None else min_bytes
    if least < 3:
        raise ValueError("fewer than three guaranteed bytes: posting lists would be too long")
    names = [f"fp{k}" for k in range(lanes)]
    of = cut(fingerprints(docs, words, lanes, distinct=sure_bits is not None), "fingerprints")
    nodes = cut(of.groupBy(*names).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(nodes, lanes, max_bits, least, block, wide_from, sure_bits)
    if sure_bits is not None:
        edges = similar(_thinned(cut(edges, "edges")), nodes, docs, words, lanes, similarity)
    parts = components(edges.select("a", "b"))
    if sure_bits is not None:
        # what the index or its forests passed over: all pairs between the components so far, by their shingles
        parts = cut(parts, "parts")
        more = linked(cut(apart(nodes, parts, docs, words, lanes, similarity, block), "apart"), nodes, parts, docs, words, lanes, similarity, block)
        # components that these links join are few: the graph is that of components from here on
        of_end = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        across = more.join(of_end("a"), "a", "left").join(of_end("b"), "b", "left")
        over = components(across.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct())
        over = cut(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "over")
    joined = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if sure_bits is not None:
        joined = joined.join(over, "component", "left").withColumn("component", F.coalesce("over", "component")).drop("over")
    ids = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = cut(joined.join(ids, "component").select(*names, "component_id"), "classes")
    return of.join(classes, names).select("doc_id", *names, "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 4, max_bits: int = 56, min_bytes: int = 3, sure_bits: int = 28, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those near a row of smaller doc_id; one row of each group stays.

    Four 64-bit lanes of distinct five-word shingles. Texts that share 0.8 of them differ in 39 of the 256
    bits, plus or minus 6; unrelated ones in 128, plus or minus 8. Links of up to 56 bits are verified on
    the texts. The index finds 84 % of links of exactly 0.8 (some byte triple of a lane must agree), 95 % at
    0.85, 99 % at 0.9; a second index over a share of each text's shingles finds all that are left,
    verified likewise. A doc_id names one document: its rows stay or go together. Rows without doc_id stay.
    """
    found = near_duplicates(docs, words, lanes, max_bits, min_bytes, sure_bits=sure_bits, similarity=similarity)
    name = free_name(docs, "__gone")
    gone = cut(found.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(small(gone, 16), F.col("doc_id") == F.col(name), "left_anti")
