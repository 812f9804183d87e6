"""Secret scans: dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hexadecimal strings. The method adds other
strings: all long tokens on a line that names something sensitive, within ``AROUND`` bytes of such a
name, or in a block that a key's header opens. Each candidate is judged by its marginal compressed bytes: a zstandard compressor, primed with a dictionary of the
identifiers that stand around candidates in the whole corpus, compresses the surrounding code with
and without the candidate. Words, names and repeated values cost little; what stays incompressible is
reported.

Offsets are code points of the text, ends exclusive. Defined cases: null counts as empty; added spans
never overlap base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut, id_and_text

# The base patterns and the words that mark what stands around them as sensitive.
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE = (*KEYWORDS, b"passphrase", b"credential", b"private", b"auth", b"bearer", b"signature", b"akia")
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
WORD = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
NAMED = re.compile(b"|".join(SENSITIVE))
KEY_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,64}-----(.*?)(?:-----END |\Z)", re.DOTALL)

#: Code on either side of a candidate that the compressor sees.
AROUND = 256
#: Dictionary bytes, and words that it is made of at most.
DICTIONARY_BYTES = 64 << 10
#: A candidate is novel from this many marginal bytes for each of its own.
NOVEL = 0.6


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def sensitive_ranges(text: bytes) -> list[tuple[int, int]]:
    """Disjoint ranges in order: ``AROUND`` bytes on either side of a sensitive word and the rest of its line, and key blocks."""
    low, found = text.lower(), []
    for m in NAMED.finditer(low):
        if found and m.end() + AROUND <= found[-1][1]:
            continue
        end = text.find(b"\n", m.end())
        found.append((min(max(0, m.start() - AROUND), text.rfind(b"\n", 0, m.start()) + 1), max(m.end() + AROUND, len(text) if end < 0 else end)))
    found += [m.span(1) for m in KEY_BLOCK.finditer(text) if b"KEY" in text[m.start() : m.start(1)]]
    out: list[tuple[int, int]] = []
    for x, y in sorted(found):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def other_candidates(text: bytes, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Long tokens in sensitive ranges, also those that a range cuts, outside the base spans."""
    ranges = sensitive_ranges(text)
    if not ranges:
        return []
    out, at, k = [], 0, 0
    spans = sorted((x, y) for _, x, y in base)
    ends = [y for _, y in spans]  # the furthest end so far, so that base spans may overlap
    for i in range(1, len(ends)):
        ends[i] = max(ends[i], ends[i - 1])
    for m in WORD.finditer(text):
        a, b = m.span()
        while at < len(ranges) and ranges[at][1] <= a:
            at += 1
        if at == len(ranges):
            break
        while k < len(spans) and spans[k][0] < b:
            k += 1
        if ranges[at][0] < b and not (k and ends[k - 1] > a):
            out.append(("novel", a, b))
    return out


def code_points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset, in one pass."""
    out, at, n = {}, 0, 0
    for x in sorted(set(offsets)):
        n += len(text[at:x].decode("utf-8", "replace"))
        out[x], at = n, x
    return out


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,before:binary,value:binary,after:binary>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("before", pa.binary()), ("value", pa.binary()), ("after", pa.binary())]))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row, base ones and others, with the code around each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in byte_values(batch.column(1)):
                text = text or b""
                base = base_spans(text)
                every = base + other_candidates(text, base)
                points = code_points(text, [x for s in every for x in s[1:]]) if every else {}
                rows.append([{"kind": k, "start": points[a], "end": points[b], "before": text[max(0, a - AROUND) : a], "value": text[a:b], "after": text[b : b + AROUND]} for k, a, b in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, ARROW)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(scan, FOUND)


def identifier_dictionary(found: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers around candidates of the most rows, the most frequent last, where zstandard reaches them cheapest.

    Those of a single row are left out: pieces of a secret stand around the secrets next to it.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(0).to_pylist():
                own: set[bytes] = set()
                for s in spans:
                    own |= set(re.findall(rb"[A-Za-z_\x80-\xff]{3,32}", s["before"] + b" " + s["after"]))
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["word"])

    counts = found.select("spans").mapInArrow(words, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "word").limit(size // 8).collect()
    out = b" ".join(bytes(r["word"]) for r in reversed(top))[-size:]
    return out if len(out) >= 8 else b"password secret token key value " + out


class Novelty:
    """Marginal compressed bytes of a candidate, for each of its bytes."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, before: bytes, value: bytes, after: bytes) -> float:
        without = len(self.compressor.compress(before + after))
        return (len(self.compressor.compress(before + value + after)) - without) / max(1, len(value))


def secrets(docs: DataFrame, novel: float = NOVEL) -> DataFrame:
    """doc_id and spans (kind, start, end, value, novelty): base spans, and other candidates from ``novel`` on."""
    found = cut(candidates(docs), "candidates")
    held = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(found))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("novelty", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(held.value)
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                out = []
                for s in spans:
                    x = novelty(s["before"], s["value"], s["after"])
                    if s["kind"] != "novel" or x >= novel:
                        out.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "value": s["value"].decode("utf-8", "replace"), "novelty": x})
                rows.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(judge, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string,novelty:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' hash and all spans, one row for each document."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = found.select("doc_id", ordered.alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
