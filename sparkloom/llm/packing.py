"""Packing documents into training sequences by minimum bin slack.

A document is its token ids and one end id. Whole windows are cut off its front; what remains is one
piece shorter than a window. How pieces meet windows depends on their lengths alone, so the packing is
worked out on the histogram of lengths, at most one entry for each length up to the window, whatever
the size of the corpus: the longest length left opens a window, and dynamic programming over a bitset of
reachable sums picks the multiset of other lengths that fills it closest to capacity, with the counts
traced back. The same choice is taken as often as the counts allow, so there are few choices.

Windows lie one behind the other on a line of tokens, and a choice gives every piece its place on the
line by its rank within its length. Where no multiset comes within ``slack`` of a full window, the pieces
of the length that opened it go to the end of the line, which is cut at every window: sequences are
full there too. The last, incomplete window is cut into powers of two, which need no padding.

Ranks are dealt without sorting: each tokenising task counts its pieces of each length, and running
sums over the tasks' counts give where each of them starts.

Defined cases: a null text is empty, an empty one holds the end id alone; rows with the same or no
doc_id are documents of their own; an empty table has no pieces; other columns aren't read. The ids of
a very long text are made in segments, cut where no token can cross.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, small

WINDOW = 2048
END_ID = 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Characters of a text that are tokenised at once, and bytes of pieces that leave a task at once.
SEGMENT, OUT_BYTES = 1 << 20, 8 << 20

#: Where no token of a byte-level vocabulary crosses: before a single blank or line end between printable characters.
_BREAK = re.compile(r"(?<=[!-~])(?=[ \n][!-~])")

# Texts that both libraries split into the same words: characters whose class no Unicode version changed, and no special token.
_PLAIN, _SPECIAL = re.compile("[\t\n\r -~\xa1-\u024f]*"), "<|"
# Runs of characters, and of white space, that would strain a regular expression.
LONG_WORD, LONG_BLANK = 500, 100
_BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")

PIECES = "doc_id long, doc_tokens long, start long, length long, ids binary, part int, at long"


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers, by the tokenizer's file. ``ranks`` is the same vocabulary for a
    library that is three times as fast; it takes the segments for which both give the same ids, the others go to
    the tokenizer."""

    _own: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, ranks: str | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks:
            with open(ranks, "rb") as f:
                of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})

    @classmethod
    def at(cls, path: str, ranks: str | None) -> Encoder:
        """One for each worker process."""
        if (path, ranks) not in cls._own:
            cls._own[path, ranks] = cls(path, ranks)
        return cls._own[path, ranks]

    def ids(self, text: str) -> bytes:
        return b"".join(self._segment(s) for s in segments(text))

    def _segment(self, text: str) -> bytes:
        if self.fast is not None and _PLAIN.fullmatch(text) and _SPECIAL not in text and not long_runs(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def long_runs(text: str) -> bool:
    words = list(map(len, text.split()))
    spare = len(text) - sum(words) - len(words)  # blanks beyond one between words: a long blank needs as many
    return max(words, default=0) >= LONG_WORD or (spare >= LONG_BLANK - 2 and _BLANKS.search(text) is not None)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the lengths, with their counts, the multiset whose sum is closest to the capacity and not beyond it.

    Bit s of ``reach`` says that some multiset sums to s. Lengths enter from the longest, each in doubling
    lots; the states before each lot are kept, and tell, from the end, which lots the best sum needs.
    """
    reach, within, lots = 1, (1 << capacity + 1) - 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, lot = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            n = min(lot, left)
            lots.append((length, n, reach))
            reach |= reach << n * length & within
            left, lot = left - n, 2 * lot
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(lots):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= n * length
    return used


def choices(counts: dict[int, int], window: int, slack: int = 0) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(times, {length: pieces of each window}) by decreasing longest length, and the counts that no window took."""
    left, out, rest = {k: n for k, n in counts.items() if n}, [], {}
    for longest in sorted(left, reverse=True):
        while n := left.get(longest, 0):
            taken = fill(left | {longest: n - 1}, window - longest)
            taken[longest] = taken.get(longest, 0) + 1
            if window - sum(k * m for k, m in taken.items()) > slack:
                rest[longest] = left.pop(longest)
                break
            times = min(left[k] // m for k, m in taken.items())
            out.append((times, taken))
            for k, m in taken.items():
                left[k] -= times * m
                if not left[k]:
                    del left[k]
    return out, rest


def places(counts: dict[int, int], window: int, slack: int = 0) -> tuple[pd.DataFrame, int, int]:
    """Where pieces lie on the line: those of ``length`` from rank ``first`` on, ``n`` of them, ``per`` to a window, the
    first at ``base``; then where the windows of choices end, and the line."""
    found, rest = choices(counts, window, slack)
    ranks, rows, at = dict.fromkeys(counts, 0), [], 0
    for times, taken in found:
        base = at
        for length, m in sorted(taken.items(), reverse=True):
            rows.append((length, ranks[length], times * m, m, base))
            ranks[length] += times * m
            base += length * m
        at += times * window
    end = at
    for length, n in rest.items():
        rows.append((length, ranks[length], n, n, end))
        end += length * n
    return pd.DataFrame(rows, columns=["of_length", "first", "n", "per", "base"]).astype(np.int64), at, end


def pieces(docs: DataFrame, path: str, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Windows and remainders of all documents, with the task that made them and their number there within their length."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * window

    def encode(batches):
        encoder, part, seen = Encoder.at(path, ranks), TaskContext.get().partitionId(), {}
        columns, held = [[] for _ in range(7)], 0

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            for c in columns:
                c.clear()
            return made

        for one in batches:
            for doc, text in zip(one.column("doc_id").to_pylist(), one.column("text"), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for start in range(0, len(ids), width):
                    own = ids[start : start + width]
                    length = len(own) // 4
                    at = seen.get(length, 0)
                    seen[length] = at + 1
                    for c, v in zip(columns, (doc, len(ids) // 4, start // 4, length, own, part, at), strict=True):
                        c.append(v)
                    held += len(own)
                    if held >= OUT_BYTES:
                        held = 0
                        yield batch()
        if columns[0]:
            yield batch()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return id_and_text(docs).mapInArrow(encode, PIECES)


def packed(docs: DataFrame, path: str | None = None, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID, slack: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``path``: the tokenizer's file, ``ranks``: the same vocabulary as ranks, if there is such a file; the public ones by default.
    ``slack``: tokens that a window may lack before its pieces are cut instead.
    """
    spark = docs.sparkSession
    if path is None:
        path, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    made = cut(pieces(docs, path, ranks, window, end_id), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    table, windows, end = places(counts, window, slack)
    runs = F.broadcast(cut(spark.createDataFrame(table, "of_length long, first long, n long, per long, base long"), "runs"))  # bounded by lengths
    starts = small(cut(counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")), "starts"), 60)
    ranked = made.join(starts, ["length", "part"]).withColumn("rank", F.col("skip") + F.col("at"))
    lies = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    nth = F.col("rank") - F.col("first")
    line = F.col("base") + F.floor(nth / F.col("per")) * window + nth % F.col("per") * F.col("length")
    placed = ranked.join(runs, lies).withColumn("at", line.cast("long"))
    return _cut_at_windows(placed, window, windows, end).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def last_marks(whole: int, end: int) -> list[int]:
    """Where the sequences after the last whole window end: powers of two, the largest first."""
    marks, at = [], whole
    while at < end:
        at += 1 << (end - at).bit_length() - 1
        marks.append(at)
    return marks


def _cut_at_windows(placed: DataFrame, window: int, windows: int, end: int) -> DataFrame:
    """Pieces cut where the line is, numbered by sequence. ``at`` is a piece's place on the line."""
    whole = windows + (end - windows) // window * window
    tail = F.array(*[F.lit(m).cast("long") for m in last_marks(whole, end)]) if end > whole else F.array().cast("array<long>")
    at, to = F.col("at"), F.col("at") + F.col("length")
    following = (F.floor(at / window) + 1).cast("long") * window
    inner = F.filter(F.concat(F.array(F.when(following <= whole, following)), tail), lambda m: (m > at) & (m < to))
    marks = F.array_sort(F.concat(F.array(at, to), inner))
    spans = F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = placed.select("*", F.explode(spans).alias("span")).select("*", "span.a", "span.b")
    reached = F.filter(tail, lambda m: m <= F.col("a"))
    in_tail, into = F.col("a") >= whole, (F.col("a") - F.col("at")).cast("int")
    return rows.select(
        "doc_id", (F.col("start") + into).alias("start"), (F.col("b") - F.col("a")).alias("length"), "doc_tokens",
        F.substring("ids", 4 * into + 1, (4 * (F.col("b") - F.col("a"))).cast("int")).alias("ids"),
        F.when(in_tail, F.lit(whole // window).cast("long") + F.size(reached)).otherwise(F.floor(F.col("a") / window)).cast("long").alias("sequence_id"),
        F.when(in_tail, F.col("a") - F.coalesce(F.array_max(reached), F.lit(whole))).otherwise(F.col("a") % window).cast("long").alias("offset"),
    )


def sequences(pieces_: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): each sequence's pieces joined by offset. A sequence is at most a window."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(own, F.lit("").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    return pieces_.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
