"""Fill-in-middle transformation by a parallel automaton scan.

A text's units are runs of ASCII letters and single other characters. An automaton over bytes counts where
units and code points begin and finds the marker strings. A piece of a text is summed up as a function of
the state it is entered in: the state it is left in, and how many units and markers it counts. Such
functions compose associatively, so the pieces of a giant text are scanned by different tasks, and
composition afterwards tells every piece's entry state and where its units start in the count. A cut
after the k-th unit is then a selection: the piece that holds the unit is known, and it alone is searched.

A text of one piece is entered in the first state, so its scan and its cuts are one step. Giants are
summed up piece by piece; only these small sums are gathered, at most 2 GiB / ``piece`` of them a text.

The automaton remembers at most two bytes: two steps lead from every state to the same one. So states
inside a piece are looked up from neighbouring bytes at once, and entry states matter at its first two.

Defined cases: a null text is empty; an empty text has no units and is plain; a null doc_id draws as an
empty string; rows with equal doc_ids are cut alike, each in its own text; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, each_bytes, id_and_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of a piece; longer texts are giants.
PIECE = 1 << 20
#: Bytes of texts that are scanned at once.
AT_ONCE = 4 << 20

# Classes of bytes and states of the automaton.
OTHER, LETTER, MARK, OPEN, CLOSE, REST = range(6)  # REST: a later byte of a character
OUT, WORD, OPENED, MARKED = range(4)  # MARKED: the letter after "<", which is a word too

CLASS = np.full(256, OTHER, np.uint8)
CLASS[np.r_[65:91, 97:123]] = LETTER
CLASS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = MARK
CLASS[ord("<")], CLASS[ord(">")], CLASS[128:192] = OPEN, CLOSE, REST

STEP = np.zeros((4, 6), np.uint8)  # [state, class]: the next state
STEP[:, LETTER] = STEP[:, MARK] = WORD
STEP[OPENED, MARK], STEP[:, OPEN] = MARKED, OPENED

UNIT = np.ones((4, 6), bool)  # [state, class]: whether a unit begins
UNIT[:, REST] = UNIT[np.ix_([WORD, MARKED], [LETTER, MARK])] = False

PAIR = STEP[STEP[0]]  # [class, next class]: the state after both, from whichever state


def entered(classes: np.ndarray, firsts: np.ndarray, state: int = OUT) -> np.ndarray:
    """The state before each byte, of texts or pieces that begin at ``firsts`` and are entered in ``state``."""
    after = np.empty(len(classes), np.uint8)
    after[1:] = PAIR[classes[:-1], classes[1:]]
    after[firsts] = STEP[state, classes[firsts]]
    # the second byte follows a state that the entry decides
    second = firsts[firsts + 1 < len(classes)]
    second = second[~np.isin(second + 1, firsts)]
    after[second + 1] = STEP[after[second], classes[second + 1]]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[firsts] = state
    return before


@dataclass(frozen=True)
class Sums:
    """What a piece does: for each state it may be entered in, the state it is left in, its units and its markers."""

    leaves: tuple[int, ...]
    units: tuple[int, ...]
    markers: tuple[int, ...]

    def then(self, later: Sums) -> Sums:
        return Sums(
            tuple(later.leaves[s] for s in self.leaves),
            tuple(n + later.units[s] for n, s in zip(self.units, self.leaves, strict=True)),
            tuple(n + later.markers[s] for n, s in zip(self.markers, self.leaves, strict=True)),
        )


NOTHING = Sums((0, 1, 2, 3), (0, 0, 0, 0), (0, 0, 0, 0))


def summed(piece: bytes) -> Sums:
    if not piece:
        return NOTHING
    classes, firsts = CLASS[np.frombuffer(piece, np.uint8)], np.array([0])
    found = []
    for state in range(4):
        before = entered(classes, firsts, state)
        found.append((int(STEP[before[-1], classes[-1]]), int(UNIT[before, classes].sum()), int(((before == MARKED) & (classes == CLOSE)).sum())))
    return Sums(*zip(*found, strict=True))


def characters(piece: bytes) -> int:
    return int((CLASS[np.frombuffer(piece, np.uint8)] != REST).sum())


def selected(piece: bytes, state: int, nth: int) -> int:
    """Code points of the piece before its unit number ``nth``, counted from 0, if it is entered in ``state``."""
    classes = CLASS[np.frombuffer(piece, np.uint8)]
    begins = np.flatnonzero(UNIT[entered(classes, np.array([0]), state), classes])
    return int((classes[: begins[nth]] != REST).sum())


def _draws(seed: int, doc: Column) -> Column:
    """Four unsigned 32-bit numbers from the first digits of a sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


CUT = "n long, markers long, prefix_chars long, middle_chars long"


def _in_one_piece(texts: DataFrame) -> DataFrame:
    """doc_id, text, draws with the unit count and the cuts, for texts of one piece: many are scanned at once."""

    def found(texts_: list[bytes], draws: list[list[int]]) -> pd.DataFrame:
        sizes = np.array([len(t) for t in texts_], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        classes = CLASS[np.frombuffer(b"".join(texts_), np.uint8)]
        before = entered(classes, starts[sizes > 0])
        begins = np.flatnonzero(UNIT[before, classes])
        closes = np.flatnonzero((before == MARKED) & (classes == CLOSE))
        base = np.searchsorted(begins, starts)
        n = np.searchsorted(begins, ends) - base
        chars = np.r_[0, np.cumsum(classes != REST)]
        d = np.array(draws, np.int64).reshape(-1, 4)
        ranks = np.sort(d[:, :2] % (n + 1)[:, None], axis=1)
        places = np.append(begins, 0)
        cuts = [chars[np.where(k < n, places[np.minimum(base + k, len(begins))], ends)] - chars[starts] for k in ranks.T]
        markers = np.searchsorted(closes, ends) - np.searchsorted(closes, starts)
        return pd.DataFrame({"n": n, "markers": markers, "prefix_chars": cuts[0], "middle_chars": cuts[1] - cuts[0]}).astype(np.int64)

    def scan(batches):
        for batch in batches:
            values, draws = each_bytes(batch.column("text")), batch.column("draws").to_pylist()
            own, held, first = [], 0, 0
            for i, text in enumerate(values):
                own.append(text or b"")
                held += len(own[-1])
                if held >= AT_ONCE or i + 1 == batch.num_rows:
                    of = found(own, draws[first : i + 1])
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("draws"), *[pa.array(of[c]) for c in of]], names=["doc_id", "text", "draws", *of.columns])
                    own, held, first = [], 0, i + 1

    return texts.mapInArrow(scan, f"doc_id long, text string, draws array<long>, {CUT}")


def _giant(texts: DataFrame, piece: int) -> DataFrame:
    """The same for texts of several pieces, which are dealt to all tasks."""
    kept = cut(texts.withColumn("row", F.monotonically_increasing_id()), "giants")

    def split(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), each_bytes(batch.column("text")), strict=True):
                for at in range(0, len(text), piece):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([at // piece], pa.int32()), pa.array([text[at : at + piece]], pa.binary())], names=["row", "at", "bytes"])

    def sums(batches):
        for pdf in batches:
            of = [summed(b) for b in pdf["bytes"]]
            yield pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "chars": [characters(b) for b in pdf["bytes"]], "leaves": [list(s.leaves) for s in of], "units": [list(s.units) for s in of], "markers": [list(s.markers) for s in of]})

    def resolved(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry states, the counts before each piece, and which piece holds each cut."""
        pdf = pdf.sort_values("at")
        upto, before, chars = NOTHING, [], 0
        for leaves, units, markers, own in zip(pdf["leaves"], pdf["units"], pdf["markers"], pdf["chars"], strict=True):
            before.append((upto.leaves[OUT], upto.units[OUT], chars))
            upto, chars = upto.then(Sums(tuple(leaves), tuple(units), tuple(markers))), chars + own
        n, firsts = upto.units[OUT], np.array([b[1] for b in before])
        out = {"row": [pdf["row"].iloc[0]], "n": [n], "markers": [upto.markers[OUT]]}
        ranks = sorted(int(d) % (n + 1) for d in pdf["draws"].iloc[0][:2])
        for name, k in zip("ab", ranks, strict=True):
            # the last piece that starts at or before the unit; a piece without units of its own is passed over
            i = int(np.searchsorted(firsts, k, "right")) - 1
            state, first, skipped = before[i]
            out |= {f"piece_{name}": [i], f"state_{name}": [state], f"nth_{name}": [k - first if k < n else -1], f"skip_{name}": [skipped if k < n else chars]}
        return pd.DataFrame(out)

    where = ", ".join(f"piece_{x} int, state_{x} int, nth_{x} long, skip_{x} long" for x in "ab")
    counted = kept.select("row", "text").mapInArrow(split, "row long, at int, bytes binary").repartition("row", "at").mapInPandas(sums, "row long, at int, chars long, leaves array<int>, units array<long>, markers array<long>")
    cuts = counted.join(kept.select("row", "draws"), "row").groupBy("row").applyInPandas(resolved, f"row long, n long, markers long, {where}")

    def select(batches):
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in batch.schema.names if "_" in c and c != "doc_id"}
            out = []
            for i, text in enumerate(each_bytes(batch.column("text"))):
                at = [of[f"skip_{x}"][i] + (selected(text[of[f"piece_{x}"][i] * piece :][:piece], of[f"state_{x}"][i], of[f"nth_{x}"][i]) if of[f"nth_{x}"][i] >= 0 else 0) for x in "ab"]
                out.append((at[0], at[1] - at[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("draws"), batch.column("n"), batch.column("markers"), *[pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)]], names=["doc_id", "text", "draws", *[c.split()[0] for c in CUT.split(", ")]])

    return kept.join(cuts, "row").drop("row").mapInArrow(select, f"doc_id long, text string, draws array<long>, {CUT}")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20, piece: int = PIECE) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Of 100 documents about ``plain`` are transformed, and of these ``spm`` of 100 with the suffix first.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    texts = id_and_text(docs).select("doc_id", whole.alias("text"), _draws(seed, F.col("doc_id")).alias("draws"))
    large = F.octet_length("text") > piece
    cuts = _in_one_piece(texts.where(~large)).unionByName(_giant(texts.where(large), piece))
    form = F.when((F.col("n") == 0) | (F.col("markers") > 0) | (F.col("draws")[2] % 100 >= plain), "plain").when(F.col("draws")[3] % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    first, middle, last = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b), F.substring("text", a + b + 1, F.length("text"))
    psm, back = F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle)
    cells = cuts.withColumn("form", form)
    cut_only = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(back)
    return cells.select("doc_id", "n", "form", cut_only("prefix_chars"), cut_only("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with a marker are plain, so the markers are where it was cut."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
