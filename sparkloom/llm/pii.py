"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Seeds are the base patterns' matches: e-mail and IP addresses, card and phone numbers. Every
identifier-like token (one with a digit or an @) is an instance; the word before it, and the two words
before it, are its lexical patterns. A line break counts as a word, as does the start of the text.
Patterns and instances form a graph, scored in rounds: a pattern's confidence for a kind is the mean
confidence of the instances it introduces (damped for few of them, more so for one word), an instance's
is the noisy-or of its patterns'. A pattern acts when it introduces enough seeds, or instances believed
in the round before; with high confidence it discovers identifiers that no base pattern matches.

Offsets are code points, ends exclusive. The text is scanned once; only identifiers and the two words
before them are shuffled, counted before they move. Quantifiers are possessive, and starts within a run
are ruled out, so that a text of one endless token takes time in proportion to its length.

Defined cases: null counts as empty; rows that repeat a doc_id are rows of their own; discovered spans
never overlap base spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

# Kinds in order, and the base patterns (written so that they cannot backtrack).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"

#: A pattern acts from this confidence, and this many distinct seeds, on.
CONFIDENT = 0.8
SEEDS = 3
ROUNDS = 3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(digits(match))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(items: Column, add: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``add`` puts out, walking the items from offset 0: add(at, item) gives (end, array of ``kind``).

    The items are taken in about sqrt(n) chunks of as many items, so that what has been put out is copied
    within its chunk only: n items cost n^1.5 copied references, not n^2.
    """
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        return once(add(acc["at"], x), lambda y: F.struct(y["end"].alias("at"), F.when(F.size(y["out"]) > 0, F.concat(acc["out"], y["out"])).otherwise(acc["out"]).alias("out")))

    def chunk(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return once(own, lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

    def walk(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda c: F.slice(xs, c * width + 1, width))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(chunks, first, chunk, lambda acc: F.flatten(acc["out"]))

    return once(items, lambda xs: F.when(F.size(xs) > 0, walk(xs)).otherwise(none))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Valid matches in order, as (kind, start, end). Between the matches stand the pieces of a split, so
    lengths of pieces and matches add up to offsets."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).cast("long").alias("skip"), m.alias("m")))

    def add(at: Column, x: Column) -> Column:
        a = at + x["skip"]
        b = a + F.coalesce(F.length(x["m"]), F.lit(0)).cast("long")
        found = F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))).cast(SPAN)
        keep = x["m"].isNotNull() & valid(kind, x["m"])
        return F.struct(b.alias("end"), F.when(keep, found).otherwise(F.array().cast(SPAN)).alias("out"))

    return running(both, add, SPAN)


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start; texts without a digit or @ are not searched."""
    none = F.array().cast(SPAN)
    has = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    return F.concat(*[F.when(has[k], spans(text, k, PATTERNS[k])).otherwise(none) for k in KINDS])


INSTANCE = "array<struct<start:bigint,end:bigint,value:string,contexts:array<string>>>"
#: The line break as a word, and characters before an instance in which its two words are looked for.
BREAK, BEFORE = "\u00b6", 256
#: Damping of patterns of two words and of one.
DAMP = (0.25, 1.0)


def instances(text: Column) -> Column:
    """Identifier-like tokens with the two words and the one word before them: (start, end, value, contexts)."""
    none = F.array().cast(INSTANCE)
    pattern = r"(?:(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what stands before the k-th match: the match before it and the piece between them
    earlier = F.concat(F.array(F.lit("")), matches)

    def contexts(before: Column) -> Column:
        broken = F.regexp_replace(F.right(before, F.lit(BEFORE)), r"[\x20\x09-\x0D]*[\n\r][\x20\x09-\x0D]*", f" {BREAK} ")
        padded = F.lower(F.concat(F.lit(f"{BREAK} {BREAK} "), broken))
        two = F.regexp_extract(padded, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 0)
        return once(F.regexp_extract_all(two, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.array(F.array_join(w, " "), F.try_element_at(w, F.lit(2))))

    value = lambda m: F.regexp_extract(m, r"^[\"'(\[<]*+(.*?)[\"'),.;:!?\]>]*+$", 1)
    lead = lambda m: F.length(F.regexp_extract(m, r"^([\"'(\[<]*+)", 1)).cast("long")
    before = F.zip_with(earlier, pieces, lambda e, p: F.struct(F.length(p).cast("long").alias("skip"), contexts(F.concat(F.coalesce(F.right(e, F.lit(BEFORE)), F.lit("")), F.right(p, F.lit(BEFORE)))).alias("contexts")))
    both = F.zip_with(
        before,
        matches,
        lambda p, m: F.struct(p["skip"].alias("skip"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("take"), lead(m).alias("lead"), value(m).alias("value"), p["contexts"].alias("contexts")),
    )

    def add(at: Column, x: Column) -> Column:
        a = at + x["skip"]
        start = a + x["lead"]
        found = F.array(F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["contexts"].alias("contexts"))).cast(INSTANCE)
        return F.struct((a + x["take"]).alias("end"), F.when(F.length(x["value"]) > 0, found).otherwise(none).alias("out"))

    return F.when(text.rlike("[0-9@]"), running(both, add, INSTANCE)).otherwise(none)


def discover(seen: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, seeds: int = SEEDS) -> DataFrame:
    """(context, value, found) that confident patterns introduce and no base pattern matches.

    seen: (context, value, kind or null), one row for each occurrence and pattern. The graph's edges are
    counted first; each round is two grouped aggregations over those edges.
    """
    edges = cut(seen.where("context is not null and context <> ''").groupBy("context", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("for")
    graph = cut(edges.where(F.col("context") != BREAK).select("context", "value", "kind", kinds), "pii-graph")
    score = F.when(F.col("kind").isNull(), F.lit(0.0)).otherwise((F.col("kind") == F.col("for")).cast("double"))
    damp = F.when(F.col("context").contains(" "), F.lit(DAMP[0])).otherwise(F.lit(DAMP[1]))
    scored = graph.withColumn("score", score)
    patterns = None
    for _ in range(rounds):
        patterns = scored.groupBy("context", "for").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("of"), F.count_if(F.col("score") >= confident).alias("support"))
        patterns = patterns.where(F.col("support") >= seeds).withColumn("confidence", F.col("sum") / (F.col("of") + damp))
        patterns = cut(patterns.select("context", "for", "confidence"), "pii-patterns")
        # unseen instances: noisy-or over the patterns that introduce them
        met = graph.where("kind IS NULL").join(small(patterns, 100), ["context", "for"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1.0 - F.col("confidence")))))
        values = cut(met.groupBy("value", "for").agg((1.0 - doubt).alias("believed")), "pii-values")
        scored = graph.join(small(values, 100), ["value", "for"], "left").withColumn("score", F.coalesce(F.when(F.col("kind").isNull(), F.col("believed")), score))
        scored = cut(scored.select("context", "value", "kind", "for", "score"), "pii-scored")
    sure = patterns.where(F.col("confidence") >= confident)
    found = scored.where(F.col("kind").isNull() & (F.col("score") >= confident)).join(small(cut(sure, "pii-sure"), 100).select("context", "for"), ["context", "for"])
    best = found.groupBy("context", "value").agg(F.max_by("for", F.struct("score", "for")).alias("found"))
    return cut(best, "pii-found")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, seeds: int = SEEDS) -> DataFrame:
    """doc_id, base (spans of the base patterns) and added (discovered spans); one row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"), base_spans(text).alias("base"), instances(text).alias("instances"))
    over = lambda i: F.try_element_at(F.filter(F.col("base"), lambda s: (s["start"] < i["end"]) & (i["start"] < s["end"])), F.lit(1))

    def tagged(i: Column) -> Column:
        def tag(s: Column) -> Column:
            value = F.when(s.isNull(), i["value"]).otherwise(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
            begins = s.isNull() | ((i["start"] <= s["start"]) & (s["start"] < i["end"]))
            return F.struct(i["start"].alias("start"), i["end"].alias("end"), value.alias("value"), i["contexts"].alias("contexts"), s["kind"].alias("kind"), begins.alias("begins"))

        return once(over(i), tag)

    # a base span of several tokens is one instance: where it begins, with all of its text
    own = F.filter(F.transform("instances", tagged), lambda i: i["begins"])
    rows = cut(rows.select("doc_id", "row", "base", own.alias("instances")), "pii-rows")
    seen = rows.where(F.size("instances") > 0).select("row", F.explode("instances").alias("i")).select("row", "i.*").withColumn("context", F.explode("contexts"))
    found = discover(seen.select("context", "value", "kind"), rounds, confident, seeds)
    new = seen.where("kind IS NULL").join(small(found, 100), ["context", "value"])
    added = new.groupBy("row").agg(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added"))
    added = cut(added, "pii-added")
    out = rows.join(small(added, 200), "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans, one row for each document."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    order = lambda s: F.array_sort(F.transform(s, lambda x: F.struct(rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    shown = lambda s: F.array_join(F.transform(order(s), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"))
