"""Correlation networks: which columns hang together, and which lines of text respect that.

A network has as many nodes as the table has columns, so the pairs are collected and walked on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = 0.35

Pair = tuple[str, str, float]


def components(names: Iterable[str], pairs: Iterable[Pair], threshold: float = EDGE) -> tuple[dict[str, int], dict[int, int]]:
    """Component number of each name, and the size of each component; numbered by least name."""
    names = sorted(set(names))
    root = {n: n for n in names}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b, r in pairs:
        if a in root and b in root and r is not None and abs(r) >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    number: dict[str, int] = {}
    of = {n: number.setdefault(find(n), len(number)) for n in names}
    sizes: dict[int, int] = {}
    for k in of.values():
        sizes[k] = sizes.get(k, 0) + 1
    return of, sizes


def largest(sizes: dict[int, int]) -> set[int]:
    most = max(sizes.values(), default=0)
    return {k for k, n in sizes.items() if n == most}


def component_table(pairs: DataFrame, names: Sequence[str], threshold: float = EDGE) -> DataFrame:
    """(column, component, size, is_largest); a component is named by its least column."""
    found = [(r["col_a"], r["col_b"], r["r"]) for r in pairs.where(F.abs("r") >= threshold).select("col_a", "col_b", "r").collect()]
    of, sizes = components(names, found, threshold)
    least: dict[int, str] = {}
    for n in sorted(of):
        least.setdefault(of[n], n)
    main = largest(sizes)
    return pairs.sparkSession.createDataFrame([(n, least[k], sizes[k], k in main) for n, k in of.items()], "column string, component string, size long, is_largest boolean")


def centrality(pairs: DataFrame) -> DataFrame:
    """(column, centrality): summed strength of a column's correlations with the others."""
    both = pairs.select(F.col("col_a").alias("column"), "r").unionByName(pairs.select(F.col("col_b").alias("column"), "r"))
    return both.groupBy("column").agg(F.sum(F.abs("r")).alias("centrality"))


def main_centrality(pairs: DataFrame, names: Sequence[str], threshold: float = EDGE) -> DataFrame:
    """(column, centrality) of the first largest network: summed strength of each column's correlations within it."""
    found = component_table(pairs, names, threshold).where("is_largest")
    main = found.join(F.broadcast(found.agg(F.min("component").alias("component"))), "component").select("column")
    inside = pairs.join(F.broadcast(main.withColumnRenamed("column", "col_a")), "col_a").join(F.broadcast(main.withColumnRenamed("column", "col_b")), "col_b")
    return main.join(centrality(inside), "column", "left").select("column", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def most_important(pairs: Sequence[Pair], names: Sequence[str], threshold: float = EDGE) -> str | None:
    """The most central column of the first largest component; the first of equals."""
    if not names:
        return None
    of, sizes = components(names, pairs, threshold)
    main = min(largest(sizes))
    inside = [n for n in names if of[n] == main]
    total = dict.fromkeys(inside, 0.0)
    for a, b, r in pairs:
        if a in total and b in total and r is not None:
            total[a] += abs(r)
            total[b] += abs(r)
    return max(inside, key=lambda n: total[n])


def scatter_pair(pairs: Sequence[Pair], names: Sequence[str], threshold: float = EDGE) -> Pair | None:
    """The strongest pair of the main network that touches its most important column, else its strongest pair."""
    best = most_important(pairs, names, threshold)
    if best is None:
        return None
    of, _ = components(names, pairs, threshold)
    inside = [p for p in pairs if of.get(p[0]) == of[best] == of.get(p[1])]
    return next((p for p in inside if best in p[:2]), inside[0] if inside else None)


def mentioned(line: str, names: Sequence[str]) -> list[str]:
    """Names that occur in a line as words, longest first."""
    low, out = line.lower(), []
    for name in sorted(names, key=len, reverse=True):
        n, at = name.lower(), 0
        while len(n) >= 2 and (at := low.find(n, at)) >= 0:
            end = at + len(n)
            if not _letter(low[at - 1 : at]) and not _letter(low[end : end + 1]):
                out.append(name)
                break
            at += 1
    return out


def _letter(c: str) -> bool:
    return bool(c) and (c == "_" or (c.isascii() and c.isalnum()))


def spans_components(line: str, of: dict[str, int]) -> bool:
    return len({of[n] for n in mentioned(line, list(of))}) > 1


def leaves_main(line: str, of: dict[str, int], main: set[int]) -> bool:
    return any(of[n] not in main for n in mentioned(line, list(of)))


def filter_lines(pair_lines: Sequence[str], prediction_lines: Sequence[str], names: Sequence[str], pairs: Sequence[Pair]) -> tuple[list[str], list[str]]:
    """Without lines that mix unrelated columns, and predictions outside the largest component."""
    of, sizes = components(names, pairs)
    if len(sizes) <= 1:
        return list(pair_lines), list(prediction_lines)
    main = largest(sizes)
    kept = [x for x in pair_lines if not spans_components(x, of)]
    return kept, [x for x in prediction_lines if not spans_components(x, of) and not leaves_main(x, of, main)]


def network_summary(names: Sequence[str], pairs: Sequence[Pair]) -> tuple[str, str, str]:
    """For a prompt: the main columns, the others, and a note."""
    of, sizes = components(names, pairs)
    main = largest(sizes)
    inside, outside = ([n for n in sorted(of) if (of[n] in main) == want] for want in (True, False))
    note = "All columns belong to one correlation network." if len(sizes) <= 1 else "Relate only columns of the same network."
    return ", ".join(inside) or "none", ", ".join(outside) or "none", note
