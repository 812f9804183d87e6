"""Choosing targets and features. Names are judged by rules, columns by aggregates, subsets by Gram matrices."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import numeric_columns, text_columns
from .assoc import correlation_pairs
from .gram import Grams
from .masked import correlations as correlations_with
from .metrics import Score as Value
from .metrics import beats, first_of
from .metrics import label_codes as numbered_labels
from .profile import stacked
from .ranks import distinct_counts, quantile_values

# Words in names, and what they add to a target's prior.
OUTCOMES = ("price", "value", "score", "count", "amount", "income", "cost", "sale", "rating", "risk", "prob", "churn", "demand")
PENALTIES = ("index", "rank", "code", "zip", "latitude", "longitude", "lat", "lon", "lng", "id")
LEAKS = ("target", "label", "prediction", "predicted", "outcome", "response")
COORDINATES = ("lat", "latitude", "lon", "lng", "longitude")

Score = Callable[[list[str]], Value | None]


def ahead(score: Score, subsets: Sequence[Sequence[str]]) -> None:
    """Lets a score that can work out many subsets together do so."""
    many = getattr(score, "many", None)
    if many is not None:
        many(subsets)


def entry(features: Sequence[str], value: Value) -> dict:
    """A line of a search's history."""
    found = {"k": len(features), "features": list(features), "score": first_of(value)}
    return found | {"accuracy": value[1]} if isinstance(value, tuple) and len(value) > 1 else found


def is_coordinate(name: str) -> bool:
    """A short coordinate name as a whole, a long one as a part of the name."""
    return any(w == name.lower() or (len(w) > 3 and w in name.lower()) for w in COORDINATES)


def target_prior(name: str) -> float:
    n = name.lower()
    prior = 0.15 * sum(w in n for w in OUTCOMES) - 0.12 * sum(w in n for w in PENALTIES)
    return prior + 0.25 * ("price" in n or "value" in n) - 0.25 * is_coordinate(name)


def leaks(feature: str, target: str) -> bool:
    f, t = feature.lower(), target.lower()
    parts = [p for p in re.split("[-_]", t) if len(p) >= 4]
    return f == t or any(w in f for w in LEAKS) or sum(p in f for p in parts) >= 2


def id_name(name: str) -> bool:
    n = name.lower()
    return "id" in n or n.endswith(("_key", "uuid"))


def id_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_ratio, is_id): by name, or by more than 95% distinct values."""
    columns = list(columns or df.columns)
    n = df.count()
    rows = [(c, unique / n if n else None, bool(n) and (id_name(c) or unique / n > 0.95)) for c, unique in distinct_counts(df, columns).items()]
    return df.sparkSession.createDataFrame(rows, "column string, unique_ratio double, is_id boolean")


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """df with each label of a text target replaced by its place in the order of labels; rows without one are left out."""
    return numbered_labels(df, target, "__code").where("__code is not null").withColumn(target, F.col("__code").cast("double")).drop("__code")


def relevance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(column, relevance): absolute correlation with the target over rows where nothing is missing."""
    whole = df.select(*[F.col(f"`{c}`") for c in [*features, target]]).dropna()
    if target in text_columns(df):  # labels count by their order
        whole = label_codes(whole, target)
    found = correlations_with(whole, [*features, target], target=True).where(f"i < {len(features)}")
    return found.select(F.col("col_a").alias("column"), F.coalesce(F.abs("r"), F.lit(0.0)).alias("relevance"))


def ranked(df: DataFrame, target: str, features: Sequence[str]) -> list[str]:
    """Most relevant first; equals stay in order. Under eight whole rows nothing is reordered."""
    features = [f for f in features if f != target]
    if not features or df.select(*features, target).dropna().limit(8).count() < 8:
        return features
    found = {r["column"]: r["relevance"] for r in relevance(df, target, features).collect()}
    return sorted(features, key=lambda f: -found[f])


def pool_summary(df: DataFrame, target: str, pool: Sequence[str]) -> DataFrame:
    """(column, missing, std, abs_corr) of candidate features."""
    if target in text_columns(df):
        df = label_codes(df, target)
    found = correlations_with(df, [*pool, target], target=True).where(f"i < {len(pool)}").select(F.col("col_a").alias("column"), F.abs("r").alias("abs_corr"))
    return stacked(df, list(pool), {"missing": lambda c: F.avg(c.isNull().cast("double")), "std": lambda c: F.stddev_pop(c.cast("double"))}).join(F.broadcast(found), "column")


def prune_redundant(ranked_: Sequence[str], relevance_: dict[str, float], corr: dict[frozenset, float], limit: float = 0.95) -> list[str]:
    """Of columns that correlate beyond the limit the more relevant stays."""
    kept: list[str] = []
    for f in ranked_:
        twin = next((k for k in kept if abs(corr.get(frozenset((f, k)), 0.0) or 0.0) >= limit), None)
        if twin is None:
            kept.append(f)
        elif relevance_.get(f, 0.0) > relevance_.get(twin, 0.0):
            kept[kept.index(twin)] = f
    return kept


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[frozenset, float]:
    return {frozenset((r["col_a"], r["col_b"])): r["r"] for r in correlation_pairs(df, list(columns)).where("r is not null").collect()}


def agent_pool(df: DataFrame, target: str, most: int = 28) -> list[str]:
    numbers = [c for c in numeric_columns(df) if c != target]
    ids = {r["column"] for r in id_columns(df, numbers).where("is_id").collect()} if numbers else set()
    return ranked(df, target, [c for c in numbers if c not in ids and not leaks(c, target)])[:most]


# subsets -------------------------------------------------------------------------------------------


def grow(features: Sequence[str], score: Score, rows: int, gain: float = 0.005, stop_early: bool = True) -> tuple[list[str], list[dict]]:
    """The first k features, for the k from 3 on that scores best; stops where more no longer help."""
    if rows < 40 or len(features) <= 3:
        return list(features), []
    ahead(score, [features[:k] for k in range(3, len(features) + 1)])
    best, best_k, history = None, 3, []
    for k in range(3, len(features) + 1):
        s = score(list(features[:k]))
        history.append({"k": k, "score": None if s is None else first_of(s)})
        if s is not None and (first_of(s) > -1.0 + gain if best is None else beats(s, best, gain)):
            best, best_k = s, k
        elif stop_early:
            break
    return list(features[:best_k]), history


def subsets(pool: int, most: int) -> int:
    return sum(comb(pool, k) for k in range(2, min(pool, most) + 1))


def best_entries(history: list[dict], most: int = 12) -> list[dict]:
    return sorted(history, key=lambda h: (h["score"], h.get("accuracy", 0.0)), reverse=True)[:most]


def exhaustive(pool: Sequence[str], score: Score, most: int, tol: float) -> tuple[list[str], Value | None, list[dict]]:
    every = [list(some) for k in range(2, min(len(pool), most) + 1) for some in combinations(pool, k)]
    ahead(score, every)
    best, best_score, history = [], None, []
    for some in every:
        s = score(some)
        if s is not None:
            history.append(entry(some, s))
            if beats(s, best_score, tol):
                best, best_score = some, s
    return best, best_score, best_entries(history)


def greedy(pool: Sequence[str], score: Score, most: int, tol: float, prefix: int = 18) -> tuple[list[str], Value | None, list[dict]]:
    """The best pair of the first ``prefix`` features, then additions, then removals, while they help. What one round
    compares is scored together."""
    history: list[dict] = []

    def first_best(rounds: list[set[str]]) -> tuple[list[str], Value | None]:
        options = [[f for f in pool if f in names] for names in rounds]
        ahead(score, options)
        found, found_score = [], None
        for some in options:
            s = score(some)
            if s is not None:
                history.append(entry(some, s))
                if beats(s, found_score, 0.0):
                    found, found_score = some, s
        return found, found_score

    best, best_score = first_best([set(pair) for pair in combinations(pool[:prefix], 2)])
    while best_score is not None and len(best) < most:
        some, s = first_best([{*best, f} for f in pool if f not in best])
        if s is None or not beats(s, best_score, tol):
            break
        best, best_score = some, s
    while len(best) > 2:
        some, s = first_best([set(best) - {f} for f in best])
        if s is None or not beats(s, best_score, tol):
            break
        best, best_score = some, s
    return best, best_score, best_entries(history)


def best_subset(features: Sequence[str], score: Score, pool: int = 12, most: int = 8, evaluations: int = 5500, tol: float = 0.001) -> tuple[list[str], Value | None, list[dict], str]:
    """Every subset where there are few enough, else greedy search."""
    pool_ = list(features[:pool])
    if len(pool_) < 2:
        return pool_, score(pool_) if pool_ else None, [], "none"
    if subsets(len(pool_), most) <= evaluations:
        return (*exhaustive(pool_, score, most, tol), "exhaustive")
    return (*greedy(pool_, score, most, tol), "greedy")


def ablation(features: Sequence[str], score: Score) -> list[dict]:
    """What the score loses without each feature, most first."""
    base = score(list(features))
    if base is None or len(features) < 2:
        return []
    ahead(score, [[x for x in features if x != f] for f in features])
    drops = [{"feature": f, "drop": first_of(base) - first_of(s)} for f in features if (s := score([x for x in features if x != f])) is not None]
    return sorted(drops, key=lambda d: -d["drop"])


def pair_champion(pool: Sequence[str], score: Score, incumbent: Sequence[str], most: int = 22, tol: float = 1e-6) -> tuple[list[str], Value | None]:
    """The incumbent, or a pair of the pool's first columns that beats it. An incumbent without a score stays."""
    best, best_score = list(incumbent), score(list(incumbent)) if incumbent else None
    if incumbent and best_score is None:
        return best, None
    pairs = [list(pair) for pair in combinations(pool[:most], 2)]
    ahead(score, pairs)
    for pair in pairs:
        s = score(pair)
        if s is not None and beats(s, best_score, tol):
            best, best_score = pair, s
    return best, best_score


def champion_or_subset(pool: Sequence[str], score: Score, champion: Sequence[str]) -> tuple[list[str], Value | None, str]:
    found, s, _, _ = best_subset(pool, score, pool=22, most=14, evaluations=7000, tol=1e-6)
    base = score(list(champion)) if champion else None
    if s is not None and beats(s, base, 1e-6):
        return found, s, "subset"
    return list(champion), base, "champion"


def forward(pool: Sequence[str], score: Score, most: int = 8, gain: float = 0.003) -> tuple[list[str], float]:
    chosen: list[str] = []
    best = float("-inf")
    while len(chosen) < most:
        found = [(s, f) for f in pool if f not in chosen and (s := score([*chosen, f])) is not None]
        if not found:
            break
        s, f = max(found, key=lambda x: x[0])
        if chosen and s < best + gain:
            break
        chosen, best = [*chosen, f], s
    return chosen, best


def heuristic_target(df: DataFrame, grams_for: Callable[[list[str], str], Grams]) -> tuple[str, list[str], dict]:
    """The numeric column that others explain best, and the features that do: a composite of validation R²,
    the name's prior and completeness."""
    numbers = numeric_columns(df)
    ids = {r["column"] for r in id_columns(df, numbers).where("is_id").collect()} if numbers else set()
    columns = [c for c in numbers if c not in ids]
    if len(columns) < 2:
        columns = numbers
    if len(columns) < 2:
        raise ValueError("a target and a feature need two numeric columns")
    facts = {r["column"]: r for r in stacked(df, columns, {"missing": lambda c: F.avg(c.isNull().cast("double")), "std": lambda c: F.stddev_pop(c.cast("double"))}).collect()}
    corr = correlations(df, columns)
    best: tuple[float, str, list[str], float] | None = None
    for target in columns:
        if (facts[target]["std"] or 0.0) <= 1e-12 or is_coordinate(target):
            continue
        strength = {c: abs(corr.get(frozenset((c, target)), 0.0)) for c in columns if c != target and not leaks(c, target)}
        order = sorted(strength, key=lambda c: -strength[c])
        pool = [c for c in order if strength[c] >= 0.08] or order[:10]
        pool = prune_redundant(pool, strength, corr)[:12]
        if not pool:
            continue
        chosen, r2 = forward(pool, grams_for(pool, target).score)
        if not chosen:
            continue
        quality = 0.08 if facts[target]["missing"] <= 0.15 else 0.0
        composite = 0.75 * max(r2, -0.2) + 0.15 * target_prior(target) + 0.10 * quality
        if best is None or composite > best[0]:
            best = (composite, target, chosen, r2)
    if best is None:
        raise ValueError("no numeric column can serve as a target")
    return best[1], best[2], {"composite": best[0], "validation_r2": best[3]}


# engineered features -------------------------------------------------------------------------------

# Operators that a proposal may use, and their tags in names.
OPERATORS = {"multiply": "mul", "divide": "ratio", "add": "add", "subtract": "sub"}


def fragment(name: str) -> str:
    return re.sub(r"[^\w]", "_", name)[:48] or "col"


def engineered(df: DataFrame, proposals: Sequence[dict], base: Sequence[str], existing: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """df with the valid ones of up to twelve proposed column pairs; ratios by a denominator near zero and columns
    that do not vary are left out."""
    base, taken, cells = list(base)[:12], set(existing), {}
    for p in [p for p in proposals[:12] if isinstance(p, dict)]:
        op, a, b = (str(p.get(k, "")).strip() for k in ("operator", "feature_a", "feature_b"))
        op = op.lower()
        if op not in OPERATORS or a not in base or b not in base or a == b:
            continue
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        cell = {"multiply": x * y, "add": x + y, "subtract": x - y, "divide": x / F.nullif(y, F.lit(0.0))}[op]
        plain = f"__eng_{OPERATORS[op]}__{fragment(a)}__{fragment(b)}"
        given = str(p.get("name", "")).strip()
        name = f"__eng_{OPERATORS[op]}__{fragment(given)}" if given else plain
        name = plain if len(name) >= 180 or name in taken else name
        if len(name) >= 180 or name in taken:
            continue
        taken.add(name)
        cells[name] = (cell, F.abs(y) if op == "divide" else None)
    if not cells:
        return df, []
    stds = dict(zip(cells, df.agg(*[F.stddev_samp(c) for c, _ in cells.values()]).first(), strict=True))
    ratios = [n for n, (_, below) in cells.items() if below is not None]
    medians = dict(zip(ratios, quantile_values(df, [cells[n][1] for n in ratios], [0.5]), strict=True))
    wide = lambda n: n not in medians or (medians[n][0] > 0 and medians[n][1][0] >= 1e-8)
    kept = [n for n in cells if (stds[n] or 0.0) >= 1e-12 and wide(n)][:28]
    return df.withColumns({n: cells[n][0] for n in kept}) if kept else df, kept


def accept_engineered(names: Sequence[str], features: Sequence[str], score: Score, tol: float = 0.005, most: int = 5) -> tuple[list[str], list[str]]:
    """Features with the engineered columns that each raise the score by more than ``tol``."""
    chosen, best = list(features), score(list(features))
    added: list[str] = []
    while len(added) < most:
        options = [n for n in names if n not in chosen]
        ahead(score, [[*chosen, n] for n in options])
        top, top_score = None, None
        for n in options:
            s = score([*chosen, n])
            if s is not None and beats(s, top_score, 0.0):
                top, top_score = n, s
        if top is None or not beats(top_score, best, tol):
            break
        chosen, best, added = [*chosen, top], top_score, [*added, top]
    return chosen, added


def parse_selection(reply: dict | None, pool: Sequence[str], most: int = 12) -> tuple[list[str], str]:
    """Features of a reply that are in the pool, each once; the pool's first six without any."""
    reason = str((reply or {}).get("reasoning") or "").strip() if isinstance(reply, dict) else ""
    raw = reply.get("features") if isinstance(reply, dict) else None
    names = [n for n in dict.fromkeys(str(x).strip() for x in raw) if n in set(pool)][:most] if isinstance(raw, list) else []
    return (names, reason) if names else (list(pool[: min(6, most)]), reason or "the first columns of the ranked pool")
