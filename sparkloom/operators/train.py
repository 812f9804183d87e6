"""Training: least squares or logistic models on a chosen target, scored on held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import finite, numeric_columns
from . import select as sel
from .gram import Grams, grams
from .descent import HERE_CELLS
from .logistic import candidate_scores, fit, predicted
from .metrics import Score, beats, classification_scores, first_of, problem_type, regression_scores

#: Rows that a model needs, and test rows that it is judged on at least.
LEAST_ROWS, LEAST_TEST = 30, 10
ITERATIONS = 5
#: Features of a pool whose subsets are all scored pivot by pivot.
SWEPT = 14


def usable(df: DataFrame, target: str, features: Sequence[str], numeric_target: bool = True) -> DataFrame:
    y = F.col(f"`{target}`")
    return df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in features], (finite(y.cast("double")) if numeric_target else y.cast("string")).alias("y_true")).dropna()


def with_split(df: DataFrame, features: Sequence[str], least: int = LEAST_TEST) -> DataFrame:
    """Four fifths train, the rest test, by hash of the row's values; of a small table at least ``least`` rows test."""
    draw = F.xxhash64(*[f"`{f}`" for f in features], "y_true", F.lit(42))
    test = F.pmod(draw, F.lit(5)) == 4
    if df.where(test).limit(least).count() < least:
        last = df.select(draw.alias("draw")).orderBy(F.desc("draw")).limit(least).agg(F.min("draw")).first()[0]
        test = draw >= F.lit(last)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def train_linear(df: DataFrame, target: str, features: Sequence[str]) -> dict:
    """Scores on the test rows, coefficients by size, and a DataFrame of predictions for all rows."""
    work = with_split(usable(df, target, features), features)
    n = {r["split"]: r["count"] for r in work.groupBy("split").count().collect()}
    if sum(n.values()) < LEAST_ROWS:
        raise ValueError("a linear model needs 30 rows without missing values")
    roles = F.array(F.when(F.col("split") == "train", "train").otherwise("validate"))
    g = grams(work.select(*[f"`{f}`" for f in features], F.col("y_true"), "split"), list(features), "y_true", roles=roles)
    intercept, slopes = g.coefficients(list(features))
    said = F.lit(intercept) + sum((F.lit(slopes[f]) * F.col(f"`{f}`") for f in features), F.lit(0.0))
    predictions = work.select("y_true", said.alias("y_pred"), "split")
    scores = regression_scores(predictions.where("split = 'test'"), "y_true", "y_pred").first()
    return {
        "model_type": "linear_regression", "problem_type": "regression", "target_column": target, "feature_columns": list(features),
        "rows_used": sum(n.values()), "train_rows": n.get("train", 0), "test_rows": n.get("test", 0), "metrics": scores.asDict(), "intercept": intercept,
        "coefficients": [{"feature": f, "coefficient": c} for f, c in sorted(slopes.items(), key=lambda x: -abs(x[1]))],
        "predictions": predictions, "sample_predictions": [r.asDict() for r in predictions.limit(20).collect()],
    }


def train_logistic(df: DataFrame, target: str, features: Sequence[str], here_cells: int = HERE_CELLS) -> dict:
    """One model for two labels (the larger is positive, the threshold swept on the training rows), else one for each."""
    work = with_split(usable(df, target, features, numeric_target=False), features)
    n = {r["split"]: r["count"] for r in work.groupBy("split").count().collect()}
    if sum(n.values()) < LEAST_ROWS:
        raise ValueError("a logistic model needs 30 rows without missing values")
    coded = work.select(*[f"`{f}`" for f in features], F.col("y_true").cast(df.schema[target].dataType).alias("__label"), "split")
    train_rows = coded.where("split = 'train'")
    if train_rows.select("__label").distinct().limit(2).count() < 2:
        raise ValueError("the training rows hold one class only")
    models, labels, threshold = fit(train_rows, features, "__label", here_cells=here_cells)
    predictions = predicted(coded, features, "__label", models, labels, threshold).select("y_true", "y_pred", "y_prob", "split")
    scores = classification_scores(predictions.where("split = 'test'"), "y_true", "y_pred").first()
    return {
        "model_type": "logistic_regression", "problem_type": "classification", "target_column": target, "feature_columns": list(features), "classes": labels,
        "rows_used": sum(n.values()), "train_rows": n.get("train", 0), "test_rows": n.get("test", 0), "metrics": {"accuracy": scores["accuracy"], "f1": scores["f1_macro"]},
        "coefficients": [], "predictions": predictions, "sample_predictions": [r.asDict() for r in predictions.limit(20).collect()],
    }


class Scorer:
    """Mean holdout score of feature subsets: R² from one Gram scan for regression, macro-F1 with accuracy for classes,
    where subsets that are asked for together are fitted in one descent."""

    def __init__(self, df: DataFrame, target: str, features: Sequence[str], kind: str):
        self.kind, self.df, self.target = kind, df, target
        self.grams: Grams | None = grams(df, list(features), target) if kind == "regression" else None
        self.seen: dict[tuple[str, ...], Score | None] = {}

    def many(self, subsets: Sequence[Sequence[str]]) -> None:
        """Score subsets together."""
        new = [s for s in dict.fromkeys(map(tuple, subsets)) if s and s not in self.seen]
        if self.kind == "classification" and new:
            found = {r["candidate"]: (r["f1_macro"], r["accuracy"]) for r in candidate_scores(self.df, new, self.target).collect()}
            self.seen |= {s: found.get(i) for i, s in enumerate(new)}
        elif self.grams is not None and len(new) > 2 * len(pool := [f for f in self.grams.columns if any(f in s for s in new)]) and len(pool) <= SWEPT:
            found = self.grams.subset_scores(pool, max(map(len, new)))
            order = {f: i for i, f in enumerate(pool)}
            self.seen |= {s: found[key] for s in new if (key := tuple(sorted(s, key=order.__getitem__))) in found}

    def __call__(self, features: list[str]) -> Score | None:
        key = tuple(features)
        if key not in self.seen:
            if self.grams is not None:
                self.seen[key] = self.grams.score(features)
            else:
                self.many([features])
        return self.seen.get(key)


def kind_of(df: DataFrame, target: str) -> str:
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    return "classification" if problem_type(df, target, numeric).first()["is_classification"] else "regression"


Ask = Callable[[str], dict | None]


def choose_target(df: DataFrame, ask: Ask | None = None) -> tuple[str, list[str], dict]:
    """The model's choice if it stands up to the rules, else the heuristic one."""
    reply = ask("Choose a numeric target and its features; columns: " + ", ".join(numeric_columns(df))) if ask else None
    if isinstance(reply, dict):
        target = str(reply.get("target", "")).strip()
        if target in numeric_columns(df):
            pool = sel.agent_pool(df, target)
            raw = reply.get("features")
            named = [str(f).strip() for f in raw] if isinstance(raw, list) else []
            features = [f for f in dict.fromkeys(named) if f in pool]
            if len(features) >= 2 and not sel.id_name(target):
                return target, sel.ranked(df, target, features)[:12], {"source": "model"}
    target, features, facts = sel.heuristic_target(df, lambda pool, t: grams(df, list(pool), t))
    return target, features, facts | {"source": "heuristic"}


def agent_loop(df: DataFrame, target: str, pool: Sequence[str], kind: str, ask: Ask, iterations: int = ITERATIONS) -> tuple[list[dict], int]:
    """Rounds of proposals by the model, each scored on the same folds, with ablations; and the index of the best."""
    score, log = Scorer(df, target, pool, kind), []
    for i in range(1, iterations + 1):
        prompt = f"Round {i} of {iterations}. Target {target} ({kind}). Pool: {', '.join(pool)}. Before: {[(x['features'], x['score']) for x in log]}"
        features, reason = sel.parse_selection(ask(prompt), pool)
        score.many([features, *[[f for f in features if f != x] for x in features]])
        found = score(features)
        log.append({"iteration": i, "features": features, "score": None if found is None else first_of(found), "reasoning": reason, "feature_ablation": sel.ablation(features, score)})
        if isinstance(found, tuple):
            log[-1]["validation_accuracy"] = found[1]
    best, best_score = 0, score(log[0]["features"])
    for k, line in enumerate(log):
        found = score(line["features"])
        if found is not None and beats(found, best_score, 0.0):
            best, best_score = k, found
    return log, best


def train(df: DataFrame, ask: Ask | None = None, target: str | None = None, agent: bool = False) -> dict:
    """Target, features, engineered columns, subset and model, in that order."""
    if target is None:
        target, features, facts = choose_target(df, ask)
    else:
        features, facts = sel.agent_pool(df, target)[:12], {"source": "given"}
    kind = kind_of(df, target)
    features = sel.ranked(df, target, features)
    if ask is not None:
        reply = ask(f"Propose pairs of features to combine for {target}: {', '.join(features)}")
        proposals = reply.get("candidates") if isinstance(reply, dict) else None
        df, made = sel.engineered(df, proposals if isinstance(proposals, list) else [], features, df.columns)
        if made:
            features, added = sel.accept_engineered(made, features, Scorer(df, target, [*features, *made], kind), tol=0.005 if kind == "regression" else 0.002)
            facts["engineered"] = added
    if agent and ask is not None:
        pool = list(dict.fromkeys([*features, *sel.agent_pool(df, target)]))[:28]
        log, best = agent_loop(df, target, pool, kind, ask)
        score = Scorer(df, target, pool, kind)
        chosen, _ = sel.pair_champion(pool, score, log[best]["features"])
        chosen, _, facts["winner"] = sel.champion_or_subset(pool, score, chosen)
        facts |= {"iterations": log, "best_iteration": best}
    else:
        score, regression = Scorer(df, target, features, kind), kind == "regression"
        grown, facts["growth"] = sel.grow(features, score, df.count(), 0.005 if regression else 1e-6, stop_early=regression)
        chosen, facts["subset_score"], facts["history"], facts["search"] = sel.best_subset(grown, score, tol=0.001 if regression else 1e-6)
        chosen = chosen or features
    result = (train_linear if kind == "regression" else train_logistic)(df, target, chosen)
    held_out = Scorer(df, target, chosen, kind)(list(chosen))
    if held_out is not None:
        result["metrics"]["r2" if kind == "regression" else "f1"] = first_of(held_out)
    return result | {"selection": facts}


__all__ = ["Ask", "Scorer", "agent_loop", "choose_target", "kind_of", "train", "train_linear", "train_logistic"]
