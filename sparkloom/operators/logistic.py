"""Logistic regression by full-batch gradient descent, without scaling and without a convergence test: models as
expressions, fits and scores of feature subsets (see descent, where all of them advance together)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import sigmoid
from .descent import HERE_CELLS, STEPS, TRAIN, UNUSED, VALIDATE, Rows, fitted
from .descent import candidate_scores as scored
from .gram import REPEATS, fold_bucket
from .gram import TRAIN as TRAIN_SHARE
from .gram import VALIDATE as VALIDATE_SHARE


def probability(weights: Sequence[float], features: Sequence[str]) -> Column:
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        z = z + F.lit(float(w)) * F.col(f"`{f}`").cast("double")
    return sigmoid(z)


def one_vs_rest(models: dict[str, Sequence[float]], features: Sequence[str]) -> Column:
    """The label of the highest share, by one model for each label; the first of equals."""
    labels = list(models)
    cells = F.array(*[probability(models[k], features) for k in labels])
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(cells, F.array_max(cells)).cast("int"))


def fold_roles(repeats: int = REPEATS):
    """Each row's role in each holdout repeat, by hash of its values."""

    def of(names: list[str]) -> list[Column]:
        bucket = [fold_bucket(r, *names) for r in range(repeats)]
        return [F.when(b < TRAIN_SHARE, TRAIN).when(b < VALIDATE_SHARE, VALIDATE).otherwise(UNUSED) for b in bucket]

    return of


def candidate_scores(df: DataFrame, subsets: Sequence[Sequence[str]], target: str, repeats: int = REPEATS, steps: int = STEPS, here_cells: int = HERE_CELLS) -> DataFrame:
    """(candidate, f1_macro, accuracy): mean over holdout repeats of each feature subset that can be scored. Rows with a
    missing value in any of the features are left out of all."""
    names = sorted({f for s in subsets for f in s})
    masks = np.array([[1.0] * len(subsets), *[[float(f in s) for s in map(set, subsets)] for f in names]])
    found = scored(Rows(df, names, target, fold_roles(repeats)), masks, steps, here_cells)
    rows = [(i, float(f1), float(accuracy)) for i, (f1, accuracy) in enumerate(found) if not np.isnan(f1)]
    return df.sparkSession.createDataFrame(rows, "candidate int, f1_macro double, accuracy double")


def fit(train: DataFrame, features: Sequence[str], target: str, steps: int = STEPS, here_cells: int = HERE_CELLS) -> tuple[dict[str, np.ndarray], list[str], float]:
    """Models of all rows of train: weights by label (of two labels the larger one's only), the labels in order, the threshold."""
    rows = Rows(train, features, target, [F.lit(TRAIN)])
    models, threshold = fitted(rows, steps, here_cells)
    return models, rows.labels, threshold


def predicted(rows: DataFrame, features: Sequence[str], target: str, models: dict[str, np.ndarray], labels: Sequence[str], threshold: float) -> DataFrame:
    """rows with y_true, y_pred and y_prob."""
    y = F.col(f"`{target}`").cast("string").alias("y_true")
    if len(labels) > 2:
        return rows.select("*", y, one_vs_rest(models, features).alias("y_pred"), F.lit(None).cast("double").alias("y_prob"))
    p = probability(models[labels[1]], features)
    return rows.select("*", y, F.when(p >= threshold, labels[1]).otherwise(labels[0]).alias("y_pred"), p.alias("y_prob"))
