"""Least squares from Gram matrices: one scan of the table scores any number of feature subsets.

For every holdout repeat and role (train, validate) the products of [1, features, target] are summed in
one pass; a subset's coefficients and its validation error follow from sub-matrices on the driver, whose
size is the number of columns squared. Columns are centred and scaled first, to limit cancellation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite

REPEATS = 4
TRAIN, VALIDATE = 70, 85
#: Rows from which subsets are scored.
LEAST_ROWS = 40


def fold_bucket(repeat: int, *keys: str) -> Column:
    """A number of 0 to 99 for a row and repeat, by hash of the keys (all columns by default)."""
    return F.pmod(F.xxhash64(*keys, F.lit(repeat)), F.lit(100))


def role(bucket: Column) -> Column:
    """What a row with this number does in a repeat."""
    return F.when(bucket < TRAIN, "train").when(bucket < VALIDATE, "validate").otherwise("unused")


#: Pivots after which a fit is built anew, and the share of a feature's variance that the others must leave open.
FRESH, OPEN_SHARE = 64, 1e-7


def _pivoted(a: np.ndarray, k: int) -> np.ndarray:
    """The symmetric matrices [..., n, n] with variable k taken into the fit, or out of it if it is in."""
    d = a[:, k, k][:, None]
    row, column = a[:, k, :] / d, a[:, :, k]
    out = a - column[:, :, None] * row[:, None, :]
    out[:, k, :], out[:, :, k] = row, -column / d
    out[:, k, k] = 1 / d[:, 0]
    return out


def _independent(start: np.ndarray, m: int) -> bool:
    """Whether every feature varies beyond what all others say of it."""
    state = start
    for k in range(1, m + 1):
        if (state[:, k, k] <= OPEN_SHARE * start[:, k, k]).any():
            return False
        state = _pivoted(state, k)
    own, inverse = (np.stack([x[:, k, k] for k in range(1, m + 1)]) for x in (start, state))
    return bool((1 / inverse > OPEN_SHARE * own).all())


@dataclass
class Grams:
    """Sums of products per (repeat, role), over columns [1, *features, target], of standardised values."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    sums: dict[tuple[int, str], np.ndarray]
    rows: int | None = None

    def r2(self, features: list[str], repeat: int) -> float | None:
        """Validation R² of least squares on the features; None without validation rows."""
        train, val = self.sums.get((repeat, "train")), self.sums.get((repeat, "validate"))
        if train is None or val is None or val[0, 0] < 5:
            return None
        at = [0, *(1 + self.columns.index(f) for f in features)]
        y = len(self.columns) + 1
        beta = np.linalg.lstsq(train[np.ix_(at, at)], train[at, y], rcond=None)[0]
        error = val[y, y] - 2 * beta @ val[at, y] + beta @ val[np.ix_(at, at)] @ beta
        total = val[y, y] - val[0, y] ** 2 / val[0, 0]
        if total <= 1e-9 * val[0, 0]:  # standardised values: the target is constant here, but for rounding
            return 0.0
        return float(1 - error / total)

    def score(self, features: list[str]) -> float | None:
        """Mean R² of the repeats; None for too few rows."""
        if self.rows is not None and self.rows < LEAST_ROWS:
            return None
        found = [x for r in range(REPEATS) if (x := self.r2(features, r)) is not None]
        return float(np.mean(found)) if found and features else None

    def subset_scores(self, pool: list[str], most: int) -> dict[tuple[str, ...], float | None]:
        """``score`` of every subset of the pool with up to ``most`` features, in the pool's order.

        Subsets are visited so that each differs from the last by one feature, which one pivot takes in or out
        of the fit. Empty where features are so dependent that pivots would lose digits.
        """
        if self.rows is not None and self.rows < LEAST_ROWS:
            return {}
        used = [r for r in range(REPEATS) if (r, "train") in self.sums and (r, "validate") in self.sums and self.sums[r, "validate"][0, 0] >= 5]
        if not used:
            return {}
        m, y = len(pool), len(pool) + 1
        at = [0, *(1 + self.columns.index(f) for f in pool), len(self.columns) + 1]
        train, val = (np.stack([self.sums[r, role][np.ix_(at, at)] for r in used]) for role in ("train", "validate"))
        total = val[:, y, y] - val[:, 0, y] ** 2 / val[:, 0, 0]
        varies = total > 1e-9 * val[:, 0, 0]
        start = _pivoted(train, 0) if (train[:, 0, 0] > 0).all() else None
        if start is None or not _independent(start, m):
            return {}
        state, out, chosen = start, {}, np.zeros(m, bool)
        for step in range(1, 1 << m):
            bit = (step & -step).bit_length() - 1
            chosen[bit] ^= True
            if step % FRESH:
                state = _pivoted(state, 1 + bit)
            else:  # rounding is not carried on for ever
                state = start
                for k in np.flatnonzero(chosen):
                    state = _pivoted(state, 1 + int(k))
            if chosen.sum() <= most:
                beta = np.where(np.r_[True, chosen], state[:, :y, y], 0.0)
                error = val[:, y, y] - 2 * (beta * val[:, :y, y]).sum(axis=1) + np.einsum("ri,rij,rj->r", beta, val[:, :y, :y], beta)
                r2 = np.where(varies, 1 - error / np.where(varies, total, 1.0), 0.0)
                out[tuple(f for f, c in zip(pool, chosen, strict=True) if c)] = float(r2.mean())
        return out

    def coefficients(self, features: list[str], role: str = "train", repeat: int = 0) -> tuple[float, dict[str, float]]:
        """Intercept and slopes in the table's own units."""
        g = self.sums[(repeat, role)]
        at = [0, *(1 + self.columns.index(f) for f in features)]
        y = len(self.columns) + 1
        beta = np.linalg.lstsq(g[np.ix_(at, at)], g[at, y], rcond=None)[0]
        slopes = {f: float(b * self.scale[-1] / self.scale[self.columns.index(f)]) for f, b in zip(features, beta[1:], strict=True)}
        intercept = beta[0] * self.scale[-1] + self.mean[-1] - sum(slopes[f] * self.mean[self.columns.index(f)] for f in features)
        return float(intercept), slopes


def grams(df: DataFrame, features: list[str], target: str, repeats: int = REPEATS, roles: Column | None = None) -> Grams:
    """One scan for means and spreads, one for all sums. ``roles`` may give each row's array of roles by repeat."""
    names = [*features, target]
    work = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(names)], *([roles.alias("roles")] if roles is not None else [])).dropna()
    if roles is None:
        cells = [f"c{i}" for i in range(len(names))]
        of = [role(fold_bucket(r, *cells)) for r in range(repeats)]
        work = work.withColumn("roles", F.array(*of))
    first = work.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(names))], *[F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(len(names))], F.count(F.lit(1)).alias("n")).first()
    k = len(names)
    mean = np.array([first[i] or 0.0 for i in range(k)])
    scale = np.array([first[k + i] or 1.0 for i in range(k)])
    roles_of = ("train", "validate")

    def sums(batches):
        total: dict[tuple[int, str], np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), (pdf[[f"c{i}" for i in range(k)]].to_numpy(float) - mean) / scale])
            given = np.array(pdf["roles"].tolist()).reshape(len(pdf), -1)
            for r in range(given.shape[1]):
                for own_role in roles_of:
                    own = x[given[:, r] == own_role]
                    total[r, own_role] = total.get((r, own_role), 0.0) + own.T @ own
        rows = [(r, own_role, i, j, g[i, j]) for (r, own_role), g in total.items() for i in range(k + 1) for j in range(k + 1)]
        yield pd.DataFrame(rows, columns=["repeat", "role", "i", "j", "v"])

    parts = work.mapInPandas(sums, "repeat int, role string, i int, j int, v double").groupBy("repeat", "role", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[tuple[int, str], np.ndarray] = {}
    for r in parts:
        out.setdefault((r["repeat"], r["role"]), np.zeros((k + 1, k + 1)))[r["i"], r["j"]] = r["v"]
    return Grams(features, mean, scale, out, first["n"])


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
