"""Many logistic models in one gradient descent.

Models differ in the features they use, the holdout repeat whose training rows they see and the label they
tell from the rest; each is a column of one matrix of weights, with zeros for features it doesn't use. A
step multiplies blocks of rows by that matrix, so all models advance together, and the weights travel as
data. Two ways, with the same arithmetic:

* Where all rows are known to be few (by their number and width), every task holds them and descends a share of
  the candidates by itself: one job for any number of steps and candidates.
* Else rows stay in the partitions. Each step is one job that adds up all models' gradients: as many jobs as steps.

Thresholds and scores of all models then come from one pass each: a histogram of training scores over the
thresholds, whose suffix sums are every threshold's confusion matrix, and counts of predicted labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite
from .metrics import THRESHOLDS

STEPS, RATE, L2 = 900, 0.05, 1e-4

#: What a row does in a repeat.
UNUSED, TRAIN, VALIDATE = range(3)

#: Rows of a block, and rows and models of one product (1 MB of scores).
BLOCK, TILE_ROWS, TILE_MODELS = 16384, 512, 256

#: Rows times columns up to which every task may hold all rows (at 8 bytes a cell).
HERE_CELLS = 4_000_000

#: Models that descend together at most, when gradients travel (with 12 features 7 MB of weights).
TOGETHER = 1 << 16

#: Rows, and validation rows, from which a candidate is scored.
LEAST_ROWS, LEAST_VALIDATION = 40, 5


def squash(z: np.ndarray) -> np.ndarray:
    """The sigmoid of new scores, in their place."""
    np.clip(z, -30.0, 30.0, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


@dataclass
class Block:
    """Rows: [1, *features], the label's number, and what the row does in each repeat."""

    x: np.ndarray
    y: np.ndarray
    roles: np.ndarray


@dataclass(frozen=True)
class Group:
    """Models of one repeat: candidates times labels, label by label. ``first`` is their first column."""

    repeat: int
    labels: tuple[int, ...]
    weights: tuple[tuple[float, float], ...]  # of a row with the label, and without it
    first: int

    def columns(self, label: int, candidates: int) -> range:
        start = self.first + label * candidates
        return range(start, start + candidates)


@dataclass(frozen=True)
class Plan:
    candidates: int
    groups: tuple[Group, ...]
    uses: np.ndarray  # [1 + features, models]: 1 where a model uses a feature

    @classmethod
    def of(cls, masks: np.ndarray, counts: np.ndarray) -> Plan:
        """``masks``: [1 + features, candidates]; ``counts``: [repeats, 2, labels] of training and validation rows."""
        groups, first, c = [], 0, masks.shape[1]
        for repeat, (train, held) in enumerate(counts):
            labels = tuple(int(k) for k in np.flatnonzero(train))
            if len(labels) < 2 or held.sum() < LEAST_VALIDATION:
                continue
            own = labels[1:] if len(labels) == 2 else labels
            n = float(train.sum())
            groups.append(Group(repeat, own, tuple((n / (2 * max(float(train[k]), 1.0)), n / (2 * max(n - float(train[k]), 1.0))) for k in own), first))
            first += c * len(own)
        uses = np.concatenate([masks] * sum(len(g.labels) for g in groups), axis=1) if groups else masks[:, :0]
        return cls(c, tuple(groups), uses)

    def totals(self, counts: np.ndarray) -> np.ndarray:
        """The sum of row weights of each model."""
        out = np.empty(self.uses.shape[1])
        for g in self.groups:
            n = counts[g.repeat, 0].sum()
            for i, (k, (with_, without)) in enumerate(zip(g.labels, g.weights, strict=True)):
                out[g.columns(i, self.candidates)] = counts[g.repeat, 0, k] * with_ + (n - counts[g.repeat, 0, k]) * without
        return out


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def gradients(block: Block, plan: Plan, w: np.ndarray) -> np.ndarray:
    """The block's part of every model's gradient, before the row weights' sum divides it."""
    out = np.zeros_like(w)
    for g in plan.groups:
        rows = block.roles[:, g.repeat] == TRAIN
        x, y = block.x[rows], block.y[rows]
        for i, (label, (with_, without)) in enumerate(zip(g.labels, g.weights, strict=True)):
            truth = (y == label).astype(float)[:, None]
            weight = np.where(truth > 0, with_, without)
            models = g.columns(i, plan.candidates)
            for c in _tiles(len(models), TILE_MODELS):
                columns = slice(models.start + c.start, models.start + c.stop)
                for r in _tiles(len(x), TILE_ROWS):
                    miss = squash(x[r] @ w[:, columns])
                    miss -= truth[r]
                    miss *= weight[r]
                    out[:, columns] += x[r].T @ miss
    return out


def label_counts(block: Block, repeats: int, labels: int) -> np.ndarray:
    return np.array([[np.bincount(block.y[block.roles[:, r] == role], minlength=labels) for role in (TRAIN, VALIDATE)] for r in range(repeats)], dtype=float)


def histograms(block: Block, plan: Plan, w: np.ndarray) -> np.ndarray:
    """[models, other or own label, thresholds reached]: training rows, of the groups with one model a candidate."""
    levels = len(THRESHOLDS) + 1
    out = np.zeros((w.shape[1], 2, levels))
    for g in (g for g in plan.groups if len(g.labels) == 1):
        rows = block.roles[:, g.repeat] == TRAIN
        x, own = block.x[rows], (block.y[rows] == g.labels[0]).astype(int)[:, None]
        for c in _tiles(plan.candidates, TILE_MODELS):
            columns = slice(g.first + c.start, g.first + c.stop)
            at = np.arange(c.stop - c.start)[None, :] * 2 * levels
            for r in _tiles(len(x), TILE_ROWS):
                reached = np.searchsorted(THRESHOLDS, squash(x[r] @ w[:, columns]), side="right")
                found = np.bincount((at + own[r] * levels + reached).ravel(), minlength=at.shape[1] * 2 * levels)
                out[columns] += found.reshape(-1, 2, levels)
    return out


def best_thresholds(histogram: np.ndarray) -> np.ndarray:
    """For each model the threshold of best macro-F1, then accuracy; the lowest of equals."""
    said = histogram[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # rows at or above each threshold
    fp, tp = said[:, 0], said[:, 1]
    tn, fn = histogram[:, :1].sum(axis=2) - fp, histogram[:, 1:].sum(axis=2) - tp
    share = lambda hit: 2 * hit / np.maximum(2 * hit + fp + fn, 1)
    labels = (tp + fp + fn > 0).astype(int) + (tn + fp + fn > 0)
    f1, accuracy = (share(tp) + share(tn)) / np.maximum(labels, 1), (tp + tn) / np.maximum(tp + fp + tn + fn, 1)
    n = len(histogram)
    at, best = np.full(n, 0.5), np.full((2, n), -1.0)
    for i, t in enumerate(THRESHOLDS):
        wins = (f1[:, i] > best[0] + 1e-6) | ((np.abs(f1[:, i] - best[0]) <= 1e-6) & (accuracy[:, i] > best[1] + 1e-6))
        at[wins], best[0, wins], best[1, wins] = t, f1[wins, i], accuracy[wins, i]
    return at


def tallies(block: Block, plan: Plan, w: np.ndarray, thresholds: np.ndarray, others: tuple[int, ...], labels: int) -> np.ndarray:
    """[groups, candidates, 3, labels]: validation rows of each label that were hit, that have it, that were said to have it.

    ``others``: for each group of one model the label that is said below the threshold.
    """
    out = np.zeros((len(plan.groups), plan.candidates, 3, labels))
    for k, g in enumerate(plan.groups):
        rows = block.roles[:, g.repeat] == VALIDATE
        x, y = block.x[rows], block.y[rows]
        for c in _tiles(plan.candidates, TILE_MODELS):
            for r in _tiles(len(x), TILE_ROWS):
                p = [squash(x[r] @ w[:, g.first + i * plan.candidates + c.start : g.first + i * plan.candidates + c.stop]) for i in range(len(g.labels))]
                if len(p) == 1:
                    said = np.where(p[0] >= thresholds[g.first + c.start : g.first + c.stop], g.labels[0], others[k])
                else:
                    said = np.array(g.labels)[np.argmax(np.stack(p), axis=0)]
                for label in range(labels):
                    own, told = (y[r] == label)[:, None], said == label
                    out[k, c, 0, label] += (own & told).sum(axis=0)
                    out[k, c, 1, label] += own.sum()
                    out[k, c, 2, label] += told.sum(axis=0)
    return out


def scores(tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Macro-F1 over labels that are there or said, and accuracy, over the last two axes of tallies."""
    hit, own, told = tally[..., 0, :], tally[..., 1, :], tally[..., 2, :]
    there = own + told > 0
    f1 = np.where(there, 2 * hit / np.maximum(own + told, 1), 0).sum(axis=-1) / np.maximum(there.sum(axis=-1), 1)
    return f1, hit.sum(axis=-1) / np.maximum(own.sum(axis=-1), 1)


#: ``total(f, *args)`` adds up f(block, *args) over all blocks.
Total = Callable[..., np.ndarray]


def descend(total: Total, plan: Plan, counts: np.ndarray, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights of all models. Both classes weigh the same in each, intercepts aren't shrunk."""
    w, sums = np.zeros_like(plan.uses), plan.totals(counts)
    shrink = np.full((len(w), 1), l2)
    shrink[0] = 0.0
    for _ in range(steps):
        w -= rate * (total(gradients, plan, w) / sums + shrink * w) * plan.uses
    return w


def _others(plan: Plan, counts: np.ndarray) -> tuple[int, ...]:
    return tuple(int(next(k for k in np.flatnonzero(counts[g.repeat, 0]) if k != g.labels[0])) for g in plan.groups)


def judged(total: Total, masks: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """[candidates, 2]: mean macro-F1 and accuracy of the repeats; NaN where no repeat can be scored."""
    plan = Plan.of(masks, counts)
    if not plan.groups:
        return np.full((masks.shape[1], 2), np.nan)
    w = descend(total, plan, counts, steps)
    thresholds = best_thresholds(total(histograms, plan, w))
    f1, accuracy = scores(total(tallies, plan, w, thresholds, _others(plan, counts), counts.shape[2]))
    return np.stack([f1.mean(axis=0), accuracy.mean(axis=0)], axis=1)


class Rows:
    """The rows of a table in blocks: features that are finite numbers, a label that is there."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, roles: Sequence[Column] | Callable[[list[str]], list[Column]]):
        """``roles``: for each repeat a number (see above), over columns x0, x1, ... and y."""
        kind = df.schema[target].dataType
        cells = [finite(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(features)]
        y = F.col(f"`{target}`")
        table = df.select(*cells, y.cast("string").alias("y"), y.alias("sorted")).dropna()
        found = table.select("sorted", "y").distinct().orderBy("sorted").collect()  # as many as the target has classes
        self.labels, self.kind = [r["y"] for r in found], kind
        names = [*(f"x{i}" for i in range(len(features))), "y"]
        self.roles = roles(names) if callable(roles) else list(roles)
        self.features, self.spark = list(features), df.sparkSession
        code = F.create_map(*[F.lit(v) for i, k in enumerate(self.labels) for v in (k, i)])[F.col("y")] if found else F.lit(0)
        self.table = table.select(*names[:-1], code.cast("int").alias("y"), F.array(*self.roles).alias("roles"))
        self._blocks: RDD | None = None
        self._counts: np.ndarray | None = None

    @property
    def blocks(self) -> RDD:
        if self._blocks is None:
            width = len(self.features)

            def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for i in range(0, len(pdf), BLOCK):
                        part = pdf.iloc[i : i + BLOCK]
                        x = part[[f"x{k}" for k in range(width)]].to_numpy(float)
                        yield pd.DataFrame({"n": [len(part)], "x": [x.tobytes()], "y": [part["y"].to_numpy("<i4").tobytes()], "roles": [np.array(part["roles"].tolist(), "u1").tobytes()]})

            def unpack(r) -> Block:
                x = np.frombuffer(r["x"]).reshape(r["n"], width)
                return Block(np.column_stack([np.ones(r["n"]), x]), np.frombuffer(r["y"], "<i4"), np.frombuffer(r["roles"], "u1").reshape(r["n"], -1))

            self._blocks = self.table.mapInPandas(pack, "n int, x binary, y binary, roles binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        return self._blocks

    def counts(self) -> np.ndarray:
        """[repeats, 2, labels]: training and validation rows."""
        if self._counts is None:
            out = np.zeros((len(self.roles), 2, len(self.labels)))
            each = F.posexplode("roles").alias("repeat", "role")
            for r in self.table.select("y", each).groupBy("repeat", "role", "y").count().where(f"role > {UNUSED}").collect():
                out[r["repeat"], r["role"] - TRAIN, r["y"]] = r["count"]
            self._counts = out
        return self._counts

    def total(self, f: Callable[..., np.ndarray], *args) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(args)
        try:
            return self.blocks.map(lambda b: f(b, *shared.value)).treeReduce(np.add)
        finally:
            shared.destroy()

    def release(self) -> None:
        if self._blocks is not None:
            self._blocks.unpersist()
            self._blocks = None

    def few(self, n: int, cells: int = HERE_CELLS) -> bool:
        return n * (len(self.features) + 1 + len(self.roles)) <= cells


def merged(blocks: Sequence[Block]) -> Block:
    return Block(np.concatenate([b.x for b in blocks]), np.concatenate([b.y for b in blocks]), np.concatenate([b.roles for b in blocks]))


def candidate_scores(rows: Rows, masks: np.ndarray, steps: int = STEPS, here_cells: int = HERE_CELLS) -> np.ndarray:
    """[candidates, 2]: mean macro-F1 and accuracy over the repeats of every subset of features."""
    n = rows.table.count()
    if n < LEAST_ROWS or not masks.shape[1]:
        return np.full((masks.shape[1], 2), np.nan)
    counts = rows.counts()
    try:
        if not rows.few(n, here_cells):
            models = max(1, sum(int((c[0] > 0).sum()) for c in counts))
            return np.concatenate([judged(rows.total, masks[:, part], counts, steps) for part in _tiles(masks.shape[1], max(1, TOGETHER // models))])
        shared = rows.spark.sparkContext.broadcast(merged(rows.blocks.collect()))
    finally:
        rows.release()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = lambda f, *args: f(shared.value, *args)
        for pdf in parts:
            own = pdf["id"].to_numpy()
            found = judged(here, masks[:, own], counts, steps)
            yield pd.DataFrame({"id": own, "f1": found[:, 0], "accuracy": found[:, 1]})

    # every task takes every so-many-th candidate, so that large and small subsets are shared evenly
    tasks = min(masks.shape[1], 2 * rows.spark.sparkContext.defaultParallelism)
    dealt = rows.spark.range(masks.shape[1]).repartition(tasks, F.col("id") % tasks) if masks.shape[1] > 1 else rows.spark.range(1)
    out = np.full((masks.shape[1], 2), np.nan)
    for r in dealt.mapInPandas(run, "id long, f1 double, accuracy double").collect():
        out[r["id"]] = r["f1"], r["accuracy"]
    return out


def fitted(rows: Rows, steps: int = STEPS, here_cells: int = HERE_CELLS) -> tuple[dict[str, np.ndarray], float]:
    """Weights by label, over all features and the training rows of the first repeat, and the threshold of two labels."""
    counts = np.array(rows.counts())
    counts[:, 1] = LEAST_VALIDATION  # nothing is scored here
    plan = Plan.of(np.ones((1 + len(rows.features), 1)), counts)
    n = int(counts[0, 0].sum())

    def both(total: Total) -> tuple[np.ndarray, np.ndarray]:
        w = descend(total, plan, counts, steps)
        return w, best_thresholds(total(histograms, plan, w))

    try:
        if rows.few(n, here_cells):
            own = lambda blocks: [both(lambda f, *args, of=merged(list(blocks)): f(of, *args))]
            w, thresholds = rows.blocks.coalesce(1).mapPartitions(own).first()
        else:
            w, thresholds = both(rows.total)
    finally:
        rows.release()
    labels = plan.groups[0].labels
    return {rows.labels[k]: w[:, i] for i, k in enumerate(labels)}, float(thresholds[0])


