"""Operator 8: quality rules by gradient-boosted trees over document statistics.

The trees are fitted here on a bounded sample of labelled rows (SAMPLE), with histograms of each feature, Newton steps on the logistic
loss and monotonic constraints: along a constrained feature a split is only taken if its sides are in order, and the sides' values are
bounded by the middle from then on, so the whole score is monotonic. For scoring the trees are flattened into arrays of nodes and
all rows of a batch step down all trees together.

Nulls: a null text has no words and so fails the base rules; a null doc_id is returned as null and is never a labelled row. If a
doc_id has several labels the largest counts. Repeated rows are scored alike; without labelled rows of both kinds the trees are empty and
only the base rules decide; an empty table gives an empty one. Columns other than doc_id, the text and the label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, settle, table
from tessella.llm.docstats import COUNTS, FEATURES, feature_rows, labelled_sample, measured

#: Labelled rows that are fitted on at most, and the least probability of quality that is kept.
SAMPLE, KEEP = 20_000, 0.3
#: +1: the score may not fall along the feature, -1: not rise.
MONOTONE = {"symbols_a_word": -1, "repeat_share": -1, "dup_line_share": -1, "sign_end_share": -1, "pipe_share": -1, "shout_share": -1, "adjacent_share": -1}


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child, roots are where the trees begin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    nodes: list[list[float]] = []
    if len(y) == 0 or y.min() == y.max():
        return Trees(*(np.zeros(0, int), np.zeros(0)) * 2, np.zeros(0), np.zeros(0, int), 0.0, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, roots = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-G / (H + ridge), low, high))
        nodes.append([0, 0.0, at, at, value * rate])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(x.shape[1]) if level < depth else ():
            if not len(cuts[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((G - gl) * vr + 0.5 * (H - hl + ridge) * vr**2) + (G * value + 0.5 * (H + ridge) * value**2)
            gain[(hl < least) | (H - hl < least) | (monotone[f] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k, vl[k], vr[k])
        if best[1] < 0:
            score[rows] += value * rate
            return at
        _, f, k, vl, vr = best
        middle, goes = (vl + vr) / 2, binned[rows, f] <= k
        sides = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
        left = grow(rows[goes], g, h, *sides[0], level + 1)
        right = grow(rows[~goes], g, h, *sides[1], level + 1)
        nodes[at] = [f, cuts[f][k], left, right, 0.0]
        return at

    everything = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(everything, p - y, p * (1 - p), -np.inf, np.inf, 0))
    n = np.array(nodes)
    return Trees(n[:, 0].astype(int), n[:, 1], n[:, 2].astype(int), n[:, 3].astype(int), n[:, 4], np.array(roots), base, depth)


def _judge(trees: Trees, keep: float):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = feature_rows(batch)
        n, repeats = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
        failed, p = (n < 50) | (100 * repeats > 50 * n), trees.probability(x)
        columns = [batch.column("doc_id"), *(batch.column(c) for c in COUNTS if c != "n_words"), batch.column("n_words")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)], names=["doc_id", *(c for c in COUNTS if c != "n_words"), "n_words", "base_failed", "kept", "quality_score"])

    return step


def judge(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept and the trees' probability of quality."""
    stats = settle(measured(documents))
    x, y = labelled_sample(stats, labels, sample)
    trees = fit(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS if c != "n_words") + ", n_words long, base_failed boolean, kept boolean, quality_score double"
    return map_arrow(stats, _judge, schema, trees, keep)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
