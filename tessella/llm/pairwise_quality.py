"""Operator 10: quality by Bradley-Terry pairwise ranking.

A document's worth is linear in its statistics. Preference pairs set a row of label 1 above one of label 0; the logistic loss of the
differences of their features is minimised by Newton steps, whose sums are made where the rows are. The cut is the quantile of the worths of the fitting rows that leaves out as many
of them as have label 0; the score is a logistic function of the worth that is CUT at that quantile.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, and from all of these. They are dealt to chunks by the hash of doc_id, and a chunk
has EACH pairs for each of its rows, a row of either label drawn for each; so pairs grow with the rows, not with their square. Nulls: a null
text is scored as the empty one; a null doc_id is returned as null, is not held out and has no label. If a doc_id has several labels the
largest counts. Repeated rows and ties get equal scores; without labels of both kinds each score is 0.5; an empty table gives an
empty one. Columns other than doc_id, the text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, settle, table
from tessella.llm.docstats import FEATURES, feature_rows, labelled, measured

#: Rows of a chunk about, those of the rarer label at least, and pairs a row; pairs that are worked on at a time; the most tasks of a fit; values that the driver may sort.
CHUNK, RARE, EACH, PAIRS, TASKS, FEW, CUT = 2_500, 20, 20, 60_000, 200, 5_000, 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def expand(x: np.ndarray) -> np.ndarray:
    """The statistics, their square roots (shares near 0 differ more) and whether they are 0."""
    return np.hstack([x, np.sqrt(np.abs(x)), x == 0])


#: The sum of what a function of (features, labels, seed) gives for each chunk, as a list of arrays.
Total = Callable[[Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]], list[np.ndarray]]


class Worth:
    """worth(x) = weights . standardised x; cut is the worth of which the score is CUT. pairs: how many are worked on at a time."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int, ridge: float = 1.0, seed: int = 7):
        self.fit(lambda work: work(x, y, seed), pairs, ridge)
        if self.weights is not None:
            self.cut = float(np.quantile(self.worth(x), (y == 0).sum() / len(y)))

    @classmethod
    def of(cls, rows: DataFrame) -> Worth:
        """The fit to all of rows(doc_id, features, label), of which only sums come to the driver."""
        out = cls.__new__(cls)
        counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n, rare = sum(counts.values()), min(counts.get(0, 0), counts.get(1, 0))
        chunks = max(1, min(-(-n // CHUNK), rare // RARE))
        tasks = min(TASKS, chunks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "features", F.col("label").cast("int").alias("label"))
        dealt = settle(dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk"))
        out.fit(lambda work: _total(dealt, work), PAIRS)
        if out.weights is not None:
            out.cut = quantile(settle(map_arrow(dealt.select("features"), _worths, "value double", out)), counts[0] / n)
        return out

    def fit(self, total: Total, pairs: int, ridge: float = 1.0) -> None:
        self.weights = None
        n, good, first = total(lambda x, y, seed: [np.array(len(y)), np.array((y == 1).sum()), expand(x).sum(0)])
        if not 0 < good < n:
            return
        self.mean = mean = first / n
        self.scale = scale = np.sqrt(total(lambda x, y, seed: [((expand(x) - mean) ** 2).sum(0)])[0] / n) + 1e-9
        w = np.zeros(len(mean))
        for _ in range(25):
            slope, bend = total(_slopes(mean, scale, w, pairs))
            step = np.linalg.solve(bend + ridge * np.eye(len(w)), slope - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        above = self.worth(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(above + np.log(CUT / (1 - CUT)), -30, 30)))


def _slopes(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, pairs: int):
    """The gradient and the second derivatives of the loss of a chunk's pairs."""

    def work(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
        slope, bend = np.zeros(len(w)), np.zeros((len(w), len(w)))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            z, rng = (expand(x) - mean) / scale, np.random.default_rng(seed)
            above, below = rng.choice(good, EACH * len(y)), rng.choice(bad, EACH * len(y))
            for at in range(0, len(above), pairs):
                d = z[above[at : at + pairs]] - z[below[at : at + pairs]]
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                slope, bend = slope + d.T @ (1 - p), bend + (d * (p * (1 - p))[:, None]).T @ d
        return [slope, bend]

    return work


def _total(dealt: DataFrame, work: Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums of work over the chunks: a row of numbers a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, chunk, held = None, None, []

        def add() -> None:
            nonlocal sums
            x, y = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((y, *x.T[::-1]))  # the fit does not rest on the order of rows
            found = work(x[order], y[order], 7 + chunk)
            sums = found if sums is None else [a + b for a, b in zip(sums, found)]

        for batch in batches:
            of, x, y = batch.column("chunk").to_numpy(), feature_rows(batch), batch.column("label").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)].tolist() if len(of) else []
            for a, b in zip(edges, edges[1:]):
                if int(of[a]) != chunk and held:
                    add()
                    held = []
                chunk = int(of[a])
                held.append((x[a:b], y[a:b]))
        if held:
            add()
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(s, float).tobytes()], pa.binary()) for s in sums], names=names)

    shapes = [np.shape(s) for s in work(np.zeros((0, len(FEATURES))), np.zeros(0, int), 0)]
    names = [f"s{k}" for k in range(len(shapes))]
    rows = dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return [sum((np.frombuffer(r[k]).reshape(shape) for r in rows), np.zeros(shape)) for k, shape in enumerate(shapes)]


def _worths(worth: Worth):
    return lambda batch: pa.RecordBatch.from_arrays([pa.array(worth.worth(feature_rows(batch)))], names=["value"])


def ranked(values: DataFrame, k: int) -> float:
    """The value that k others come before, from the counts of ever narrower stretches; the driver gets counts and no more than FEW values."""
    while True:
        n, low, high = values.agg(F.count("*"), F.min("value"), F.max("value")).first()
        if n <= FEW:
            return sorted(r.value for r in values.collect())[k]
        width = (high - low) / 1000
        if not width:
            return low
        part = F.floor((F.col("value") - low) / width)
        for at, many in sorted((r.part, r.n) for r in values.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
            if k < many:
                break
            k -= many
        values = values.where(part == at)


def quantile(values: DataFrame, share: float) -> float:
    """np.quantile of all values."""
    at = share * (values.count() - 1)
    low = int(at)
    first = ranked(values, low)
    return first if low == at else first + (at - low) * (ranked(values, low + 1) - first)


def _score(worth: Worth):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = feature_rows(batch)
        score = worth.score(x)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return step


def rank(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    held = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    stats = settle(measured(documents))
    worth = Worth.of(labelled(stats, labels.where(~held(F.col("doc_id").cast("long")))))
    return map_arrow(stats.select("doc_id", "features", held(F.col("doc_id")).alias("held_out")), _score, SCHEMA, worth)


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
