"""Statistics of documents that the quality operators share."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hashed_sample, map_arrow, prepare, settle, text_column

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the models, computed over whole texts.
FEATURES = ("log_words", "symbols_a_word", "repeat_share", "dup_line_share", "word_length", "capital_share", "digit_share", "mark_share", "pipe_share", "sign_end_share", "shout_share", "distinct_share", "adjacent_share")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    seen = Counter(zip(words, words[1:], words[2:]))
    if len(seen) == len(words) - 2:
        return 0
    covered = np.zeros(len(words), bool)
    twice = np.fromiter((seen[w] > 1 for w in zip(words, words[1:], words[2:])), bool, len(words) - 2)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    words = WORD.findall(text)
    n = len(words)
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    symbols = sum(int(count[ord(c)]) for c in SYMBOLS)
    chars = len(text) - int(count[9:14].sum() + count[32])
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    w, c = max(n, 1), max(chars, 1)
    sign_end = sum(x[-1] in SYMBOLS for x in words)
    shout = sum(len(x) > 1 and x.isupper() for x in words)
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    features = [
        np.log1p(n), symbols / w, repeats / w, dup / max(len(lines), 1), chars / w, int(count[65:91].sum()) / c, int(count[48:58].sum()) / c,
        int(count[33] + count[63]) / w, int(count[124]) / w, sign_end / w, shout / w, len(set(words)) / w, adjacent / w,
    ]
    return [n, chars, symbols, dup, repeats], [float(x) for x in features]


def _measure():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in batch.column(1).to_pylist()]
        counts = np.array([f[0] for f in found], np.int64)
        features = pa.array(np.array([f[1] for f in found], float).ravel())
        lists = pa.ListArray.from_arrays(np.arange(0, len(features) + 1, len(FEATURES), dtype=np.int32), features)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), lists], names=["doc_id", *COUNTS, "features"])

    return step


def feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch, a row each, without a Python object for each number."""
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))


def measured(df: DataFrame) -> DataFrame:
    """doc_id, COUNTS and the features of each row; a null text counts as the empty one."""
    prepare(df.sparkSession)
    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), _measure, SCHEMA)


def labelled(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, features and label of all labelled rows; the largest label of a doc_id counts."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    # both sides are written tables, so a hot partition of the join can be split
    return settle(stats.where("doc_id is not null").select("doc_id", "features").join(settle(known), "doc_id"))


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of `most` labelled rows, a quarter more at most, chosen by the hash of doc_id, on the driver: the only data that a model is fitted on, bounded whatever the size of the corpus."""
    both = labelled(stats, labels, label)
    rows = sorted((r.features, r.label) for r in hashed_sample(both, most, "doc_id").select("features", "label").collect())  # the fit does not rest on the order of partitions
    return np.array([f for f, _ in rows], float).reshape(len(rows), len(FEATURES)), np.array([y for _, y in rows], int)
