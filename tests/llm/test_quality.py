"""Statistics against a plain version, the trees' constraints, and held-out accuracy."""

import re
import zlib

import numpy as np
from pyspark.sql import Row

from tessella.llm import boosted_rules, pairwise_quality
from tessella.llm.docstats import FEATURES, measure

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_statistics():
    for text in ["", " \n\t", "a b c a b c", "é#x |y\né#x |y\n\nz", "a a a a", "one\x85two\xa0three\x1cfour"]:
        assert measure(text)[0] == plain(text)


def test_trees_are_monotonic():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.3 * rng.standard_normal(2000) > 0.6).astype(int)
    trees = boosted_rules.fit(x, y, np.array([1, -1, 0]))
    for f, sign in ((0, 1), (1, -1)):
        probe = np.tile(x[:50, None], (1, 40, 1))
        probe[:, :, f] = np.linspace(0, 1, 40)
        assert (sign * np.diff(trees.raw(probe.reshape(-1, 3)).reshape(50, 40)) >= -1e-12).all()
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.75


def edge_rows(spark):
    texts = [None, "", "word " * 60, "word " * 60, "Fine words here " * 30_000]
    return spark.createDataFrame([Row(doc_id=None if i == 1 else i, text=t, features="clash", label=1) for i, t in enumerate(texts)], "doc_id long, text string, features string, label int")


def test_edges(spark):
    df, none = edge_rows(spark), spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for known in (none, labels):
        rows = boosted_rules.judge(df, known).collect()
        assert [r.base_failed for r in rows] == [True] * 5 and not any(r.kept for r in rows)
        assert [0 <= r.score <= 1 for r in pairwise_quality.rank(df, known).collect()] == [True] * 5
    assert boosted_rules.judge(df.limit(0), labels).count() == pairwise_quality.rank(df.limit(0), labels).count() == 0


def walk(trees, x):
    """A row's score, one node after another."""
    total = trees.base
    for at in trees.roots.tolist():
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def labelled(spark, test=lambda d: True):
    """Features and labels of the labelled documents, sorted, and all documents' statistics."""
    docs = {r.doc_id: measure(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted((docs[d][1], y) for d, y in labels.items() if d in docs and y in (0, 1) and test(d))
    return docs, np.array([f for f, _ in rows]), np.array([y for _, y in rows])


def test_quality_rules_equal_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs, x, y = labelled(spark)
    trees = boosted_rules.fit(x, y, np.array([boosted_rules.MONOTONE.get(f, 0) for f in FEATURES]))
    rows = boosted_rules.op8_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs) and 0 < sum(r.kept for r in rows) < len(rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        if len(words) < 2_000:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == plain(texts[r.doc_id] or "")
        p = walk(trees, docs[r.doc_id][1])
        assert abs(p - r.quality_score) < 1e-9 and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality_score >= boosted_rules.KEEP)


def test_pairwise_ranking_equals_plain_version(spark):
    """The weights are the minimum of the loss of the pairs, and the scores follow from them."""
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    docs, x, y = labelled(spark, lambda d: not held(d))
    worth = pairwise_quality.Worth(x, y, pairwise_quality.PAIRS)
    z = (np.hstack([x, np.sqrt(np.abs(x)), x == 0]) - worth.mean) / worth.scale
    rng = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, 20 * len(y))] - z[rng.choice(bad, 20 * len(y))]
    slope = sum(-row / (1 + np.exp(row @ worth.weights)) for row in d) + worth.weights
    assert np.abs(slope).max() < 1e-3
    order = sorted(row @ worth.weights for row in z)
    at = len(bad) / len(y) * (len(order) - 1)
    cut = order[int(at)] + (at - int(at)) * (order[min(int(at) + 1, len(order) - 1)] - order[int(at)])
    for r in pairwise_quality.op10_pairwise_quality(spark, SF).collect():
        f = np.array(docs[r.doc_id][1])
        above = ((np.concatenate([f, np.sqrt(np.abs(f)), f == 0]) - worth.mean) / worth.scale) @ worth.weights - cut
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(above + np.log(3 / 7), -30, 30)))) < 1e-9 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3)


def test_rules_on_held_out_labels(spark):
    """The trees' verdict on labels that they were not fitted on."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    true = {r.doc_id: r.quality for r in labels.where(held).collect()}
    rows = boosted_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(f"not ({held})")).collect()
    judged = [(r.quality_score >= boosted_rules.KEEP, true[r.doc_id] == 1) for r in rows if r.doc_id in true]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) > 0.9


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = pairwise_quality.op10_pairwise_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) / len(held) > 0.9
    kept = [(r.kept, labels[r.doc_id]) for r in boosted_rules.op8_quality_rules(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(p == bool(q) for p, q in kept) / len(kept) > 0.9
    assert len(FEATURES) == len(measure("")[1])
