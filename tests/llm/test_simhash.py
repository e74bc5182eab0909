"""Fingerprints and components against brute force over all pairs."""

import re

import numpy as np
import xxhash
from pyspark.sql import Row

from tessella.llm import simhash

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius=4):
    """The component of each row by comparing all rows with all."""
    fps = np.array(fps, np.uint64)
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            up[find(i + 1 + int(j))] = find(i)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [plain(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], classes([r.doc_id for r in docs], fps)))
    rows = simhash.op9_simhash(spark, SF).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.fingerprint for r in rows} == {r.doc_id: f"{f:016x}" for r, f in zip(docs, fps)}


def test_forest_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    point = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(12)]))
    found = {(int(a), int(b)) for q, n in simhash.Forest(np.zeros(len(point), np.int64), point).links(4) for a, b in zip(q, n)}
    d = np.bitwise_count(point[:, None] ^ point[None])
    assert found == {(int(a), int(b)) for a, b in zip(*np.where(d <= 4)) if a != b}


def test_edges(spark):
    texts = [None, "", "  \n", "One two three four five", "one TWO three four five", "one TWO three four five", "w " * 40_000, "alone"]
    ids = [None, 5, 3, 9, 8, 8, 4, None]
    df = spark.createDataFrame([Row(doc_id=i, text=t, fp="clash", node=1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, node int")
    rows = simhash.group(df).collect()
    want = sorted(zip(ids, (f"{plain(t):016x}" for t in texts), classes(ids, [plain(t) for t in texts])), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == want
    assert simhash.group(df.limit(0)).count() == 0


def test_ids_that_texts_share(spark):
    """Only fingerprints link: of (7, A), (7, B), (3, B) A is a component of its own. Ids as large as they get."""
    rng = np.random.default_rng(0)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 999, 80)) for _ in range(3)]
    rows = [(7, text[0]), (7, text[1]), (3, text[1]), (2**62 + 5, text[2]), (2**63 - 1, text[2]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.group(df).collect()), key=str)
    assert got == sorted([(7, 7), (7, 3), (3, 3), (2**62 + 5, 2**62 + 5), (2**63 - 1, 2**62 + 5), (None, None)], key=str)
