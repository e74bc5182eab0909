"""Removed bytes against brute force over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from tessella.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.01"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(d, cover) if not c)
        out.append((len(d), int(cover.sum()), int((cover[:-1] & ~np.r_[False, cover[:-2]]).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], 400)))
    rows = sd.op5_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and any(r.n_removed for r in rows)


@pytest.mark.parametrize("bucket", [20, 1_000_000])
def test_edges(spark, monkeypatch, bucket):
    monkeypatch.setattr(sd, "BUCKET", bucket)  # small buckets: equal suffixes cross boundaries
    random.seed(bucket)
    pool = ["".join(random.choices("abcé ", k=random.randrange(5, 90))) for _ in range(12)]
    texts = ["".join(random.choices(pool, k=random.randrange(1, 8))) for _ in range(60)] + [None, "", "a" * 3000, "ab" * 900, pool[0] * 3, pool[0] * 3]
    df = spark.createDataFrame([Row(doc_id=None if i % 9 == 0 else i, text=t, rid="clash", at=1) for i, t in enumerate(texts)], "doc_id long, text string, rid string, at int")
    rows = sd.dedup(df, 40, 24).collect()
    want = [(None if i % 9 == 0 else i, *w) for i, w in enumerate(brute(texts, 40))]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert sd.dedup(df.limit(0)).count() == 0


def joined_rows(df):
    """Rows that the joins of a plan made when it ran."""
    plan, rows = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if "Adaptive" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        for x in inner:
            walk(x)

    walk(plan)
    return rows


def test_only_rims_of_buckets_are_joined(spark, monkeypatch):
    """What stands at the ends of two buckets is joined to three suffixes of a bucket, at most, not to all that repeat."""
    monkeypatch.setattr(sd, "BUCKET", 1000)
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, rng.randrange(40)]), rng.choice([1, 1, 2, rng.randrange(10**6)]), i, 0, 1) for i in range(20_000)]
    ones, boths = Counter(r[0] for r in rows), Counter(r[:2] for r in rows)
    classes = Counter(a for a, _ in boths)
    out = sd.repeated(spark.createDataFrame(rows, sd.SUFFIX), len(rows))
    got = {r.rid: r for r in out.collect()}
    assert {i: g.both for i, g in got.items()} == {i: boths[a, b] > 1 for a, b, i, *_ in rows if ones[a] > 1}
    speak = {(a, b) for a, b, i, *_ in rows if i in got and got[i].open}
    assert speak >= {x for x in boths if ones[x[0]] > 1 and (boths[x] == 1 or classes[x[0]] > 1)}
    made = joined_rows(out)
    assert made and sum(made) <= 2 * 3 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 20)


def test_windows_leave_in_pieces():
    """However many windows a batch of texts has."""
    text = "".join(random.choices("abc", k=20_000))
    groups = [{"at": a, "n": 100} for a in range(0, 19_600, 100)]
    batch = pa.RecordBatch.from_pylist([{"rid": k, "text": text, "groups": groups} for k in range(20)])
    pieces = [b.num_rows for b in sd._windows(400)(iter([batch]))]
    assert sum(pieces) == 20 * 19_600 and max(pieces) <= sd.PIECE + 100


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 50, 60_000), rng.integers(0, 2000, 60_000)]
    order = sd.multikey_quicksort(tokens)
    assert sorted(zip(*(t.tolist() for t in tokens))) == list(zip(*(t[order].tolist() for t in tokens)))


def test_strings_that_polynomials_confuse(spark):
    """Two strings of 512 bytes that any polynomial modulo 2^64 takes for one (Thue and Morse), and what they share."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = ["x" * 30 + one, two + "y" * 30, one[:512], two[:512]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, sd.dedup(df).collect())) == [(i, *w) for i, w in enumerate(brute(texts, 400))]


def test_rows_behind_a_shuffle(spark):
    """Row ids hold when another scan would deal the rows otherwise; ids as large as they get."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, sd.dedup(docs).collect()))
    assert sorted(map(tuple, sd.dedup(docs.repartition(7).dropDuplicates(["doc_id"])).collect())) == want


def test_stripped_keeps_columns(spark):
    words = " ".join(f"w{i}" for i in range(200))
    texts = ["head " + words, words + " é tail", None, "", "short", "short"]
    df = spark.createDataFrame([(2**63 - 1 if i == 0 else i, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)], "doc_id long, text string, rid string, left_text string, `left` string, spans string, `a.b` string")
    rows = sd.stripped(df).collect()
    assert df.columns == sd.stripped(df).columns and {tuple(r)[2:] for r in rows} == {("a", "b", "c", "d", "e")}
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted([(2**63 - 1, "head "), (1, " é tail"), (2, None), (3, ""), (4, "short"), (5, "short")], key=str)
    assert sd.stripped(df.limit(0)).count() == 0
