"""Pairs of a source by blocks, on rows that the driver's tables don't have."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.plans import relational

NAMES = ["pairs_current_current", "pairs_current_historical", "allowed_pairs_union"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One large source and small ones; ids and sources that are null, repeated, negative or large."""
    d = str(tmp_path_factory.mktemp("pairs"))
    rows = [(i, "src" if i < 300 else f"s{i % 5}") for i in range(400)]
    rows += [(None, "src"), (None, "s1"), (None, None), (7, None), (3, "src"), (105, "src"), (-7, "src"), (-3, "s1"), (1 << 40, "s2"), (5, "alone")]
    spark.createDataFrame([(i, s, "text") for i, s in rows], "doc_id long, source string, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("block", [4096, 64])
@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, folder, monkeypatch, name, block):
    monkeypatch.setattr(relational, "BLOCK", block, raising=False)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(relational.SQL[name])
    df = relational.QUERIES[name](spark, folder)
    assert [c[0] for c in want.description] == df.columns
    want = Counter(want.fetchall())
    assert Counter(map(tuple, df.collect())) == want and sum(want.values()) > 10_000


@pytest.mark.parametrize("name", NAMES)
def test_a_large_source_is_no_single_task(spark, folder, monkeypatch, name):
    monkeypatch.setattr(relational, "BLOCK", 32, raising=False)
    monkeypatch.setattr(relational, "ROW", 4, raising=False)
    made = [r.n for r in relational.QUERIES[name](spark, folder).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(made) < sum(made) / 5
