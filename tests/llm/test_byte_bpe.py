"""Encoding and decoding against the tokenizers library."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from tessella.llm import byte_bpe

MODEL, LIBRARY = byte_bpe.load(byte_bpe.default_path()), Tokenizer.from_file(byte_bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12) | st.sampled_from(["<|endoftext|>", "  ", "the", "'s", "é", "日本", "\U0001f600"]), max_size=8).map("".join))
def test_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert MODEL.encode(text) == ids
    assert MODEL.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_in_step_equals_one_by_one():
    words = [bytes([97 + i * j % 26 for j in range(1, 2 + i % 40)]) for i in range(4000)]
    assert MODEL.merge_many(words) == [MODEL.merge(w) for w in words]


def test_query_rows(spark):
    texts = [None, "", "one two", "one two", "aé" * 30_000, "x" * 50_000]
    df = spark.createDataFrame([Row(doc_id=None if i == 1 else i, text=t, ids_sha256="clash") for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string")
    for row, text in zip(byte_bpe.round_trip(df).collect(), texts):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.round_trip(df.limit(0)).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert [r.decoded for r in back] == texts


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some text", "v", 3, "x"), (2, None, "v", 3, "x")], "doc_id long, text string, `Value` string, value_ int, `a.b` string")
    out = byte_bpe.decode(byte_bpe.encode(df))
    assert out.columns == [*df.columns, "token_ids", "decoded"] and [tuple(r)[:5] for r in out.collect()] == [tuple(r) for r in df.collect()]
    again = byte_bpe.encode(byte_bpe.encode(df), to="token_ids")
    assert again.columns == [*df.columns, "token_ids"] and [r.token_ids for r in again.collect()] == [MODEL.encode("some text"), None]


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = byte_bpe.op2_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
