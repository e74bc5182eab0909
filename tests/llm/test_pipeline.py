"""run() against plain versions of what the stages do."""

import importlib

import corpus_pipeline
from tests.llm.test_near_copies import left as different
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, decontaminate, language, secrets

SF = "/root/testdata/sf0.01"


def test_run(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = {r.doc_id for r in language.op1_language_id(spark, SF).collect() if r.kept}
    assert len(known) > 0.97 * len(docs)
    single = {d for d, _ in different([(d, docs[d].text) for d in sorted(known)])}
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d for d in single if not any(len((g := decontaminate.shingles(i)) & decontaminate.shingles(decontaminate.words(docs[d].text))) >= 0.8 * len(g) for i in items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left and len(rows) == len(left) < len(single) < len(docs)
    library = Tokenizer.from_file(byte_bpe.default_path())
    for r in rows:
        spans, text = secrets.spans_of(docs[r.doc_id].text), docs[r.doc_id].text
        assert (r.text == text) == (not spans) and not secrets.spans_of(r.text) and r.n_chars == len(r.text)
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids
        assert (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, ties, a long text, and columns with names that the stages use: stage by stage."""
    item = "What is the tall tower of the old town called? The tower is named after its first mason."
    plain = [f"the cat and the dog number {i} went to the house of {i * i} friends in the town and came back {i} times later" for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    rows += [(3, "a row of its own that has the id of another one and is kept for its text", "en", "s", None), rows[5], (None, plain[6], "en", "s", 1), (None, "words without an id that nobody else has in this table at all", "en", "s", 1)]
    rows += [(40, None, "en", "s", None), (41, "", "en", "s", 0), (42, "\x01\x02\x7f" * 99, None, None, 297), (43, f"the dog read {item} and went to the house", "en", "s", 9), (44, "the dog has a password = abcdefghijklmnop in the house", "en", "s", 9)]
    rows += [(2**63 - 1, "the dog and the cat " * 30_000, "en", "s", 1)]
    names = ("rid", "row", "value", "token_ids", "n_tokens", "keys", "node", "base", "a.b")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(*r, *names) for r in rows], schema)
    folder = str(tmp_path)
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item), (None, "the cat")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    assert out.columns == [c for c in df.columns if c != "token_ids"] + ["token_ids"]
    assert {(r.rid, r["row"], r.value, r["a.b"]) for r in got} == {("rid", "row", "value", "a.b")}
    want = {(r[0], r[1]) for r in rows[:30]} | {(3, rows[30][1]), (None, rows[33][1]), (40, None), (44, "the dog has a [ASSIGN] in the house"), rows[-1][:2]}
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(want)
    assert all((r.token_ids, r.n_tokens) == (None, None) if r.text is None else r.n_tokens == len(r.token_ids) and byte_bpe.load(byte_bpe.default_path()).decode(r.token_ids) == r.text for r in got)
    assert {r.doc_id: r.n_chars for r in got if r.doc_id in (40, 44)} == {40: None, 44: len("the dog has a [ASSIGN] in the house")}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"]


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}_" for n in range(1, 11)} <= {k.partition("_")[0] + "_" for k in entry.queries()} and "pipeline" in entry.queries()
