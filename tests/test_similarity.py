"""End-to-end comparisons on inline sources."""

import pytest
from pyspark.sql import Row

from tessella.config import Params
from tessella.operators import similarity

SMALL = Params(gst_min_match_length=3, minimum_comment_length=5)
LONG = "// find the top student of the whole class by average grade\n"


def run(spark, sources, language, params=SMALL, template=None, kinds=None, maps=None):
    rows = [(str(k), "a", (kinds or ["current"] * 9)[k], k, language, s, (maps or {}).get(k)) for k, s in enumerate(sources)]
    df = spark.createDataFrame(rows, similarity.SUBMISSIONS)
    t = spark.createDataFrame([("a", language, template, None)], f"assignment_id string, language string, source string, source_map {similarity.SOURCE_MAP}") if template else None
    return {r.pair_id: r for r in similarity.analyze(df, t, params).collect()}


def add(name, f, x, y):
    return f"class {name} {{ int {f}(int {x}, int {y}) {{ return {x} + {y}; }} }}"


def test_renamed_copy(spark):
    (r,) = run(spark, [add("A", "add", "a", "b"), add("B", "sum", "x", "y")], "java").values()
    assert r.similarity_score > 0 and r.matches and r.matches[0].left.byte_end > r.matches[0].left.byte_start


def test_template_hides_all(spark):
    (r,) = run(spark, [add("A", "add", "a", "b")] * 2, "java", template=add("A", "add", "a", "b")).values()
    assert r.similarity_score == 0.0 and r.matches == []


@pytest.mark.parametrize("language, source", [("java", "package a.b;\nimport c.d;\n"), ("c", "#include <stdio.h>\n")])
def test_nothing_but_imports(spark, language, source):
    (r,) = run(spark, [source] * 2, language, Params(1, 5)).values()
    assert r.similarity_score == 0.0 and r.matches == []


@pytest.mark.parametrize("left, right, template, want", [(LONG * 2, LONG, None, 1), (LONG * 2, LONG * 2, LONG, 1), ("// find top student\n", "/* find top student */", None, 0), (LONG, "/* Find the TOP student, of the whole class; by average-grade! */", None, 1)])
def test_comments(spark, left, right, template, want):
    (r,) = run(spark, [left + "class A {}", right + "class B {}"], "java", template=template).values()
    assert sum(m.kind == "comment" for m in r.matches) == want


def test_files_pairs_and_kinds(spark):
    c = "int add(int a, int b) { int c = a + b; return c; }\n"
    got = run(spark, [c, c.replace("add", "sum"), c], "c", kinds=["current", "current", "historical"], maps={k: [("main.c", 0, len(c))] for k in range(3)})
    assert set(got) == {"0__1", "0__2", "1__2"} and got["0__1"].matches[0].left.file_path == "main.c"
    assert all(r.matched_token_count == sum(m.matched_token_count for m in r.matches) for r in got.values())


def test_problems(spark):
    df = spark.createDataFrame([("1", "a", "current", 0, "c", "int a;", [("x", 0, 99)]), ("1", "a", "current", 0, "c", "", []), (" ", "a", "current", 0, "c", "", [])], similarity.SUBMISSIONS)
    pairs = spark.createDataFrame([Row(pair_id="p", left_id="1", right_id="9"), Row(pair_id="q", left_id="1", right_id="1")])
    assert sorted(r.problem.split(":")[0] for r in similarity.problems(df, pairs).collect()) == ["duplicate submission_id", "invalid source_map", "pair of one submission", "pair with unknown submission", "submission_id must not be blank"]


def test_chunks_and_candidates_against_plain_pairs(spark, monkeypatch):
    """Small chunks, several assignments, one of them none, null and empty texts: candidates are the allowed pairs that share a key."""
    monkeypatch.setattr(similarity, "CHUNK", 2)
    bodies = [add("A", "f", "a", "b"), add("B", "g", "x", "y"), LONG + "class C {}", LONG + "class D { long q; }", "", None, "class E { String s = null; }"]
    rows = [(f"{a}{k}", a, "historical" if k == 1 else "current", k, "java", body, None) for a in ("p", "q", None) for k, body in enumerate(bodies)]
    templates = spark.createDataFrame([("p", "java", bodies[6], None), ("z", "java", bodies[0], None)], f"assignment_id string, language string, source string, source_map {similarity.SOURCE_MAP}")
    tokens = similarity.prepared(spark.createDataFrame(rows, similarity.SUBMISSIONS), templates, Params(gst_min_match_length=3, minimum_comment_length=5, template_min_match=3)).persist()
    got = tokens.collect()
    assert sorted(r.submission_id for r in got) == sorted(r[0] for r in rows)
    assert {r.submission_id: all(r.mask) for r in got if r.submission_id.endswith("6")} == {"p6": True, "q6": False, "None6": False}
    want = {(l.submission_id, r.submission_id) for l in got for r in got if l.assignment_id and l.assignment_id == r.assignment_id and l.kind == "current" and (r.kind == "historical" or l.ord < r.ord) and l.submission_id != r.submission_id and set(l["keys"]) & set(r["keys"])}
    assert want and {(r.left_id, r.right_id) for r in similarity.candidates(tokens).collect()} == want
    tokens.unpersist()


def test_no_submissions(spark):
    assert run(spark, [], "java", template="class A {}") == run(spark, [], "java") == {}
