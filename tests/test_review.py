"""Sinks, deletions, look-ups and display rules on small tables, and the JSON transport."""

import json
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import columns, lexer, tokens
from tessella.operators import review, similarity, state
from tessella.operators.rows import before
from tessella.sources import transport

AT = datetime(2026, 1, 2)


def test_sums_before(spark, monkeypatch):
    """A hot key, null keys, ties and negative numbers, against a plain loop."""
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", (i * 37) % 90 - 20, i, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, tie int, v long")
    got = before(df, ["k"], ["o", "tie"], total=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [x for x in rows if x[0] == r.k and (x[1], x[2]) < (r.o, r.tie)]
        assert (r.total, r.n) == (sum(x[3] for x in earlier), len(earlier))
    assert before(df.limit(0), ["k"], ["o"], n=F.lit(1)).count() == 0


def results(spark, scores):
    span = {"byte_start": 1, "byte_end": 5, "file_path": None, "line_start": 1, "column_start": 2, "line_end": 1, "column_end": 5, "token_start": 0, "token_end": 3}
    match = {"match_id": "code-0", "kind": "code", "left": span, "right": span, "matched_token_count": 4}
    rows = [(f"a__{k}", "a", str(k), s, 4, [match] * (k % 2), k) for k, s in enumerate(scores)]
    return spark.createDataFrame(rows, similarity.RESULT + ", ord int")


def test_results_of_a_run_are_replaced(spark):
    tables = {
        "comparison_runs": spark.createDataFrame([("r1", "QUEUED", None, None, None), ("r2", "QUEUED", None, None, None)], "comparison_run_id string, status string, error_message string, started_at timestamp, completed_at timestamp"),
        "pair_results": spark.createDataFrame([], "pair_result_id string, comparison_run_id string, left_id string, right_id string, similarity_score double, matched_token_count int, sort_order int"),
        "pair_matches": spark.createDataFrame([], "pair_result_id string, match_key string, kind string, " + ", ".join(f"{s}_{c} int" for s in ("left", "right") for c in ("byte_start", "byte_end", "line_start", "line_end", "token_start", "token_end"))),
    }
    tables["comparison_runs"] = state.start_run(tables["comparison_runs"], "r1", AT)
    assert {r.comparison_run_id: r.status for r in tables["comparison_runs"].collect()} == {"r1": "RUNNING", "r2": "QUEUED"}
    one = state.store_results(tables, "r1", results(spark, [0.1, 0.2, 0.3]), AT)
    two = state.store_results(state.store_results(one, "r2", results(spark, [0.9]), AT), "r1", results(spark, [0.5, 0.4]), AT)
    got = sorted((r.pair_result_id, r.similarity_score, r.sort_order) for r in two["pair_results"].collect())
    assert got == [("r1/a__0", 0.5, 0), ("r1/a__1", 0.4, 1), ("r2/a__0", 0.9, 0)]
    assert [(r.pair_result_id, r.kind, r.right_token_end) for r in two["pair_matches"].collect()] == [("r1/a__1", "CODE", 3)]
    assert {(r.status, r.completed_at) for r in two["comparison_runs"].collect()} == {("COMPLETED", AT)}
    failed = state.fail_run(tables["comparison_runs"], "r2", "broken", AT).where("comparison_run_id = 'r2'").first()
    assert (failed.status, failed.error_message) == ("FAILED", "broken")


def test_prepared_submissions_come_in(spark):
    prepared = spark.createDataFrame([("s1", "Ann", "historical", "x\ny\n", [("a.c", 0, 2), ("b.c", 2, 4)])], f"submission_id string, display_name string, kind string, source string, source_map {similarity.SOURCE_MAP}")
    files = state.stored_files(prepared.selectExpr("submission_id", "'a' as assignment_id", "'b' as upload_batch_id", "'ann' as slug", "source_map"))
    assert [tuple(r) for r in files.orderBy("canonical_order").collect()] == [("s1", "a.c", "prepared/a/b/ann/0001", 0, 0, 2), ("s1", "b.c", "prepared/a/b/ann/0002", 1, 2, 4)]
    tables = {
        "assignments": spark.createDataFrame([("a", 4), ("z", 1)], "assignment_id string, comparison_input_version int"),
        "upload_batches": spark.createDataFrame([("b", "PROCESSING", "e", None, None)], "upload_batch_id string, status string, error_message string, warning_message string, skipped_submission_count int"),
        "submissions": spark.createDataFrame([], f"submission_id string, assignment_id string, upload_batch_id string, display_name string, kind string, source string, source_map {similarity.SOURCE_MAP}"),
        "submission_files": files.limit(0),
    }
    out = state.store_submissions(tables, "a", "b", prepared, files, 1, "one was skipped")
    assert {r.assignment_id: r.comparison_input_version for r in out["assignments"].collect()} == {"a": 5, "z": 1}
    assert tuple(out["upload_batches"].first()) == ("b", "READY", None, "one was skipped", 1)
    assert [(r.submission_id, r.kind, r.upload_batch_id) for r in out["submissions"].collect()] == [("s1", "HISTORICAL", "b")] and out["submission_files"].count() == 2


def test_deleting_what_is_not_there(spark):
    tables = {"assignments": spark.createDataFrame([("a", 1)], "assignment_id string, comparison_input_version int"), "submissions": spark.createDataFrame([("s", "a", "b")], "submission_id string, assignment_id string, upload_batch_id string"), "comparison_runs": spark.createDataFrame([], "comparison_run_id string, assignment_id string")}
    with pytest.raises(ValueError, match="no longer exists"):
        state.delete_submission(tables, "other", "s")
    assert state.delete_submission(tables, "a", "s")["submissions"].isEmpty()
    sessions = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, AT), (3, datetime(2026, 1, 3)), (4, None)], "id int, expires_at timestamp")
    assert [r.id for r in state.live_sessions(sessions, AT).collect()] == [3]


def test_look_ups(spark):
    keys = spark.createDataFrame([("abc", True), ("old", False)], "public_key string, is_active boolean")
    assert review.active_key(keys, " ABC ").count() == 1
    for typed in ("old", " ", "none"):
        with pytest.raises(ValueError, match="invalid or inactive"):
            review.active_key(keys, typed)
    named = spark.createDataFrame([("1", "Ann"), ("2", "Bo"), ("3", "Bo"), ("Ann", "Cy")], "submission_id string, display_name string")
    assert review.find_submission(named, " Ann ").first().display_name == "Cy" and review.find_submission(named, "Cy").count() == 1
    for typed, said in ((" ", "Enter a valid"), ("Bo", "multiple"), ("bo", "No such")):
        with pytest.raises(ValueError, match=said):
            review.find_submission(named, typed)


def test_missing_sides_are_errors(spark):
    rows = spark.createDataFrame([(str(k), "a", "current", k, "java", f"class A{k} {{ int x; int y; }}", None) for k in range(2)], similarity.SUBMISSIONS)
    prepared = similarity.prepared(rows, None)
    pairs = spark.createDataFrame([("0__1", "0", "1"), ("0__9", "0", "9")], "pair_id string, left_id string, right_id string")
    with pytest.raises(Exception, match="unknown right submission 9"):
        similarity.compared(pairs, prepared).collect()
    with pytest.raises(Exception, match="unknown left submission"):
        review.run_reports(
            spark.createDataFrame([("r",)], "comparison_run_id string"), spark.createDataFrame([Row(pair_result_id="p", comparison_run_id="r", left_id="x", right_id="y", similarity_score=0.1, matched_token_count=1, sort_order=0)]),
            spark.createDataFrame([], "pair_result_id string, " + ", ".join(f"{c} string" for c in review.MATCH)), spark.createDataFrame([("y", "n", "CURRENT")], "submission_id string, display_name string, kind string"),
        ).collect()


def test_display_rules(spark):
    shares = [k / 1000 for k in range(0, 1001, 3)] + [0.0025, 0.0005, 0.0145, 0.14449999, 1.0, 0.1225, 0.99949, 0.99951]
    df = spark.createDataFrame([(s,) for s in shares] + [(None,)], "s double")
    want = [f"{Decimal(s * 100).quantize(Decimal('0.1'), ROUND_HALF_UP)}%" for s in shares] + ["N/A"]
    assert [r.p for r in df.select(columns.fixed_percent(F.col("s")).alias("p")).collect()] == want
    d = spark.createDataFrame([(5, 10, 10), (0, 0, 0)], "m int, l int, r int").select(columns.dice(F.col("m"), F.col("l"), F.col("r")).alias("d"))
    assert [r.d for r in d.collect()] == [0.5, 0.0]
    spans = spark.createDataFrame([(-3, 99, "code"), (4, 4, "code"), (9, 2, "comment"), (2, 99, "comment")], "a int, b int, k string")
    hidden = F.array(F.struct(F.lit(5).cast("long").alias("a"), F.lit(8).cast("long").alias("b")))
    shown = spans.select(columns.render_spans(F.col("a"), F.col("b"), F.col("k"), hidden, F.lit(20)).alias("x")).collect()
    assert [[tuple(s) for s in r.x] for r in shown] == [[(0, 5), (8, 20)], [], [], [(2, 20)]]
    key = tokens.assignment_key()
    assert len(key) == 16 and int(key, 16) >= 0 and key != tokens.assignment_key()
    token = tokens.status_token("batch", "secret")
    assert len(token) == 43 and tokens.token_holds("batch", token, "secret") and not tokens.token_holds("batch", token[:-1], "secret") and not tokens.token_holds("other", token, "secret")


def request(**changes):
    source = "int add(int a, int b) { int c = a + b; return c; }\n"
    submissions = [{"submissionId": s, "submissionKind": "current", "source": source.replace("add", f"add{s}"), "sourceMap": [{"filePath": "main.c", "byteStart": 0, "byteEnd": len(source) + 1}]} for s in "xy"]
    whole = {"schemaVersion": "1.0", "engineVersion": "t", "language": "c", "submissions": submissions, "pairs": [{"pairId": "p2", "leftSubmissionId": "y", "rightSubmissionId": "x"}, {"pairId": "p1", "leftSubmissionId": "x", "rightSubmissionId": "y"}], "params": {"gstMinMatchLength": 3, "minimumCommentLength": 5}}
    return whole | changes


def test_transport(spark, tmp_path):
    path = tmp_path / "request.json"

    def answer(**changes):
        path.write_text(json.dumps(request(**changes), indent=2))
        return json.loads(transport.answered(spark, str(path)).first().response)

    out = answer()
    assert [r["pairId"] for r in out["pairResults"]] == ["p2", "p1"] and out["schemaVersion"] == "1.0" and out["language"] == "c"
    match = out["pairResults"][1]["matches"][0]
    assert out["pairResults"][1]["similarityScore"] > 0 and match["kind"] == "code" and match["left"]["filePath"] == "main.c" and match["left"]["position"]["lineStart"] == 1 and match["left"]["tokens"]["tokenStart"] == 0
    body = request()["submissions"][0]["source"]
    assert all(r["similarityScore"] == 0 for r in answer(template={"source": body.replace("addx", "other"), "sourceMap": []})["pairResults"])
    assert answer(pairs=[])["pairResults"] == []
    bad = request()["submissions"]
    wrong = [
        ({"schemaVersion": "0.9"}, "schema_version"), ({"engineVersion": " "}, "engine_version"), ({"language": "cobol"}, "language"), ({"submissions": []}, "submissions"), ({"params": {"gstMinMatchLength": 0, "minimumCommentLength": 5}}, "gst_min_match_length"),
        ({"params": {"gstMinMatchLength": 3}}, "minimum_comment_length"), ({"submissions": [bad[0], bad[0]]}, "duplicate"), ({"pairs": [{"pairId": "p", "leftSubmissionId": "x", "rightSubmissionId": "x"}]}, "one submission"),
        ({"template": {"source": "int a;", "sourceMap": [{"filePath": " ", "byteStart": 0, "byteEnd": 3}]}}, "source_map"), ({"template": {"source": "int a;", "sourceMap": [{"filePath": "f", "byteStart": 0, "byteEnd": 3}, {"filePath": "g", "byteStart": 2, "byteEnd": 5}]}}, "source_map"),
    ]
    for changes, said in wrong:
        with pytest.raises(transport.RequestError, match=said):
            answer(**changes)


def test_lexers_take_linear_time():
    """Wide characters in front of many tokens, many names in one record, many comments."""
    begun = datetime.now()
    wide = "/* é */ int x = 1; // ö\n" * 20_000
    p = lexer.lex(wide, "c")
    assert len(p.tokens) == 100_000 and p.tokens[5].byte_start == len("/* é */ int x = 1; // ö\n/* é */ ".encode())
    assert wide.encode()[p.tokens[-2].byte_start : p.tokens[-2].byte_end] == b"1"
    fields = lexer.lex("struct S { " + "int a; " * 20_000 + "}; int b;", "c").tokens
    assert [t.norm for t in fields if t.norm == "FIELD_ID"] == ["FIELD_ID"] * 20_000 and fields[-2].norm == "ID"
    assert len(lexer.trailing_comments(wide)) == 20_000
    assert (datetime.now() - begun).total_seconds() < 60
