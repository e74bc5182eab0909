"""Typed fields, editor positions, status texts, the object store, and account operations."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import forms
from tessella.operators import state
from tessella.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_position(text, offset):
    done, line, column = 0, 1, 1
    for c in text:
        done += len(c.encode())
        if done > offset:
            break
        line, column = (line + 1, 1) if c == "\n" else (line, column + 1)
    return line, column


@pytest.mark.parametrize("text", ["", "\n", "ab\ncd", "é\n\n漢字x\n", "a😀b\n😀"])
def test_positions(spark, text):
    n = len(text.encode())
    df = spark.createDataFrame([(text, k) for k in range(-1, n + 3)], "text string, at int").withColumn("p", forms.editor_position(F.col("text"), F.col("at")))
    for r in df.withColumn("back", forms.byte_offset(F.col("text"), F.col("p.line"), F.col("p.column"))).collect():
        assert tuple(r.p) == plain_position(text, r["at"]), (text, r["at"])
        whole = min(max(r["at"], 0), n)
        assert r.back == len(text.encode()[:whole].decode(errors="ignore").encode())
    for line, column in ((0, 1), (99, 1), (1, 99), (1, 0)):
        assert one(spark, forms.byte_offset(F.lit(text), F.lit(line), F.lit(column))) == n


def test_fields(spark):
    assert one(spark, forms.email(F.lit(" A@B.Org "))) == "a@b.org"
    assert one(spark, forms.optional_field(F.lit(" \t"))) is None and one(spark, forms.optional_field(F.lit(None).cast("string"))) is None
    assert one(spark, forms.due_date(F.lit(" "))) is None and str(one(spark, forms.due_date(F.lit("2024-05-01")))).startswith("2024-05-01")
    for bad in ("soon", "2024-13-01", "12:00"):
        with pytest.raises(PySparkException, match="valid due date"):
            one(spark, forms.due_date(F.lit(bad)))
    assert tuple(one(spark, forms.encrypted_identity(F.lit(" sidenc:v1:k.1:aB_-9 ")))) == ("k.1", "aB_-9")
    for bad in ("sidenc:v2:k:a", "sidenc:v1::a", "sidenc:v1:k:", "sidenc:v1:k:a=", "x sidenc:v1:k:a"):
        assert one(spark, forms.encrypted_identity(F.lit(bad))) is None
    good = '{"v":1,"studentName":" Ann ","studentNumber":"7","assignmentKey":" KEY ","studentEmail":" "}'
    assert tuple(one(spark, forms.identity_payload(F.lit(good)))) == ("Ann", "7", "key", None)
    for bad in (good.replace('"v":1', '"v":2'), good.replace('"7"', '" "'), good.replace("assignmentKey", "other"), "no json"):
        assert one(spark, forms.identity_payload(F.lit(bad))) is None


def test_texts(spark):
    none = F.lit(None).cast("string")
    say = lambda s, e=none, w=none: one(spark, forms.upload_summary(F.lit(s), e, w))
    assert say("READY", F.lit(" " + "e" * 200)) == "e" * 120 and say("ready", F.lit(""), F.lit("w")) == forms.UPLOAD_WARNED
    assert say("Completed") == forms.UPLOAD_STATES["ready"] and say("odd") == forms.UPDATED
    assert [one(spark, forms.upload_purpose(F.lit(p))) for p in ("template_upload", "current_bulk-upload")] == ["Template Code", "Current Bulk Upload"]
    assert [one(spark, forms.status_label(F.lit(s))) for s in ("ready", "not_ready", "a_b_c")] == ["ready to run", "not ready", "a b c"]
    assert one(spark, forms.empty_text(F.lit("ready"))) == forms.EMPTY_DEFAULT


def test_keys():
    parts = store.object_key("a b/../c", r"dir\Wörk (1).ZIP").split("/")
    assert parts[:3] == ["a-b", "..", "c"] and parts[4] == "W-rk-1.zip" and store.checked("//a/b") == "a/b"
    for bad in ("", "/", "../a", "a//b", "a/../b", "a/"):
        with pytest.raises(ValueError):
            store.checked(bad)


def test_store(spark, tmp_path):
    s = store.ObjectStore(spark, f"file://{tmp_path}/root")
    staged = s.stage("a.zip", b"\x00\xffdata")
    assert s.read(staged) == b"\x00\xffdata"
    with pytest.raises(ValueError):
        s.stage("b.zip", b"12345", most=4)
    with pytest.raises(ValueError):
        s.promote("uploads/x/a.zip", "y")
    assert s.promote(staged, "uploads/x/a.zip") and not s.exists(staged) and not (tmp_path / "root" / store.STAGED).exists()
    s.delete("uploads/x/a.zip")
    s.delete("uploads/x/a.zip")
    assert (tmp_path / "root").exists() and not (tmp_path / "root" / "uploads").exists()


@pytest.mark.parametrize("fails", [None, "promote", "record", "enqueue"])
def test_finalise(spark, tmp_path, fails):
    s, seen = store.ObjectStore(spark, f"file://{tmp_path}/root"), []

    def step(name):
        def run(key):
            if fails == name:
                raise RuntimeError(name)
            seen.append(name)

        return run

    staged = s.stage("a.zip", b"x")
    if fails is None:
        store.finalise(s, staged, "up/a.zip", step("record"), step("enqueue"), step("forget"))
        assert seen == ["record", "enqueue"] and s.exists("up/a.zip")
        return
    with pytest.raises((RuntimeError, ValueError)):
        store.finalise(s, staged, "up//a.zip" if fails == "promote" else "up/a.zip", step("record"), step("enqueue"), step("forget"))
    assert not s.exists(staged) and not s.exists("up/a.zip")
    assert seen == {"promote": [], "record": [], "enqueue": ["record", "forget"]}[fails]


def test_accounts(spark):
    users = spark.createDataFrame([("p", "PROFESSOR"), ("q", "PROFESSOR"), ("s", "STUDENT")], "user_id string, role string")
    assignments = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", None)], "assignment_id string, professor_id string")
    files = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "assignment_id string, n int")
    u, a, left = state.delete_account(users, assignments, {"files": files}, "p")
    assert {r.user_id for r in u.collect()} == {"q", "s"} and {r.assignment_id for r in a.collect()} == {"b", "c"} and {r.n for r in left["files"].collect()} == {2, 3}
    for who, busy in (("s", None), ("nobody", None), ("p", assignments.where("assignment_id = 'a'"))):
        with pytest.raises(ValueError):
            state.delete_account(users, assignments, {}, who, busy)
    out = state.upsert(users, spark.createDataFrame([("s",), ("t",)], "user_id string").withColumn("role", F.lit("ADMIN")), "user_id")
    assert {tuple(r) for r in out.collect()} == {("p", "PROFESSOR"), ("q", "PROFESSOR"), ("s", "ADMIN"), ("t", "ADMIN")}
