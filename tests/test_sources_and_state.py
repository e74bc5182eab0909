"""Archives built in memory, status rules, deletions, and the queue."""

import io
import random
import string
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.config import Limits
from tessella.functions import columns
from tessella.operators import state
from tessella.sources import archives
from tessella.streaming import queue


def pack(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


JAVA = pack({"Main.java": "class A {}"})


def paths(language, files, **how):
    return [p for p, _, _ in archives.extract(language, pack(files), **how)]


def test_junk_and_suffixes():
    assert paths("java", {"__MACOSX/a.java": "x", ".DS_Store": "x", "Thumbs.db": "", "._Main.java": "x", "Student1.java": "x"}) == ["Student1.java"]
    mixed = {"Main.JAVA": "x", "nested/Solver.CPP": "x", "include/Util.H": "x"}
    assert paths("java", mixed) == ["Main.JAVA"] and paths("cpp", mixed) == ["include/Util.H", "nested/Solver.CPP"]
    assert paths("java", {"a.zip": pack({"b.zip": JAVA})}) == ["a.zip!/b.zip!/Main.java"]
    assert archives.source_text(b"\xef\xbb\xbfa\r\nb\rc\0\xff") == "a\nb\nc�"
    assert sorted(["Main.java", "src/A.java", "_x.java", "B.java", "a.java", "src-a.java"], key=archives.path_key) == ["_x.java", "a.java", "B.java", "Main.java", "src-a.java", "src/A.java"]


@pytest.mark.parametrize("files, limits, message", [({"a.zip": pack({"b.zip": JAVA})}, Limits(max_depth=1), "nesting depth"), ({"A.java": "", "B.java": ""}, Limits(max_source_files=1), "too many source files"), ({"A.java": "x" * 99}, Limits(max_expanded_bytes=50), "beyond the allowed"), ({"a/../A.java": ""}, Limits(), "unsafe archive entry path"), ({"a.txt": ""}, Limits(), "no relevant java source files found in uploaded archive")])
def test_limits(files, limits, message):
    with pytest.raises(archives.ArchiveError, match=message):
        archives.extract("java", pack(files), limits=limits)


def test_layouts():
    assert archives.child_archives("historical", [("__MACOSX/x", False), ("Student2.ZIP", False), ("Student1.zip", False)]) == ["Student1.zip", "Student2.ZIP"]
    assert archives.child_archives("historical", [("Folder", True), ("Folder/Student4.zip", False), ("Folder/Student3.zip", False), ("Folder/.DS_Store", False)]) == ["Folder/Student3.zip", "Folder/Student4.zip"]
    for bad in ([], [("a/x.zip", False), ("b/y.zip", False)], [("x.txt", False)]):
        with pytest.raises(archives.ArchiveError):
            archives.child_archives("bulk current", bad)


def test_bulk():
    none = pack({"a.txt": ""})
    kept, skipped = archives.bulk("java", pack({"good.zip": JAVA, "bad.zip": none}))
    assert [n for n, _ in kept] == ["good"] and archives.skip_warning(skipped).startswith("1 submission was")
    assert [n for n, _ in archives.bulk("java", pack({"Student#1.zip": none, "Student-1.zip": JAVA}))[0]] == ["Student-1"]
    for files, message in (({"a.zip": none}, "no relevant java"), ({"Student#1.zip": JAVA, "Student-1.zip": JAVA}, "duplicate submission names"), ({"a.zip": b"broken"}, "failed to read zip archive:")):
        with pytest.raises(archives.ArchiveError, match=message):
            archives.bulk("java", pack(files))


def test_paths_are_ordered_as_in_sql(spark):
    rng = random.Random(1)
    signs = string.ascii_letters + string.digits + "_-./ ()+@#$%&~,;!='[]{}^`éÄößñ"
    names = sorted({"".join(rng.choices(signs, k=rng.randrange(1, 8))) for _ in range(1500)} | set(signs) | {"Resume", "résumé", "resume", "Résumé", "resumé"})
    rng.shuffle(names)
    by_sql = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.collate("n", "UNICODE"), "n").collect()]
    assert sorted(names, key=archives.path_key) == by_sql


def test_ingest(spark, tmp_path):
    (tmp_path / "s1.zip").write_bytes(pack({"b.java": "class B {}", "A.java": "class Ä {}\n"}))
    (tmp_path / "s2.zip").write_bytes(b"broken")
    files = archives.extracted(spark, str(tmp_path), "java")
    assert [r.error.split(":")[0] for r in files.where("error is not null").collect()] == ["failed to read zip archive"]
    (r,) = archives.concatenated(files).collect()
    assert r.source == "class Ä {}\nclass B {}\n" and [tuple(x) for x in r.source_map] == [("A.java", 0, 12), ("b.java", 12, 23)]
    (z,) = archives.zipped(files.where("error is null"), "display_name").collect()
    assert zipfile.ZipFile(io.BytesIO(bytes(z.archive))).namelist() == ["A.java", "b.java"]
    said = spark.createDataFrame([("failed to read zip archive: x",), (" Archive nesting depth limit exceeded ",), ("no relevant c source files found after extraction",), ("?",)], "m string")
    assert [r.m[:20] for r in said.select(columns.upload_message("m").alias("m")).collect()] == ["We couldn't read tha", "That archive is too ", "No supported source ", "We couldn't process "]


def test_status(spark):
    run = lambda s, v: Row(status=s, input_version=v)
    cases = [(True, False, 2, 0, [], "preparing"), (False, True, 2, 0, [], "running"), (False, False, 1, 0, [], "not_ready"), (False, False, 2, 0, [run("completed", 3)], "current"), (False, False, 1, 1, [run("COMPLETED", 2)], "stale"), (False, False, 2, 0, [run("FAILED", 3), run("COMPLETED", 2)], "failed"), (False, False, 2, 0, [], "ready")]
    df = spark.createDataFrame([c[:5] for c in cases], "u boolean, r boolean, c int, h int, runs array<struct<status: string, input_version: int>>")
    got = df.select(state.comparison_status(F.col("u"), F.col("r"), F.col("c"), F.col("h"), F.lit(3), F.col("runs")).alias("s")).collect()
    assert [r.s for r in got] == [c[5] for c in cases]
    assert state.runnable(1, 0, 0, 0) and state.runnable(2, 0, 1, 0) and state.runnable(1, 1, 0, 0) is None


def test_deletions_and_templates(spark):
    subs = spark.createDataFrame([("1", "a", "current"), ("2", "a", "historical"), ("3", "b", "current")], "submission_id string, assignment_id string, kind string")
    results, assignments = spark.createDataFrame([("a", 1), ("b", 2)], "assignment_id string, x int"), spark.createDataFrame([("a", 1), ("b", 1)], "assignment_id string, comparison_input_version int")
    s, r, a = state.delete_category(subs, results, assignments, "a", "historical")
    assert (s.count(), r.count(), {x.assignment_id: x.comparison_input_version for x in a.collect()}) == (2, 1, {"a": 2, "b": 1})
    s, r, a = state.delete_category(subs, results, assignments, "b", "historical")
    assert (s.count(), r.count(), a.where("comparison_input_version > 1").count()) == (3, 2, 0)
    t = spark.createDataFrame([("x", "a", 1, datetime(2026, 1, 1), False), ("y", "a", 2, datetime(2026, 1, 1), False), ("z", "a", 2, datetime(2026, 1, 2), False)], "template_id string, assignment_id string, version_number int, created_at timestamp, is_active boolean")
    assert [r.template_id for r in state.promote_newest(t).where("is_active").collect()] == ["z"]
    more = state.add_template(t, t.where("template_id = 'x'").withColumn("template_id", F.lit("n")))
    assert [(r.template_id, r.version_number) for r in more.where("is_active").collect()] == [("n", 3)]


def test_queue(spark, tmp_path):
    schema = "comparison_run_id string, x int"
    queue.enqueue(spark.createDataFrame([("r1", 1), ("r1", 2)], schema), f"{tmp_path}/in")
    work = lambda jobs: jobs.withColumn("y", F.col("x") * 2)
    for n in (1, 2):  # the second time from the start again: results are replaced
        assert queue.consume(spark, f"{tmp_path}/in", schema, work, f"{tmp_path}/out", f"{tmp_path}/cp{n}", files_a_batch=99).awaitTermination(60)
        assert sorted(r.y for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 4]
    log = spark.createDataFrame([("j", "QUEUED", 1), ("j", "FAILED", 2), ("j", "RUNNING", 3), ("k", "QUEUED", 1), ("k", "RUNNING", 2)], "job_id string, status string, at int")
    assert {r.job_id: r.status for r in queue.transitions(log).collect()} == {"j": "FAILED", "k": "RUNNING"}


def test_limits_from_env():
    assert Limits.from_env({"TESSELLA_MAX_DEPTH": "3"}).max_depth == 3
    with pytest.raises(ValueError):
        Limits.from_env({"TESSELLA_MAX_DEPTH": "x"})
