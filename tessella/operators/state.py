"""Status, versions and deletions as operations on whole tables: each returns the table as it is afterwards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What hangs on what: a table, its column, the table that the column refers to. Children stand behind their parents.
OWNED = (
    ("submissions", "assignment_id", "assignments"),
    ("templates", "assignment_id", "assignments"),
    ("upload_batches", "assignment_id", "assignments"),
    ("assignment_keys", "assignment_id", "assignments"),
    ("comparison_runs", "assignment_id", "assignments"),
    ("submission_files", "submission_id", "submissions"),
    ("template_files", "template_id", "templates"),
    ("pair_results", "comparison_run_id", "comparison_runs"),
    ("pair_matches", "pair_result_id", "pair_results"),
)
Tables = dict[str, DataFrame]


def replace_by(existing: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys go, whether the new rows have any for them or not; the new rows come in."""
    return existing.join(keys.select(key), key, "left_anti").unionByName(new)


def write_by_run(results: DataFrame, path: str, key: str = "comparison_run_id") -> None:
    """Replace the results of the runs that are in the frame and no others; a replay leaves the same."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def bump(assignments: DataFrame, touched: DataFrame) -> DataFrame:
    """comparison_input_version + 1 where an assignment was touched."""
    t = touched.select("assignment_id").distinct().withColumn("_hit", F.lit(1))
    return assignments.join(t, "assignment_id", "left").withColumn("comparison_input_version", F.col("comparison_input_version") + F.coalesce("_hit", F.lit(0))).drop("_hit")


def delete_category(submissions: DataFrame, results: DataFrame, assignments: DataFrame, assignment_id: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions of a kind go, and with them all results of the assignment, and its version rises; nothing happens if there are none."""
    gone = submissions.where((F.col("assignment_id") == assignment_id) & (F.col("kind") == kind))
    touched = gone.select("assignment_id").distinct()
    return submissions.join(gone.select("submission_id"), "submission_id", "left_anti"), results.join(touched, "assignment_id", "left_anti"), bump(assignments, touched)


def promote_newest(templates: DataFrame) -> DataFrame:
    """Where no template of an assignment is active, the one of the highest version, then the latest, becomes so."""
    w = Window.partitionBy("assignment_id")
    newest = F.row_number().over(w.orderBy(F.desc("version_number"), F.desc("created_at"), "template_id")) == 1
    return templates.withColumn("_any", F.max("is_active").over(w)).withColumn("_new", newest).withColumn("is_active", F.col("is_active") | (~F.col("_any") & F.col("_new"))).drop("_any", "_new")


def add_template(templates: DataFrame, new: DataFrame) -> DataFrame:
    """New templates are active, of the next version; the others are not any more."""
    top = templates.groupBy("assignment_id").agg(F.max("version_number").alias("_top"))
    added = new.join(top, "assignment_id", "left").withColumn("version_number", F.coalesce("_top", F.lit(0)) + 1).withColumn("is_active", F.lit(True)).drop("_top")
    ids = new.select("assignment_id").distinct().withColumn("_hit", F.lit(True))
    rest = templates.join(ids, "assignment_id", "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).drop("_hit")
    return rest.unionByName(added.select(rest.columns))


def comparison_status(uploads: Column, running: Column, current: Column, historical: Column, version: Column, runs: Column) -> Column:
    """status of an assignment; runs: array of (status, input_version) in the order they are looked through."""
    of_now = F.filter(runs, lambda r: r["input_version"] == version)
    done = lambda r: F.upper(r["status"]) == "COMPLETED"
    return (
        F.when(uploads, "preparing").when(running, "running").when(~((current >= 1) & (current + historical >= 2)), "not_ready").when(F.exists(of_now, done), "current")
        .when((F.size(of_now) > 0) & (F.upper(F.try_element_at(of_now, F.lit(1))["status"]) == "FAILED"), "failed")
        .when(F.exists(runs, lambda r: (r["input_version"] < version) & done(r)), "stale").otherwise("ready")
    )


def runnable(current: int, historical: int, uploads: int, runs: int) -> str | None:
    """Why a comparison cannot be started, or None."""
    if uploads:
        return "uploads are still being prepared"
    if runs:
        return "a comparison is already queued or running"
    return None if current >= 1 and current + historical >= 2 else "at least one current and two submissions in all are needed"


def api_matched_tokens(matches: DataFrame) -> DataFrame:
    """The count that the review pages show: the distance of the tokens' ends, which are inclusive."""
    return matches.withColumn("api_matched_token_count", F.col("left.token_end") - F.col("left.token_start"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new come in place of those with their key; columns that new has not keep their values, or are null in rows not seen before."""
    kept = [c for c in existing.columns if c not in new.columns]
    filled = new.join(existing.select(key, *kept), key, "left")
    return existing.join(new.select(key), key, "left_anti").unionByName(filled.select(existing.columns))


def delete_account(users: DataFrame, assignments: DataFrame, owned: dict[str, DataFrame], user_id: str, busy: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """A professor's account goes with the assignments and all rows of owned tables that are theirs. busy: assignments with work that is not finished; one of theirs there is an error."""
    gone = assignments.where(F.col("professor_id") == user_id).select("assignment_id")
    if users.where((F.col("user_id") == user_id) & (F.col("role") == "PROFESSOR")).isEmpty():
        raise ValueError("that account is no longer available")
    if busy is not None and not busy.join(gone, "assignment_id", "left_semi").isEmpty():
        raise ValueError("assignments of the account have active jobs")
    left = {name: t.join(gone, "assignment_id", "left_anti") for name, t in owned.items()}
    return users.where(F.col("user_id") != user_id), assignments.where(~F.col("professor_id").eqNullSafe(user_id)), left


def cascade(tables: Tables, gone: Tables) -> Tables:
    """tables without the keys that are gone (a table's name: its keys) and without all that hangs on them. Tables that are not given are left out."""
    gone = dict(gone)
    out = dict(tables)
    for parent, keys in list(gone.items()):
        out[parent] = tables[parent].join(keys, keys.columns, "left_anti")
    for child, column, parent in OWNED:
        if parent in gone and child in tables:
            lost = tables[child].join(gone[parent].select(column), column, "left_semi")
            out[child] = out[child].join(gone[parent].select(column), column, "left_anti")
            if key := next((c for t, c, p in OWNED if p == child), None):
                mine = lost.select(key)
                gone[child] = gone[child].unionByName(mine) if child in gone else mine
    return out


def of_assignment(table: DataFrame, assignment_id: str) -> DataFrame:
    return table.where(F.col("assignment_id") == assignment_id)


def clear_comparisons(tables: Tables, assignment_id: str) -> Tables:
    """All runs of an assignment go, with their results and matches."""
    return cascade(tables, {"comparison_runs": of_assignment(tables["comparison_runs"], assignment_id).select("comparison_run_id")})


def unreferenced(batches: DataFrame, *references: DataFrame, key: str = "upload_batch_id") -> DataFrame:
    """Batches that no row of the other tables refers to."""
    for r in references:
        batches = batches.join(r.select(key), key, "left_anti")
    return batches


def _without(tables: Tables, assignment_id: str, name: str, key: str, value: str) -> Tables:
    """One submission or template goes: its files, all comparisons of the assignment, its batch if nothing else came with it; the version rises."""
    found = of_assignment(tables[name], assignment_id).where(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"that {name.removesuffix('s')} no longer exists")
    out = cascade(clear_comparisons(tables, assignment_id), {name: found.select(key)})
    if "upload_batches" in out:
        batch = out["upload_batches"].join(found.select("upload_batch_id"), "upload_batch_id", "left_semi")
        empty = unreferenced(batch, *(out[t] for t in ("submissions", "templates") if t in out)).select("upload_batch_id")
        out["upload_batches"] = out["upload_batches"].join(empty, "upload_batch_id", "left_anti")
    return out | {"assignments": bump(tables["assignments"], found)}


def delete_submission(tables: Tables, assignment_id: str, submission_id: str) -> Tables:
    return _without(tables, assignment_id, "submissions", "submission_id", submission_id)


def delete_template(tables: Tables, assignment_id: str, template_id: str) -> Tables:
    """As for a submission; if the template was active, the newest of the others becomes so."""
    out = _without(tables, assignment_id, "templates", "template_id", template_id)
    was_active = not of_assignment(tables["templates"], assignment_id).where((F.col("template_id") == template_id) & F.col("is_active")).isEmpty()
    if was_active:
        mine = F.col("assignment_id") == assignment_id
        out["templates"] = promote_newest(out["templates"].where(mine)).unionByName(out["templates"].where(~mine))
    return out


def delete_assignment(tables: Tables, assignment_id: str) -> Tables:
    """An assignment goes with all that hangs on it."""
    return cascade(tables, {"assignments": of_assignment(tables["assignments"], assignment_id).select("assignment_id")})


def live_sessions(sessions: DataFrame, now: datetime) -> DataFrame:
    """Sessions that have not expired yet."""
    return sessions.where(F.col("expires_at") > F.lit(now))


def store_results(tables: Tables, run_id: str, results: DataFrame, at: datetime) -> Tables:
    """The results of a run come in place of its former ones, and the run is completed. results: RESULT of similarity with the place of each pair in the response (ord);
    a pair's place among the run's is its sort_order."""
    from tessella.operators.rows import before

    placed = before(results.withColumn("comparison_run_id", F.lit(run_id)), ["comparison_run_id"], ["ord", "pair_id"], sort_order=F.lit(1))
    pair = F.concat_ws("/", "comparison_run_id", "pair_id").alias("pair_result_id")
    pairs = placed.select(pair, "comparison_run_id", "left_id", "right_id", "similarity_score", "matched_token_count", F.col("sort_order").cast("int").alias("sort_order"))
    m = placed.select(pair, F.explode("matches").alias("m"))
    sides = [F.col(f"m.{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("byte_start", "byte_end", "line_start", "line_end", "token_start", "token_end")]
    matches = m.select("pair_result_id", F.col("m.match_id").alias("match_key"), F.upper("m.kind").alias("kind"), *sides)
    kept = cascade(tables, {"pair_results": tables["pair_results"].where(F.col("comparison_run_id") == run_id).select("pair_result_id")})
    return kept | {
        "pair_results": kept["pair_results"].unionByName(pairs), "pair_matches": kept["pair_matches"].unionByName(matches),
        "comparison_runs": _marked(tables["comparison_runs"], "comparison_run_id", run_id, status=F.lit("COMPLETED"), completed_at=F.lit(at)),
    }


def _marked(table: DataFrame, key: str, value: str, **changes: Column) -> DataFrame:
    return table.withColumns({c: F.when(F.col(key) == value, x).otherwise(F.col(c)) for c, x in changes.items()})


def start_run(runs: DataFrame, run_id: str, at: datetime) -> DataFrame:
    return _marked(runs, "comparison_run_id", run_id, status=F.lit("RUNNING"), started_at=F.lit(at), error_message=F.lit(None))


def fail_run(runs: DataFrame, run_id: str, message: str, at: datetime) -> DataFrame:
    return _marked(runs, "comparison_run_id", run_id, status=F.lit("FAILED"), error_message=F.lit(message), completed_at=F.lit(at))


def store_submissions(tables: Tables, assignment_id: str, batch_id: str, prepared: DataFrame, files: DataFrame, skipped: int = 0, warning: str | None = None) -> Tables:
    """Prepared submissions and their files come in, their batch is ready, and the assignment's version rises. prepared: submission_id, display_name, kind, source, source_map; files: submission_id and
    the columns of stored_files()."""
    new = prepared.select("submission_id", F.lit(assignment_id).alias("assignment_id"), F.lit(batch_id).alias("upload_batch_id"), "display_name", F.upper("kind").alias("kind"), "source", "source_map")
    ready = _marked(tables["upload_batches"], "upload_batch_id", batch_id, status=F.lit("READY"), error_message=F.lit(None), warning_message=F.lit(warning), skipped_submission_count=F.lit(skipped))
    touched = of_assignment(tables["assignments"], assignment_id)
    return tables | {
        "submissions": tables["submissions"].unionByName(new), "submission_files": tables["submission_files"].unionByName(files.select(tables["submission_files"].columns)),
        "upload_batches": ready, "assignments": bump(tables["assignments"], touched),
    }


def stored_files(submissions: DataFrame) -> DataFrame:
    """A row for each file of prepared submissions (submission_id, assignment_id, upload_batch_id, slug, source_map): its place, its bytes, and the folder of its object key, which ends in the place from 1, four digits wide.
    The files of a submission are bounded by the limits of extraction."""
    one = submissions.select("submission_id", "assignment_id", "upload_batch_id", "slug", F.posexplode("source_map").alias("canonical_order", "f"))
    folder = F.concat_ws("/", F.lit("prepared"), "assignment_id", "upload_batch_id", "slug", F.lpad((F.col("canonical_order") + 1).cast("string"), 4, "0"))
    return one.select("submission_id", F.col("f.file_path").alias("relative_path"), folder.alias("storage_folder"), "canonical_order", "f.byte_start", "f.byte_end")


def active_work(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """assignment_id, active_uploads, active_runs of the assignments that have either."""
    busy = lambda t, states, name: t.where(F.upper("status").isin(*states)).groupBy("assignment_id").agg(F.count("*").alias(name))
    both = busy(batches, ("QUEUED", "PROCESSING"), "active_uploads").join(busy(runs, ("QUEUED", "RUNNING"), "active_runs"), "assignment_id", "full")
    return both.select("assignment_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("active_uploads", "active_runs")))


def startable(assignments: DataFrame, runs: DataFrame) -> DataFrame:
    """Assignments without a run that is queued or running: only of these may a run be started."""
    return assignments.join(runs.where(F.upper("status").isin("QUEUED", "RUNNING")).select("assignment_id"), "assignment_id", "left_anti")
