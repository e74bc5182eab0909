"""What reviewers look at: runs with their pairs and matches, assignments with all that they hold, filters and look-ups.

Children are gathered to one row a parent before they are joined, so no join multiplies the rows of another; parents without children keep empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import reveal_mode, within_percent

#: What look-ups say.
KEY_INVALID = "That assignment key is invalid or inactive"
LOOKUP_EMPTY = "Enter a valid submission ID or exact submission name."
LOOKUP_NONE = "No such submission."
LOOKUP_MANY = "That name matches multiple submissions. Enter the unique submission ID instead."


def gathered(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[Column], *columns: str) -> DataFrame:
    """parents with the children of each as a sorted list of structs. A list is bounded by what one page shows."""
    rank = [o.alias(f"_{k}") for k, o in enumerate(order)]
    kept = F.struct(*columns)
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rank, kept.alias("_row")))).alias("_all")).select(key, F.transform("_all", lambda x: x["_row"]).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def _sides(pairs: DataFrame, submissions: DataFrame, *columns: str) -> DataFrame:
    """pairs with both submissions as structs; the table is joined twice. A side that is missing is an error."""
    for side in ("left", "right"):
        s = submissions.select(F.col("submission_id").alias(f"_{side}"), F.struct("submission_id", *columns).alias(f"{side}_submission"))
        pairs = pairs.join(s, F.col(f"{side}_id") == F.col(f"_{side}"), "left").drop(f"_{side}")
        said = F.concat(F.lit(f"unknown {side} submission "), F.coalesce(f"{side}_id", F.lit("")))
        pairs = pairs.withColumn(f"{side}_submission", F.when(F.col(f"{side}_submission").isNull(), F.raise_error(said).cast(pairs.schema[f"{side}_submission"].dataType)).otherwise(F.col(f"{side}_submission")))
    return pairs


MATCH = ("match_key", "kind", "left_byte_start", "left_byte_end", "right_byte_start", "right_byte_end")


def with_matches(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """pairs with their matches, and how many of them are comments."""
    out = gathered(pairs, matches, "pair_result_id", "matches", [F.col("match_key")], *MATCH)
    return out.withColumn("comment_match_count", F.size(F.filter("matches", lambda m: F.upper(m["kind"]) == "COMMENT"))).withColumn("match_count", F.size("matches"))


def run_reports(runs: DataFrame, pairs: DataFrame, matches: DataFrame, submissions: DataFrame) -> DataFrame:
    """runs with their pairs in the order of the response, each with both submissions and its matches."""
    whole = _sides(with_matches(pairs, matches), submissions, "display_name", "kind")
    return gathered(runs, whole, "comparison_run_id", "pairs", [F.col("sort_order"), F.col("pair_result_id")], "pair_result_id", "similarity_score", "matched_token_count", "comment_match_count", "match_count", "left_submission", "right_submission", "matches")


def with_files(parents: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """parents with their files by place, and their number."""
    return gathered(parents, files, key, "files", [F.col("canonical_order"), F.col("relative_path")], "relative_path", "canonical_order", "byte_start", "byte_end").withColumn("file_count", F.size("files"))


def pair_details(pairs: DataFrame, matches: DataFrame, runs: DataFrame, assignments: DataFrame, submissions: DataFrame, batches: DataFrame, files: DataFrame) -> DataFrame:
    """Each pair with its run's assignment, its matches, and both submissions with their files and how their submitters can be named."""
    named = submissions.join(batches.select("upload_batch_id", "encrypted_identity", "purpose", "uploader_id"), "upload_batch_id", "left")
    named = with_files(named, files, "submission_id").withColumn("reveal_mode", reveal_mode(F.col("encrypted_identity"), F.col("purpose"), F.col("uploader_id")))
    of_run = runs.select("comparison_run_id", "assignment_id").join(assignments.select("assignment_id", F.struct("assignment_id", "title", "language").alias("assignment")), "assignment_id").select("comparison_run_id", "assignment")
    return _sides(with_matches(pairs, matches).join(of_run, "comparison_run_id"), named, "display_name", "kind", "reveal_mode", "files")


def assignment_details(assignments: DataFrame, keys: DataFrame, batches: DataFrame, submissions: DataFrame, submission_files: DataFrame, templates: DataFrame, template_files: DataFrame, reports: DataFrame) -> DataFrame:
    """assignments with their keys, batches (latest first), submissions (earliest first) and templates (newest first) with files, and runs (latest first; reports: of run_reports)."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    latest = -at
    out = gathered(assignments, keys, "assignment_id", "keys", [F.col("public_key")], "public_key", "is_active")
    out = gathered(out, batches, "assignment_id", "batches", [latest, F.col("upload_batch_id")], "upload_batch_id", "purpose", "status")
    held = with_files(submissions, submission_files, "submission_id")
    out = gathered(out, held, "assignment_id", "submissions", [at, F.col("submission_id")], "submission_id", "display_name", "kind", "file_count", "files")
    held = with_files(templates, template_files, "template_id")
    out = gathered(out, held, "assignment_id", "templates", [-F.col("version_number"), F.col("template_id")], "template_id", "version_number", "is_active", "file_count", "files")
    return gathered(out, reports, "assignment_id", "runs", [latest, F.col("comparison_run_id")], "comparison_run_id", "status", "pairs")


def pair_category(left: Column, right: Column) -> Column:
    """current-current or current-historical, in either order of the sides; null for two historical ones."""
    l, r = F.lower(left), F.lower(right)
    mixed = ((l == "current") & (r == "historical")) | ((l == "historical") & (r == "current"))
    return F.when((l == "current") & (r == "current"), "current-current").when(mixed, "current-historical")


def shown_pairs(pairs: DataFrame, low: str, high: str, comments_only: bool) -> DataFrame:
    """Pairs whose score is within the typed percentages and, if wanted, that have a comment match."""
    found = pairs.where(within_percent("similarity_score", low, high))
    return found.where("comment_match_count >= 1") if comments_only else found


def filtered_out(pairs: DataFrame, key: str, low: str, high: str, comments_only: bool) -> DataFrame:
    """Of each key: all pairs, those that the score leaves out, and those that the wish for comments leaves out of the rest."""
    scored = within_percent("similarity_score", low, high)
    told = F.lit(not comments_only) | (F.col("comment_match_count") >= 1)
    return pairs.groupBy(key).agg(F.count("*").alias("total"), F.count_if(~scored).alias("by_score"), F.count_if(scored & ~told).alias("by_comment"))


def active_key(keys: DataFrame, typed: str) -> DataFrame:
    """The active key that was typed, in either case and with blanks around it; an error without one."""
    wanted = typed.strip().lower()
    found = keys.where((F.col("public_key") == wanted) & F.col("is_active")).limit(1)
    if not wanted or found.isEmpty():
        raise ValueError(KEY_INVALID)
    return found


def find_submission(submissions: DataFrame, typed: str) -> DataFrame:
    """The submission of an id, or else of a name that no other has; an error otherwise."""
    wanted = typed.strip()
    if not wanted:
        raise ValueError(LOOKUP_EMPTY)
    by_id = submissions.where(F.col("submission_id") == wanted).limit(1)
    if not by_id.isEmpty():
        return by_id
    by_name = submissions.where(F.col("display_name") == wanted).limit(2)
    n = by_name.count()
    if n != 1:
        raise ValueError(LOOKUP_MANY if n else LOOKUP_NONE)
    return by_name
