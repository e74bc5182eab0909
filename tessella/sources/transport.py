"""Requests and responses of comparisons as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Params
from tessella.functions.lexer import LITERALS
from tessella.operators import similarity

#: Fixed value: the version of the schema.
VERSION = "1.0"
MAP = "array<struct<filePath: string, byteStart: int, byteEnd: int>>"
REQUEST = (
    f"schemaVersion string, engineVersion string, language string, submissions array<struct<submissionId: string, submissionKind: string, source: string, sourceMap: {MAP}>>, "
    f"template struct<source: string, sourceMap: {MAP}>, pairs array<struct<pairId: string, leftSubmissionId: string, rightSubmissionId: string>>, params struct<gstMinMatchLength: int, minimumCommentLength: int>"
)


class RequestError(ValueError):
    pass


def _map(entries: Column) -> Column:
    return F.transform(F.coalesce(entries, F.array().cast(MAP)), lambda e: F.struct(e["filePath"].alias("file_path"), e["byteStart"].alias("byte_start"), e["byteEnd"].alias("byte_end")))


def _span(s: Column) -> Column:
    position = F.struct(*(s[a].alias(b) for a, b in (("line_start", "lineStart"), ("column_start", "columnStart"), ("line_end", "lineEnd"), ("column_end", "columnEnd"))))
    tokens = F.struct(s["token_start"].alias("tokenStart"), s["token_end"].alias("tokenEnd"))
    return F.struct(s["byte_start"].alias("byteStart"), s["byte_end"].alias("byteEnd"), s["file_path"].alias("filePath"), position.alias("position"), tokens.alias("tokens"))


def answered(spark: SparkSession, path: str) -> DataFrame:
    """The response to the request in a JSON file, a row with the column `response`; RequestError names what is wrong with the request. A request is of one assignment; its submissions and pairs are compared as rows."""
    asked = spark.read.schema(REQUEST).option("multiLine", "true").json(path)
    head = asked.select("schemaVersion", "engineVersion", "language", "params", F.size("submissions").alias("n"), F.col("template").isNotNull().alias("template")).first()
    _check_head(head)
    one = asked.select(F.explode("submissions").alias("s"), "language")
    submissions = one.select(F.col("s.submissionId").alias("submission_id"), F.lit("request").alias("assignment_id"), F.col("s.submissionKind").alias("kind"), F.lit(0).cast("long").alias("ord"), "language", F.coalesce("s.source", F.lit("")).alias("source"), _map(F.col("s.sourceMap")).alias("source_map"))
    pairs = asked.select(F.posexplode("pairs").alias("ord", "p")).select("ord", F.col("p.pairId").alias("pair_id"), F.col("p.leftSubmissionId").alias("left_id"), F.col("p.rightSubmissionId").alias("right_id"))
    template = asked.select(F.lit("request").alias("assignment_id"), "language", "template.source", _map(F.col("template.sourceMap")).alias("source_map")) if head.template else None
    wrong = similarity.problems(submissions, pairs)
    if template is not None:
        wrong = wrong.unionAll(similarity.bad_maps(template.withColumn("submission_id", F.lit("template"))))
    if found := wrong.orderBy("problem").first():
        raise RequestError(found.problem)
    params = Params(gst_min_match_length=head.params.gstMinMatchLength, minimum_comment_length=head.params.minimumCommentLength)
    results = similarity.compared(pairs.drop("ord"), similarity.prepared(submissions, template, params), params).join(pairs.select("pair_id", "ord"), "pair_id")
    match = lambda m: F.struct(m["match_id"].alias("matchId"), m["kind"].alias("kind"), _span(m["left"]).alias("left"), _span(m["right"]).alias("right"), m["matched_token_count"].alias("matchedTokenCount"))
    row = F.struct("ord", F.struct(F.col("pair_id").alias("pairId"), F.col("left_id").alias("leftSubmissionId"), F.col("right_id").alias("rightSubmissionId"), F.col("similarity_score").alias("similarityScore"), F.col("matched_token_count").alias("matchedTokenCount"), F.transform("matches", match).alias("matches")).alias("r"))
    whole = results.agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("pairResults"))
    return whole.select(F.to_json(F.struct(F.lit(head.schemaVersion).alias("schemaVersion"), F.lit(head.engineVersion).alias("engineVersion"), F.lit(head.language).alias("language"), "pairResults")).alias("response"))


def _check_head(head) -> None:
    if head is None or head.schemaVersion != VERSION:
        raise RequestError(f"schema_version must be {VERSION}")
    if not (head.engineVersion or "").strip():
        raise RequestError("engine_version must be non-empty")
    if head.language not in LITERALS:
        raise RequestError(f"unknown language: {head.language}")
    if not head.n or head.n < 0:
        raise RequestError("submissions must be non-empty")
    for name, value in (("gst_min_match_length", head.params and head.params.gstMinMatchLength), ("minimum_comment_length", head.params and head.params.minimumCommentLength)):
        if not value or value <= 0:
            raise RequestError(f"{name} must be greater than zero")
