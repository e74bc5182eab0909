"""Reviews, look-ups and deletions over the driver's tables, each with the same in SQL.

Customers stand for assignments, orders for their runs and submissions, lineitem for pairs and files, parts and suppliers for the submissions of pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns, lexer
from tessella.operators import review, state
from tessella.operators.rows import per_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers f(t), in which t(name) is a table, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


# Runs, pairs, matches and the submissions of pairs.

#: A line number may occur twice in an order: its largest values are the pair.
LINES_SQL = "li AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def lines(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")))


def pairs(t) -> DataFrame:
    return lines(t).select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("pair_result_id"), F.col("l_orderkey").alias("comparison_run_id"), F.concat(F.lit("p"), "l_partkey").alias("left_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("right_id"), F.col("l_discount").alias("similarity_score"), F.col("l_quantity").cast("long").alias("matched_token_count"), F.col("l_linenumber").alias("sort_order"),
    )


def matches(t) -> DataFrame:
    """Two matches of each odd line, the first of them a comment."""
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    l = lines(t).where("l_linenumber % 2 = 1").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("pair_result_id"), k)
    return l.select("pair_result_id", F.concat(F.lit("m-"), "k").alias("match_key"), F.when(F.col("k") == 0, "COMMENT").otherwise("CODE").alias("kind"), *(F.col("k").alias(c) for c in review.MATCH[2:]))


def compared_submissions(t) -> DataFrame:
    p = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("submission_id"), F.col("p_name").alias("display_name"), F.lit("CURRENT").alias("kind"), F.lit("b1").alias("upload_batch_id"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "HISTORICAL").otherwise("CURRENT").alias("kind")
    return p.unionAll(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_name", kind, F.concat(F.lit("b"), F.col("s_suppkey") % 3)))


def runs(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("comparison_run_id"), F.col("o_custkey").alias("assignment_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def reports(t) -> DataFrame:
    return review.run_reports(runs(t), pairs(t), matches(t), compared_submissions(t))


#: A pair as one text: what the nested rows hold, for the comparison with SQL.
PAIR_SQL = """l_linenumber || ' ' || p_name || ' ' || s_name || ' ' || CASE s_suppkey % 2 WHEN 0 THEN 'HISTORICAL' ELSE 'CURRENT' END || ' ' || CAST(l_quantity AS BIGINT) || ' ' || (l_linenumber % 2) || ' '
  || CASE l_linenumber % 2 WHEN 1 THEN 'm-0 m-1' ELSE '' END"""
RUNS_SQL = f"""{LINES_SQL}, r AS (SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderdate) AS o_orderdate, CAST(count(l_orderkey) AS BIGINT) AS n_pairs, coalesce(string_agg({PAIR_SQL}, '; ' ORDER BY l_linenumber), '') AS pairs
  FROM orders LEFT JOIN (li JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def told(p) -> Column:
    keys = F.array_join(F.transform(p["matches"], lambda m: m["match_key"]), " ")
    place = F.substring_index(p["pair_result_id"], "/", -1)
    return F.concat_ws(" ", place, p["left_submission"]["display_name"], p["right_submission"]["display_name"], p["right_submission"]["kind"], p["matched_token_count"], p["comment_match_count"], keys)


def all_told(p) -> Column:
    return F.array_join(F.transform(p, told), "; ")


@query(f"WITH {RUNS_SQL} SELECT o_orderkey, n_pairs, pairs FROM r")
def run_reports(t):
    return reports(t).select(F.col("comparison_run_id").alias("o_orderkey"), F.size("pairs").cast("long").alias("n_pairs"), all_told(F.col("pairs")).alias("pairs"))


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, o_custkey, c_name AS title, 'display_name' AS left_reveal,
  CASE s_suppkey % 3 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'display_name' END AS right_reveal, CAST(coalesce(n, 0) AS BIGINT) AS left_files, coalesce(files, '') AS left_file_names, CAST(2 * (l_linenumber % 2) AS BIGINT) AS n_matches
FROM li JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN (SELECT p_partkey, p_size % 3 AS n, string_agg('f' || k, ',' ORDER BY k) AS files FROM (SELECT p_partkey, p_size, unnest(range(0, p_size % 3)) AS k FROM part) GROUP BY p_partkey, p_size) ON p_partkey = l_partkey""")
def pair_details(t):
    """Batch b0 has an identity, b1 is anonymous, b2 was handed in by a user."""
    batches = t("region").where("r_regionkey < 3").select(
        F.concat(F.lit("b"), "r_regionkey").alias("upload_batch_id"), F.when(F.col("r_regionkey") == 0, "sidenc:v1:k:x").alias("encrypted_identity"), F.lit("STUDENT_SUBMISSION").alias("purpose"),
        F.when(F.col("r_regionkey") == 2, "u").alias("uploader_id"),
    )
    k = F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < F.col("p_size") % 3)).alias("canonical_order")
    files = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("submission_id"), k).withColumns({"relative_path": F.concat(F.lit("f"), "canonical_order"), "byte_start": F.lit(0), "byte_end": F.lit(1)})
    assignments = t("customer").select(F.col("c_custkey").alias("assignment_id"), F.col("c_name").alias("title"), F.lit("java").alias("language"))
    found = review.pair_details(pairs(t), matches(t), runs(t), assignments, compared_submissions(t), batches, files)
    names = F.array_join(F.transform("left_submission.files", lambda f: f["relative_path"]), ",")
    return found.select(
        F.col("comparison_run_id").alias("l_orderkey"), F.col("sort_order").alias("l_linenumber"), F.col("assignment.assignment_id").alias("o_custkey"), F.col("assignment.title").alias("title"),
        F.col("left_submission.reveal_mode").alias("left_reveal"), F.col("right_submission.reveal_mode").alias("right_reveal"), F.size("left_submission.files").cast("long").alias("left_files"),
        names.alias("left_file_names"), F.col("match_count").cast("long").alias("n_matches"),
    )


@query(f"""WITH {RUNS_SQL}, a AS (SELECT o_custkey, string_agg(o_orderkey || ':' || n_pairs, ',' ORDER BY o_orderdate DESC, o_orderkey) AS runs FROM r GROUP BY o_custkey),
f AS (SELECT l_orderkey, string_agg('l' || l_linenumber, '+' ORDER BY l_linenumber) AS files, count(*) AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_custkey, string_agg(o_orderkey || ' ' || coalesce(n, 0) || ' ' || coalesce(files, ''), ',' ORDER BY o_orderdate, o_orderkey) AS submissions FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, lower(c_name) AS key, coalesce(runs, '') AS runs, coalesce(submissions, '') AS submissions, CASE WHEN s_suppkey IS NULL THEN '' ELSE 't' || s_suppkey || ' 0' END AS templates, CAST(0 AS BIGINT) AS n_batches
FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""")
def assignment_details(t):
    assignments = t("customer").select(F.col("c_custkey").alias("assignment_id"), "c_name")
    keys = t("customer").select(F.col("c_custkey").alias("assignment_id"), F.lower("c_name").alias("public_key"), F.lit(True).alias("is_active"))
    submissions = t("orders").select(F.col("o_custkey").alias("assignment_id"), F.col("o_orderkey").alias("submission_id"), F.lit("").alias("display_name"), F.lit("CURRENT").alias("kind"), F.col("o_orderdate").alias("created_at"))
    files = t("lineitem").select(F.col("l_orderkey").alias("submission_id"), F.concat(F.lit("l"), "l_linenumber").alias("relative_path"), F.col("l_linenumber").alias("canonical_order"), F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end"))
    templates = t("supplier").select(F.col("s_suppkey").alias("assignment_id"), F.concat(F.lit("t"), "s_suppkey").alias("template_id"), F.lit(1).alias("version_number"), F.lit(True).alias("is_active"))
    none = files.limit(0).withColumnRenamed("submission_id", "template_id").withColumn("template_id", F.lit(""))
    batches = t("events").limit(0).select(F.col("user_id").alias("assignment_id"), F.col("event_type").alias("upload_batch_id"), F.col("event_type").alias("purpose"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    found = review.assignment_details(assignments, keys, batches, submissions, files, templates, none, reports(t))
    listed = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return found.select(
        F.col("assignment_id").alias("c_custkey"), F.col("keys")[0]["public_key"].alias("key"), listed("runs", lambda r: F.concat_ws(":", r["comparison_run_id"], F.size(r["pairs"]))),
        listed("submissions", lambda s: F.concat_ws(" ", s["submission_id"], s["file_count"], F.array_join(F.transform(s["files"], lambda f: f["relative_path"]), "+"))),
        listed("templates", lambda x: F.concat_ws(" ", x["template_id"], x["file_count"])), F.size("batches").cast("long").alias("n_batches"),
    )


# Filters and look-ups.


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 AND l_suppkey % 2 = 0 THEN 'current-current' WHEN l_partkey % 2 = 0 OR l_suppkey % 2 = 0 THEN 'current-historical' END AS category FROM lineitem""")
def pair_categories(t):
    kind = lambda c: F.when(F.col(c) % 2 == 0, "CURRENT").otherwise("HISTORICAL")
    return t("lineitem").select("l_orderkey", "l_linenumber", review.pair_category(kind("l_partkey"), kind("l_suppkey")).alias("category"))


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS by_score, CAST(count(*) FILTER (WHERE ok AND l_linenumber % 2 = 0) AS BIGINT) AS by_comment
FROM (SELECT *, l_discount >= 2.0 / 100 AND l_discount <= 5.0 / 100 AS ok FROM li) GROUP BY l_orderkey""")
def filtered_out(t):
    return review.filtered_out(review.with_matches(pairs(t), matches(t)), "comparison_run_id", "2", "5 ", True).withColumnRenamed("comparison_run_id", "l_orderkey")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber FROM li WHERE l_linenumber % 2 = 1 AND l_discount >= 2.0 / 100")
def shown_pairs(t):
    found = review.shown_pairs(review.with_matches(pairs(t), matches(t)), "2", "", True)
    return found.select(F.col("comparison_run_id").alias("l_orderkey"), F.col("sort_order").alias("l_linenumber"))


@query("SELECT c_custkey FROM customer WHERE c_custkey = 7")
def active_key(t):
    keys = t("customer").select("c_custkey", F.lower("c_name").alias("public_key"), (F.col("c_custkey") % 7 == 0).alias("is_active"))
    name = t("customer").where("c_custkey = 7").first().c_name
    return review.active_key(keys, f"  {name.upper()}\n").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (5, 9)")
def find_submission(t):
    named = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("submission_id"), F.col("c_name").alias("display_name"))
    name = t("customer").where("c_custkey = 9").first().c_name
    return review.find_submission(named, " 5 ").unionAll(review.find_submission(named, name)).select("c_custkey")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS anonymous, CASE WHEN o_orderkey % 5 = 0 THEN 'encrypted' WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'display_name' END AS mode FROM orders""")
def reveal_modes(t):
    k = F.col("o_orderkey") % 5
    identity = F.when(k == 0, "sidenc:v1:k:x").when(k == 1, "")
    purpose, uploader = F.when(F.col("o_orderkey") % 3 == 0, "student_submission").otherwise("HISTORICAL_SUBMISSION"), F.when(F.col("o_custkey") % 2 == 1, "u")
    return t("orders").select("o_orderkey", columns.public_anonymous(purpose, uploader).alias("anonymous"), columns.reveal_mode(identity, purpose, uploader).alias("mode"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity + l_linenumber > 8 THEN round(2.0 * l_linenumber / (l_quantity + l_linenumber - 8), 9) ELSE 0.0 END AS dice FROM lineitem")
def dice_coverage(t):
    value = columns.dice(F.col("l_linenumber"), F.greatest(F.col("l_quantity") + F.col("l_linenumber") - 8, F.lit(0)), F.lit(0))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(value, 9).alias("dice"))


def _channel(turn: int) -> str:
    return f"printf('%02x', CAST(floor((0.52 - 0.3456 * greatest(-1.0, least((hue / 30 + {turn}) % 12 - 3, 9 - (hue / 30 + {turn}) % 12, 1.0))) * 255 + 0.5) AS INTEGER))"


@query(f"SELECT p_partkey, '#' || {_channel(0)} || {_channel(8)} || {_channel(4)} AS colour FROM (SELECT p_partkey, CAST(floor((p_partkey * 137.508::DOUBLE) % 360 + 0.5) AS DOUBLE) AS hue FROM part)")
def match_colours(t):
    return t("part").select("p_partkey", columns.match_colour(F.col("p_partkey")).alias("colour"))


@query("""WITH s AS (SELECT p_partkey, strlen(p_name) AS n, strlen(p_type) AS m, p_size AS a, p_size + 40 AS b FROM part), e AS (SELECT *, 7 + 3 + n + 1 AS x, 7 + 3 + n + 1 + 7 AS y FROM s), z AS (SELECT *, y + m + 6 AS c, y + m + 6 + 7 AS size FROM e),
g AS (SELECT p_partkey, greatest(a, 0) AS lo, least(b, 7, size) AS hi FROM z WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, greatest(a, x), least(b, y, size) FROM z WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, greatest(a, c), least(b, size) FROM z WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, least(a, size), least(b, size) FROM z WHERE p_partkey % 3 = 0)
SELECT p_partkey, CAST(lo AS BIGINT) AS byte_start, CAST(hi AS BIGINT) AS byte_end FROM g WHERE hi > lo""")
def render_spans(t):
    """A line with a comment behind its code, one with a comment in front of its code's end."""
    source = F.concat(F.lit("int x; // "), "p_name", F.lit("\nint y; /* "), "p_type", F.lit(" */int z;\n"))
    p = t("part").select("p_partkey", "p_size", source.alias("source"))
    hidden = per_row(p, ["source"], "hidden array<struct<a: bigint, b: bigint>>", lambda s: [{"a": a, "b": b} for a, b in lexer.trailing_comments(s)])
    kind = F.when(F.col("p_partkey") % 3 == 0, "comment").otherwise("code")
    return hidden.select("p_partkey", F.inline(columns.render_spans(F.col("p_size"), F.col("p_size") + 40, kind, F.col("hidden"), F.octet_length("source"))))


# Deletions and sinks.


def held(t) -> state.Tables:
    """Assignments with all that hangs on them. The orders of an assignment came in two batches, its template, if it has one, in the second."""
    batch = lambda a, k: F.concat_ws("-", a, k)
    o, s = t("orders"), t("supplier")
    mine = o.select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("assignment_id"), batch("o_custkey", F.col("o_orderkey") % 2).alias("upload_batch_id"))
    templates = s.select(F.concat(F.lit("t"), "s_suppkey").alias("template_id"), F.col("s_suppkey").alias("assignment_id"), batch("s_suppkey", F.lit(1)).alias("upload_batch_id"), F.lit(1).alias("version_number"), F.lit(True).alias("is_active"), F.lit(0).alias("created_at"))
    older = templates.withColumns({"template_id": F.concat("template_id", F.lit("old")), "version_number": F.lit(0), "is_active": F.lit(False)})
    return {
        "assignments": t("customer").select(F.col("c_custkey").alias("assignment_id"), F.lit(1).alias("comparison_input_version")), "submissions": mine, "templates": templates.unionAll(older),
        "submission_files": t("lineitem").select(F.col("l_orderkey").alias("submission_id"), "l_linenumber"), "template_files": templates.unionAll(older).select("template_id"),
        "upload_batches": mine.select("upload_batch_id", "assignment_id").union(templates.select("upload_batch_id", "assignment_id")).distinct(),
        "comparison_runs": t("events").select(F.col("event_id").alias("comparison_run_id"), F.col("user_id").alias("assignment_id")),
        "pair_results": t("events").select(F.concat(F.lit("r"), "event_id").alias("pair_result_id"), F.col("event_id").alias("comparison_run_id")),
        "pair_matches": t("events").select(F.concat(F.lit("r"), "event_id").alias("pair_result_id")),
    }


NAMED = {"assignments": "concat_ws(':', assignment_id, comparison_input_version)", "submissions": "submission_id", "templates": "concat_ws(':', template_id, is_active)", "submission_files": "concat_ws('/', submission_id, l_linenumber)", "template_files": "template_id", "upload_batches": "upload_batch_id", "comparison_runs": "comparison_run_id", "pair_results": "pair_result_id", "pair_matches": "pair_result_id"}


def listed(tables: state.Tables) -> DataFrame:
    out = None
    for name, key in NAMED.items():
        one = tables[name].select(F.lit(name).alias("what"), F.expr(f"cast({key} as string)").alias("id"))
        out = one if out is None else out.unionAll(one)
    return out


HELD_SQL = """a AS (SELECT c_custkey AS a, c_custkey || ':1' AS id FROM customer), s AS (SELECT o_custkey AS a, o_orderkey AS s, o_custkey || '-' || (o_orderkey % 2) AS b FROM orders),
m AS (SELECT s_suppkey AS a, 't' || s_suppkey AS t, s_suppkey || '-1' AS b, true AS active FROM supplier UNION ALL SELECT s_suppkey, 't' || s_suppkey || 'old', s_suppkey || '-1', false FROM supplier),
b AS (SELECT DISTINCT b, a FROM (SELECT b, a FROM s UNION ALL SELECT b, a FROM m)), r AS (SELECT event_id AS r, user_id AS a FROM events)"""


def left_sql(assignments: str, submissions: str, templates: str, active: str, batches: str, runs: str) -> str:
    """What is left of each table, given what of it stays."""
    return f"""WITH {HELD_SQL}, s2 AS (SELECT * FROM s WHERE {submissions}), m2 AS (SELECT * FROM m WHERE {templates}), r2 AS (SELECT * FROM r WHERE {runs})
SELECT 'assignments' AS what, {assignments} UNION ALL SELECT 'submissions', CAST(s AS VARCHAR) FROM s2 UNION ALL SELECT 'templates', t || ':' || CASE WHEN {active} THEN 'true' ELSE 'false' END FROM m2
UNION ALL SELECT 'submission_files', l_orderkey || '/' || l_linenumber FROM lineitem JOIN s2 ON s = l_orderkey UNION ALL SELECT 'template_files', t FROM m2 UNION ALL SELECT 'upload_batches', b FROM b WHERE {batches}
UNION ALL SELECT 'comparison_runs', CAST(r AS VARCHAR) FROM r2 UNION ALL SELECT 'pair_results', 'r' || r FROM r2 UNION ALL SELECT 'pair_matches', 'r' || r FROM r2"""


#: An assignment that has runs, submissions and templates, and its first submission.
ONE = 3
FIRST_SQL = f"(SELECT min(o_orderkey) FROM orders WHERE o_custkey = {ONE})"
BUMPED_SQL = f"CASE a WHEN {ONE} THEN a || ':2' ELSE id END AS id FROM a"


@query(left_sql(BUMPED_SQL, f"s <> {FIRST_SQL}", "true", "active", f"b IN (SELECT b FROM m2 UNION ALL SELECT b FROM s2) OR a <> {ONE}", f"a <> {ONE}"))
def delete_submission(t):
    first = t("orders").where(F.col("o_custkey") == ONE).agg(F.min("o_orderkey")).first()[0]
    return listed(state.delete_submission(held(t), ONE, first))


@query(left_sql(BUMPED_SQL, "true", f"t <> 't{ONE}'", f"active OR t = 't{ONE}old'", "true", f"a <> {ONE}"))
def delete_template(t):
    return listed(state.delete_template(held(t), ONE, f"t{ONE}"))


@query(left_sql(f"id FROM a WHERE a <> {ONE}", f"a <> {ONE}", f"a <> {ONE}", "active", f"a <> {ONE}", f"a <> {ONE}"))
def delete_assignment(t):
    return listed(state.delete_assignment(held(t), ONE))


@query("""SELECT c_custkey, CAST(k AS INTEGER) AS place, 'prepared/' || c_nationkey || '/b/' || c_custkey || '/' || printf('%04d', CAST(k + 1 AS INTEGER)) AS folder, 'f' || k AS path, CAST(10 * k AS INTEGER) AS byte_start
FROM (SELECT c_custkey, c_nationkey, unnest(range(0, 1 + c_custkey % 12)) AS k FROM customer)""")
def stored_files(t):
    entry = lambda k: F.struct(F.concat(F.lit("f"), k).alias("file_path"), (10 * k).cast("int").alias("byte_start"), (10 * k + 10).cast("int").alias("byte_end"))
    count = (F.col("c_custkey") % 12).cast("int")
    s = t("customer").select(F.col("c_custkey").alias("submission_id"), F.col("c_nationkey").alias("assignment_id"), F.lit("b").alias("upload_batch_id"), F.col("c_custkey").alias("slug"), F.transform(F.sequence(F.lit(0), count), entry).alias("source_map"))
    return state.stored_files(s).select(F.col("submission_id").alias("c_custkey"), F.col("canonical_order").alias("place"), F.col("storage_folder").alias("folder"), F.col("relative_path").alias("path"), "byte_start")


@query("""SELECT user_id, CAST(count(*) FILTER (WHERE event_type IN ('view', 'click')) AS BIGINT) AS active_uploads, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS active_runs FROM events
WHERE user_id % 2 = 0 AND event_type IN ('view', 'click', 'error') GROUP BY user_id""")
def active_work(t):
    said = lambda *states: F.element_at(F.create_map(*(F.lit(x) for pair in states for x in pair)), F.col("event_type")).alias("status")
    e = t("events").where("user_id % 2 = 0")
    batches = e.where("event_type in ('view', 'click', 'purchase')").select(F.col("user_id").alias("assignment_id"), said(("view", "QUEUED"), ("click", "processing"), ("purchase", "READY")))
    ran = e.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("assignment_id"), said(("error", "RUNNING"), ("signup", "COMPLETED")))
    return state.active_work(batches, ran).withColumnRenamed("assignment_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0)")
def startable(t):
    ran = t("orders").select(F.col("o_custkey").alias("assignment_id"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0), "queued").otherwise("COMPLETED").alias("status"))
    return state.startable(t("customer").select(F.col("c_custkey").alias("assignment_id")), ran).select(F.col("assignment_id").alias("c_custkey"))
