"""Relational operators of the review platform as DataFrame plans over the driver's tables, each with the same in SQL.

Documents stand for submissions (plans/inputs.py), their lines and conversations for comments, orders and lineitem for runs and pairs. The queries call the library's operators; the SQL
is written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import tiling
from tessella.operators import grams, similarity, state
from tessella.operators.rows import before, per_row
from tessella.plans.inputs import KIND_SQL, kind, numbered_submissions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers f(t), in which t(name) is a table, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


SUBS = f"s AS (SELECT doc_id, source, text, {KIND_SQL} AS kind FROM documents)"


def subs(t) -> DataFrame:
    return t("documents").select("doc_id", "source", "text", kind().alias("kind"))


#: Submissions of a block, about; ids in a row that stay together in one, so that pairs in a row look alike; partitions that the pairs of blocks are dealt to at most.
BLOCK, ROW, PARTITIONS = 4096, 64, 10_000


def _pairs(t, kind: str) -> DataFrame:
    """Pairs of current submissions with those of a kind: left_id, right_id, and both as text (left, right).

    A source is dealt to blocks, and each left block meets each right one in a cell of its own, so that many tasks make the pairs of a large source. What is shuffled is a row for each
    submission and cell of its source that has it, about the number of pairs over BLOCK."""
    s = subs(t).where("source IS NOT NULL").select("doc_id", "source", "kind")
    blocks = s.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    n = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 0, PARTITIONS))
    # sources of one block are not told, so there is one row for BLOCK submissions at most
    dealt = s.join(F.broadcast(blocks.where("blocks > 1")), "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))

    def side(kind: str, name: str, mine: str, other: str) -> DataFrame:
        block, others = F.pmod(F.xxhash64(F.expr(f"doc_id div {ROW}")), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        # ids become text here, and not once a pair
        ids = F.col("doc_id").alias(f"{name}_id"), F.col("doc_id").cast("string").alias(name)
        return dealt.where(F.col("kind") == kind).select("source", block.alias(mine), others.alias(other), *ids).repartition(n, "source", "l", "r")

    out = side("current", "left", "l", "r").join(side(kind, "right", "r", "l"), ["source", "l", "r"])
    return (out.where("left_id < right_id") if kind == "current" else out).drop("source", "l", "r")


@query(f"WITH {SUBS} SELECT l.doc_id AS left_id, r.doc_id AS right_id FROM s l JOIN s r ON l.source = r.source AND l.doc_id < r.doc_id WHERE l.kind = 'current' AND r.kind = 'current'")
def pairs_current_current(t):
    return _pairs(t, "current").select("left_id", "right_id")


@query(f"WITH {SUBS} SELECT l.doc_id AS left_id, r.doc_id AS right_id FROM s l JOIN s r ON l.source = r.source WHERE l.kind = 'current' AND r.kind = 'historical'")
def pairs_current_historical(t):
    return _pairs(t, "historical").select("left_id", "right_id")


@query(f"""WITH {SUBS} SELECT l.doc_id || '__' || r.doc_id AS pair_id, CASE r.kind WHEN 'current' THEN 0 ELSE 1 END AS category
FROM s l JOIN s r ON l.source = r.source AND (r.kind = 'historical' OR l.doc_id < r.doc_id) WHERE l.kind = 'current'""")
def allowed_pairs_union(t):
    both = _pairs(t, "current").withColumn("category", F.lit(0)).unionAll(_pairs(t, "historical").withColumn("category", F.lit(1)))
    return both.select(F.concat("left", F.lit("__"), "right").alias("pair_id"), "category")


@query("""SELECT doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start,
  CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS byte_end, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS canonical_order
FROM (SELECT doc_id, source, strlen(text) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS n FROM documents)""")
def concat_offsets(t):
    n = (F.octet_length("text") + F.when(F.endswith("text", F.lit("\n")), 0).otherwise(1)).cast("long")
    d = before(t("documents").select("doc_id", "source", n.alias("n")), ["source"], ["doc_id"], byte_start=F.col("n"), canonical_order=F.lit(1).cast("long"))
    return d.select("doc_id", "byte_start", (F.col("byte_start") + F.col("n")).alias("byte_end"), "canonical_order")


NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def normal(c="text"):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}\s]", " "), r"\s+", " "))


@query(f"SELECT conv_id, turn, {NORMAL} AS normal, CAST(strlen({NORMAL}) AS BIGINT) AS n_bytes FROM conversations")
def comment_normalize(t):
    return t("conversations").select("conv_id", "turn", normal().alias("normal"), F.octet_length(normal()).cast("long").alias("n_bytes"))


OCC = f"""c AS (SELECT conv_id, turn, normal, row_number() OVER (PARTITION BY conv_id, normal ORDER BY turn) AS k
  FROM (SELECT conv_id, turn, {NORMAL} AS normal FROM conversations) WHERE strlen(normal) >= 35)"""
LINE_NORMAL = NORMAL.replace("lower(text)", "lower(line)")


def lines(t) -> DataFrame:
    """The lines of documents as comments."""
    return subs(t).select("doc_id", "source", "kind", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(f"""WITH l AS (SELECT doc_id, source, {KIND_SQL} AS kind, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, source, kind, n, normal, row_number() OVER (PARTITION BY doc_id, normal ORDER BY n) AS k FROM (SELECT *, {LINE_NORMAL} AS normal FROM l) WHERE strlen(normal) >= 35)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, CAST(a.n AS BIGINT) AS left_line, CAST(b.n AS BIGINT) AS right_line
FROM c a JOIN c b ON a.source = b.source AND a.normal = b.normal AND a.k = b.k WHERE a.kind = 'current' AND (b.kind = 'historical' OR a.doc_id < b.doc_id)""")
def comment_zip_join(t):
    said = lines(t).select(F.col("doc_id").alias("submission_id"), F.col("source").alias("assignment_id"), "kind", F.col("doc_id").alias("ord"), F.col("n").cast("long").alias("line"), normal("line").alias("normal"))
    return similarity.comment_pairs(similarity.occurrences(said, ["line"]), "line")


@query(f"""WITH {OCC}, t AS (SELECT normal, count(*) AS n FROM c WHERE conv_id % 10 = 0 GROUP BY normal)
SELECT conv_id, turn FROM c LEFT JOIN t ON c.normal = t.normal WHERE conv_id % 10 <> 0 AND k > coalesce(n, 0)""")
def template_comment_antijoin(t):
    """Each tenth conversation is of the template."""
    said = similarity.occurrences(t("conversations").select(F.col("conv_id").alias("submission_id"), "turn", normal().alias("normal")), ["turn"])
    left = similarity.without_template(said.where("submission_id % 10 <> 0"), said.where("submission_id % 10 = 0"))
    return left.select(F.col("submission_id").alias("conv_id"), "turn")


@query("""WITH p AS (SELECT page_id, strlen(html) AS n FROM pages), f AS (SELECT page_id, CAST(unnest(range(0, n, 700)) AS BIGINT) AS a FROM p), q AS (SELECT page_id, CAST(unnest(range(0, n - 200, 300)) AS BIGINT) AS bs FROM p)
SELECT q.page_id, bs, 'part-' || (a // 700) AS file_path FROM q LEFT JOIN f ON q.page_id = f.page_id AND a <= bs AND bs + 150 <= a + 700""")
def span_to_file(t):
    p = t("pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"), F.octet_length("html").alias("n")).where("n > 200")
    files = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(700)), lambda a: F.struct(F.concat(F.lit("part-"), (a / 700).cast("int")).alias("file_path"), a.alias("byte_start"), (a + 700).alias("byte_end")))
    p = p.withColumn("files", files).withColumn("starts", F.sequence(F.lit(0), F.col("n") - 201, F.lit(300)))

    def found(html, files, starts):
        at = similarity.line_starts(html)
        return [{"bs": a, "file_path": similarity.located(at, files, a, a + 150)["file_path"]} for a in starts]

    return per_row(p, ["html", "files", "starts"], "found array<struct<bs: bigint, file_path: string>>", found).select("page_id", F.inline("found"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents), p AS (SELECT doc_id, substr(text, 1, n // 4) AS a, substr(text, 1, 3 * n // 4) AS b FROM d WHERE n >= 4),
q AS (SELECT *, substr(b, 1, length(b) - 1) AS c, strlen(a) AS byte_start, strlen(b) AS byte_end FROM p),
r AS (SELECT *, strlen(a) - strlen(regexp_extract(a, '[^\n]*$')) AS line_a, strlen(c) - strlen(regexp_extract(c, '[^\n]*$')) AS line_c FROM q)
SELECT doc_id, byte_start, byte_end, CAST(length(a) - length(replace(a, chr(10), '')) + 1 AS BIGINT) AS line_start, byte_start - line_a + 1 AS column_start,
  CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS BIGINT) AS line_end, byte_end - line_c AS column_end FROM r""")
def byte_to_line(t):
    """The second and third quarter of each text as a span of bytes."""
    n = F.length("text")
    upto = lambda part: F.octet_length(F.expr(f"substr(text, 1, {part})"))
    d = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(n >= 4).select("doc_id", "text", upto("length(text) div 4").alias("a"), upto("3 * length(text) div 4").alias("b"))
    fields = ("byte_start", "byte_end", "line_start", "column_start", "line_end", "column_end")

    def found(text, a, b):
        place = similarity.located(similarity.line_starts(text), [], a, b)
        return {f: place[f] for f in fields}

    return per_row(d, ["text", "a", "b"], f"at struct<{', '.join(f + ': bigint' for f in fields)}>", found).select("doc_id", "at.*")


WORDS_SQL = "w AS (SELECT doc_id, source, w.pos - 1 AS pos, w.word AS word FROM (SELECT doc_id, source, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'pos': i, 'word': ws[i]})) AS w FROM (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents)))"


def split_words():
    return F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


@query(f"""WITH {WORDS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(active) AS BIGINT) AS sum_active, CAST(max(active) AS BIGINT) AS last_active
FROM (SELECT doc_id, CASE WHEN m = 1 THEN NULL ELSE pos - coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS active
  FROM (SELECT doc_id, pos, CASE WHEN word IN ('the', 'of', 'and', 'de', 'la') THEN 1 ELSE 0 END AS m FROM w)) GROUP BY doc_id""")
def active_index(t):
    masked = F.transform("words", lambda w: w.isin("the", "of", "and", "de", "la"))
    d = t("documents").select("doc_id", split_words().alias("words")).where("size(words) > 0").select("doc_id", F.transform("words", lambda w, i: i).alias("units"), masked.alias("mask"))
    d = per_row(d, ["units", "mask"], "active array<bigint>", tiling.active_index)
    shown = F.filter("active", lambda a: a.isNotNull())
    total = F.when(F.size(shown) > 0, F.aggregate(shown, F.lit(0).cast("long"), lambda s, a: s + a))
    return d.select("doc_id", F.size("active").cast("long").alias("n_tokens"), total.alias("sum_active"), F.array_max("active").alias("last_active"))


GRAMS_SQL = f"{WORDS_SQL}, g AS (SELECT doc_id, source, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w)"


ALLOWED_SQL = f"l.kind = 'current' AND (r.kind = 'historical' OR l.doc_id < r.doc_id)"


@query(f"""WITH {GRAMS_SQL}, k AS (SELECT DISTINCT source, gram, doc_id, {KIND_SQL} AS kind FROM g WHERE n = 8)
SELECT DISTINCT l.doc_id AS left_id, r.doc_id AS right_id FROM k l JOIN k r ON l.source = r.source AND l.gram = r.gram WHERE {ALLOWED_SQL}""")
def kgram_candidates(t):
    return grams.pairs(numbered_submissions(t("documents")), 8)


@query(f"""WITH {GRAMS_SQL}, h AS (SELECT *, {KIND_SQL} AS kind FROM g WHERE n = 8),
p AS (SELECT l.doc_id AS left_id, r.doc_id AS right_id, l.pos AS l, l.pos - r.pos AS diag FROM h l JOIN h r ON l.source = r.source AND l.gram = r.gram WHERE {ALLOWED_SQL})
SELECT left_id, right_id, CAST(min(l) AS BIGINT) AS left_start, CAST(min(l) - diag AS BIGINT) AS right_start, CAST(count(*) + 7 AS BIGINT) AS length
FROM (SELECT *, l - row_number() OVER (PARTITION BY left_id, right_id, diag ORDER BY l) AS island FROM p) GROUP BY left_id, right_id, diag, island""")
def maximal_runs(t):
    return grams.runs(numbered_submissions(t("documents")), 8)


@query("SELECT o_orderkey, CAST(greatest(10, least(15, (3 * least(a, b) + 99) // 100)) AS BIGINT) AS threshold FROM (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) % 700 AS a, o_custkey AS b FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_custkey FROM orders))")
def tile_threshold(t):
    o = t("orders").select("o_orderkey", F.expr("cast(floor(o_totalprice) % 700 as bigint)").alias("a"), F.col("o_custkey").alias("b"))
    return per_row(o, ["a", "b"], "threshold bigint", tiling.threshold).select("o_orderkey", "threshold")


@query(f"""WITH {WORDS_SQL} SELECT doc_id, CAST(min(pos) AS BIGINT) AS tile_start, CAST(count(*) AS BIGINT) AS length FROM (SELECT doc_id, pos, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS island
  FROM (SELECT doc_id, pos, CASE WHEN ends_with(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '.') THEN 1 ELSE 0 END AS cut FROM w)) GROUP BY doc_id, island""")
def tile_split(t):
    """A text held against itself, with a unit left out behind each word that ends in a dot."""
    d = t("documents").select("doc_id", split_words().alias("words")).where("size(words) > 0").select("doc_id", F.transform("words", lambda w: F.endswith(w, F.lit("."))).alias("dots"))

    def parts(dots):
        units, unit = [], 0
        for dot in dots:
            units.append(unit)
            unit += 1 + dot
        return [{"tile_start": a, "length": n} for a, _, n in tiling.split_on_gaps([(0, 0, len(units))], units, units)]

    return per_row(d, ["dots"], "tiles array<struct<tile_start: bigint, length: bigint>>", parts).select("doc_id", F.inline("tiles"))


@query("""WITH a AS (SELECT l_orderkey, sum(l_quantity) AS exact, sum(l_quantity + l_linenumber) AS eff, max(l_quantity) AS longest, count(*) AS n, 400.0 AS ls, 250.0 AS rs FROM lineitem GROUP BY l_orderkey),
b AS (SELECT *, eff / ls AS l, eff / rs AS r FROM a),
c AS (SELECT *, least(1, 0.75 * 2 * l * r / (l + r) + 0.25 * sqrt(l * r)) AS anchor, least(1, 0.9 + 0.05 * longest / rs + 0.05 * least(1, greatest(0, (longest - 8) / 8))) AS contiguity, least(1, 0.85 + 0.10 * sqrt(least(1, longest / eff)) + 0.05 * least(1, greatest(0, (eff / n - 8) / 8))) AS fragmentation FROM b)
SELECT l_orderkey, round(least(1, anchor * contiguity * fragmentation * sqrt(exact / eff)), 6) AS similarity_score FROM c""")
def score_from_regions(t):
    from tessella.functions.columns import score

    a = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("exact"), F.sum(F.col("l_quantity") + F.col("l_linenumber")).alias("eff"), F.max("l_quantity").alias("longest"), F.count("*").alias("n"))
    return a.select("l_orderkey", F.round(score(F.col("exact"), F.col("eff"), F.col("eff"), F.col("eff"), F.col("longest"), F.col("n"), F.lit(400.0), F.lit(250.0), 8), 6).alias("similarity_score"))


@query("SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS comment_match_count, CAST(count(*) AS BIGINT) AS match_count FROM lineitem GROUP BY l_orderkey")
def comment_match_count(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("comment_match_count"), F.count("*").alias("match_count"))


@query(f"WITH {SUBS} SELECT source, CAST(count(*) FILTER (WHERE kind = 'current') AS BIGINT) AS n_current, CAST(count(*) FILTER (WHERE kind = 'historical') AS BIGINT) AS n_historical FROM s GROUP BY source")
def kind_counts(t):
    return subs(t).groupBy("source").agg(F.count_if(F.col("kind") == "current").alias("n_current"), F.count_if(F.col("kind") == "historical").alias("n_historical"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS pair_count, CAST(sum(least(n, 5)) AS BIGINT) AS pair_count_capped FROM (SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment) GROUP BY c_mktsegment")
def dashboard_totals(t):
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    per = t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))
    return per.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("n").alias("pair_count"), F.sum(F.least("n", F.lit(5))).cast("long").alias("pair_count_capped")).select("c_mktsegment", "n", "pair_count", "pair_count_capped")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE (try_cast(nullif(trim(' 2 '), '') AS DOUBLE) IS NULL OR l_discount >= try_cast(nullif(trim(' 2 '), '') AS DOUBLE) / 100) AND (try_cast(nullif(trim('5'), '') AS DOUBLE) IS NULL OR l_discount <= try_cast(nullif(trim('5'), '') AS DOUBLE) / 100)")
def score_range_filter(t):
    from tessella.functions.columns import within_percent

    return t("lineitem").where(within_percent("l_discount", " 2 ", "5")).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') OR contains(lower(coalesce(p_brand, '')), 'an')")
def assignment_search(t):
    from tessella.functions.columns import search

    return t("part").where(search(" AN ", "p_name", "p_type", "p_brand")).select("p_partkey", "p_name")


@query("""SELECT l_orderkey, l_linenumber, bucket, CAST(row_number() OVER (PARTITION BY l_orderkey, bucket ORDER BY l_discount DESC, l_linenumber) AS BIGINT) AS place
FROM (SELECT *, CASE WHEN l_discount >= 0.05 THEN 'suspicious' WHEN l_returnflag = 'R' THEN 'comments' ELSE 'hidden' END AS bucket FROM lineitem)""")
def suspicious_partition(t):
    bucket = F.when(F.col("l_discount") >= 0.05, "suspicious").when(F.col("l_returnflag") == "R", "comments").otherwise("hidden")
    w = Window.partitionBy("l_orderkey", "bucket").orderBy(F.desc("l_discount"), "l_linenumber")
    return t("lineitem").withColumn("bucket", bucket).select("l_orderkey", "l_linenumber", "bucket", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def per_parent_topn(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return t("orders").withColumn("k", F.row_number().over(w)).where("k <= 5").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_completed_or_latest(t):
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct((F.col("o_orderstatus") == "F").alias("f"), "o_orderdate", (-F.col("o_orderkey")).alias("k")))
    return t("orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


RUN_SQL = "CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'QUEUED' END"


@query(f"""WITH e AS (SELECT *, event_type = 'purchase' AND value > 60 AS is_run, 1 + event_id % 2 AS version, {RUN_SQL} AS run_status FROM events),
u AS (SELECT user_id, bool_or(event_type = 'signup' AND value > 180) AS uploads, bool_or(event_type = 'error' AND value > 180) AS running, count(*) FILTER (WHERE event_type = 'click' AND value > 100) AS cur,
  count(*) FILTER (WHERE event_type = 'view') AS hist, bool_or(is_run AND version = 2 AND run_status = 'COMPLETED') AS done, bool_or(is_run AND version < 2 AND run_status = 'COMPLETED') AS done_before,
  arg_min(run_status, event_id) FILTER (WHERE is_run AND version = 2) AS first_now FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN uploads THEN 'preparing' WHEN running THEN 'running' WHEN NOT (cur >= 1 AND cur + hist >= 2) THEN 'not_ready' WHEN done THEN 'current' WHEN first_now = 'FAILED' THEN 'failed'
  WHEN done_before THEN 'stale' ELSE 'ready' END AS status FROM u""")
def status_derivation(t):
    what, n, value = F.col("event_type"), F.col("event_id"), F.col("value")
    said = F.when(n % 3 == 0, "COMPLETED").when(n % 3 == 1, "FAILED").otherwise("QUEUED")
    run = F.when((what == "purchase") & (value > 60), F.struct(n.alias("n"), said.alias("status"), (1 + n % 2).alias("input_version")))
    e = t("events").groupBy("user_id").agg(
        F.bool_or((what == "signup") & (value > 180)).alias("uploads"), F.bool_or((what == "error") & (value > 180)).alias("running"),
        F.count_if((what == "click") & (value > 100)).alias("cur"), F.count_if(what == "view").alias("hist"), F.array_sort(F.collect_list(run)).alias("runs"),
    )
    return e.select("user_id", state.comparison_status(*(F.col(c) for c in ("uploads", "running", "cur", "hist")), F.lit(2), F.col("runs")).alias("status"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 3 AS version, o_orderdate, o_custkey % 4 = 0 AND o_orderkey % 7 = 0 AS active FROM orders),
w AS (SELECT *, bool_or(active) OVER (PARTITION BY o_custkey) AS has, row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC, o_orderdate DESC, o_orderkey) AS k FROM v)
SELECT o_custkey, o_orderkey FROM w WHERE active OR (NOT has AND k = 1)""")
def newest_template(t):
    versions = t("orders").select(F.col("o_custkey").alias("assignment_id"), F.col("o_orderkey").alias("template_id"), (1 + F.col("o_orderkey") % 3).alias("version_number"), F.col("o_orderdate").alias("created_at"), ((F.col("o_custkey") % 4 == 0) & (F.col("o_orderkey") % 7 == 0)).alias("is_active"))
    return state.promote_newest(versions).where("is_active").select(F.col("assignment_id").alias("o_custkey"), F.col("template_id").alias("o_orderkey"))


@query(f"""WITH {SUBS} SELECT 'submission' AS what, CAST(doc_id AS VARCHAR) AS id, 0 AS version FROM s WHERE NOT (source = 'src1' AND kind = 'historical')
UNION ALL SELECT 'result', CAST(l.doc_id AS VARCHAR), 0 FROM labels l JOIN s ON s.doc_id = l.doc_id WHERE source <> 'src1'
UNION ALL SELECT 'assignment', source, CASE source WHEN 'src1' THEN 2 ELSE 1 END FROM (SELECT DISTINCT source FROM s)""")
def delete_category(t):
    """The historical submissions of an assignment go: labels stand for results."""
    s = subs(t).select(F.col("doc_id").alias("submission_id"), F.col("source").alias("assignment_id"), "kind")
    results = t("labels").select(F.col("doc_id").alias("submission_id")).join(s, "submission_id").select("submission_id", "assignment_id")
    assignments = s.select("assignment_id").distinct().withColumn("comparison_input_version", F.lit(1))
    s, results, assignments = state.delete_category(s, results, assignments, "src1", "historical")
    rows = lambda what, df, key, version: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("id"), version.alias("version"))
    return rows("submission", s, "submission_id", F.lit(0)).unionAll(rows("result", results, "submission_id", F.lit(0))).unionAll(rows("assignment", assignments, "assignment_id", F.col("comparison_input_version")))


@query("SELECT c_custkey, CASE WHEN k = 1 THEN f ELSE f || '-' || k END AS folder FROM (SELECT c_custkey, f, row_number() OVER (PARTITION BY f ORDER BY c_custkey) AS k FROM (SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS f FROM customer))")
def folder_dedup(t):
    c = before(t("customer").withColumn("f", F.concat_ws("-", "c_mktsegment", "c_nationkey")).select("c_custkey", "f"), ["f"], ["c_custkey"], earlier=F.lit(1))
    return c.select("c_custkey", F.when(F.col("earlier") == 0, F.col("f")).otherwise(F.concat_ws("-", "f", F.col("earlier") + 1)).alias("folder"))


@query("SELECT c_custkey, 'SUB-' || upper(substr(sha256(c_name), 1, 10)) AS alias FROM customer")
def alias_sha256(t):
    from tessella.functions.columns import alias

    return t("customer").select("c_custkey", alias("c_name").alias("alias"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-'), ''), 'submission') AS slug FROM pages")
def slugify(t):
    from tessella.functions.columns import slug

    return t("pages").select("page_id", slug("url", "submission").alias("slug"))


@query("""WITH s AS (SELECT l_orderkey, 12 * l_linenumber AS a, 12 * l_linenumber + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
e AS (SELECT l_orderkey, a, b, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM s),
g AS (SELECT l_orderkey, greatest(seen, 0) AS byte_start, least(a, 100) AS byte_end FROM e UNION ALL SELECT l_orderkey, greatest(max(b), 0), 100 FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM g WHERE byte_end > byte_start""")
def interval_except(t):
    from tessella.functions.columns import minus_spans

    a = (12 * F.col("l_linenumber")).cast("long")
    s = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b")))).alias("spans"))
    return s.select("l_orderkey", F.inline(minus_spans(F.lit(0).cast("long"), F.lit(100).cast("long"), F.col("spans"))))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_custkey % 4 <> 0 OR o_orderkey % 2 = 0")
def replace_by_run(t):
    from tessella.operators.state import replace_by

    o = t("orders").select("o_orderkey", "o_custkey")
    return replace_by(o.withColumn("version", F.lit("old")), o.where("o_custkey % 4 = 0 and o_orderkey % 2 = 0").withColumn("version", F.lit("new")), o.where("o_custkey % 4 = 0").select("o_custkey").distinct(), "o_custkey")


@query("SELECT DISTINCT k FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT o_orderpriority FROM orders) WHERE k IS NOT NULL")
def distinct_keys(t):
    keys = t("customer").select(F.col("c_mktsegment").alias("k")).unionAll(t("part").select("p_brand")).unionAll(t("orders").select("o_orderpriority"))
    return keys.where("k is not null").distinct()


@query("""SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS kind, CAST(round(l_discount * 100) AS BIGINT) || '%' AS percent,
  (CAST(l_quantity AS BIGINT) * 25 // 10) || '.' || (CAST(l_quantity AS BIGINT) * 25 % 10) || '%' AS tenths FROM lineitem""")
def display_values(t):
    from tessella.functions.columns import fixed_percent

    whole = F.concat(F.round(F.col("l_discount") * 100).cast("long"), F.lit("%"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("kind"), whole.alias("percent"), fixed_percent(F.col("l_quantity") / 40).alias("tenths"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id = documents.doc_id)")
def unreferenced_batches(t):
    return state.unreferenced(t("documents").select("doc_id"), t("labels"), t("pages").select(F.col("page_id").alias("doc_id")), key="doc_id")


@query("SELECT c_custkey, c_name, n_orders, last_key FROM customer JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'")
def owned_detail(t):
    owned = t("customer").join(t("nation").join(t("region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_key"))
    return owned.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n_orders", "last_key")


@query("""SELECT doc_id, CAST(strlen(h) AS BIGINT) AS byte_offset, CAST(length(h) - length(replace(h, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(length(regexp_extract(h, '[^\\n]*$')) + 1 AS BIGINT) AS column_number, CAST(strlen(h) AS BIGINT) AS back
FROM (SELECT doc_id, left(text, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL)""")
def editor_positions(t):
    from tessella.functions.forms import byte_offset, editor_position

    at = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    found = t("documents").where("text is not null").select("doc_id", "text", at.alias("byte_offset")).withColumn("p", editor_position(F.col("text"), F.col("byte_offset")))
    back = byte_offset(F.col("text"), F.col("p.line"), F.col("p.column"))
    return found.select("doc_id", F.col("byte_offset").cast("long"), F.col("p.line").cast("long").alias("line"), F.col("p.column").cast("long").alias("column_number"), back.cast("long").alias("back"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'not_ready' WHEN 'F' THEN 'failed' ELSE 'in_review' END AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 'not_ready' THEN 'not ready' ELSE replace(s, '_', ' ') END AS label,
  CASE s WHEN 'not_ready' THEN 'More prepared submissions are needed before running.' WHEN 'failed' THEN 'The latest comparison attempt failed.' ELSE 'Status updated.' END AS said,
  CASE s WHEN 'not_ready' THEN 'At least one current submission and two non-template submissions are required.' WHEN 'failed' THEN 'No current results are available because the latest run failed.' ELSE 'Run a comparison to see suspicious pairs.' END AS empty_said FROM o""")
def status_texts(t):
    from tessella.functions.forms import empty_text, status_label, status_text

    s = F.when(F.col("o_orderstatus") == "O", "not_ready").when(F.col("o_orderstatus") == "F", "failed").otherwise("in_review")
    return t("orders").select("o_orderkey", status_label(s).alias("label"), status_text(s).alias("said"), empty_text(s).alias("empty_said"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN left(o_orderpriority, 120) WHEN o_orderkey % 5 = 1 THEN 'This upload finished with warnings.'
  WHEN o_orderstatus = 'F' THEN 'This upload did not finish successfully.' WHEN o_orderstatus = 'O' THEN 'Waiting to be processed.' ELSE 'This upload finished successfully.' END AS summary FROM orders""")
def upload_summaries(t):
    from tessella.functions.forms import upload_summary

    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "Queued").otherwise("ready")
    k = F.col("o_orderkey") % 5
    return t("orders").select("o_orderkey", upload_summary(status, F.when(k == 0, F.col("o_orderpriority")), F.when(k == 1, F.lit("w"))).alias("summary"))


@query("""SELECT c_custkey, lower(c_name) || '@x.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS department,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 12:00:00' END AS due,
  CASE WHEN c_custkey % 2 = 0 THEN 'k' || c_nationkey END AS key_id FROM customer""")
def typed_fields(t):
    from tessella.functions.forms import due_date, email, encrypted_identity, optional_field

    third = F.col("c_custkey") % 3 == 0
    token = F.concat(F.lit(" sidenc:v1:k"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, ":abc_-9 ").otherwise(":a b"))
    return t("customer").select(
        "c_custkey", email(F.concat(F.lit(" \t"), F.col("c_name"), F.lit("@X.org\n"))).alias("email"), optional_field(F.when(third, F.lit("  ")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" ")))).alias("department"),
        due_date(F.when(third, F.lit(" ")).otherwise(F.lit(" 2024-01-31T12:00:00 "))).cast("timestamp_ntz").alias("due"), encrypted_identity(token)["key_id"].alias("key_id"),
    )


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'seed' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, NULL, 'seed' FROM customer WHERE c_custkey % 4 = 0")
def upsert_seed(t):
    from tessella.operators.state import upsert

    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    seed = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("seed").alias("c_mktsegment"))
    return upsert(c, seed.unionAll(seed.withColumn("c_custkey", F.col("c_custkey") + 10_000_000)), "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))")
def delete_account_cascade(t):
    from tessella.operators.state import delete_account

    o = t("orders").select(F.col("o_orderkey").alias("assignment_id"), F.col("o_custkey").cast("string").alias("professor_id"))
    users = o.select(F.col("professor_id").alias("user_id")).distinct().withColumn("role", F.lit("PROFESSOR"))
    first = str(t("orders").agg(F.min("o_custkey")).first()[0])
    left = delete_account(users, o, {"lines": t("lineitem").select(F.col("l_orderkey").alias("assignment_id"), "l_linenumber")}, first)[2]
    return left["lines"].withColumnRenamed("assignment_id", "l_orderkey")
