"""The comparison of all allowed pairs of an assignment's submissions, as a plan of DataFrames.

Each submission is tokenised and masked once. A pair can only have tiles if it shares a gram of the least tile length, and comment matches
only if it shares a comment, so pairs come from equi-joins on those; all other allowed pairs score zero and are added on request.
Only the greedy choice within a pair runs in Python, a row per pair over Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.config import Params
from tessella.functions import lexer, tiling

SOURCE_MAP = "array<struct<file_path: string, byte_start: int, byte_end: int>>"
SUBMISSIONS = f"submission_id string, assignment_id string, kind string, ord long, language string, source string, source_map {SOURCE_MAP}"
TOKENS = "tokens array<string>, units array<int>, starts array<int>, ends array<int>, comments array<struct<text: string, byte_start: int, byte_end: int>>, lines array<int>"
SPAN = "struct<byte_start: int, byte_end: int, file_path: string, line_start: int, column_start: int, line_end: int, column_end: int, token_start: int, token_end: int>"
MATCHES = f"array<struct<match_id: string, kind: string, left: {SPAN}, right: {SPAN}, matched_token_count: int>>"
RESULT = f"pair_id string, left_id string, right_id string, similarity_score double, matched_token_count int, matches {MATCHES}"

#: Submissions of a chunk about; chunks of submissions without an assignment; tokens of sides that a task keeps.
CHUNK, ALONE, HELD = 256, 1024, 1_000_000


def tokenise(submissions: DataFrame) -> DataFrame:
    """submissions with their tokens and the bytes at which their lines begin."""
    schema = T.StructType([*submissions.schema.fields, *T.StructType.fromDDL(TOKENS).fields])
    types = [pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.struct([("text", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32())])), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, language, files in zip(*(batch.column(c).to_pylist() for c in ("source", "language", "source_map"))):
                p = lexer.lex(source or "", language, tuple(f["byte_start"] for f in (files or [])[1:]))
                rows.append(([t.norm for t in p.tokens], [t.unit_index for t in p.tokens], [t.byte_start for t in p.tokens], [t.byte_end for t in p.tokens], [dict(zip(("text", "byte_start", "byte_end"), c)) for c in p.comments], line_starts(source or "")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=schema.names)

    return submissions.mapInArrow(run, schema)


def chunked(submissions: DataFrame, templates: DataFrame) -> DataFrame:
    """submissions in chunks of an assignment, about CHUNK each, its template in front of every chunk (is_template).

    A template travels once a chunk, not once a submission, and a large assignment is dealt to many tasks."""
    n = int(submissions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = submissions.groupBy("assignment_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("submission_id"), F.coalesce("chunks", F.lit(ALONE))).cast("int")
    rows = submissions.join(counts, "assignment_id", "left").select(*submissions.columns, F.lit(False).alias("is_template"), chunk.alias("chunk"))
    first = templates.join(counts, "assignment_id").select(*templates.columns, F.lit(True).alias("is_template"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return rows.unionByName(first, allowMissingColumns=True).repartition(n, "assignment_id", "chunk").sortWithinPartitions("assignment_id", "chunk", F.desc("is_template"))


def long_comments(comments: list[dict], floor: int) -> list[tuple[int, str]]:
    """(place, normal text) of the comments that count."""
    return [(k, n) for k, c in enumerate(comments) if len((n := lexer.normalize_comment(c["text"])).encode()) >= floor]


def prepared(submissions: DataFrame, templates: DataFrame | None, params: Params = Params()) -> DataFrame:
    """submissions tokenised and masked, once each. mask: the tokens that the assignment's template has too; comments are without those of the
    template, as often as it has them; keys: hashes of the unmasked grams and long comments.

    templates: (assignment_id, language, source, source_map), one row an assignment."""
    tokens = tokenise(submissions if templates is None else chunked(submissions, templates))
    kept = [f for f in tokens.schema.fields if f.name not in ("is_template", "chunk")]
    schema = T.StructType([*kept, *T.StructType.fromDDL("mask array<boolean>, keys array<long>").fields])
    mixed = templates is not None
    names, floor, least = [f.name for f in kept], max(params.minimum_comment_length, params.comment_floor), params.template_min_match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, side, grams, long = None, None, None, Counter()  # the template in front of the rows, and its assignment
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("assignment_id", "tokens", "units", "comments")))
            first = batch.column("is_template").to_pylist() if mixed else [False] * batch.num_rows
            masks, comments, keys = [], [], []
            for (assignment, own, units, said), is_template in zip(rows, first):
                mask = [False] * len(own)
                if is_template:
                    if of != assignment or side is None:
                        of, side, grams, long = assignment, tiling.Side(own, units, mask), tiling.Grams(own, mask, least), Counter(n for _, n in long_comments(said, floor))
                    continue
                if side is not None and of == assignment:
                    mask = tiling.template_mask(tiling.Side(own, units, mask), side, grams, least)
                    left, hidden = long.copy(), set()
                    for k, n in long_comments(said, floor):
                        if left[n] > 0:
                            left[n] -= 1
                            hidden.add(k)
                    said = [c for k, c in enumerate(said) if k not in hidden]
                _, hashes = tiling.gram_hashes(own, mask, params.gst_min_match_length)
                texts = np.array([xxhash.xxh64_intdigest(n, 1) for _, n in long_comments(said, floor)], np.uint64)
                masks.append(mask)
                comments.append(said)
                keys.append(np.unique(np.concatenate([hashes, texts])).view(np.int64))
            rest = batch.filter(pa.array([not x for x in first]))
            columns = [rest.column(c) for c in names]
            columns[names.index("comments")] = pa.array(comments, batch.column("comments").type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(masks, pa.list_(pa.bool_())), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return tokens.mapInArrow(run, schema)


#: Current with later current ones, and current with historical ones, which stand on the right.
ALLOWED = "kind = 'current' and (r_kind = 'historical' or (r_kind = 'current' and (ord < r_ord or (ord = r_ord and submission_id < r_submission_id))))"


def allowed_pairs(submissions: DataFrame) -> DataFrame:
    """All pairs that are compared: pair_id, left_id, right_id."""
    l = submissions.select("submission_id", "assignment_id", "kind", "ord")
    r = l.select(*(F.col(c).alias(f"r_{c}") for c in l.columns))
    return l.join(r, (F.col("assignment_id") == F.col("r_assignment_id")) & F.expr(ALLOWED)).select(F.concat_ws("__", "submission_id", "r_submission_id").alias("pair_id"), F.col("submission_id").alias("left_id"), F.col("r_submission_id").alias("right_id"))


def candidates(tokens: DataFrame) -> DataFrame:
    """Allowed pairs that share an unmasked gram or a long comment. Keys are hashes: a false pair costs time, not a result.

    Keys that one submission alone has go before the join, and of keys that the same submissions have one stands for all, so copies that share thousands of
    grams meet once."""
    keys = tokens.select("assignment_id", "submission_id", "kind", "ord", F.explode("keys").alias("key"))
    # sums of halves of two hashes: a set of submissions without its order, free of overflow
    halves = [f(F.xxhash64("submission_id", F.lit(seed))) for seed in (1, 2) for f in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    held = keys.groupBy("assignment_id", "key").agg(F.count("*").alias("n"), *(F.sum(h).alias(f"h{k}") for k, h in enumerate(halves))).where("n > 1")
    standing = held.groupBy("assignment_id", "n", *(f"h{k}" for k in range(4))).agg(F.min("key").alias("key")).select("assignment_id", "key")
    keys = keys.join(standing, ["assignment_id", "key"], "left_semi")
    r = keys.select(*(F.col(c).alias(f"r_{c}") for c in keys.columns))
    joined = keys.join(r, (F.col("assignment_id") == F.col("r_assignment_id")) & (F.col("key") == F.col("r_key")) & F.expr(ALLOWED))
    return joined.select(F.concat_ws("__", "submission_id", "r_submission_id").alias("pair_id"), F.col("submission_id").alias("left_id"), F.col("r_submission_id").alias("right_id")).distinct()


def occurrences(comments: DataFrame, order: list[str], floor: int = Params.comment_floor) -> DataFrame:
    """comments(submission_id, normal, ...) of `floor` bytes or more with their rank k among equal ones of the submission."""
    return comments.where(F.octet_length("normal") >= floor).withColumn("k", F.row_number().over(Window.partitionBy("submission_id", "normal").orderBy(*order)))


def comment_pairs(ranked: DataFrame, *kept: str) -> DataFrame:
    """The matches of equal comments between the submissions of allowed pairs: the first with the first, the second with the second, so that repeats do not multiply. ranked: assignment_id, submission_id, kind, ord, normal, k and
    what else is kept of both sides (left_..., right_...)."""
    r = ranked.select(*(F.col(c).alias(f"r_{c}") for c in ranked.columns))
    same = (F.col("assignment_id") == F.col("r_assignment_id")) & (F.col("normal") == F.col("r_normal")) & (F.col("k") == F.col("r_k"))
    joined = ranked.join(r, same & F.expr(ALLOWED))
    return joined.select(F.col("submission_id").alias("left_id"), F.col("r_submission_id").alias("right_id"), *(F.col(c).alias(f"left_{c}") for c in kept), *(F.col(f"r_{c}").alias(f"right_{c}") for c in kept))


def without_template(ranked: DataFrame, template: DataFrame) -> DataFrame:
    """ranked comments without those of a template(normal), as often as it has them."""
    counts = template.groupBy("normal").agg(F.count("*").alias("_n"))
    return ranked.join(counts, "normal", "left").where(F.col("k") > F.coalesce("_n", F.lit(0))).drop("_n")


def line_starts(source: str) -> list[int]:
    """The bytes at which the lines of a text begin."""
    return [0, *(np.flatnonzero(np.frombuffer(source.encode(), np.uint8) == 10) + 1).tolist()]


def located(lines: list[int], files: list[dict], start: int, end: int) -> dict:
    """The file and the lines and columns (from 1, in bytes) of the span [start, end); the end is that of its last byte. A span that no file holds whole has none."""
    last = max(end - 1, start)
    a, b = bisect_right(lines, start), bisect_right(lines, last)
    file = next((f["file_path"] for f in files if f["byte_start"] <= start and end <= f["byte_end"]), None)
    return {"byte_start": start, "byte_end": end, "file_path": file, "line_start": a, "column_start": start - lines[a - 1] + 1, "line_end": b, "column_end": last - lines[b - 1] + 1}


class _Prepared:
    """One side of comparisons; what they need of it is worked out once."""

    def __init__(self, row: dict, params: Params):
        self.starts, self.ends, self.comments, self.files = row["starts"], row["ends"], row["comments"], row["source_map"] or []
        self.side = tiling.Side(row["tokens"], row["units"], row["mask"])
        self.active = self.side.active
        self.grams = tiling.Grams(row["tokens"], row["mask"], params.gst_min_match_length)
        self.lines = row["lines"]
        self.said: dict[str, list[int]] = {}
        for k, n in long_comments(self.comments, max(params.minimum_comment_length, params.comment_floor)):
            self.said.setdefault(n, []).append(k)

    def span(self, start: int, end: int, tokens: tuple[int, int]) -> dict:
        return located(self.lines, self.files, start, end) | {"token_start": tokens[0], "token_end": tokens[1]}

    def code(self, a: int, b: int) -> dict:
        return self.span(self.starts[a], self.ends[b], (a, b))

    def comment(self, k: int) -> dict:
        return self.span(self.comments[k]["byte_start"], self.comments[k]["byte_end"], (k, k))


class _Sides:
    """The sides that a task has seen last, up to a number of tokens."""

    def __init__(self, make: Callable[[dict], Any], most: int):
        self.make, self.most, self.held = make, most, 0
        self.known: OrderedDict[tuple, tuple[Any, int]] = OrderedDict()

    def get(self, name: str, sides: pa.StructArray, k: int) -> Any:
        key = name, sides.field("digest")[k].as_py()  # rows that repeat an id are told apart by their text
        if key in self.known:
            self.known.move_to_end(key)
            return self.known[key][0]
        row = sides[k].as_py()
        found, weight = self.make(row), len(row["tokens"]) + 1
        self.known[key], self.held = (found, weight), self.held + weight
        while self.held > self.most and len(self.known) > 1:
            self.held -= self.known.popitem(last=False)[1][1]
        return found


def compare(left: _Prepared, right: _Prepared, params: Params = Params()) -> tuple[float, int, list[dict]]:
    """Score, matched tokens and matches of two submissions."""
    found = tiling.regions(tiling.greedy_tiles(left.grams, right.grams), left.side, right.side, params)
    value = tiling.score(found, left.active, right.active, params.gst_min_match_length)
    matches = [{"match_id": f"code-{k}", "kind": "code", "left": left.code(r.left_start, r.left_end), "right": right.code(r.right_start, r.right_end), "matched_token_count": r.exact} for k, r in enumerate(found)]
    for text in sorted(left.said.keys() & right.said.keys(), key=str.encode):
        for a, b in zip(left.said[text], right.said[text]):
            matches.append({"match_id": f"comment-{len(matches)}", "kind": "comment", "left": left.comment(a), "right": right.comment(b), "matched_token_count": 0})
    return value, sum(r.exact for r in found), matches


def sided(pairs: DataFrame, tokens: DataFrame, *columns: str) -> DataFrame:
    """pairs with both sides as structs, with a digest in place of the text; a side that is missing is an error. Dealt by right_id, which no assignment has in more pairs than it has submissions, to the session's number of
    partitions: comparing is work for the processor, so partitions of few bytes are not put together."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = F.struct(*columns, F.xxhash64("source").alias("digest"))
    l, r = (tokens.select(F.col("submission_id").alias(f"{s}_id"), side.alias(s)) for s in ("left", "right"))
    both = pairs.join(l, "left_id", "left").repartition(n, "right_id").join(r, "right_id", "left")
    known = lambda side: F.when(F.col(side).isNull(), F.raise_error(F.concat(F.lit(f"unknown {side} submission "), F.coalesce(f"{side}_id", F.lit("")))).cast(both.schema[side].dataType)).otherwise(F.col(side)).alias(side)
    return both.select("pair_id", "left_id", "right_id", known("left"), known("right"))


def compared(pairs: DataFrame, tokens: DataFrame, params: Params = Params()) -> DataFrame:
    """RESULT of each pair; both sides are joined to it once."""
    schema = T.StructType.fromDDL(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, sides = to_arrow_schema(schema), _Sides(lambda row: _Prepared(row, params), HELD)
        for batch in batches:
            rows = []
            for k, (pair, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pair_id", "left_id", "right_id")))):
                value, exact, matches = compare(sides.get(left, batch.column("left"), k), sides.get(right, batch.column("right"), k), params)
                rows.append({"pair_id": pair, "left_id": left, "right_id": right, "similarity_score": value, "matched_token_count": exact, "matches": matches})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sided(pairs, tokens, "tokens", "units", "starts", "ends", "comments", "mask", "lines", "source_map").mapInArrow(run, schema)


def bad_maps(submissions: DataFrame) -> DataFrame:
    """Source maps with an entry without a path, one that ends before it begins or beyond the source, or two that overlap."""
    entry = "f.byte_start > f.byte_end or f.byte_start < 0 or f.byte_end > octet_length(source) or coalesce(trim(f.file_path), '') = ''"
    bad = F.expr(f"exists(source_map, f -> {entry}) or exists(transform(source_map, (f, i) -> i > 0 and f.byte_start < source_map[greatest(i - 1, 0)].byte_end), x -> x)")
    return submissions.where(bad).select(F.concat(F.lit("invalid source_map: "), "submission_id").alias("problem"))


def problems(submissions: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """What makes a request invalid, a row each; empty if it is valid."""
    blank = submissions.where(F.coalesce(F.trim("submission_id"), F.lit("")) == "").select(F.lit("submission_id must not be blank").alias("problem"))
    twice = submissions.groupBy("submission_id").count().where("count > 1").select(F.concat(F.lit("duplicate submission_id: "), "submission_id").alias("problem"))
    out = blank.unionAll(twice).unionAll(bad_maps(submissions))
    if pairs is not None:
        ids = submissions.select("submission_id")
        ends = pairs.select("pair_id", F.explode(F.array("left_id", "right_id")).alias("submission_id"))
        out = out.unionAll(ends.join(ids, "submission_id", "left_anti").select(F.concat(F.lit("pair with unknown submission: "), "pair_id").alias("problem")))
        out = out.unionAll(pairs.where("left_id = right_id").select(F.concat(F.lit("pair of one submission: "), "pair_id").alias("problem")))
    return out


def analyze(submissions: DataFrame, templates: DataFrame | None = None, params: Params = Params(), zero_pairs: bool = True) -> DataFrame:
    """Results of all allowed pairs, or, without zero_pairs, of those that share anything. templates: (assignment_id, language, source, source_map). The tokens stay persisted for the result's
    readers; catalog.clearCache() lets go of them."""
    tokens = prepared(submissions, templates, params).persist()
    found = compared(candidates(tokens), tokens, params)
    if not zero_pairs:
        return found
    rest = allowed_pairs(submissions)
    out = rest.join(found.drop("left_id", "right_id"), "pair_id", "left")
    return out.select("pair_id", "left_id", "right_id", F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"), F.coalesce("matched_token_count", F.lit(0)).alias("matched_token_count"), F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def tiles(pairs: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """The tiles of each pair in the order of their acceptance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(lambda row: tiling.Grams(row["tokens"], row["mask"], least), HELD)
        for batch in batches:
            rows = []
            for k, (pair, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pair_id", "left_id", "right_id")))):
                found = tiling.greedy_tiles(sides.get(left, batch.column("left"), k), sides.get(right, batch.column("right"), k))
                rows += [(pair, seq, *t) for seq, t in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] + [pa.int32()] * 4)], names=["pair_id", "seq", "left_start", "right_start", "length"])

    return sided(pairs, tokens, "tokens", "mask").mapInArrow(run, "pair_id string, seq int, left_start int, right_start int, length int")


def runs(pairs: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """The maximal equal stretches of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(lambda row: tiling.Grams(row["tokens"], row["mask"], least), HELD)
        for batch in batches:
            rows = []
            for k, (pair, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pair_id", "left_id", "right_id")))):
                rows += [(pair, *t) for t in tiling.maximal_runs(sides.get(left, batch.column("left"), k), sides.get(right, batch.column("right"), k))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] + [pa.int32()] * 3)], names=["pair_id", "left_start", "right_start", "length"])

    return sided(pairs, tokens, "tokens", "mask").mapInArrow(run, "pair_id string, left_start int, right_start int, length int")
