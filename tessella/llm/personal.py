"""Operator 4: personal data and the words that disclose it, with SQL functions only.

Base spans are e-mail and IP addresses, card and phone numbers. A found value is a protected entity. All words of the documents that have it
are candidates for disclosing it: over the whole corpus, the pointwise mutual information of word and entity is held
against the entity's own information, log(N / documents that have it). A word that gives away DISCLOSES of it or more, by two
documents at least, is a span of kind `term` wherever it stands in a document with such an entity, but not inside of a base span; sanitise()
removes it, and puts the kind of an entity in its place.

A pattern is found by splitting the text at it, so the lengths of the gaps are the places. Patterns are possessive, and runs that cannot match
are not entered again at each of their characters (\\G: behind the last match), so long texts take linear time.

Nulls: a null text is empty; a null doc_id is returned as null. Rows are told apart by a row id, so repeated rows are counted and returned
each; ties of kinds at one start follow KINDS; an empty table gives an empty one. Columns other than doc_id and the text are not read by find(), and kept by sanitise(), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import keyed, prepare, settle, table, text_column, unpacked

DISCLOSES, LEAST_DOCUMENTS = 0.8, 2
KINDS = ("email", "ip", "card", "phone", "term")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: Of each kind: the pattern, a test that is cheap and true where it matches, and what a match must hold.
PATTERNS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true"),
    (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike r'[0-9]\.[0-9]'", rf"x.m rlike r'^{OCTET}(?:\.{OCTET}){{3}}$'"),
    (
        r"[0-9](?:[\x20-]?[0-9])++", r"text rlike r'[0-9][\x20-]?[0-9]'",
        f"length({DIGITS}) between 14 and 19 and aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + luhn_digit(i)) % 10 = 0",
    ),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", f"length({DIGITS}) between 10 and 15"),
)
#: The i-th digit from the right, doubled if i is even, its digits added.
LUHN_DIGIT = f"(CASE WHEN i % 2 = 1 THEN int(substr(reverse({DIGITS}), i, 1)) ELSE 2 * int(substr(reverse({DIGITS}), i, 1)) - IF(int(substr(reverse({DIGITS}), i, 1)) > 4, 9, 0) END)"
#: Words are whole runs of letters; PIECES is where a run begins or ends.
WORDS, PIECES = r"\p{L}{3,}", r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"


#: Matches whose places are added up in one go: long lists of matches are dealt to pieces, so that no growing array is copied for each match of a text.
PIECE = 256


def let(name: str, value: str, then: str) -> str:
    """SQL: then, in which the name stands for the value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def places(text: str, pattern: str) -> str:
    """SQL: array of (a, b, m), the matches of a pattern in a text and where they begin and end in code points."""
    gaps, hits = f"split({text}, r'{pattern}', -1)", f"regexp_extract_all({text}, r'{pattern}', 0)"
    empty = "cast(array() as array<struct<a: int, b: int, m: string>>)"
    ends = f"named_struct('at', s.at + length(g.gap) + length(g.hit), 'out', concat(s.out, array(named_struct('a', s.at + length(g.gap), 'b', s.at + length(g.gap) + length(g.hit), 'm', g.hit))))"
    zipped = f"zip_with(slice({gaps}, 1, size(hits)), hits, (gap, hit) -> named_struct('gap', gap, 'hit', hit))"
    piece = f"slice(pairs, p * {PIECE} + 1, {PIECE})"
    lengths = f"transform(sequence(0, (size(pairs) - 1) div {PIECE}), p -> aggregate({piece}, 0, (n, g) -> n + length(g.gap) + length(g.hit)))"
    begins = "aggregate(lengths, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, n) -> named_struct('at', s.at + n, 'out', concat(s.out, array(s.at)))).out"
    found = f"flatten(transform(begins, (begin, p) -> aggregate({piece}, named_struct('at', begin, 'out', {empty}), (s, g) -> {ends}).out))"
    return let("hits", hits, f"IF(size(hits) = 0, {empty}, {let('pairs', zipped, let('lengths', lengths, let('begins', begins, found)))})")


def mentions() -> Column:
    """array of (a, k, b, m): base spans by start and kind."""
    found = []
    for k, (pattern, test, holds) in enumerate(PATTERNS):
        holds = holds.replace("luhn_digit(i)", LUHN_DIGIT)
        found.append(f"transform(filter(IF({test}, {places('text', pattern)}, cast(array() as array<struct<a: int, b: int, m: string>>)), x -> {holds}), x -> named_struct('a', x.a, 'k', {k}, 'b', x.b, 'm', lower(x.m)))")
    return F.expr(f"array_sort(concat({', '.join(found)}))")


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.k], x.a, x.b)), ',')")


def spans(rows: DataFrame) -> DataFrame:
    """rows(rid, text) -> rid, base (mentions) and terms: array of (a, k, b) of the words that disclose them."""
    entities = "array_distinct(transform(base, x -> concat_ws(':', x.k, x.m)))"
    base = settle(rows.select("rid", mentions().alias("base")).select("rid", "base", F.expr(entities).alias("entities")))
    total = float(base.count())
    named = base.select("rid", F.explode("entities").alias("e"))
    of_entity = named.groupBy("e").agg(F.count("*").alias("n_entity")).where(f"n_entity between {LEAST_DOCUMENTS} and {total} - 1")
    named = settle(named.join(of_entity, "e"))
    words = rows.select("rid", F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(text, r'{WORDS}', 0), w -> lower(w)))")).alias("term"))
    # n_both is n_entity at most, so a term of more documents than this discloses none of the entities
    most = f"power({total}D, {1 - DISCLOSES}D) * power(n_entity, {DISCLOSES}D) * 1.000001D"
    limit = named.agg(F.expr(f"max({most})")).first()[0] or 0.0
    of_term = settle(words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term").between(LEAST_DOCUMENTS, limit)))
    about = words.join(named.select("rid").distinct(), "rid", "left_semi").join(of_term, "term")
    together = about.join(named, "rid").where(f"n_term <= {most}").groupBy("e", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    information = F.log(F.lit(total) / F.col("n_entity"))
    shared = F.log(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    risky = settle(together.where(F.col("n_both") >= LEAST_DOCUMENTS).where(shared >= DISCLOSES * information).select("e", "term"))
    marked = settle(named.select("rid", "e").join(risky, "e").select("rid", "term").distinct())
    # letter runs and what is between them; the lengths before a piece are its place
    pieces = rows.join(marked.select("rid").distinct(), "rid", "left_semi").select("rid", F.posexplode(F.split("text", PIECES)).alias("n", "piece"))
    pieces = pieces.withColumn("b", F.sum(F.length("piece")).over(Window.partitionBy("rid").orderBy("n")).cast("int")).select("rid", F.lower("piece").alias("term"), (F.col("b") - F.length("piece")).alias("a"), "b")
    terms = pieces.join(marked, ["rid", "term"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", F.lit(4).alias("k"), "b"))).alias("terms"))
    terms = terms.join(base.select("rid", "base"), "rid").select("rid", F.expr("filter(terms, t -> not exists(base, x -> x.a < t.b and t.a < x.b))").alias("terms"))
    return base.select("rid", "base").join(settle(terms), "rid", "left").select("rid", F.expr("transform(base, x -> named_struct('a', x.a, 'k', x.k, 'b', x.b))").alias("base"), F.expr("coalesce(terms, cast(array() as array<struct<a: int, k: int, b: int>>))").alias("terms"))


def find(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, their digest, and all spans."""
    prepare(documents.sparkSession)
    rows = keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), F.col("doc_id"), F.col("text"))
    ids = settle(rows.select("rid", "doc_id"))
    found = ids.join(settle(spans(rows.select("rid", "text"))), "rid")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("array_sort(concat(base, terms))").alias("spans"))


def sanitise(documents: DataFrame) -> DataFrame:
    """documents with entities generalised to their kind in brackets and disclosing words removed. Spans that overlap are one stretch and take the kind of the first. Texts without spans, null ones
    too, and all other columns stay as they are."""
    prepare(documents.sparkSession)
    rows = keyed(documents, text_column())
    found = spans(rows.select("rid", "text")).select("rid", F.explode(F.concat("base", "terms")).alias("x")).select("rid", "x.*")
    by = Window.partitionBy("rid").orderBy("a", "k", "b")
    begins = F.coalesce(F.col("a") >= F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    stretches = found.withColumn("n", F.sum(begins.cast("int")).over(by)).groupBy("rid", "n").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("k", F.struct("a", "k")).alias("k"))
    cuts = settle(stretches.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b", "k"))).alias("cuts")))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS[:4])
    pieces = f"transform(cuts, (x, i) -> concat(substr(text, IF(i = 0, 0, cuts[i - 1].b) + 1, x.a - IF(i = 0, 0, cuts[i - 1].b)), array({names}, '')[x.k]))"
    built = F.expr(f"IF(cuts IS NULL, cast(row.text as string), concat(array_join({pieces}, ''), substr(text, cuts[size(cuts) - 1].b + 1)))")
    return unpacked(rows.join(cuts, "rid", "left"), text=built)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
