"""Operator 1: language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text (byte trigrams of each language, and of none: `und`), what its markup
declares, and what its address suggests: the languages of a host's texts, smoothed by those of all hosts with its suffix, smoothed by
those of the whole corpus. The declarations' reliability and the priors are grouped aggregations over all rows. Only the trigram
model is fitted on a sample: about SAMPLE rows, dealt evenly to all languages that LEAST rows of the whole table declare. A declaration is a label of the
text model for the rows of that sample only; for all others it is evidence of its own. The texts of a host meet its prior by a broadcast, or, beyond HOSTS hosts, by a join
of written tables, in which the adaptive plan splits a hot host.

Nulls and empty texts: a text without trigrams is no evidence and is counted nowhere (its text_lang is `und`), so declaration and prior decide, and it is kept; a null declaration is a kind of its own; a null address is a
host of its own; a null doc_id is returned as null. Ties go to the first language of the alphabet. Repeated rows get equal
results; an empty table gives an empty one; if nothing is declared all texts are `und` and rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import keyed, map_arrow, prepare, settle, sized, table, text_column, unpacked

SAMPLE, LEAST, FEW = 4_000, 3, 20
#: Hosts whose priors are sent to all tasks; with more of them, the texts of a host meet its prior by a shuffle.
HOSTS = 50_000
UNIT = 1 << 20
BUCKETS = 1 << 16
NONE = "und"
#: Trigrams after which more text adds ever less, pseudo-counts of the next wider prior, and of declarations.
HALF, HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 200.0, 20.0, 50.0, 1.0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(data: bytes) -> np.ndarray:
    """Buckets of the byte trigrams."""
    b = LOWER[np.frombuffer(data, np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def _weigh():
    """Summed weights of the buckets of each declared language: a text is worth HALF trigrams, so that a long one with a wrong label does little. Whole numbers of 1 / UNIT, so that their order does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [(lang, np.flatnonzero(w), w[w > 0]) for lang, w in held.items()]
            names = pa.array([lang for lang, at, _ in found for _ in at], pa.string())
            return pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate([f[k] for f in found])) for k in (1, 2))], names=["declared", "bucket", "weight"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(g := grams(text.encode())):
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.rint(np.bincount(g, minlength=BUCKETS) * (HALF * UNIT / len(g))).astype(np.int64)
                if len(held) > 32:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def train(rows: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """The languages that LEAST rows(declared, text) declare, and the log-likelihood of each bucket (columns: languages, then `und`), fitted on about `most` rows: an even part of each language, but FEW rows of each (or all) in any
    case. The trigrams are counted where the rows are; the driver gets sums, BUCKETS a language at most."""
    counts = {r.declared: r["count"] for r in rows.groupBy("declared").count().where(F.col("count") >= LEAST).collect()}
    langs = sorted(counts)
    out = np.full((BUCKETS, len(langs) + 1), -math.log(BUCKETS), np.float32)
    if not langs:
        return langs, out
    each = max(most // len(langs), FEW)
    cuts = rows.sparkSession.createDataFrame([(k, min(1 << 40, (each << 40) // n)) for k, n in counts.items()], "declared string, cut long")
    chosen = rows.join(F.broadcast(cuts), "declared").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.col("cut")).select("declared", "text")
    sums = settle(chosen.mapInArrow(_weigh(), "declared string, bucket long, weight long").groupBy("declared", "bucket").agg(F.sum("weight").alias("weight")))
    found = sums.toArrow()
    lost = sorted(set(langs) - set(found.column("declared").to_pylist()))
    if lost:  # rows that hash alike may all be left out: then the first ones stand for the language
        rest = [rows.where(F.col("declared") == k).select("declared", "text").limit(FEW) for k in lost]
        found = pa.concat_tables([found, *(r.mapInArrow(_weigh(), "declared string, bucket long, weight long").groupBy("declared", "bucket").agg(F.sum("weight").alias("weight")).toArrow() for r in rest)])
    count = np.full((BUCKETS, len(langs)), 0.01)
    at = {k: i for i, k in enumerate(langs)}
    column = np.array([at[k] for k in found.column("declared").to_pylist()], np.int64)
    count[found.column("bucket").to_numpy(), column] += found.column("weight").to_numpy() / UNIT
    out[:, :-1] = np.log(count / count.sum(0))
    return langs, out


def _likelihoods(model: np.ndarray):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(4).to_pylist():
            g = grams(text.encode())
            mean = np.zeros(model.shape[1])
            for at in range(0, len(g), 1 << 20):
                mean += model[g[at : at + (1 << 20)]].sum(0, dtype=np.float64)
            out.append((mean / (len(g) + HALF) * HALF).tolist())  # a mean over the text, worth HALF trigrams at most
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))], names=["rid", "doc_id", "declared", "host", "fit"])

    return step


def _best(scores: list[Column], names: list[str]) -> Column:
    """The name of the largest score; the first of equals."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(names[-1])
    for s, n in reversed(list(zip(scores[:-1], names[:-1]))):
        out = F.when(s == top, n).otherwise(out)
    return out


def identify(rows: DataFrame, text: Column, declared: Column, address: Column, sample: int = SAMPLE, key: str | None = None) -> DataFrame:
    """Per row: doc_id, declared, text_lang (by the text alone), lang_id, posterior, and kept: whether a language fits better than none; and rid, if the rows have a key."""
    prepare(rows.sparkSession)
    host = F.coalesce(F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))
    code = F.regexp_extract(F.lower(F.coalesce(declared, F.lit(""))), "^[a-z]{2,3}", 0)
    rid = F.col(key) if key else F.lit(None).cast("long")
    base = rows.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), code.alias("declared"), host.alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    langs, model = train(base.where("declared <> '' and length(text) >= 3"), sample)
    names = [*langs, NONE]
    scored = settle(map_arrow(base, _likelihoods, "rid long, doc_id long, declared string, host string, fit array<double>", model))
    fit = [F.col("fit")[k] for k in range(len(names))]
    known = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("other")) if langs else F.lit("")
    # texts without trigrams say nothing of their declarations and hosts
    scored = scored.withColumn("tells", F.exists("fit", lambda x: x != 0)).withColumn("text_lang", F.when(F.col("tells"), _best(fit, names)).otherwise(NONE)).withColumn("said", known)

    # How often texts of each language declare what: few rows whatever the input.
    said = {(r.text_lang, r.said): r["count"] for r in scored.where("tells").groupBy("text_lang", "said").count().collect()}
    kinds = [*langs, "other", ""]
    reliable = {n: {k: math.log((said.get((n, k), 0) + DECLARED_WEIGHT) / (sum(said.get((n, x), 0) for x in kinds) + DECLARED_WEIGHT * len(kinds))) for k in kinds} for n in names}

    # Priors of hosts, smoothed by their suffix, smoothed by the whole.
    counts = [F.sum((F.col("tells") & (F.col("text_lang") == n)).cast("long")).alias(f"n{k}") for k, n in enumerate(names)]
    hosts = settle(scored.groupBy("host").agg(*counts).withColumn("suffix", F.regexp_extract("host", r"\.([a-z]{2,})$", 1)))
    again = [F.sum(f"n{k}").alias(f"s{k}") for k in range(len(names))]
    suffixes = settle(hosts.groupBy("suffix").agg(*again))
    whole = suffixes.agg(*(F.sum(f"s{k}").alias(f"g{k}") for k in range(len(names)))).first()
    g = [((whole[k] or 0) + 1) / (sum(x or 0 for x in whole) + len(names)) for k in range(len(names))]
    total = lambda p: sum((F.col(f"{p}{k}") for k in range(len(names))), F.lit(0))
    wide = [(F.col(f"s{k}") + SUFFIX_WEIGHT * g[k]) / (total("s") + SUFFIX_WEIGHT) for k in range(len(names))]
    priors = settle(hosts.join(suffixes, "suffix").select("host", *(F.log((F.col(f"n{k}") + HOST_WEIGHT * wide[k]) / (total("n") + HOST_WEIGHT)).alias(f"p{k}") for k in range(len(names)))))

    def declared_as(n: str) -> Column:
        out = F.lit(reliable[n][""])
        for k in kinds[:-1]:
            out = F.when(F.col("said") == k, reliable[n][k]).otherwise(out)
        return out

    fused = scored.join(sized(priors, HOSTS), "host").select("*", *((fit[k] + F.col(f"p{k}") + declared_as(n)).alias(f"f{k}") for k, n in enumerate(names)))
    f = [F.col(f"f{k}") for k in range(len(names))]
    top = F.greatest(*f) if len(f) > 1 else f[0]
    posterior = F.lit(1.0) / sum((F.exp(x - top) for x in f), F.lit(0.0))
    out = fused.select("rid", "doc_id", "declared", "text_lang", "tells", _best(f, names).alias("lang_id"), posterior.alias("posterior")).withColumn("kept", ~F.col("tells") | (F.col("lang_id") != NONE)).drop("tells")
    return out if key else out.drop("rid")


def identify_documents(documents: DataFrame) -> DataFrame:
    return identify(documents.select("doc_id", "text", "lang", "source"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: the html element declares the language, the URL is the address, the text is what stands outside of tags."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return identify(pages.select(F.col("page_id").alias("doc_id"), "html", "url"), text, F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1), F.col("url").cast("string"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def keep_known(documents: DataFrame) -> DataFrame:
    """documents without those of no language, row by row: rows that repeat a doc_id, or have none, are judged by themselves. All columns stay."""
    prepare(documents.sparkSession)
    rows = keyed(documents, F.col("doc_id").cast("long").alias("doc_id"), text_column(), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    gone = settle(identify(rows, F.col("text"), F.col("lang"), F.col("source"), key="rid").where("not kept").select("rid"))
    return unpacked(rows.join(sized(gone), "rid", "left_anti"))
