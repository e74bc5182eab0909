"""Operator 7: benchmark decontamination by BM25 with block-max WAND.

The inverted index holds the benchmark's items; the queries are the passages of each document, windows of twice the longest item
that overlap by half, so that an item that occurs stands whole in one. Impacts are BM25 weights divided by the item's score for its own
text: a passage that holds an item scores 1, and THRESHOLD means the same for all items. A batch's passages are first bounded
by the block maxima of their terms, together in numpy; where a block may reach the threshold, block-max WAND retrieves all items above it. Each is
verified: SIMILAR of the whole item's five-word shingles must stand in the passage, or SIMILAR of its question's and SIMILAR of its answer's. The answer is the last
sentence; both overlaps are reported.

An index holds SHARD_ITEMS items at most; a larger benchmark is dealt to several, and all that GROUP_BYTES of items allow are searched in one pass over the
documents. The number of items, their mean and largest lengths and the document frequencies of terms are those of the whole benchmark, so the dealing changes no score and
no result. Only a benchmark of more than GROUP_BYTES takes a further pass.

Nulls: null and empty texts are no passages and no items; a null doc_id is returned as null, items without an id are left out of the index, repeated items are
reported each. Of the passages of a document the one with the largest overlap counts; repeated rows are reported each; an empty
table on either side gives an empty result. Columns other than the ids and texts are not read by find(), and kept by clean(), whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, prepare, settle, table, text_column

K1, B, THRESHOLD, SHINGLE, SIMILAR = 1.2, 0.75, 0.7, 5, 0.8
#: Items of a block, items of an index, and bytes of items that are held by the driver and sent to the tasks together.
BLOCK, SHARD_ITEMS, GROUP_BYTES = 8, 1_024, 8 << 20
#: Words that are looked at together.
CHUNK = 200_000
#: ASCII signs part words.
SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(SIGNS).split()


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the answer is the last sentence, or the last quarter of the words if there is but one."""
    cut = [m.end() for m in re.finditer(r"[.?!](?=\s+\S)", text)]
    if cut and words(text[cut[-1] :]) and words(text[: cut[-1]]):
        return words(text[: cut[-1]]), words(text[cut[-1] :])
    w = words(text)
    at = len(w) - len(w) // 4
    return w[:at], w[at:] or w


class Statistics(NamedTuple):
    """Of the whole benchmark: its items, their mean and largest number of words, and in how many of them the terms of an index stand."""

    n: int
    mean: float
    longest: int
    df: Mapping[bytes, int]

    @classmethod
    def of(cls, bags: list[list[bytes]]) -> Statistics:
        return cls(len(bags), sum(map(len, bags)) / len(bags), max(map(len, bags)), Counter(t for w in bags for t in set(w)))


class Index:
    """Postings by term, items in the order of the index, and the largest impact of each term in each block of items."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None):
        self.ids = [i for i, _ in items]
        bags = [words(t) for _, t in items]
        self.grams = [shingles(w) for w in bags]
        self.question, self.answer = zip(*((shingles(q), shingles(a)) for q, a in (parts(t) for _, t in items)), strict=True)
        known = known or Statistics.of(bags)
        self.vocab = {t: k for k, t in enumerate(sorted({t for w in bags for t in w}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for k, w in enumerate(bags):
            weight = {t: math.log(1 + (known.n - known.df[t] + 0.5) / (known.df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / known.mean)) for t, c in Counter(w).items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings[self.vocab[t]].append((k, x / own))
        self.items = [[k for k, _ in p] for p in postings]
        self.impact = [[x for _, x in p] for p in postings]
        self.block_max = np.zeros((len(postings), -(-len(items) // BLOCK)), np.float32)
        for t, p in enumerate(postings):
            for k, x in p:
                self.block_max[t, k // BLOCK] = max(self.block_max[t, k // BLOCK], x)
        self.most = [max(x) for x in self.impact]
        self.half = max(8, known.longest)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least the threshold for the terms, by block-max WAND."""
        slack = 1e-6
        cursors = [[self.items[t][0], t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.block_max[t, block]) for _, t, _ in cursors[: pivot + 1]) < threshold - slack:
                # No item of this block before the next cursor's can reach the threshold.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
            elif cursors[0][0] == item:
                score = sum(self.impact[t][at] for _, t, at in cursors[: pivot + 1])
                if score >= threshold - slack:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[2] = bisect_left(self.items[c[1]], target, c[2])
                    c[0] = self.items[c[1]][c[2]] if c[2] < len(self.items[c[1]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def candidates(self, bags: list[list[bytes]], threshold: float) -> list[tuple[int, int, list[int]]]:
        """(text, first word, terms) of the passages that some block's bound lets reach the threshold."""
        get, half, v = self.vocab.get, self.half, len(self.vocab)
        lens = np.fromiter(map(len, bags), np.int64, len(bags))
        halves = -(-lens // half)
        first = np.cumsum(halves) - halves
        term = np.fromiter((t for w in bags for t in map(get, w, repeat(-1))), np.int64, int(lens.sum()))
        place = np.arange(len(term)) - np.repeat(np.cumsum(lens) - lens, lens)
        window = np.repeat(first, lens) + place // half
        inside, early = term >= 0, place < half
        term, window, early = term[inside], window[inside], early[inside]
        keys = np.unique(np.concatenate([window * v + term, (window[~early] - 1) * v + term[~early]]))
        if not keys.size:
            return []
        window, term = keys // v, keys % v
        start = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        bound = np.zeros(len(start), np.float32)
        for at in range(0, len(start), 4096):
            a, b = start[at], start[at + 4096] if at + 4096 < len(start) else len(term)
            bound[at : at + 4096] = np.add.reduceat(self.block_max[term[a:b]], start[at : at + 4096] - a, axis=0).max(1)
        out = []
        for k in np.flatnonzero(bound >= threshold - 1e-4):
            text = int(np.searchsorted(first, window[start[k]], side="right")) - 1
            while not halves[text]:
                text -= 1
            out.append((text, int(window[start[k]] - first[text]) * half, term[start[k] : start[k + 1] if k + 1 < len(start) else len(term)].tolist()))
        return out

    def verified(self, bags: list[list[bytes]]) -> dict[tuple[int, int], tuple[float, ...]]:
        """(text, item) -> whole overlap, score, question overlap, answer overlap of the passage of the largest overlaps."""
        best: dict[tuple[int, int], tuple[float, ...]] = {}
        for text, word, terms in self.candidates(bags, THRESHOLD):
            hits = self.search(terms, THRESHOLD)
            passage = shingles(bags[text][word : word + 2 * self.half]) if hits else set()
            for item, score in hits:
                whole, question, answer = self.overlaps(item, passage)
                if whole >= SIMILAR or min(question, answer) >= SIMILAR:
                    best[text, item] = max(best.get((text, item), (0.0,)), (whole, score, question, answer))
        return best

    def overlaps(self, item: int, passage: set[tuple[bytes, ...]]) -> tuple[float, float, float]:
        """The shares of the item's, its question's and its answer's shingles in the passage; a part of fewer than five words counts if its words follow each other somewhere."""
        out = []
        for grams in (self.grams[item], self.question[item], self.answer[item]):
            short = next((g for g in grams if len(g) < SHINGLE), None)
            if short:
                n = len(short)
                out.append(float(any(p[k : k + n] == short for p in passage for k in range(len(p) - n + 1))))
            else:
                out.append(len(grams & passage) / len(grams))
        return out[0], out[1], out[2]


def leaks(indices: list[Index], texts: list[str]) -> list[tuple[int, int, float, float, float]]:
    """(text, item's id, score, question overlap, answer overlap) of what is verified; each pair of a text and an item once."""
    out, at = [], 0
    while at < len(texts):
        bags, size, begin = [], 0, at
        while at < len(texts) and (not bags or size < CHUNK):
            bags.append(words(texts[at]))
            size += len(bags[-1])
            at += 1
        for index in indices:
            out += [(begin + t, index.ids[i], *x[1:]) for (t, i), x in index.verified(bags).items()]
    return sorted(out)


def _words():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [words(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(list(map(len, bags)), pa.int64()), pa.array([sorted(set(w)) for w in bags], pa.list_(pa.binary()))], names=["n", "terms"])

    return step


def groups(benchmark: DataFrame) -> list[list[Index]]:
    """The indices of the benchmark, in groups of GROUP_BYTES of items; one group for any benchmark of a few thousand items. Only a group's items and the frequencies of their terms are on the driver at a time."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_column()).where("text <> ''")
    bags = map_arrow(items.select("text"), _words, "n long, terms array<binary>").where("n > 0")
    total = bags.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // GROUP_BYTES))
    if parts == 1:
        return [_indices(items, total)] if total.n else []
    df = settle(bags.select(F.explode("terms").alias("term")).groupBy("term").count())
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = []
    for k in range(parts):
        mine = items.where(part == k)
        terms = map_arrow(mine.select("text"), _words, "n long, terms array<binary>").select(F.explode("terms").alias("term")).distinct()
        if found := _indices(mine, total, {bytes(r.term): r["count"] for r in df.join(terms, "term").collect()}):
            out.append(found)
    return out


def _indices(items: DataFrame, total: Row, df: Mapping[bytes, int] | None = None) -> list[Index]:
    rows = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect() if words(r.text)]
    if df is None:
        df = Counter(t for _, text in rows for t in set(words(text)))
    known = Statistics(total.n, total["mean"], total.longest, df)
    return [Index(rows[at : at + SHARD_ITEMS], known) for at in range(0, len(rows), SHARD_ITEMS)]


def _find(indices: list[Index]):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(ids[t], *x) for t, *x in leaks(indices, texts)]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return step


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks."""
    prepare(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column())
    found = [map_arrow(source, _find, SCHEMA, indices) for indices in groups(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else documents.sparkSession.createDataFrame([], SCHEMA)


def _clean(indices: list[Index], at: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        leaky = {t for t, *_ in leaks(indices, texts)}
        return batch.filter(pa.array([k not in leaky for k in range(len(texts))]))

    return step


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that leak an item; all columns stay."""
    prepare(documents.sparkSession)
    at = documents.columns.index("text")
    for indices in groups(benchmark):
        documents = map_arrow(documents, _clean, documents.schema, indices, at)
    return documents


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
