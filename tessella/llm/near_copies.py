"""Operator 9 at a similarity: one row stays of those that are joined by links of SIMILAR or more, by the Jaccard similarity of their five-word shingles.

The five-word SimHash fingerprints of all distinct texts are linked as operator 9 does it: blocks of bits deal them to shards, whose BK-trees are searched within
four bits. What such links join is a shard for verification, so each link of four bits or fewer is met, whatever the bands below do.

Two texts of that similarity differ in ten of 64 bits of their SimHash on average, so blocks of equal bits, which serve a radius of four, do not find all
links. Minhash bands deal the same fingerprints once more, for the links that are further: distinct texts that agree in a band of ROWS minhashes are a shard; a link of 0.8 is missed by all BANDS bands with a
probability of (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000, closer ones less. In a shard the BK-tree of the five-word SimHash fingerprints is searched
within RADIUS bits (a link of 0.8 is further with a probability of about 1 in 100,000), and what it finds is verified on the shingles (64-bit hashes), within the
task that has the shard; only edges leave it. Shards with the same members are looked at once.

Rows with equal shingles are one node, so exact copies meet in no shard. A shard is held by one task, with the shingles of its members; first its members are held against one of them each
time, so a group of many near copies takes a pass or two and the tree is searched for what joins groups.

Nulls: a null text has no words; texts without words are one node. The row with the smallest doc_id stays, of those the first; a null doc_id is the
largest. Rows are told apart by a row id, so those that repeat a doc_id and those without one are treated like others; an empty table gives an empty one; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import keyed, map_arrow, prepare, settle, sized, text_column, unpacked
from tessella.llm.components import components
from tessella.llm.docstats import WORD
from tessella.llm.simhash import LOWER, Forest, linked

SHINGLE, SEED, SIMILAR, BANDS, ROWS, RADIUS = 5, 42, 0.8, 20, 4, 24
#: Members of a shard that all others are held against before the tree is searched.
STARS = 4
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = " ".join(words).encode().translate(LOWER).split(b" ")
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(max(1, len(w) - SHINGLE + 1))], np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    low = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 4096):
        low = np.minimum(low, (grams[at : at + 4096, None] * FACTORS).min(0))
    return [np.int64(np.uint64(xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k)).view(np.int64)).item() for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def joined(rids: list[int], points: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what links of a shard join."""
    edges, up = [], list(range(len(rids)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def tried(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b and similar(sets[i], sets[j]):
            edges.append((rids[i], rids[j]))
            up[max(a, b)] = min(a, b)

    rest = np.arange(len(rids))
    for _ in range(STARS):  # the members of a group meet its first one, not each other
        if len(rest) < 2:
            break
        first, others = int(rest[0]), rest[1:]
        for j in others[np.bitwise_count(points[others] ^ points[first]) <= RADIUS].tolist():
            tried(first, j)
        rest = np.array([j for j in others.tolist() if top(j) != top(first)], np.int64)
    if len({top(i) for i in range(len(rids))}) > 1:
        for a, b in Forest(np.zeros(len(points), np.int64), points).links(RADIUS):
            for i, j in zip(a.tolist(), b.tolist()):
                if i < j:
                    tried(i, j)
    return edges


def _marks():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        node = [np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64).item() for s in sets]
        columns = [pa.array(node, pa.int64()), pa.array([simhash(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["rid", "doc_id", "node", "fp", "keys"])

    return step


def simhash(grams: np.ndarray) -> int:
    """The fingerprint of the distinct shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        counts += np.unpackbits(grams[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view(np.int64)[0])


def _sets():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([simhash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "keys", "fp", "grams"])

    return step


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key."""
    key, rids, points, sets = None, [], [], []

    def out() -> pa.RecordBatch:
        found = joined(rids, np.array(points, np.int64).view(np.uint64), sets)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for k, rid, fp, grams in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "fp", "grams"))):
            if k != key:
                if len(rids) > 1:
                    yield out()
                key, rids, points, sets = k, [], [], []
            rids.append(rid)
            points.append(fp)
            sets.append(np.frombuffer(grams, np.uint64))
    if len(rids) > 1:
        yield out()


def links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(rid, doc_id, text) -> (rid, doc_id, node) of all rows and the verified edges of nodes, each named by its smallest rid."""
    marked = settle(map_arrow(rows.select("rid", "doc_id", "text"), _marks, "rid long, doc_id long, node long, fp long, keys array<long>"))
    nodes = settle(marked.groupBy("node").agg(F.min("rid").alias("rid"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    roots = settle(linked(settle(nodes.select("fp").distinct())).select(F.col("node").alias("near"), "root"))
    fingered = nodes.join(sized(roots), F.col("fp") == F.col("near"), "left").select("rid", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))
    members = fingered.union(nodes.select("rid", F.explode("keys").alias("key")))
    shards = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).where("n > 1")
    live = settle(shards.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    wanted = settle(members.join(live, "key").groupBy("rid").agg(F.collect_set("key").alias("keys")))
    grams = map_arrow(rows.select("rid", "text").join(sized(wanted, 100_000), "rid").select("rid", "keys", "text"), _sets, "rid long, keys array<long>, fp long, grams binary").select("rid", F.explode("keys").alias("key"), "fp", "grams")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = settle(grams.repartition(n, "key").sortWithinPartitions("key", "rid").mapInArrow(_edges, "u long, v long"))
    return marked.join(nodes.select("node", F.col("rid").alias("top")), "node").select("rid", "doc_id", F.col("top").alias("node")), edges


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies."""
    prepare(documents.sparkSession)
    rows = keyed(documents, F.col("doc_id").cast("long").alias("doc_id"), text_column())
    named, edges = links(rows)
    roots = components(edges)
    groups = settle(named.join(roots, "node", "left").select("rid", "doc_id", F.coalesce("root", "node").alias("root")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid"))["rid"].alias("stays")
    first = settle(groups.groupBy("root").agg(least, F.count("*").alias("n")).where("n > 1").select("root", "stays"))  # rows that are alone stay
    gone = settle(groups.join(sized(first), "root").where("rid <> stays").select("rid"))
    return unpacked(rows.join(sized(gone), "rid", "left_anti"))
