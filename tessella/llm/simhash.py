"""Operator 9: SimHash near-duplicates, found with BK-trees.

Two fingerprints at RADIUS or fewer differing bits agree in at least len(blocks) - RADIUS of some blocks of bits, so the distinct
fingerprints are dealt to shards, one for each choice of BLOCKS - RADIUS blocks and what they hold: every link falls into a shard, shards are
small, and no tree grows with the corpus. A shard's BK-tree has children keyed by their distance to the parent; a search follows the
edges within the radius only. Trees of all shards of a task are built and searched together, a level at a time, and only what joins
components leaves a shard: an edge to the first fingerprint of each group, never all pairs.

The shards are not broadcast: they grow with the corpus, so each is sent to one task instead.

Nulls: a null text has no words and the fingerprint zero. A null doc_id is never the smallest, unless its component has no other: then the
component is null. Equal texts, repeated rows and ties share a component; rows that repeat a doc_id with other texts do not, unless these are linked; an
empty table gives an empty one. Columns other than doc_id and the text are not read.

The pipeline's stage, which asks for a similarity and not for a number of bits, is in near_copies.py and searches the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, prepare, settle, table, text_column
from tessella.llm.components import components
from tessella.llm.docstats import WORD

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
#: Pairs of query and node that are compared at a time.
FRONTIER = 2_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = WORD.findall(text)
    if not words:
        return 0
    data = " ".join(words).encode().translate(LOWER)
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(data, seed)]
    else:
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts = [0, *(spaces + 1).tolist()]
        ends = [*spaces.tolist(), len(data)][shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        h = [digest(data[a:b], seed) for a, b in zip(starts, ends)]
    counts, hashes = np.zeros(64, np.int64), np.array(h, np.uint64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return step


class Forest:
    """A BK-tree for each shard, over parallel arrays; points of a shard stand together and its first point is the root."""

    def __init__(self, shard: np.ndarray, point: np.ndarray):
        self.point = point
        n = len(point)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        edges = []
        waiting = np.setdiff1d(np.arange(n), first)
        at = self.root[waiting]
        while waiting.size:
            key = at * 65 + np.bitwise_count(point[waiting] ^ point[at]).astype(np.int64)
            _, chosen, of = np.unique(key, return_index=True, return_inverse=True)
            edges.append(np.stack([key[chosen], waiting[chosen]], 1))  # the first point at a distance becomes the child
            rest = np.ones(len(waiting), bool)
            rest[chosen] = False
            at, waiting = waiting[chosen][of][rest], waiting[rest]
        table = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        table = table[table[:, 0].argsort()]
        self.keys, self.child = table[:, 0], table[:, 1]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points within the radius, in pieces. A search enters the children whose distance to their parent is within the radius of its own."""
        n = len(self.point)
        step = max(1, FRONTIER // 64)
        for begin in range(0, n, step):
            todo = [(np.arange(begin, min(n, begin + step)), self.root[begin : begin + step])]
            while todo:
                query, node = todo.pop()
                d = np.bitwise_count(self.point[query] ^ self.point[node]).astype(np.int64)
                hit = (d <= radius) & (query != node)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                count = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
                some = count > 0
                query, low, count = query[some], low[some], count[some]
                while query.size:  # children in pieces of bounded size
                    upto = max(1, int(np.searchsorted(np.cumsum(count), FRONTIER, side="right")))
                    q, a, c = query[:upto], low[:upto], count[:upto]
                    offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    todo.append((np.repeat(q, c), self.child[np.repeat(a, c) + offset]))
                    query, low, count = query[upto:], low[upto:], count[upto:]


def _smallest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each point's group, given its links."""
    up = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = up[a], up[b]
            if (ra == rb).all():
                break
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up[up] != up).any():
                up = up[up]
    return up


def _shard_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        whole = pa.Table.from_batches(kept)
        shard, fp = (whole.column(c).to_numpy() for c in ("shard", "fp"))
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        up = _smallest(len(fp), Forest(shard, fp.view(np.uint64)).links(radius))
        joined = np.flatnonzero(up != np.arange(len(up)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[up[joined]]), pa.array(fp[joined])], names=["u", "v"])

    return run


def shard_keys(fp, blocks: int, radius: int):
    """The shards of a fingerprint: a hash of which blocks are looked at and what they hold."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def linked(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """nodes(fp), each fingerprint once -> (node, root) of those that links join, by the BK-trees of shards of blocks of bits."""
    shards = nodes.select(F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"), "fp")
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * 15 // 1_000_000 + 1)
    return components(shards.repartition(n, "shard").mapInArrow(_shard_edges(radius), "u long, v long"))


def group(documents: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Per row: doc_id, fingerprint and component_id, the smallest doc_id that links reach."""
    prepare(documents.sparkSession)
    marked = settle(map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), _fingerprints, "doc_id long, fp long"))
    # A node is a fingerprint, whatever ids its rows have: rows that share an id are linked by their texts only.
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = linked(nodes, radius, blocks)
    rooted = settle(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settle(rooted.join(lowest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
