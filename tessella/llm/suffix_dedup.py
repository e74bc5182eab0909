"""Operator 5: removal of repeated byte strings with a sparse, range-partitioned suffix array.

A string of LENGTH bytes is repeated if its first LENGTH bytes, as a suffix of its text, are those of another suffix. Not all
suffixes are sorted, only two sets that decide for all:

1. Anchors. Each window of LENGTH bytes chooses one block of BLOCK bytes in it, the leftmost of the smallest hash; equal windows choose
   alike. Windows in a row that choose the same block form a group; its anchor suffix has two leading tokens: the block, and the whole
   stretch that the group spans. If no other anchor has the block, no window of the group is repeated; if another has block and
   stretch, all are.
2. Windows of the groups that are left (the block is repeated, the stretch is not: about the ends of repeated passages), and of one
   group of each repeated stretch whose block other stretches have too, for them to be compared with. Each is a suffix of its own, of which LENGTH bytes count.

Tokens are BLAKE2b digests of their bytes, 64 bits each (both tokens of a window are the halves of one digest of its bytes), so equal tokens mean equal bytes unless
someone breaks the hash; an order of digests serves as well as one of bytes, as only equality counts. A rolling polynomial chooses the blocks; what it cannot tell
apart it chooses by the place, alike in equal windows, so the result does not rest on it.
Sorted splitters from a sample (Spark's range partitioner) deal the suffixes to buckets by their tokens and, among equal
ones, by text and position, so that a string of very many copies is split over buckets. Each bucket sorts by multikey quicksort and
compares neighbours; tokens that stand at the ends of two buckets or more are found by an aggregation and compared across the boundaries.

Nulls: a null text is empty and has nothing removed; a null doc_id is returned as null. Each row is a text of its own, so repeated rows of LENGTH
bytes and more lose all their bytes. Texts shorter than LENGTH keep all; an empty table gives an empty one. Columns other than doc_id
and the text are not read by dedup(), and kept by stripped(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import keyed, map_arrow, prepare, settle, sized, table, text_column, unpacked

LENGTH, BLOCK = 400, 272
#: Bytes of a text that are looked at together, and suffixes of a bucket.
CHUNK, BUCKET = 1 << 20, 1_500_000
#: Windows that leave a task together.
PIECE = 100_000
SUFFIX = "t1 long, t2 long, rid long, at long, n int"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BASE = 0x9E3779B97F4A7C15


class Names:
    """Rolling hashes of substrings, by which blocks are chosen: differences of a running polynomial modulo 2^64, moved to the same power."""

    def __init__(self, most: int):
        self.value = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
        self.power = np.full(most + 1, np.uint64(BASE))
        self.inverse = np.full(most + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        self.power[0] = self.inverse[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def blocks(self, data: np.ndarray, block: int) -> np.ndarray:
        n = len(data) - block + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=sums[1:])
        h = (sums[block:] - sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2b of substrings: a row of longs each."""
    view = memoryview(data)
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, size // 8)


def anchors(names: Names, data: bytes, length: int, block: int) -> tuple[np.ndarray, ...]:
    """(block's digest, stretch's digest, first window, windows) of each group of windows of a piece."""
    n, span = len(data) - length + 1, length - block + 1
    at = np.arange(len(data) - block + 1)
    # the leftmost smallest hash of each window: the place breaks ties; minima over 1, 2, 4 ... places, then over any two that cover the span
    key = (names.blocks(np.frombuffer(data, np.uint8), block) >> np.uint64(21) << np.uint64(21)) | at.astype(np.uint64)
    wide = 1
    while 2 * wide <= span:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    key = np.minimum(key[:n], key[span - wide : span - wide + n])
    chosen = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, n])
    places = chosen[first]
    return digests(data, places, places + block, 8)[:, 0], digests(data, first, first + count - 1 + length, 8)[:, 0], first, count


def _batch(t1, t2, rid, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, k)) for x, k in ((t1, np.int64), (t2, np.int64), (rid, np.int64), (at, np.int64), (n, np.int32))], names=["t1", "t2", "rid", "at", "n"])


def _joined(found: list[tuple]) -> pa.RecordBatch | None:
    if not found:
        return None
    t1, t2, rid, at, n = (np.concatenate(x) for x in zip(*found))
    return _batch(t1, t2, rid, at, n)


def _anchors(length: int, block: int):
    names = Names(CHUNK + length)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode()
            for begin in range(0, len(data) - length + 1, CHUNK):
                t1, t2, first, count = anchors(names, data[begin : begin + CHUNK + length - 1], length, block)
                found.append((t1, t2, np.full(len(t1), rid), first + begin, count))
        return _joined(found)

    return step


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for rid, text, groups in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), _places(batch.column("groups"))):
                data = text.encode()
                for first, count in zip(*groups):
                    at = np.arange(first, first + count)
                    both = digests(data, at, at + length, 16)
                    found.append((both[:, 0], both[:, 1], np.full(len(at), rid), at, np.ones(len(at))))
                    size += len(at)
                    if size >= PIECE:  # a batch of texts may have as many windows as bytes
                        yield _joined(found)
                        found, size = [], 0
        if found:
            yield _joined(found)

    return run


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes by their tokens. Ranges are split in three by a pivot's token: less and greater go on with the same token, equal with the next; small ranges are sorted at once."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        rows = order[low:high]
        token = tokens[depth][rows]
        if high - low <= 4096:
            by = np.lexsort([t[rows] for t in reversed(tokens[depth:])])
            order[low:high] = rows[by]
            continue
        pivot = np.sort(token[:: max(1, len(token) // 9)])[4]
        less, equal = token < pivot, token == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[low:high] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        todo += [(low, low + a, depth), (low + a, low + a + b, depth + 1), (low + a + b, high, depth)]
    return order


def _runs(sorted_tokens: list[np.ndarray]) -> np.ndarray:
    """For each sorted suffix, whether a neighbour has the same tokens."""
    same = np.logical_and.reduce([t[1:] == t[:-1] for t in sorted_tokens])
    return np.r_[False, same] | np.r_[same, False]


BUCKETED = SUFFIX + ", bucket int, one boolean, both boolean, edge boolean, rim boolean, first boolean, mixed boolean"


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of which a neighbour has the first token, and those at the ends, with what is known within the bucket."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    t1, t2, rid, at, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in kept]) for k in range(5))
    order = multikey_quicksort([t1, t2])
    t1, t2, rid, at, n = (x[order] for x in (t1, t2, rid, at, n))
    one, both = _runs([t1]), _runs([t1, t2])
    start1 = np.flatnonzero(np.r_[True, t1[1:] != t1[:-1]])
    first = np.r_[True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]
    mixed = np.repeat(np.add.reduceat(first.astype(np.int64), start1) > 1, np.diff(np.r_[start1, len(t1)]))
    ends = np.zeros(len(t1), bool)
    ends[[0, -1]] = True
    rim = ends.copy()
    rim[start1[-1]] = True
    out = one | ends
    columns = [*(pa.array(x[out]) for x in (t1, t2, rid, at, n.astype(np.int32))), pa.array(np.full(int(out.sum()), TaskContext.get().partitionId(), np.int32)), *(pa.array(x[out]) for x in (one, both, ends, rim, first, mixed))]
    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BUCKETED.split(", ")])


def repeated(suffixes: DataFrame, total: int) -> DataFrame:
    """The suffixes that share the first token with another: rid, at, n; both: whether one shares both tokens; open: whether it speaks for suffixes with the same tokens where others share the first only (one or more of each such class do)."""
    spark = suffixes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    dealt = suffixes.repartitionByRange(n, "t1", "t2", "rid", "at").mapInArrow(_sort_bucket, BUCKETED)
    del suffixes  # no frame is named longer than it is needed: its shuffle files go with it
    held = [dealt]
    del dealt
    dealt = settle(held.pop())
    # Suffixes are in order, so tokens at the ends of two buckets cross the boundary between them; two rows of a bucket, at most, tell. What they tell is news to its rim only:
    # the ends, and the first suffix of its last token, which speaks for that class if the others with the token are in other buckets. All others have a neighbour within.
    rim = settle(dealt.where("rim"))
    ends = rim.where("edge")
    crossing = lambda: F.min("bucket") < F.max("bucket")
    c1 = settle(ends.groupBy(F.col("t1").alias("c1")).agg(crossing().alias("over")).where("over").select("c1"))
    c2 = settle(ends.groupBy(F.col("t1").alias("d1"), F.col("t2").alias("d2")).agg(crossing().alias("over")).where("over").select("d1", "d2"))
    seen = rim.join(sized(c1), F.col("t1") == F.col("c1"), "left").join(sized(c2), (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left")

    def told(of: DataFrame, both, mixed) -> DataFrame:
        return of.select("rid", "at", "n", both.alias("both"), (~both | (F.col("first") & mixed)).alias("open"))

    over = F.col("c1").isNotNull()
    inner = told(dealt.where("one and not rim"), F.col("both"), F.col("mixed"))
    return inner.union(told(seen.where(F.col("one") | over), F.col("both") | F.col("d2").isNotNull(), F.col("mixed") | over))


def _places(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(at, n) of each row's list, without an object for each entry: a batch may have as many as bytes."""
    offsets, (at, n) = lists.offsets.to_numpy(), (lists.values.field(k).to_numpy() for k in ("at", "n"))
    for a, b, known in zip(offsets[:-1], offsets[1:], lists.is_valid().to_pylist()):
        yield (at[a:b], n[a:b]) if known else (at[:0], n[:0])


def _cut(batch_of: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(bytes, covered runs) of each row."""
    for text, (at, n) in zip(batch_of.column("text").to_pylist(), _places(batch_of.column("spans"))):
        order = at.argsort()
        begin, reach = at[order], np.maximum.accumulate((at + n - 1 + length)[order])
        new = np.r_[True, begin[1:] > reach[:-1]][: len(at)]
        yield text.encode(), list(zip(begin[new].tolist(), reach[np.r_[new[1:], True][: len(at)]].tolist()))


def _digest(length: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, runs in _cut(batch, length):
            kept, end = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[end:a])
                end = b
            kept.update(data[end:])
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return step


def _strip(length: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for data, runs in _cut(batch, length):
            ends = [0, *(b for _, b in runs)]
            texts.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(data)])).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(texts, pa.string())], names=["rid", "left"])

    return step


def spans(source: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """rid -> spans: array of (at, n), n repeated windows in a row from at. source: rid, text."""
    long = source.where(F.octet_length("text") >= length)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = settle(repeated(map_arrow(long, _anchors, SUFFIX, length, block), 2 * size // (length - block + 2)))
    group = F.collect_list(F.struct("at", "n"))  # at most a text's own groups
    open_groups = settle(groups.where("open").groupBy("rid").agg(group.alias("groups")))
    left = open_groups.select(F.sum(F.aggregate("groups", F.lit(0).cast("long"), lambda a, x: a + x["n"]))).first()[0] or 0
    single = repeated(long.join(open_groups, "rid").select("rid", "text", "groups").mapInArrow(_windows(length), SUFFIX), left).where("both").select("rid", "at", "n")
    return settle(groups.where("both").select("rid", "at", "n").union(single).groupBy("rid").agg(group.alias("spans")))


def dedup(documents: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, its bytes, those removed, the runs of them, and the digest of what is left."""
    prepare(documents.sparkSession)
    source = keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), F.col("doc_id"), F.col("text"))
    found = spans(source.select("rid", "text"), length, block)
    return map_arrow(source.select("rid", "doc_id", "text").join(found, "rid", "left").select("doc_id", "text", "spans"), _digest, SCHEMA, length)


def stripped(documents: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """documents with what is left of each text; a character of which a part is removed becomes U+FFFD. Texts that lose nothing, null ones too, stay as they are."""
    prepare(documents.sparkSession)
    source = keyed(documents, text_column())
    found = spans(source.select("rid", "text"), length, block)
    left = map_arrow(source.select("rid", "text").join(found, "rid").select("rid", "text", "spans"), _strip, "rid long, left string", length)
    return unpacked(source.select("rid", "row").join(left, "rid", "left"), text=F.coalesce(F.col("left"), F.col("row.text").cast("string")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
