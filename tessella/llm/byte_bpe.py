"""Operator 2: byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over the ranks of adjacent pairs: a leaf holds (rank, position) of the pair that
starts at that position, an inner node the smaller of its children, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves at most; each change climbs to the root, so a pre-token of n bytes takes O(n log n) whatever it holds.

Nulls: a null text is encoded as the empty one (no ids); a null doc_id is returned as null. Each row is encoded by itself, so
repeated rows give repeated results and an empty table gives an empty one. Columns other than doc_id and the text are not read by round_trip(), and kept by encode() and decode(),
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import fresh, map_arrow, prepare, quoted, table, text_column

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the regex module and the tokenizers library class every character alike (tested).
ALIKE_BELOW = "՘"
#: Pre-tokens kept in each of the two generations of the cache.
CACHE = 75_000
#: Characters that are encoded together, and the largest tree that is merged in step with others.
CHUNK, IN_STEP = 1_000_000, 64
NONE = 1 << 62
#: Not ids: what stands beside a pre-token, and what is left of a merged symbol. Both are above all ids.
GONE, NO_ID = (1 << 24) - 2, (1 << 24) - 1
HASH = 0x9E3779B97F4A7C1


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, following = [], 0x100
    for b in range(256):
        out.append(chr(b if b in visible else following))
        following += b not in visible
    return out


def latin_split() -> str:
    """SPLIT for the re module, which knows no properties: its classes spelled out as far as ALIKE_BELOW."""
    chars = [chr(c) for c in range(ord(ALIKE_BELOW))]
    spelled = {k: "".join(f"\\U{ord(c):08x}" for c in chars if regex.match(p, c)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s"))}
    for name, plain in ((r"[^\s\p{L}\p{N}]", "[^{s}{L}{N}]"), (r"\p{L}", "[{L}]"), (r"\p{N}", "[{N}]"), (r"\s", "[{s}]"), (r"\S", "[^{s}]")):
        out = (out if name != r"[^\s\p{L}\p{N}]" else SPLIT).replace(name, plain.format(**spelled))
    return out


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = [vocab[c] for c in chars]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 24 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.byte_ids, self.merged_ids = np.array(self.byte_id, np.int64), np.array(self.merged, np.int64)
        self.slots = self._table()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(SPLIT)
        self.quick = re.compile(latin_split())
        self.unlike = regex.compile(f"[^\\x00-{chr(ord(ALIKE_BELOW) - 1)}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.known, self.library = path, {}, None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The ranks of pairs by open addressing, for many lookups at once."""
        size = 1 << (4 * len(self.rank)).bit_length()
        keys, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for key, rank in self.rank.items():
            slot = (((key * HASH) & (1 << 64) - 1) - ((key * HASH & 1 << 63) << 1) >> 40) & size - 1
            while keys[slot] >= 0:
                slot = slot + 1 & size - 1
            keys[slot], ranks[slot] = key, rank
        return keys, ranks, size - 1

    def merge(self, word: bytes) -> tuple[int, ...]:
        byte_id = self.byte_id
        ids = [byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        rank, merged = self.rank.get, self.merged
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        leaves, i = [], 0
        for a, b in zip(ids, ids[1:]):
            leaves.append(NONE if (r := rank(a << 24 | b)) is None else r << 32 | i)
            i += 1
        levels = [leaves + [NONE] * (size - n + 1)]
        while len(low := levels[-1]) > 1:
            levels.append(list(map(min, low[::2], low[1::2])))
        tree = [NONE]
        for level in reversed(levels):
            tree += level
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            new = ids[i] = merged[root >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(new << 24 | ids[k])
                changes = ((size + j, NONE), (size + i, NONE if r is None else r << 32 | i))
            else:
                changes = ((size + i, NONE),)
            if (h := before[i]) >= 0:
                r = rank(ids[h] << 24 | new)
                changes += ((size + h, NONE if r is None else r << 32 | h),)
            for k, value in changes:
                while k and tree[k] != value:
                    tree[k] = value
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
        return tuple([i for i in ids if i >= 0])

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() for many pre-tokens at once: those whose trees have the same size are merged in step, a numpy row each."""
        out: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_size.setdefault(max(4, 1 << (len(word) + 1).bit_length()), []).append(at)
        for size, ats in by_size.items():
            if size > IN_STEP or len(ats) < 16:
                for at in ats:
                    out[at] = self.merge(words[at])
            else:
                for at, ids in zip(ats, self._in_step([words[at] for at in ats], size), strict=True):
                    out[at] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs at a position."""
        keys, ranks, mask = self.slots
        key = left << 24 | right
        slot = key * HASH >> 40 & mask
        found = keys[slot]
        while (far := np.flatnonzero((found != key) & (found >= 0))).size:
            slot[far] = slot[far] + 1 & mask
            found[far] = keys[slot[far]]
        return np.where(found == key, ranks[slot] << 32 | at, NONE)

    def _in_step(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Positions run from 1; 0 and n + 1 hold an id that no pair has."""
        m, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((m, size), NO_ID, np.int64)
        column = np.arange(size)
        inside = (column >= 1) & (column <= lens[:, None])
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(column + 1, (m, 1))
        before = np.tile(column - 1, (m, 1))
        tree = np.full((m, 2 * size), NONE, np.int64)
        tree[:, size:-1] = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel(), np.tile(column[:-1], m)).reshape(m, -1)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        row = np.arange(m)
        while True:
            root = tree_[row * (2 * size) + 1]
            live = root != NONE
            row, root = row[live], root[live]
            if not row.size:
                break
            i, at, top = root & 0xFFFFFFFF, row * size, row * (2 * size)
            j = after_[at + i]
            new = self.merged_ids[root >> 32]
            ids_[at + i] = new
            ids_[at + j] = GONE
            k = after_[at + j]
            after_[at + i] = k
            before_[at + k] = i
            h = before_[at + i]
            leaf = top + size
            tree_[leaf + j] = NONE
            tree_[leaf + i] = self._ranks(new, ids_[at + k], i)
            tree_[leaf + h] = self._ranks(ids_[at + h], new, h)
            nodes = [size + x for x in (j, i, h)]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree_[top + x] = np.minimum(tree_[top + 2 * x], tree_[top + 2 * x + 1])
        kept = ids < GONE
        ends = np.cumsum(kept.sum(1)).tolist()
        flat = ids[kept].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """encode() of each text; what the cache lacks is merged together, some millions of characters at a time."""
        out: list[list[int]] = []
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK):
                chars += len(texts[end])
                end += 1
            out += self._encode_chunk(texts[start:end])
            start = end
        return out

    def _encode_chunk(self, texts: list[str]) -> list[list[int]]:
        parts = [[p if p in self.special else self.words(p) for p in (self.cut.split(t) if self.cut else [t]) if p] for t in texts]
        have: dict[str, tuple[int, ...]] = {}
        young, old = self.young, self.old
        for text in parts:
            for part in text:
                if not isinstance(part, str):
                    have.update(dict.fromkeys(part))
        missing = []
        for word in have:
            got = young.get(word)
            if got is None and (got := old.get(word)) is None:
                missing.append(word)
            have[word] = got
        have.update(zip(missing, self.merge_many([w.encode() for w in missing]), strict=True))
        if len(young) > CACHE:
            self.old, self.young = young, {}
        self.young.update(have)
        out = []
        for text in parts:
            ids: list[int] = []
            for part in text:
                if isinstance(part, str):
                    ids.append(self.special[part])
                else:
                    for got in map(have.__getitem__, part):
                        ids += got
            out.append(ids)
        return out

    def words(self, text: str) -> list[str]:
        """Pre-tokens. Characters that the regex module may class by a newer Unicode than the library are put to the library once each; a text with one that differs is split by the library."""
        if odd := set(self.unlike.findall(text)):
            for c in odd - self.known.keys():
                probe = f"a{c}1{c}!{c} {c}b"
                self.known[c] = self.pieces(probe) == self.split.findall(probe)
            if not all(self.known[c] for c in odd):
                return self.pieces(text)
            return self.split.findall(text)
        return self.quick.findall(text)

    def pieces(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        return self._encode_chunk([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digest(path: str):
    model = load(path)
    text_of = model.text_of.__getitem__

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, out_sha = [], [], []
        for ids in model.encode_many(batch.column(1).to_pylist()):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(text_of, ids)).encode()).hexdigest())
            out_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return step


def _tokens(path: str, how: str):
    model = load(path)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1).to_pylist()
        if how == "encode":
            out = pa.array([None if x is None else ids for x, ids in zip(column, model.encode_many([x or "" for x in column]), strict=True)], pa.list_(pa.int32()))
        else:
            out = pa.array([None if x is None else model.decode(x) for x in column], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=batch.schema.names)

    return step


def encode(df: DataFrame, text: str = "text", to: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with the ids of a text column in another column; null texts give null."""
    return _column(df, text, to, "encode", path)


def decode(df: DataFrame, ids: str = "token_ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of an ids column in another column; null lists give null."""
    return _column(df, ids, to, "decode", path)


def _column(df: DataFrame, source: str, to: str, how: str, path: str | None) -> DataFrame:
    """The values go as the last column, under a name that no column has; a column named `to` is replaced."""
    prepare(df.sparkSession)
    value = fresh(df, "value")
    kept = df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() != to.lower()))
    rows = df.select(*(F.col(quoted(c)) for c in kept.columns), F.col(quoted(source)).cast("string" if how == "encode" else "array<int>").alias(value))
    schema = T.StructType([*kept.schema.fields, T.StructField(value, T.ArrayType(T.IntegerType()) if how == "encode" else T.StringType())])
    return map_arrow(rows, _tokens, schema, path or default_path(), how).withColumnRenamed(value, to)


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, the digests of the ids and of the text decoded from them."""
    prepare(df.sparkSession)
    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), _digest, SCHEMA, path or default_path())


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
