"""Operator 3: secret scans with one deterministic automaton for all rules.

Nulls: a null text is scanned as the empty one; a null doc_id is returned as null. Rows are scanned by themselves: repeated rows
give repeated results, ties of kinds at one start are ordered as KINDS lists them, an empty table gives an empty one. Columns other
than doc_id and the text are not read by find(), and kept by redact().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.automaton import Scanner
from tessella.llm.common import map_arrow, prepare, table, text_column

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Rule(NamedTuple):
    kind: str
    pattern: str
    holds: Callable[[bytes], bool] = lambda found: True
    base: bool = False


def long_value(found: bytes) -> bool:
    """The value of an assignment, behind its sign, spaces and quote, has twelve characters at least."""
    sign = min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0)
    value = found[sign + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 12


#: A least length stands in the pattern of hex alone, where dropping shorter runs comes to the same; elsewhere counting would multiply the states.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda found: len(found) >= 18, True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("hosting", r"gh[opsur]_[A-Za-z0-9]+", lambda found: len(found) >= 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", lambda found: len(found) >= 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = tuple(r.kind for r in RULES)


@lru_cache(maxsize=4)
def scanner(patterns: tuple[str, ...]) -> Scanner:
    return Scanner(list(patterns))


def spans_of(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start."""
    data = text.encode()
    found = [(a, r, b) for r, a, b in scanner(tuple(x.pattern for x in rules)).scan(data) if rules[r].holds(data[a:b])]
    if not found:
        return []
    found.sort()
    if len(data) == len(text):
        return found
    at, chars, place = 0, 0, {}
    for cut in sorted({x for a, _, b in found for x in (a, b)}):
        chars += len(data[at:cut].decode())
        at, place[cut] = cut, chars
    return [(place[a], r, place[b]) for a, r, b in found]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans)


def _find(rules: tuple[Rule, ...]):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [[], [], []], [], []
        for text in batch.column(1).to_pylist():
            found = spans_of(text, rules)
            base = [x for x in found if rules[x[1]].base]
            for kind in range(3):
                counts[kind].append(sum(r == kind for _, r, _ in base))
            digests.append(hashlib.sha256(joined(base, rules).encode()).hexdigest())
            spans.append(joined(found, rules))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return step


def find(df: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, their digest, and all spans."""
    prepare(df.sparkSession)
    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()), _find, SCHEMA, RULES)


def _redact(rules: tuple[Rule, ...]):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = []
        for text in batch.column(at).to_pylist():
            if text:
                out, end = [], 0
                for a, r, b in spans_of(text, rules):
                    if b > end:
                        if a >= end:
                            out += [text[end:a], f"[{rules[r].kind.upper()}]"]
                        end = b
                text = "".join(out) + text[end:]
            texts.append(text)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return step


def redact(df: DataFrame) -> DataFrame:
    """df with each secret in the text replaced by its kind in brackets; of overlapping ones the whole stretch goes. Null texts stay null."""
    prepare(df.sparkSession)
    return map_arrow(df, _redact, df.schema, RULES)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
