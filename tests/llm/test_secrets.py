"""The automaton against the re module, and the query against a plain search."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tessella.llm import secrets
from tessella.llm.automaton import Scanner

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PLAIN = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}
PIECES = ["password", "Secret", "api_key", "apikey", "TOKEN", "passwd", ":", "=", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEF123456", "é", "\n", "x", "xoxb-", "日", "-"]


def brute(text):
    found = sorted((m.start(), list(PLAIN).index(k), m.end()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text) if ok(m))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_equal_the_re_module(text):
    base = [x for x in secrets.spans_of(text) if secrets.RULES[x[1]].base]
    assert secrets.joined(base, secrets.RULES) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab01-x", max_size=40))
def test_scanner_equals_re(text):
    patterns = [r"ab{2,3}0*", r"x(a|b1)?-", r"[01]{3,}"]
    found = sorted(Scanner(patterns).scan(text.encode()))
    assert found == sorted((i, *m.span()) for i, p in enumerate(patterns) for m in re.finditer(p, text))


@pytest.mark.parametrize("gap", [10, 249, 250, 300, 1_000, 2_000, 100_000])
@pytest.mark.parametrize("before", ["", "word " * 100, "é " * 200])
def test_gaps_of_any_length(gap, before):
    for text in (f"{before}token{' ' * gap}=abcdefghijklmnop.", f"{before}token={' ' * gap}'abcdefghijklmnop'", f"{before}token{' ' * gap}:{' ' * gap}abcdefghijklmnop xox"):
        base = [x for x in secrets.spans_of(text) if secrets.RULES[x[1]].base]
        assert secrets.joined(base, secrets.RULES) == brute(text) != ""


def test_gaps_inside_and_ahead():
    for gap in (250, 1_000, 100_000):
        text = "y" * 300 + "a" + "-" * gap + "b" + " " * gap + "c"
        assert Scanner(["a-*b( *c)?"]).scan(text.encode()) == [(0, 300, len(text))]


def test_ends_of_matches_that_overlap_the_last_one():
    text = "token=password:" + "x" * 300_000 + " secret=abcdefghijklmnop"
    assert secrets.joined([x for x in secrets.spans_of(text) if secrets.RULES[x[1]].base], secrets.RULES) == brute(text)


def test_query_rows(spark):
    long = "word " * 50_000 + "token=abcdefghijklmnop é AKIA" + "A" * 5000
    texts = [None, "", "é secret: 'abcdefghijklmnop'", "é secret: 'abcdefghijklmnop'", long, "ghp_" + "a1" * 20]
    df = spark.createDataFrame([Row(doc_id=None if i == 1 else i, text=t, lang=None, spans="clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, spans string")
    rows = secrets.find(df).collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        assert row.base_sha256 == hashlib.sha256(brute(text or "").encode()).hexdigest()
    assert rows[5].spans.startswith("hosting:0:44")
    assert secrets.find(df.limit(0)).count() == 0
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    assert [r.text for r in clean.collect()][2] == "é [ASSIGN]'"
