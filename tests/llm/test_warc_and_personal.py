"""Archives by round trip and odd splits; personal data against the re module."""

import gzip
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import Row

from tessella.llm import personal, warc

SF = "/root/testdata/sf0.01"


def luhn(m):
    d = [int(c) for c in re.sub(r"\D", "", m)]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN.values()) for m in re.finditer(p, text or "") if ok(m[0]))
    return found, ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in found)


def check(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        found, said = brute(text)
        assert tuple(row)[1:5] == tuple(sum(k == x for _, x, _ in found) for k in range(4)), text
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [s for s in row.spans.split(",") if not s.startswith("term")] == said.split(",")


def test_personal_equals_re(spark):
    random.seed(4)
    pieces = ["a", "B_", "@", ".", "x.com", "1", "25", "255", "256", "+", " ", "-", "(", ")", "é", "\U0001f600", "4111 1111 1111 1111", "+49 30 123456", "10.0.0.1", "4111-1111-1111-1112", "%", "\n"]
    texts = ["".join(random.choices(pieces, k=random.randrange(1, 25))) for _ in range(600)] + [None, "", "a" * 60_000, "1." * 30_000, "7" * 60_000, "a@b" + ".c" * 30_000, "1.2.3.4 " * 300]
    df = spark.createDataFrame([Row(doc_id=i, text=t, rid="clash", base=1) for i, t in enumerate(texts)], "doc_id long, text string, rid string, base int")
    check(sorted(personal.find(df).collect(), key=lambda r: r.doc_id), texts)
    assert personal.find(df.limit(0)).count() == 0


def test_personal_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    check(sorted(personal.op4_personal_data(spark, SF).collect(), key=lambda r: r.doc_id), [r.text for r in docs])


def test_disclosing_terms(spark):
    texts = [f"plain words number {i} here" for i in range(200)] + ["write to Zebulon at z@ex.org today please"] * 2 + [None]
    df = spark.createDataFrame([Row(doc_id=None if i == 200 else i, text=t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = [r.spans for r in personal.find(df).collect() if r.spans]
    assert len(spans) == 2 and all("term:9:16" in s and "email:20:28" in s for s in spans)
    assert [r.text for r in personal.sanitise(df).collect() if "[EMAIL]" in (r.text or "")] == [" to  at [EMAIL]  "] * 2


def test_disclosing_terms_anywhere(spark):
    """Words in a heading, at the start, behind signs and far off, against a count over all texts."""
    random.seed(8)
    pool = [f"common{chr(97 + k)}" for k in range(20)]
    texts = [" ".join(random.choices(pool, k=30)) for _ in range(150)]
    for name, mail in [("Zebulon", "z@ex.org"), ("Xanthippe", "x@ex.org")]:
        texts += [f"{name}\n{' '.join(random.choices(pool, k=60))} {mail} {' '.join(random.choices(pool, k=60))} ({name.upper()}) un-{name} {name}s" for _ in range(3)]
    texts += ["İzmirli said İZMİRLİ \U0001f600 far " + "pad " * 50 + "4111 1111 1111 1111"] * 2 + ["z@ex.org " + "commona " * 30, None, ""]
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [{(k, t[a:b].lower()) for a, k, b in brute(t)[0]} for t in ((x or "") for x in texts)]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")] for t in texts]
    docs = lambda test: sum(map(test, range(len(texts))))
    known, want = {}, []
    for i, t in enumerate(texts):
        mine = set()
        for e in held[i]:
            n_e = docs(lambda j: e in held[j])
            for w in {w for *_, w in words[i]}:
                if (e, w) not in known:
                    n_t, both = docs(lambda j: any(w == x for *_, x in words[j])), docs(lambda j: e in held[j] and any(w == x for *_, x in words[j]))
                    known[e, w] = both >= 2 and math.log(both * len(texts) / n_e / n_t) >= 0.8 * math.log(len(texts) / n_e) - 1e-12
                if known[e, w]:
                    mine.add(w)
        want.append([f"term:{a}:{b}" for a, b, w in words[i] if w in mine and not any(x < b and a < y for x, _, y in brute(t)[0])])
    got = sorted(personal.find(df).collect(), key=lambda r: r.doc_id)
    assert [[s for s in r.spans.split(",") if s.startswith("term")] for r in got] == want
    assert sum(map(len, want)) > 15 and "term:0:7" in got[150].spans
    assert not any("zebulon " in (r.text or "").lower() for r in personal.sanitise(df).collect())


def test_many_matches(spark):
    """More matches than are added up in one go, in linear time."""
    texts = ["é 10.0.0.%d " % (k % 256) * 300 for k in range(3)] + ["x@y.org " * 40_000, " ".join(f"u{i}@h.org, +49 30 {i:06d}" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(sorted(personal.find(df).collect(), key=lambda r: r.doc_id), texts)


def test_personal_rows_behind_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, personal.find(docs).collect()))
    assert sorted(map(tuple, personal.find(docs.dropDuplicates(["doc_id"])).collect())) == want


def test_sanitise_edges(spark):
    """Clashing names, null ids, repeated rows, long texts; words that begin or end beside a span."""
    texts = [f"plain words number {i} here" for i in range(60)] + ["Zebulonski: z@ex.org,Zebulonski"] * 2 + [None, "", "a@b.org 10.0.0.1 +49 30 1234567" + " pad" * 40_000, "mail a@b.org.10.0.0.1 end"]
    df = spark.createDataFrame([(None if i % 2 else i, t, "r", "b", "s", "t", "w", "c") for i, t in enumerate(texts)], "doc_id long, text string, rid string, base string, spans string, terms string, `row` string, cuts string")
    out = personal.sanitise(df)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == len(texts) and {tuple(r)[2:] for r in rows} == {("r", "b", "s", "t", "w", "c")}
    said = sorted((r.text for r in rows if r.text is not None and not r.text.startswith("plain")), key=len)
    assert said == ["", ": [EMAIL],", ": [EMAIL],", "mail [EMAIL] end", "[EMAIL] [IP] [PHONE]" + " pad" * 40_000] and sum(r.text is None for r in rows) == 1
    found = {r.spans for r in personal.find(df).collect() if "term" in r.spans}
    assert found == {"term:0:10,email:12:20,term:21:31"}
    assert personal.sanitise(df.limit(0)).count() == 0


def test_warc_query_equals_sql(spark):
    rows = warc.op6_warc(spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    assert sorted(map(tuple, rows), key=str) == sorted(con.execute(warc.SQL).fetchall(), key=str)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_warc_edges(spark, tmp_path, split):
    pages = [(1, "http://a/ b", "x"), (2, None, None), (3, "u", ""), (None, "u", "x"), (4, "u", "é" * 50_000), (4, "u", "é" * 50_000), (0, "u", "lone \x1f\r\n\r\n"), (None, "u", "nobody")]
    df = spark.createDataFrame([Row(page_id=p, url=u, html=h, size=1) for p, u, h in pages], "page_id long, url string, html string, size int")
    rows = warc.read(warc.write(df, f"file://{tmp_path}/{split}"), split).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows], key=str)
    assert got == sorted([(1, 1, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (None, 1, "revisit", 1), (4, 100_000, "response", None), (4, 100_000, "response", None), (0, 10, "response", None), (None, 6, "response", None)], key=str)
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {"x", "", "é" * 50_000, "lone \x1f\r\n\r\n", "nobody"}
    assert warc.round_trip(df.limit(0)).count() == 0


def member(*head, body=b"", kind="response"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *head, f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


@pytest.mark.parametrize("split", [61, 1 << 20])
def test_foreign_and_damaged_archives(spark, tmp_path, split):
    """Other types of records, fields in other cases, damaged and cut members: the others are read, each once."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    digest = "sha1:" + warc.base32_sha1(b"hello")
    good = member("warc-target-uri:http://h/1", f"WARC-PAYLOAD-DIGEST:  {digest}", "content-type: application/http; msgtype=response", body=http + b"hello")
    wrong = member("WARC-Target-URI: http://h/2", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http", body=http + b"hullo")
    big = member("WARC-Target-URI: http://h/3", "Content-Type: application/http", body=http + random.Random(1).randbytes(4000))
    broken = bytearray(big)
    broken[len(big) // 2 : len(big) // 2 + 40] = b"\xff" * 40
    parts = [member(kind="warcinfo", body=b"software: x\r\n"), good, wrong, bytes(broken), b"no member at all", member("Content-Type: text/dns", kind="resource", body=b"dns"), good, big[: len(big) // 3]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in ("a.warc.gz", "empty.warc.gz")], "path string, size long")
    rows = warc.read(files, split).collect()
    got = sorted((r.record_type, r.url, None if r.payload is None else bytes(r.payload)) for r in rows)
    assert [g for g in got if g[0] != "damaged"] == [("resource", "", b"dns"), *[("response", "http://h/1", b"hello")] * 2, ("warcinfo", "", b"software: x\r\n")]
    assert [g[1:] for g in got if g[0] == "damaged"] == [("http://h/2", None), ("http://h/3", None), ("http://h/3", None)]
    assert all(r.page_id is None and r.refers_to is None for r in rows) and {r.payload_digest for r in rows if r.url == "http://h/1"} == {digest[5:]}


def test_many_payloads(spark, monkeypatch):
    """Beyond FIRSTS payloads that occur twice the join is shuffled: the same rows."""
    rows = sorted(map(tuple, warc.op6_warc(spark, SF).collect()), key=str)
    monkeypatch.setattr(warc, "FIRSTS", 0)
    assert sorted(map(tuple, warc.op6_warc(spark, SF).collect()), key=str) == rows
