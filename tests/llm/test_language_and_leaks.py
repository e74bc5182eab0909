"""Language identification by held-out agreement; leaks against a search of every passage."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language

SF = "/root/testdata/sf0.01"


def test_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language.op1_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    assert sum(r.lang_id == docs[r.doc_id].lang for r in rows) / len(rows) > 0.97
    assert sum(r.kept for r in rows) / len(rows) > 0.97
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = language.identify_pages(pages).collect()
    assert len(found) == pages.count() and sum(r.lang_id == r.declared for r in found) / len(found) > 0.9


def test_language_edges(spark):
    good = [("en", "the cat and the dog went to the house " * 5)] * 6 + [("de", "der hund und die katze gingen nach hause " * 5)] * 6
    rows = [Row(doc_id=i, text=t, lang=l, source="https://a.example.de/x", host=1) for i, (l, t) in enumerate(good)]
    rows += [Row(doc_id=None, text=None, lang=None, source=None, host=1), Row(doc_id=90, text="", lang="de", source="", host=1), Row(doc_id=91, text="\x01\x02\x7f" * 99, lang=None, source=None, host=1), Row(doc_id=92, text="der hund und die katze " * 20_000, lang="en", source="b", host=1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host int")
    out = {r.doc_id: r for r in language.identify_documents(df).collect()}
    assert len(out) == len(rows) and out[90].lang_id == "de" and out[92].lang_id == "de" and out[91].lang_id == "und" and out[0].lang_id == "en"
    assert language.identify_documents(df.limit(0)).count() == 0
    kept = language.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(12), None, 90, 92}


def test_rare_languages_are_modelled(spark):
    rows = [(i, f"the cat and the dog went to the house number {i} " * 3, "en") for i in range(3_000)]
    rows += [(9_000 + i, "ο σκύλος και η γάτα πήγαν στο σπίτι " * (3 + i), "el") for i in range(5)] + [(9_100, "der hund und die katze gingen nach hause " * 5, "de")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    out = language.identify(df, F.col("text"), F.col("lang"), F.col("source"), sample=60).collect()
    assert len(out) == len(rows) and all(r.lang_id == r.declared and r.kept for r in out)


def test_search_finds_all_above():
    random.seed(2)
    pool = [f"w{k}" for k in range(80)]
    index = decontaminate.Index([(k, " ".join(random.choices(pool, k=random.randrange(3, 30)))) for k in range(100)])
    for _ in range(200):
        terms = sorted({index.vocab[w.encode()] for w in random.choices(pool, k=40) if w.encode() in index.vocab})
        scores = [sum(x for t in terms for k, x in zip(index.items[t], index.impact[t]) if k == i) for i in range(100)]
        assert [i for i, _ in index.search(terms, 0.5)] == [i for i, s in enumerate(scores) if s >= 0.5 - 1e-6]


def test_query_equals_verbatim_search(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = set()
    share = lambda w, have: len((g := decontaminate.shingles(w)) & have) / len(g)
    for d in docs:
        have = decontaminate.shingles(decontaminate.words(d.text))
        want |= {(d.doc_id, b.item_id) for b in items if share(decontaminate.words(b.text), have) >= 0.8 or all(share(p, have) >= 0.8 for p in decontaminate.parts(b.text))}
    rows = decontaminate.op7_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 0
    kept = decontaminate.clean(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in kept.collect()} == {d.doc_id for d in docs} - {d for d, _ in want}


def test_leak_edges(spark):
    item = "What is the tall tower of the old town called? The tower is named after its first mason."
    docs = spark.createDataFrame([Row(doc_id=1, text=None, item_id="x"), Row(doc_id=None, text="pad " * 500 + item + " pad" * 500, item_id="x"), Row(doc_id=2, text="", item_id="x"), Row(doc_id=3, text="clean words " * 9_000, item_id="x"), Row(doc_id=4, text=item, item_id="x"), Row(doc_id=4, text=item, item_id="x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, None), (10, "")], "item_id long, text string")
    rows = decontaminate.find(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted([("None", 7), ("None", 8), *[("4", 7), ("4", 8)] * 2])
    assert decontaminate.find(docs.limit(0), bench).count() == decontaminate.find(docs, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 3]


def test_altered_copies_of_items(spark):
    random.seed(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    texts, want = [], set()
    for k, (_, text) in enumerate(items):
        w = text.split()
        for copy in [w[:-n] for n in range(1, 7)] + [w[n:] for n in range(1, 7)] + [[*w[:n], "replaced", *w[n + 1 :]] for n in random.sample(range(len(w)), min(5, len(w)))] + [[*w[:-1], "replaced"]]:
            have, whole = decontaminate.shingles(decontaminate.words(" ".join(copy))), decontaminate.shingles(decontaminate.words(text))
            if copy and len(whole & have) >= 0.8 * len(whole):
                want.add((len(texts), k))
                texts.append("before " * random.randrange(300) + " ".join(copy) + " behind" * random.randrange(300))
    found = {(t, [i for i, _ in items].index(i)) for t, i, *_ in decontaminate.leaks([index], texts)}
    assert len(want) > 100 and not want - found, (len(want - found), len(want))


def plain_leaks(docs, items):
    """BM25 of each item against each passage, and the overlaps, written out."""
    import math

    bags = {k: decontaminate.words(t) for k, t in items}
    n, mean, half = len(bags), sum(map(len, bags.values())) / len(bags), max(8, *map(len, bags.values()))
    df = {t: sum(t in w for w in bags.values()) for w in bags.values() for t in w}
    out = {}
    for d, text in docs:
        w = decontaminate.words(text)
        for at in range(0, len(w), half):
            passage = w[at : at + 2 * half]
            have = decontaminate.shingles(passage)
            for k, item in items:
                weigh = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (c := bags[k].count(t)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(bags[k]) / mean))  # noqa: B023, E731
                score = sum(weigh(t) for t in set(bags[k]) & set(passage)) / sum(weigh(t) for t in set(bags[k]))
                if score >= 0.7:
                    overlap = [len((g := decontaminate.shingles(x)) & have) / len(g) for x in (bags[k], *decontaminate.parts(item))]
                    if overlap[0] >= 0.8 or min(overlap[1:]) >= 0.8:
                        out[d, k] = max(out.get((d, k), (0,)), (overlap[0], round(score, 9), overlap[1], overlap[2]))
    return sorted((*pair, *x[1:]) for pair, x in out.items())


@pytest.mark.parametrize("shard, size", [(1_024, 8 << 20), (1_024, 3_000), (7, 8 << 20), (5, 2_000)])
def test_the_dealing_of_items_changes_nothing(spark, monkeypatch, shard, size):
    """Indices of few items, and groups of few bytes, against a plain search: scores rest on the statistics of the whole benchmark."""
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", size)
    rng = random.Random(3)
    pool = [f"word{k}" for k in range(300)]
    said = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(k, f"{said(rng.randrange(6, 30))}? {said(rng.randrange(5, 12))}.") for k in range(60)]
    docs = [(d, said(rng.randrange(200))) for d in range(20)]
    for d in range(20, 60):
        question, answer = items[rng.randrange(60)][1].split("? ")
        w = f"{question} {answer}".split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((d, f"{said(rng.randrange(90))} {rng.choice([question + '? ' + answer, ' '.join(w), question + ' or rather so it is: ' + answer, question, answer])} {said(rng.randrange(90))}"))
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in found)
    assert got == plain_leaks(docs, items) and len(got) > 15


def plain_fusion(rows):
    """(doc_id, text, lang, source) -> lang_id and posterior, one row after another. All rows are of the fitting sample."""
    import math
    import re
    from collections import Counter, defaultdict

    hosts = [re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", (s or "").lower())[1] for *_, s in rows]
    codes = [(re.match("[a-z]{2,3}", (g or "").lower()) or [""])[0] for _, _, g, _ in rows]
    bags = [Counter(language.grams((t or "").encode()).tolist()) for _, t, _, _ in rows]
    trained = Counter(c for c, (_, t, _, _) in zip(codes, rows) if c and len(t or "") >= 3)
    langs = sorted(c for c, n in trained.items() if n >= 3)
    weight = {c: defaultdict(lambda: 0.01) for c in langs}
    for c, bag, (_, t, _, _) in zip(codes, bags, rows):
        if c in weight and len(t or "") >= 3:
            for g, n in bag.items():
                weight[c][g] += n * 200 / sum(bag.values())
    mass = {c: sum(w.values()) + 0.01 * (65536 - len(w)) for c, w in weight.items()}
    names = [*langs, "und"]
    each = lambda name, g: -math.log(65536) if name == "und" else math.log((weight[name][g] if g in weight[name] else 0.01) / mass[name])
    fits = [{k: sum(n * each(k, g) for g, n in bag.items()) / (sum(bag.values()) + 200) * 200 for k in names} for bag in bags]
    best = [max(names, key=lambda k: (f[k], -names.index(k))) for f in fits]
    said = [c if c in langs else "other" if c else "" for c in codes]
    tell = [bool(bag) for bag in bags]
    only = lambda found: Counter(x for x, t in zip(found, tell) if t)
    seen, spoke = only(zip(best, said)), only(best)
    suffix = {h: (re.search(r"\.([a-z]{2,})$", h) or ["", ""])[1] for h in hosts}
    of_host, of_suffix = only(zip(hosts, best)), only((suffix[h], b) for h, b in zip(hosts, best))
    n_host, n_suffix = only(hosts), only(suffix[h] for h in hosts)
    out = []
    for h, s, f in zip(hosts, said, fits):
        total = {}
        for k in names:
            whole = (spoke[k] + 1) / (sum(tell) + len(names))
            wide = (of_suffix[suffix[h], k] + 50 * whole) / (n_suffix[suffix[h]] + 50)
            total[k] = f[k] + math.log((of_host[h, k] + 20 * wide) / (n_host[h] + 20)) + math.log((seen[k, s] + 1) / (spoke[k] + len(langs) + 2))
        top = max(total.values())
        out.append((next(k for k in names if total[k] == top), 1 / sum(math.exp(x - top) for x in total.values())))
    return out


def test_query_equals_plain_fusion(spark):
    small = SF.replace("0.01", "0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = {r[0]: w for r, w in zip(rows, plain_fusion(rows))}
    got = {r.doc_id: (r.lang_id, r.posterior) for r in language.op1_language_id(spark, small).collect()}
    assert got.keys() == want.keys()
    for k, (lang, p) in want.items():
        assert abs(got[k][1] - p) < 1e-3 and (got[k][0] == lang or abs(p - 0.5) < 1e-2), (k, got[k], lang, p)


def test_hidden_declarations(spark):
    """Rows whose declaration is hidden, from the model and as evidence, are named by text and host."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = language.identify(docs, F.col("text"), F.when(~hidden, F.col("lang")), F.col("source")).collect()
    true = {r.doc_id: r.lang for r in docs.where(hidden).collect()}
    named = [(r.lang_id, true[r.doc_id]) for r in rows if r.doc_id in true]
    assert len(named) > 150 and sum(a == b for a, b in named) / len(named) > 0.95


def test_suffixes_and_hosts_decide_where_texts_do_not(spark):
    rows = [(i, f"the cat and the dog went to the house number {i} " * 4, "en", f"https://a{i}.example.uk/x") for i in range(60)]
    rows += [(100 + i, f"der hund und die katze gingen nach haus {i} " * 4, "de", f"https://user@b{i}.beispiel.de:80/x?y") for i in range(60)]
    rows += [(200, "", None, "http://new.seite.de/"), (201, None, None, "http://new.page.uk"), (202, "", None, "a3.example.uk"), (203, "", "de", "http://other.page.uk")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang_id for r in language.identify_documents(df).collect()}
    want = plain_fusion(rows)
    assert [got[r[0]] for r in rows] == [w for w, _ in want] and (got[200], got[201], got[202], got[203]) == ("de", "en", "en", "de")


def test_rows_that_share_ids_are_judged_by_themselves(spark):
    good = [(i, "the cat and the dog went to the house " * 5, "en", "s", "r") for i in range(6)]
    bad = [(3, "\x01\x02\x7f" * 99, None, None, "r"), (None, "\x01\x03\x7f" * 99, None, None, "r"), (None, "the cat and the dog " * 9, None, None, "r")]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, rid string")
    kept = language.keep_known(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([*good, bad[2]], key=str)


def test_clean_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x", None, "clean words"), (2, "x", [1], "What is the tall tower of the old town called? The tower is named after its first mason.")], "doc_id long, item_id string, `a.b` array<int>, text string")
    bench = spark.createDataFrame([(7, "What is the tall tower of the old town called? The tower is named after its first mason.")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(df, bench).collect()] == [(1, "x", None, "clean words")]
