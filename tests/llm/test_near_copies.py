"""Near copies against the Jaccard similarity of all pairs."""

import random
import re

import pyarrow as pa
from pyspark.sql import Row

import corpus_pipeline
from tessella.llm import near_copies

SF = "/root/testdata/sf0.01"


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def left(rows):
    """Ids that stay, by comparing all pairs that share a shingle."""
    sets, up, holders = [plain(t) for _, t in rows], list(range(len(rows))), {}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders.setdefault(g, [])} if s else {j for j in range(i) if not sets[j]}:
            if not s or len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                up[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, i)), (d is None, d or 0, i))
    return sorted((rows[i] for *_, i in best.values()), key=str)


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = left([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_replaced_words(spark):
    random.seed(7)
    rows = []
    for k in range(150):
        w = [f"w{random.randrange(5000)}" for _ in range(random.choice([100, 300, 1000]))]
        rows.append((2 * k, " ".join(w)))
        for i in random.sample(range(len(w)), max(1, len(w) * random.randrange(5, 30) // 1000)):
            w[i] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in rows], "doc_id long, text string")
    want = left(rows)
    assert 150 <= len(want) < 300 and sorted(((r.doc_id, r.text) for r in near_copies.keep_one(df).collect()), key=str) == want


def test_edges(spark):
    texts = [None, "", "One two three four five", "one TWO three four five", "one two", "alone here", "alone here", "alone here", "other"]
    ids = [None, 5, 9, 8, 7, None, 4, 4, None]
    df = spark.createDataFrame([Row(doc_id=i, text=t, rid="clash", node=1, row="r", keys="k") for i, t in zip(ids, texts)], "doc_id long, text string, rid string, node int, `row` string, keys string")
    assert near_copies.keep_one(df).columns == df.columns and {tuple(r)[2:] for r in near_copies.keep_one(df).collect()} == {("clash", 1, "r", "k")}
    assert sorted(str(r.doc_id) for r in near_copies.keep_one(df).collect()) == ["4", "5", "7", "8", "None"]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_groups_of_many_near_copies(spark):
    """A chain in which neighbours are similar and its ends are not, and a large group: shards with many members, and links that only the tree finds."""
    rng = random.Random(1)
    base = [f"v{k}" for k in range(200)]
    chain = [(k, " ".join([f"x{j}" if j < 4 * k else w for j, w in enumerate(base)])) for k in range(20)]
    many = [f"m{k}" for k in range(120)]
    group = [(100 + k, " ".join([*many, f"end{k}"])) for k in range(300)] + [(500 + k, " ".join(rng.sample(base, 60))) for k in range(40)]
    rows = chain + group
    rng.shuffle(rows)
    want = left(rows)
    assert len(want) == 42
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in near_copies.keep_one(df).collect()), key=str) == want


def test_unique_texts_stay(spark):
    df = spark.createDataFrame([(7, "a unique text of its own here"), (7, "another text that two rows have"), (3, "another text that two rows have")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in near_copies.keep_one(df).collect()) == [(3, "ano"), (7, "a u")]


def test_blocks_of_bits_deal_fingerprints(spark, monkeypatch):
    """Links of four bits or fewer are met without any band: by the shards and BK-trees of operator 9."""

    def marks(make=near_copies._marks):
        step = make()

        def unshared(batch):
            out = step(batch)
            return out.set_column(out.schema.get_field_index("keys"), "keys", pa.array([[rid] for rid in out.column("rid").to_pylist()], pa.list_(pa.int64())))

        return unshared

    monkeypatch.setattr(near_copies, "_marks", marks)
    rng = random.Random(5)
    rows = []
    for k in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(800)]
        rows.append((2 * k, " ".join(w)))
        w[rng.randrange(800)] = "changed"
        rows.append((2 * k + 1, " ".join(w[:-3])))
    points = [near_copies.simhash(near_copies.shingles(t)) for _, t in rows]
    apart = [(points[k] ^ points[k + 1]) & (2**64 - 1) for k in range(0, len(rows), 2)]
    close = {2 * k for k, x in enumerate(apart) if x.bit_count() <= 4}
    got = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(close) > 25 and not got & {k + 1 for k in close} and got >= {2 * k for k in range(40)}
