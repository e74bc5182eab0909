"""Scores and regions from blocks of numbers against the comparison of whole sides, and what travels."""

import random

import numpy as np

from tessella.functions import tiling
from tessella.operators import grams, similarity
from tessella.plans import catalog
from tessella.plans.inputs import numbered_submissions, prose_submissions, prose_templates

SF = "/root/testdata/sf0.001"


def test_chosen_many():
    rng = random.Random(3)
    for _ in range(60):
        cases = [[(rng.randrange(40), rng.randrange(40), rng.randrange(3, 15)) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
        flat = np.array([(p, *t) for p, c in enumerate(cases) for t in c]).T
        got = sorted(zip(*(x.tolist() for x in tiling.chosen_many(*flat, 3))))
        assert got == [(p, k, *t) for p, c in enumerate(cases) for k, t in enumerate(tiling.chosen(c, 3))]


def test_equal_to_whole_sides(spark):
    """Passages with words replaced and template material anywhere, in long and short texts."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    shared, handed, docs = [some(70) for _ in range(4)], [some(14), some(30)], []
    for d in [*range(1, 16), *range(20, 60), *range(101, 110)]:
        w = some(rng.randrange(12))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(shared))
            for at in range(rng.randrange(8, 12), 70, rng.randrange(9, 13)):
                p[at : at + 1] = rng.choice([some(1), some(2), handed[0], []])
            w += p + rng.choice([[], handed[1], some(5)])
        docs.append((d, f"src{d % 2}", " ".join(w)))
    docs += [(900, None, docs[0][2]), (901, "src0", None), (902, "other", docs[0][2]), (903, "other", docs[1][2])]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(handed)] + [(20, " ".join(handed[1]))], "item_id long, text string")
    whole = similarity.prepared(prose_submissions(documents), prose_templates(benchmark))
    want = similarity.compared(similarity.candidates(whole), whole).collect()
    numbers = numbered_submissions(documents), prose_templates(benchmark)
    got = {(str(r.left_id), str(r.right_id)): r for r in grams.scores(*numbers).collect()}
    assert len(want) == len(got) > 300 and sum(r.similarity_score > 0 for r in want) > 100
    for r in want:
        g = got[r.left_id, r.right_id]
        assert abs(g.similarity_score - r.similarity_score) < 1e-12 and (g.matched_token_count, g.n_matches) == (r.matched_token_count, len(r.matches))
    regions = sorted((r.left_id, r.right_id, int(m.match_id[5:]), m.left.token_start, m.left.token_end, m.right.token_start, m.right.token_end, m.matched_token_count) for r in want for m in r.matches)
    assert regions == sorted((str(r[0]), str(r[1]), *r[2:]) for r in grams.regions(*numbers).collect())


def test_no_tokens_travel(spark):
    """Neither tokens nor texts are shuffled or kept; what is dealt to tasks are blocks of numbers."""
    for name in ("pair_similarity", "cluster_regions"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and "tokens" not in plan
        assert all("text#" not in line for line in plan.split("\n") if "Repartition" in line)
