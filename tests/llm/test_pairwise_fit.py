"""The fit of operator 10 to all labelled rows, in several chunks."""

import numpy as np

from tessella.llm import pairwise_quality
from tessella.llm.docstats import FEATURES


def frame(spark, x, y):
    return spark.createDataFrame([(k, f.tolist(), int(v)) for k, (f, v) in enumerate(zip(x, y))], "doc_id long, features array<double>, label int").repartition(3)


def test_every_labelled_row_counts(spark):
    """More rows than were fitted on once (20,000, and a quarter more at most): mean, scale and cut are those of all, and the slope of the loss of 20 pairs a row is 0."""
    rng = np.random.default_rng(2)
    x = rng.random((27_000, len(FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(len(x)) > 0.5).astype(int)
    worth = pairwise_quality.Worth.of(frame(spark, x, y))
    z = pairwise_quality.expand(x)
    assert np.allclose(worth.mean, z.mean(0), atol=1e-12) and np.allclose(worth.scale, z.std(0) + 1e-9, atol=1e-12)
    assert abs(worth.cut - np.quantile(worth.worth(x), (y == 0).mean())) < 1e-9
    seen = []
    real = pairwise_quality._slopes(worth.mean, worth.scale, worth.weights, 1_000)
    chunks = -(-len(x) // pairwise_quality.CHUNK)
    of = [r.c for r in spark.range(len(x)).selectExpr("id", f"pmod(xxhash64(id), {chunks}) as c").orderBy("id").collect()]
    slope = -worth.weights
    for c in range(chunks):
        rows = np.flatnonzero(np.array(of) == c)
        order = rows[np.lexsort((y[rows], *x[rows].T[::-1]))]
        slope = slope + real(x[order], y[order], 7 + c)[0]
        seen += rows.tolist()
    assert np.abs(slope).max() < 1e-3 and sorted(seen) == list(range(len(x))) and chunks > 8


def test_order_statistics(spark):
    values = np.random.default_rng(1).standard_normal(21_000).round(2)
    values[:9_000] = 0.25  # more ties than the driver may sort
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    for share in (0.0, 0.3, 0.61, 1.0):
        assert abs(pairwise_quality.quantile(df, share) - np.quantile(values, share)) < 1e-12
