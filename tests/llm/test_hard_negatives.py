"""Hard negatives against all pairs."""

import math

import numpy as np

from factloom.llm import hard_negatives as H
from pyspark.sql import functions as F


def plain(rows, every=100, positives=5, negatives=5, low=80, high=100, scale=256):
    ok = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in {(i, l, tuple(v)): 0 for i, l, v in ok if i % every == 0}:
        scores = [(-sum(map(int.__mul__, v, w)), j, m) for j, m, w in ok if len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2] == l and x[1] != i)[:positives]:
            found = sorted(x for x in scores if x[2] != l and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(n=900, dims=20, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    vecs = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))
    labels = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 6, n))
    return [(int(k), int(l), v.astype(np.float32).tolist()) for k, (l, v) in enumerate(zip(labels, vecs))]


def test_matches_all_pairs(spark):
    rows = table()
    v = rows[0][2]
    # Ties, repeated rows, a repeated anchor, zero vectors, odd lengths, nulls and what isn't finite.
    rows += [(5000 + k, k % 2, v) for k in range(12)] + [rows[3], rows[3], rows[20], (2000, 0, [0.0] * 20), (2001, 1, [0.0] * 20), (2020, 0, [1.0, 2.0]), (2021, 0, [1.0, 3.0]), (2022, 1, [1.0, 2.5]), (2040, 1, []), (2041, 1, []), (2042, 2, [])]
    rows += [(2060, None, v), (None, 1, v), (2080, 1, None), (2100, 1, [None] * 20), (2120, 1, [float("nan")] * 20), (2140, 1, [float("inf")] * 20), (2160, 9, [-x for x in v])]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, label int, embedding array<float>, anchor int, i int").repartition(3)
    want = plain(rows, every=20)
    assert got(H.hard_negatives(docs, F.col("vec_id") % 20 == 0)) == want and len(want) > 300
    assert got(H.hard_negatives(docs, F.col("vec_id") % 20 == 0, positives=3, negatives=9, low=50, high=90, tile=64)) == plain(rows, 20, 3, 9, 50, 90)


def test_empty_and_without_anchors(spark):
    docs = spark.createDataFrame([(7, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert got(H.hard_negatives(docs, F.col("vec_id") == 0)) == [] == got(H.hard_negatives(docs.limit(0), F.col("vec_id") == 0)) == got(H.hard_negatives(docs, F.col("vec_id") == 7))


def test_large_components_stay_exact(spark):
    rows = [(k, k % 2, [float(2**22 + 3 * k + 1), float(2**21 - k), 5.0 * k]) for k in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = plain(rows, every=10)
    assert got(H.hard_negatives(docs, F.col("vec_id") % 10 == 0)) == want and max(r[4] for r in want) > 2**53


def test_threshold_join_finds_all_and_omits_dimensions():
    rng = np.random.default_rng(3)
    scale = 0.7 ** np.arange(40)
    a, x = (np.floor(900 * rng.normal(size=(n, 40)) * scale) for n in (30, 2500))
    x[::3] = np.floor(x[::3] / 50)
    whole = a @ x.T
    for share in (0.999, 0.97, 0.5):
        least = np.quantile(whole, share, axis=1)
        p, q, s = H.threshold_join(a, x, least)
        want = {(i, j) for i, j in zip(*np.nonzero(whole >= least[:, None]))}
        assert set(zip(p.tolist(), q.tolist())) == want and (s == whole[p, q]).all()


def test_query_matches_all_pairs_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows)
    assert got(H.op13_hard_negatives(spark, sf)) == want and want
