"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from factloom.llm.embedding_dedup import near_duplicates, passes_for
from factloom.llm.simhash_dedup import _forest


def plain(rows, threshold=0.93):
    ok = [(i, l, np.array(v, float)) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {k: set() for k in range(len(ok))}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, l, v) in enumerate(ok):
        for b in range(a):
            j, m, w = ok[b]
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[a].add(b)
                links[b].add(a)
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(links[k]), find(i)) for k, (i, _, _) in enumerate(ok)}


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    dense = rng.normal(size=16) + 0.15 * rng.normal(size=(150, 16))  # more than a window
    near = base[:60] + 0.2 * rng.normal(size=(60, 16))
    vecs = [v.astype(np.float32).tolist() for v in np.concatenate((base, near, dense, base[:5], 3 * base[5:8]))]
    rows = [(1000 - k, int(k % 2) if k < 300 else int(k % 2), v) for k, v in enumerate(vecs)]
    rows += [(2001, None, vecs[0]), (2002, 1, None), (2003, 1, [0.0] * 16), (2004, 1, [float("nan")] * 16), (2005, 1, [None, 1.0]), (2006, 1, []), (2007, 1, [1.0, 2.0]), (2008, 1, [2.0, 4.0]), (2009, 1, [1e30, 0.0]), (2010, 1, [1e-30, 0.0]), (2011, 1, [float("inf"), 1.0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, 1, vecs[0], 1)], "vec_id long, label int, embedding array<float>, n_links int").repartition(3)
    want = plain(rows)
    got = near_duplicates(docs, window=16, tile=8).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, r.vec_id is not None and r.vec_id == c), r
    assert max(n for n, _ in want.values()) > 60


def test_copies_and_repeated_rows(spark):
    docs = spark.createDataFrame([(5, 1, [1.0, 0.0])] * 2 + [(9, 1, [1.0, 0.0]), (7, 1, [-0.0, 1.0]), (8, 1, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 1, 7, True), (8, 1, 7, False), (9, 2, 5, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


def clustered(n, dims=64, seed=1):
    """Vectors around a few centres, mean cosine over 0.5, with pairs at and around the threshold and a dense group of near copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    vecs = 1.1 * centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dims))
    k = n // 20
    vecs[:k] = vecs[k : 2 * k] + rng.uniform(0.3, 0.65, (k, 1)) * rng.normal(size=(k, dims))
    dense = n // 8
    vecs[-dense:] = vecs[-1] + 0.3 * rng.normal(size=(dense, dims))
    return vecs.astype(np.float32)


def brute(vecs, threshold=0.93):
    """(links of each, smallest vector reachable of each)."""
    v = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    links, root = np.zeros(len(v), int), np.arange(len(v))
    pairs = []
    for a in range(0, len(v), 1000):
        p, q = np.nonzero(v[a : a + 1000] @ v.T >= threshold)
        p = p + a
        links += np.bincount(p[p != q], minlength=len(v))
        pairs.append((p[q < p], q[q < p]))
    return links, _forest(iter(pairs), len(v))


def test_recall_on_clustered_vectors(spark, tmp_path):
    vecs = clustered(12_000)
    links, root = brute(vecs)
    pq.write_table(pa.table({"vec_id": np.arange(len(vecs)), "label": np.zeros(len(vecs), np.int32), "embedding": pa.array(list(vecs))}), tmp_path / "vectors.parquet")
    df = spark.read.parquet(str(tmp_path)).repartition(8)
    got = {r.vec_id: r for r in near_duplicates(df, window=256).collect()}
    found = np.array([got[k].n_links for k in range(len(vecs))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and links.sum() > 500_000
    # Links outside of the dense group, and components.
    outside = np.arange(len(vecs)) < len(vecs) - len(vecs) // 8
    assert found[outside].sum() >= 0.99 * links[outside].sum() > 500
    assert np.mean([got[k].component_id == root[k] for k in range(len(vecs))]) >= 0.999


def test_rounded_comparison_loses_nothing(spark):
    """Pairs within a rounding error of the threshold are judged in double precision."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    y = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = 0.93 + rng.uniform(-3e-6, 3e-6, (400, 1))
    z = c * x + np.sqrt(1 - c * c) * y
    rows = [(k, k % 400, v.tolist()) for k, v in enumerate(np.concatenate((x, z)))]
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == want and 100 < sum(n for n, _ in got.values()) < 700


def test_only_repeated_ids(spark):
    docs = spark.createDataFrame([(5, 1, [1.0, 0.0])] * 2, "vec_id long, label int, embedding array<double>")
    assert [(r.n_links, r.component_id, r.kept) for r in near_duplicates(docs).collect()] == [(1, 5, True)] * 2


def test_passes_grow_slowly():
    assert passes_for(10) == 1 < passes_for(10_000) < passes_for(100_000_000) < 200


def test_no_link_is_lost_at_partition_ends(spark):
    """Labels no larger than a window are compared whole, wherever partitions end."""
    rng = np.random.default_rng(4)
    rows = []
    for label in range(6):
        centres = rng.normal(size=(40, 12))
        rows += [(1000 * label + k, label, (centres[k % 40] + 0.22 * rng.normal(size=12)).tolist()) for k in range(300)]
        rows += [(1000 * label + 500 + k, label, rows[-1][2]) for k in range(5)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    for window, per_part in ((310, 170), (40, 1), (2048, 170)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, window=window, rows_per_part=per_part).collect()}
        lost = sum(n for n, _ in want.values()) - sum(n for n, _ in got.values())
        assert got == want if window >= 305 else lost <= 0.01 * sum(n for n, _ in want.values()), (window, lost)
    assert sum(n for n, _ in want.values()) > 5000


def test_windows_reach_over_many_small_partitions(spark):
    """Partitions smaller than a window lie between two ends; every window is whole."""
    from factloom.llm import embedding_dedup as E

    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, 0, x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    good = E._hashed(df).select("vec_id", "label", "embedding", "h1", "h2")
    pairs = lambda parts, window: {tuple(sorted((r.u, r.v))) for r in E._window_edges(good, range(1), 0.7, window, 11, parts).where("sure").collect()}

    def joined(edges):
        return _forest(iter([(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))]), 900).tolist()

    for window in (30, 200, 2000):
        assert joined(pairs(1, window)) == joined(pairs(23, window)) == joined(pairs(300, window))
