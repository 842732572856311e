"""Quality classifier: parts against plain versions, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from factloom.llm.quality import fit, isotonic, keep_quality, score_documents, statistics


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    ones, total = rng.integers(0, 5, 40).astype(float), np.full(40, 5.0)
    _, means = isotonic(np.arange(40.0), total, ones)
    assert np.all(np.diff(means) > -1e-9)
    # Max-min formula of isotonic regression.
    y = ones / total
    plain = [max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    blocks = np.unique(np.round(plain, 12))
    assert len(blocks) == len(means)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "*** |", "x" * 200_000, "é ñ 中文 😀"])
def test_statistics_are_finite(text):
    s = statistics(text)
    assert s.shape == (18,) and np.isfinite(s).all()


def test_held_out_accuracy_and_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit(docs, labels)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-2, "")], "doc_id long, text string"))
    got = score_documents(odd.withColumn("score", odd.doc_id), model).collect()
    assert len(got) == docs.count() + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.93
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got if r.doc_id is not None and r.doc_id >= 0)
    # Labels of held-out rows change nothing.
    from factloom.llm.quality import held_out

    import pyspark.sql.functions as F

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(fit(docs, flipped).weights, model.weights)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert {r.score for r in score_documents(docs, model).collect()} == {0.5}
    assert score_documents(docs.limit(0), model).count() == 0


def test_weights_equal_plain_normal_equations(spark):
    """Partition sums against one matrix of all training rows; calibration's rows are not among them."""
    import pyspark.sql.functions as F

    from factloom.llm.quality import PENALTY, held_out

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit(docs.repartition(7), labels)
    known = labels.where(~held_out(F.col("doc_id"))).join(docs, "doc_id").withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))).where("deal % 5 != 0").collect()
    stats, y = np.stack([statistics(r.text) for r in known]), np.array([r.quality for r in known], float)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-6))
    z = model.features(stats)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + PENALTY * len(z) * np.eye(z.shape[1]), z.T @ y), atol=1e-6)


def test_empty_table_and_null_texts_are_kept_or_not(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert keep_quality(docs.limit(0), model).count() == 0 and keep_quality(docs, model).count() == 2
