"""Trees of any depth."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import trees


def test_a_deep_chain_is_closed_and_guarded(spark):
    nodes = spark.range(150).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("order"), F.lit(1).alias("world"))
    closure = trees.ancestors(nodes)
    assert closure.count() == 150 * 151 // 2 and closure.agg(F.max("depth")).first()[0] == 149
    with pytest.raises(ValueError):
        trees.move(nodes, 0, 149, 0, "node")


def test_a_cycle_ends(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long")
    assert {(r.node, r.ancestor) for r in trees.ancestors(nodes).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, k) for k in (1, 2, 3, 4)}
