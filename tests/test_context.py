"""Ranked types: sums that are equal, and what the registered query says of users with one type."""

import pytest

from factloom import catalog
from factloom.operators import context

def test_equal_sums_go_by_name_in_any_order(spark):
    low, high = sorted([[0.1, 0.2, 0.3], [0.3, 0.2, 0.1]], key=lambda v: (v[0] + v[1]) + v[2])
    assert (low[0] + low[1]) + low[2] < (high[0] + high[1]) + high[2]
    for k in range(1, 40):  # somewhere the saturated doubles differ, too
        rows = [(1, "a", x * k) for x in low] + [(1, "b", x * k) for x in high]
        r = context.rank_types(spark.createDataFrame(rows, "user long, kind string, w double").coalesce(1), ["user"], "kind", "w").first()
        assert (r.best, r.alternatives, r.status) == ("a", ["b"], "ambiguous-scored")


@pytest.mark.parametrize("value, score", [(float("nan"), "nan"), (float("inf"), 1.0), (1e300, 1.0), (None, 0.0), (-1.0, 0.0)])
def test_odd_evidence_counts_as_before(spark, value, score):
    r = context.rank_types(spark.createDataFrame([(1, "a", value)], "user long, kind string, w double"), ["user"], "kind", "w").first()
    assert str(r.score) == "nan" if score == "nan" else r.score == score


def test_top_types_without_alternatives(spark, tmp_path):
    rows = [(k, u, kind, v) for k, (u, kind, v) in enumerate([(1, "view", 20.0), (2, "view", 10.0), (2, "click", 10.0), (None, "view", 5.0), (None, "click", 7.0)])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(f"select user_id, best, alternatives, status from ({catalog.ORACLES['top_types']})").fetchall()}
    got = {r.user_id: (r.best, r.alternatives, r.status) for r in catalog.QUERIES["top_types"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == ("view", None, "semantic-scored")
