"""Commits over several tables: all or nothing, once, and only where something changed."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.streaming import manifest


def store(spark, path, hooks=None):
    return manifest.Store(spark, str(path), {"docs": "doc_id long, text string", "cands": "doc_id long, cand string, version long"}, {"docs": ["doc_id"], "cands": ["doc_id"]}, {"docs": manifest.upsert("doc_id"), "cands": manifest.replace_documents()}, buckets=5, hooks=hooks or {})


def rows(df):
    return sorted(map(tuple, df.collect()))


def docs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, text string")


def cands(spark, *pairs):
    return spark.createDataFrame([(d, c, None) for d, c in pairs], "doc_id long, cand string, version long")


def test_commits_switch_all_tables_at_once(spark, tmp_path):
    s = store(spark, tmp_path)
    assert rows(s.table("docs")) == [] and s.commits() == []
    assert s.commit(0, {"docs": docs(spark, *((k, f"a{k}") for k in range(20))), "cands": cands(spark, (1, "x"), (1, "y"), (2, "z"))})
    before = s.manifest()

    def broken(old, new):
        raise RuntimeError("lost")

    s.merges["cands"] = broken
    with pytest.raises(RuntimeError):
        s.commit(1, {"docs": docs(spark, (3, "b3")), "cands": cands(spark, (1, "w"))})
    # Nothing of the broken commit is seen, in either table.
    assert s.commits() == [0] and rows(s.table("docs"))[3] == (3, "a3") and rows(s.table("cands")) == [(1, "x", 1), (1, "y", 1), (2, "z", 1)]
    s.merges["cands"] = manifest.replace_documents()
    change = {"docs": docs(spark, (3, "b3"), (50, "new")), "cands": cands(spark, (1, "w"), (9, "v"))}
    assert s.commit(1, change) and not s.commit(1, {"docs": docs(spark, (3, "never"))})
    assert dict(rows(s.table("docs")))[3] == "b3" and dict(rows(s.table("docs")))[50] == "new" and len(rows(s.table("docs"))) == 21
    assert rows(s.table("cands")) == [(1, "w", 2), (2, "z", 1), (9, "v", 1)]
    # Only touched buckets have new files; the first commit can still be read.
    after, touched = s.manifest(), {str(r[0]) for r in change["docs"].select(s._bucket("docs")).collect()}
    assert {b for b in after["docs"] if after["docs"][b] != before["docs"].get(b)} == touched and len(touched) < 5
    assert rows(s.table("docs", 0))[3] == (3, "a3")
    assert s.clean(1) > 0 and dict(rows(s.table("docs")))[3] == "b3" and rows(s.table("cands")) == [(1, "w", 2), (2, "z", 1), (9, "v", 1)]


def test_hooks_run_once(spark, tmp_path):
    seen, fails = [], [True]

    def timeline(s, number):
        if fails.pop() if fails else False:
            raise RuntimeError("later")
        seen.append(("timeline", number))

    s = store(spark, tmp_path, {"graph": lambda s, number: seen.append(("graph", number)), "timeline": timeline})
    with pytest.raises(RuntimeError):
        s.commit(4, {"docs": docs(spark, (1, "a"))})
    assert s.commits() == [4] and seen == [("graph", 4)]
    assert not s.commit(4, {"docs": docs(spark, (1, "other"))}) and not s.commit(4, {})
    assert seen == [("graph", 4), ("timeline", 4)] and rows(s.table("docs")) == [(1, "a")]


def test_a_bucket_may_become_empty(spark, tmp_path):
    s = store(spark, tmp_path)
    s.commit(0, {"docs": docs(spark, (1, "a"), (2, "b"))})
    s.merges["docs"] = lambda old, new: old.join(new.select("doc_id"), "doc_id", "left_anti")
    s.commit(1, {"docs": docs(spark, (1, None))})
    assert rows(s.table("docs")) == [(2, "b")]
    s.commit(2, {"docs": docs(spark, (2, None)).limit(0)})
    assert s.commits() == [0, 1, 2] and rows(s.table("docs")) == [(2, "b")]


def test_streamed_batches_are_commits(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(d, f"{k}:{d}") for d in range(k, k + 4)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    s = store(spark, tmp_path / "store")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    split = lambda b: {"docs": b, "cands": b.select("doc_id", F.col("text").alias("cand"), F.lit(None).cast("long").alias("version"))}
    for _ in range(2):  # a second run has nothing new
        manifest.stream_commits(stream, s, str(tmp_path / "c"), split).trigger(availableNow=True).start().awaitTermination(120)
    assert s.commits() == [0, 1, 2]
    assert dict(rows(s.table("docs"))) == {0: "0:0", 1: "1:1", 2: "2:2", 3: "2:3", 4: "2:4", 5: "2:5"}
    assert {(d, v) for d, _, v in rows(s.table("cands"))} == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 2), (5, 1)}
