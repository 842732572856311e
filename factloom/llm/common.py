"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; any file system that Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is used only where a local session has none, as in tests; on a
    cluster its machines wouldn't share it, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-scratch")
    return base.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of rows that go to a Python worker at once; whole texts are long, and several batches are in memory.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold ``BATCH_BYTES`` at most, unless it has a limit of its own; a longer row is a batch alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


#: Paths of the tables written since ``settled`` was entered in this thread, innermost last.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def _delete(spark: SparkSession, path: str, on_exit: bool = False) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if on_exit:
        files.deleteOnExit(at)
    else:
        files.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor costs no recomputation.

    The files go when the application ends, or before that by ``drop_cut`` or ``settled``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, on_exit=True)
    for open_ in _MADE.get():
        open_.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_factloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table; every other table that ``make`` wrote on the way is deleted."""
    paths: list[str] = []
    outer = _MADE.set((*_MADE.get(), paths))
    try:
        out = cut(make())
        for path in paths:
            if path != out._factloom_path:
                _delete(spark, path)
    finally:
        _MADE.reset(outer)
    return out


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star contraction until every component is a star,
    O(log^2 n) rounds; the driver gets one number a round. Minima are pre-aggregated, and the
    joins back to a hub's edges are plain equi-joins that adaptive execution can split,
    so a star with millions of leaves doesn't sit in one task. Every round is cut to
    the shared folder. Self-loops and repeated edges are allowed; null ends are ignored.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    for _ in range(max_rounds):
        # Edges point down (u > v). All components are stars if no node has two edges down, or edges both ways.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        crossed = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
        if crossed.isEmpty():
            break
        # Large star: all larger neighbours of x hang on the smallest of x and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: x and its smaller neighbours hang on the smallest of them. Edges point down (u > v).
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(e)
        e = nxt
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
