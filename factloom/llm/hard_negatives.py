"""Hard-negative mining by threshold joins in the manner of L2AP (operator 13).

Anchors meet all rows in squares of tiles: a square holds at most ``TILE`` anchors and
``TILE`` rows, so a row travels once for each ``TILE`` anchors, and an anchor once for each tile of rows.
Inside a square, a threshold join finds the pairs whose inner product reaches a
threshold for the anchor:

- dimensions stand in one order, in stretches, with the norms of what is left of each
  vector from each stretch on;
- the inverted index holds, for each stretch, the rows that need it: once the rest of a row
  can't reach the least threshold by itself (the product of the remaining norms), that rest
  isn't indexed;
- partial scores are accumulated stretch by stretch, and rows are dropped once no
  anchor can reach its threshold with what remains;
- pairs that may still reach it are verified with the dimensions that weren't indexed.

Thresholds are lowered, for the anchors that need it, until their windows are full or can't
be filled: first for the positives of an anchor (no end but the last row), then for the
negatives of each positive (down to the window's end). What a square finds is its own best
few for each window; the best of these are the result. All sums are of
integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cut, read_table

#: Rows of a tile at most and, where there are more partitions to fill, at least.
TILE, LEAST_TILE = 16_384, 4_096
#: Dimensions of a stretch, and rows that are compared at once.
STRETCH, BLOCK = 8, 1_024
#: Thresholds for positives, as shares of the anchor's norm times the median norm of rows; then none.
LEVELS = (0.7, 0.4, 0.2)
#: Thresholds for negatives, as shares of the way from the least positive down to its window's end.
STEPS = (0.0, 0.5, 1.0)
#: Floating norms may be this much too low.
_SLACK = 1 + 1e-9


def _stretches(dims: int) -> list[slice]:
    return [slice(k, min(k + STRETCH, dims)) for k in range(0, dims, STRETCH)]


def _rest_norms(v: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from each stretch on; the last column is zero."""
    parts = np.stack([(v[:, s] ** 2).sum(1) for s in _stretches(v.shape[1])], 1) if v.shape[1] else np.zeros((len(v), 0))
    return np.concatenate((np.sqrt(np.cumsum(parts[:, ::-1], 1)[:, ::-1]) * _SLACK, np.zeros((len(v), 1))), 1)


def threshold_join(a: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with an inner product of ``least`` (by anchor) or more.

    ``a`` and ``x`` hold integers as doubles, dimensions in an order that puts the largest first;
    the product of their norms must be under 2^53, so that every sum is exact.
    """
    out = []
    pieces, an = _stretches(a.shape[1]), _rest_norms(a)
    lowest = least.min(initial=np.inf)
    for lo in range(0, len(x), BLOCK):
        block = x[lo : lo + BLOCK]
        xn = _rest_norms(block)
        # The first stretch from which on a row's rest can't reach any threshold; it isn't indexed from there.
        ends = (xn * an.max(0, initial=0.0) >= lowest).sum(1) if lowest > 0 else np.full(len(block), len(pieces))
        alive = np.flatnonzero((ends > 0) | (lowest <= 0))
        score = np.zeros((len(a), len(block)))
        for k, s in enumerate(pieces):
            listed = alive[ends[alive] > k]
            if not len(listed):
                break
            score[:, listed] += a[:, s] @ block[listed, s].T
            if np.isfinite(lowest) and k + 1 < len(pieces):
                hopeless = ~((score[:, listed] + an[:, k + 1, None] * xn[listed, k + 1]) >= least[:, None]).any(0)
                if hopeless.any():
                    alive = np.setdiff1d(alive, listed[hopeless], assume_unique=True)
        at = np.minimum(ends[alive], len(pieces))
        p, q = np.nonzero(score[:, alive] + an[:, at] * xn[alive, at] >= least[:, None])
        q = alive[q]
        got = score[p, q]
        # What wasn't indexed is added for the pairs that are left.
        for k in np.unique(ends[q[ends[q] < len(pieces)]]).tolist():
            own = np.flatnonzero(ends[q] == k)
            for part in np.array_split(own, len(own) // 65_536 + 1):
                got[part] += np.einsum("ij,ij->i", a[p[part], k * STRETCH :], block[q[part], k * STRETCH :])
        ok = got >= least[p]
        out.append((p[ok], q[ok] + lo, got[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out))


def _exact(a: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``threshold_join`` for integers of any size, all pairs in Python's integers."""
    score = a.astype(object) @ x.T.astype(object)
    p, q = np.nonzero((score >= least[:, None]).astype(bool))
    return p, q, score[p, q].astype(np.int64)


class Block:
    """Vectors of one length; their dimensions in the order of the rows' energy."""

    def __init__(self, a: np.ndarray, x: np.ndarray):
        order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        norms = [np.sqrt((v.astype(np.float64) ** 2).sum(1)) for v in (a, x)]
        self.norms = norms
        self.small = norms[0].max(initial=0.0) * norms[1].max(initial=0.0) < 2**52
        self.a, self.x = (v[:, order].astype(np.float64) for v in (a, x)) if self.small else (a, x)

    def reaching(self, own: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in own, row, score) of anchors ``own`` with ``rows``."""
        p, q, score = (threshold_join if self.small else _exact)(self.a[own], self.x[rows], least)
        return p, rows[q], score.astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(group)]))))
    return order[place < k]


def _arrays(t: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``t``, ids, labels, vectors) of the rows whose vectors have ``dims`` parts."""
    vectors = t["vector"].combine_chunks()
    at = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == dims)
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, t["vec_id"].to_numpy()[at], t["label"].to_numpy()[at], flat.reshape(len(at), dims)


def _dims(*tables: pa.Table) -> list[int]:
    """Lengths that vectors of all tables have."""
    return sorted(set.intersection(*(set(t["vector"].combine_chunks().value_lengths().to_pylist()) for t in tables)))


def best_positives(a_id: np.ndarray, a_label: np.ndarray, x_id: np.ndarray, x_label: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of each anchor's first ``k`` other rows of its label, among the rows given."""
    found = []
    for label in np.unique(a_label):
        rows, open_ = np.flatnonzero(x_label == label), np.flatnonzero(a_label == label)
        typical = np.median(block.norms[1][rows]) if len(rows) else 0.0
        for level in (*(LEVELS if block.small else ()), None):
            if not len(open_) or not len(rows):
                break
            least = np.full(len(open_), -np.inf) if level is None else np.floor(level * typical * block.norms[0][open_])
            p, q, score = block.reaching(open_, rows, least)
            other = a_id[open_[p]] != x_id[q]
            p, q, score = p[other], q[other], score[other]
            full = np.bincount(p, minlength=len(open_)) >= (0 if level is None else k)
            done = full[p]
            p, q, score = open_[p[done]], q[done], score[done]
            top = _first(p, score, x_id[q], k)
            found.append((p[top], q[top], score[top]))
            open_ = open_[~full]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*found))


def best_negatives(a_label: np.ndarray, positives: list[list[int]], x_id: np.ndarray, x_label: np.ndarray, block: Block, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place of the positive, row, score): the first ``k`` rows of another label in each positive's window, among the rows given."""
    found = []
    width = max(map(len, positives), default=0)
    p_score = np.array([p + [-1] * (width - len(p)) for p in positives], np.int64).reshape(len(positives), width)
    # A negative positive score has an empty window: 0.8 of it is more than itself.
    window = p_score >= 0 if low <= high else np.zeros_like(p_score, bool)
    near = np.where(window, p_score, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
    live = np.flatnonzero(window.any(1))
    for label in np.unique(a_label[live]):
        rows, open_ = np.flatnonzero(x_label != label), live[a_label[live] == label]
        for step in STEPS:
            if not len(open_) or not len(rows):
                break
            edge, end = near[open_] * (high / 100), near[open_] * (low / 100)
            # Doubles can't hold the edges of very large scores: all pairs are looked at then.
            least = np.floor(edge - step * (edge - end)) - (step == STEPS[-1]) if block.small else np.full(len(open_), -np.inf)
            p, q, score = block.reaching(open_, rows, least)
            hundred = 100 * (score if block.small else score.astype(object))
            full, kept = np.ones(len(open_), bool), []
            for j in range(width):
                of = p_score[open_[p], j] if block.small else p_score[open_[p], j].astype(object)
                inside = np.flatnonzero((window[open_[p], j] & (low * of <= hundred) & (hundred <= high * of)).astype(bool))
                full &= (np.bincount(p[inside], minlength=len(open_)) >= k) | ~window[open_, j]
                kept.append(inside)
            full |= step == STEPS[-1]
            for j, inside in enumerate(kept):
                inside = inside[full[p[inside]]]
                own = open_[p[inside]]
                top = _first(own, score[inside], x_id[q[inside]], k)
                found.append((own[top], np.full(len(top), j), q[inside][top], score[inside][top]))
            open_ = open_[~full]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(z) for z in zip(*found))


def _squares(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, tile: int, parts: int):
    """Both sides, grouped by square."""
    across = -(-n_anchors // tile)
    down = max(-(-n_rows // tile), min(parts, -(-n_rows // min(tile, LEAST_TILE))))
    deal = lambda df, n, c: df.withColumn(c, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    left = deal(anchors, across, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = deal(rows, down, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of (vec_id, label, embedding) where ``is_anchor`` holds.

    A component x counts as floor(scale * x). An anchor's positives are its first ``positives`` other rows
    of its label; each has the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Rows with a null id or label, a null vector, or a null or non-finite component take no part, and rows
    whose vectors differ in length don't meet. Repeated rows are rows of their own, but a repeated
    anchor asks once, and rows with the anchor's vec_id are not its positives. Scores
    must fit a long. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    marked = vectors.where(ok).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = marked.select("vec_id", "label", "vector")
    anchors = cut(marked.where("asks").select("vec_id", "label", "vector").distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "vector")))
    n_rows, n_anchors = rows.count(), anchors.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = "anchor anchor_id place positive_id positive_score negative_id negative_score".split()

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.schema([("anchor", pa.int64()), ("positive_id", right.schema.field("vec_id").type), ("positive_score", pa.int64())]).empty_table()]
        for dims in _dims(left, right):
            (at, a_id, a_label, a), (_, x_id, x_label, x) = _arrays(left, dims), _arrays(right, dims)
            p, q, score = best_positives(a_id, a_label, x_id, x_label, Block(a, x), positives)
            out.append(pa.table([left["anchor"].take(pa.array(at[p])), pa.array(x_id[q], out[0].schema.field(1).type), pa.array(score)], schema=out[0].schema))
        return pa.concat_tables(out)

    def mine(left: pa.Table, right: pa.Table) -> pa.Table:
        id_type = right.schema.field("vec_id").type
        out = [pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("negative_id", id_type), ("negative_score", pa.int64())]).empty_table()]
        for dims in _dims(left, right):
            (at, _, a_label, a), (_, x_id, x_label, x) = _arrays(left, dims), _arrays(right, dims)
            own = [[r["score"] for r in cell] for cell in left["positives"].take(pa.array(at)).to_pylist()]
            p, place, q, score = best_negatives(a_label, own, x_id, x_label, Block(a, x), negatives, low, high)
            out.append(pa.table([left["anchor"].take(pa.array(at[p])), pa.array(place, pa.int32()), pa.array(x_id[q], id_type), pa.array(score)], schema=out[0].schema))
        return pa.concat_tables(out)

    if not n_anchors:
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    near = _squares(anchors, rows, n_anchors, n_rows, tile, parts).applyInArrow(find, f"anchor long, positive_id {kind}, positive_score long")
    # At most ``positives`` a square and anchor come together here.
    best = near.groupBy("anchor").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("positive_score")).alias("less"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))), 1, positives).alias("positives"))
    asked = cut(anchors.join(best, "anchor").withColumnRenamed("vec_id", "anchor_id"))
    mined = _squares(asked.select(F.col("anchor_id").alias("vec_id"), "label", "vector", "anchor", "positives"), rows, n_anchors, n_rows, tile, parts).applyInArrow(mine, f"anchor long, place int, negative_id {kind}, negative_score long")
    each = asked.select("anchor", "anchor_id", F.posexplode("positives").alias("place", "positive"))
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = ranked.join(each, ["anchor", "place"])
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", "negative_id", F.col("positive.score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of ``embeddings``, after some labels have been changed."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP13_SQL = """
with q as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from q a join q b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
pos as (
    select anchor_id, other_id as positive_id, score as positive_score
    from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
neg as (
    select p.anchor_id, p.positive_id, p.positive_score, n.other_id as negative_id, n.score as negative_score,
           row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) as rank
    from pos p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from neg where rank <= 5
"""
