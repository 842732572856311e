"""Embedding near-duplicates by sorted projection passes (operator 2).

In each pass the vectors of a label are sorted by concatenated random hashes (in which
of a random rotation's directions a projection is largest), and each is compared with a
bounded window of its predecessors, also over the ends of partitions, whose first and last rows
meet in a second small pass; the pairs of all passes are united into components.
The number of passes follows from the number of vectors, so that a pair at the threshold
meets in some window with probability ``RECALL`` if vectors lie evenly. Whether they do
is measured: further passes with fresh hashes follow until a batch of them joins nothing
that was apart.

What is sorted are 16-bit roundings of the vectors, half their size, each with its error;
a pair is linked on the spot where that error can't matter, and is else compared again
in double precision from the table. Vectors that round alike and lie together are one in
a window, so copies don't fill it.

A window can't hold a dense group, so link counts don't come from windows: every link
lies inside a component, and components are compared exactly in double precision, tile by
tile (``TILE`` distinct vectors, packed), each pair once and counted on the spot. Pairs of
vectors are never written out; windows return forest edges only. The number of compared
pairs inside one component grows with the square of its distinct vectors, as its links do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import bounded_batches, connected_components, cut, read_table
from .simhash_dedup import _forest

THRESHOLD = 0.93
#: Predecessors that a vector is compared with in a pass; wanted chance that a pair meets.
WINDOW, RECALL = 2048, 0.999
#: Directions of one hash (a power of two), and hashes to a sort key.
DIRECTIONS, HASHES = 8, 15
#: Passes of a control batch, as a share of those before it.
CONTROL = 0.25
#: Distinct vectors in a tile of the exact comparison.
TILE = 1024
_BITS = 1 + DIRECTIONS.bit_length() - 1


@lru_cache(maxsize=16)
def _agree(threshold: float) -> float:
    """Chance that a hash of two vectors at the threshold agrees, by simulation."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(100_000, DIRECTIONS))
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * rng.normal(size=a.shape)
    return float((_code(a) == _code(b)).mean())


def _code(projected: np.ndarray) -> np.ndarray:
    """The direction in which each row is largest, and its sign."""
    at = np.abs(projected).argmax(-1)
    return 2 * at + (np.take_along_axis(projected, at[..., None], -1)[..., 0] > 0)


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which two of n evenly spread vectors at the threshold have shared a window with probability ``recall``.

    They surely share it if the hashes that part n vectors into cells of half a window agree.
    """
    if n <= window:
        return 1
    agree = _agree(threshold) ** (math.log2(2 * n / window) / _BITS)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for any finite size."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, h1, h2): 128 bits that tell vectors apart; null where a row links with nothing."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    same = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return vectors.select("vec_id", "label", "embedding", F.when(ok, F.xxhash64("label", same)).alias("h1"), F.when(ok, F.xxhash64(F.lit("again"), "label", same)).alias("h2"))


#: Fields of a rounded vector: its error's length and its scale come before the 16-bit parts.
_FIELDS = 8


def _round(v: np.ndarray) -> np.ndarray:
    """Unit rows as bytes: error and scale (32-bit floats), then 16-bit parts."""
    scale = (np.abs(v).max(1, keepdims=True) / 32767).astype(np.float32)
    parts = np.rint(v / scale).astype(np.int16)
    error = np.sqrt(((v - parts * scale.astype(np.float64)) ** 2).sum(1, keepdims=True)).astype(np.float32) * np.float32(1.001)
    return np.concatenate((error.view(np.uint8).reshape(-1, 4), scale.view(np.uint8).reshape(-1, 4), parts.view(np.uint8).reshape(len(v), -1)), 1)


def _window_edges(good: DataFrame, turns: range, threshold: float, window: int, seed: int, parts: int) -> DataFrame:
    """(u, v, sure) from the passes ``turns``: forest edges, and pairs that need a closer look."""

    kind_of = lambda c: good.schema[c].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == d))
                v = _unit(_matrix(own.column("embedding")))
                n, packed = own.num_rows, _packed(_round(v))
                for k in turns:
                    if (k, d) not in planes:
                        planes[k, d] = np.random.default_rng([seed, k, d]).normal(size=(d, HASHES * DIRECTIONS))
                    codes = _code((v @ planes[k, d]).reshape(n, HASHES, DIRECTIONS)).astype(np.int64)
                    key = codes @ (np.int64(1) << (_BITS * np.arange(HASHES - 1, -1, -1, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), own.column("label"), pa.array(np.full(n, d, np.int32)), pa.array(key), own.column("vec_id"), packed], names=["turn", "label", "dim", "key", "vec", "packed"])

    ids = {"u": kind_of("vec_id"), "v": kind_of("vec_id"), "sure": "boolean"}
    row = {"turn": "int", "label": kind_of("label"), "dim": "int", "vec": kind_of("vec_id"), "packed": "binary"}
    place = {"part": "int", "side": "int", "pos": "long"}

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges inside the partition; and its first and last ``window`` distinct rows (sides 0 and 1), or all (side 2) if it has no more."""
        held: pa.Table | None = None
        first: list[pa.Table] = []
        n_first = 0
        for b in batches:
            t = pa.Table.from_batches([b]).select(list(row))
            fresh = held.num_rows if held is not None else 0
            t = pa.concat_tables([held, t]) if held is not None else t
            edges, distinct, seen = compare(t.combine_chunks(), fresh)
            yield from (filled(e, ids) for e in edges)
            if n_first <= window:
                first.append(distinct.slice(seen))
                n_first += distinct.num_rows - seen
            held = distinct.slice(max(0, distinct.num_rows - window))
        if held is None:
            return
        whole = pa.concat_tables(first)
        for side, t in ((2, whole),) if n_first <= window else ((0, whole.slice(0, window)), (1, held)):
            at = {"part": pa.array(np.full(t.num_rows, TaskContext.get().partitionId(), np.int32)), "side": pa.array(np.full(t.num_rows, side, np.int32)), "pos": pa.array(np.arange(t.num_rows))}
            for b in pa.table({**{c: t[c] for c in row}, **at}).to_batches():
                yield filled(b, row | place)

    def over_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of rows that stand on both sides of partitions' ends, end by end."""
        end, held = None, None
        for b in batches:
            for own in np.unique(b.column("end")).tolist():
                t = pa.Table.from_batches([b.filter(pc.equal(b.column("end"), own))]).select(list(row))
                if own != end:
                    end, held = own, None
                fresh = held.num_rows if held is not None else 0
                t = pa.concat_tables([held, t]) if held is not None else t
                edges, distinct, _ = compare(t.combine_chunks(), fresh)
                yield from edges
                held = distinct.slice(max(0, distinct.num_rows - window))

    def filled(b: pa.RecordBatch, given: dict) -> pa.RecordBatch:
        """A batch with nulls for the columns that it doesn't have."""
        return pa.RecordBatch.from_arrays([b.column(c) if c in given else pa.nulls(b.num_rows, nothing[c]) for c in ids | row | place], names=list(ids | row | place))

    def compare(t: pa.Table, seen: int) -> tuple[list[pa.RecordBatch], pa.Table, int]:
        """Edges of the rows from ``seen`` on with the ``window`` distinct rows before each, in their pass and group; the distinct rows, and how many of these are from before ``seen``."""
        out: list[pa.RecordBatch] = []
        group = [t[c].to_numpy(zero_copy_only=False) for c in ("turn", "label", "dim")]
        vec = t["vec"].to_numpy()
        packed = np.array(t["packed"].to_pylist(), object)
        starts = np.concatenate(([True], np.logical_or.reduce([g[1:] != g[:-1] for g in group])))
        again = np.concatenate(([False], packed[1:] == packed[:-1])) & ~starts
        if again.any():
            # Vectors that round alike: one stays, the others hang on it.
            one = np.maximum.accumulate(np.where(again, 0, np.arange(t.num_rows)))
            own = np.flatnonzero(again & (np.arange(t.num_rows) >= seen))
            own = own[vec[own] != vec[one[own]]]
            out.append(pa.RecordBatch.from_arrays([pa.array(vec[own]), pa.array(vec[one[own]]), pa.array(np.ones(len(own), bool))], names=["u", "v", "sure"]))
            stay = np.flatnonzero(~again)
            t, starts, vec, packed, seen = t.take(pa.array(stay)), starts[stay], vec[stay], packed[stay], int(np.searchsorted(stay, seen))
        edges = np.flatnonzero(starts).tolist()
        for a, e in zip(edges, [*edges[1:], t.num_rows]):
            if e <= seen or e - a < 2:
                continue
            raw = np.frombuffer(b"".join(packed[a:e]), np.uint8).reshape(e - a, -1)
            error, scale = (np.ascontiguousarray(raw[:, k : k + 4]).view(np.float32)[:, 0].astype(np.float64) for k in (0, 4))
            v = (np.ascontiguousarray(raw[:, _FIELDS:]).view(np.int16) * scale[:, None]).astype(np.float32)
            worst = 3 * error.max() + 2e-6 * math.sqrt(v.shape[1])  # both errors, their product, and 32-bit sums
            for at in range(max(0, seen - a), e - a, 512):
                end, lo = min(at + 512, e - a), max(0, at - window)
                p, q = np.nonzero((near := v[at:end] @ v[lo:end].T) >= threshold - worst)
                close = near[p, q]
                p, q = p + at - lo, q
                ok = (q < p) & (p - q <= window) & (p + lo + a >= seen)
                p, q, close = p[ok], q[ok], close[ok]
                # The window's sure pairs only matter by what they connect: one edge a row at most.
                sure = close >= threshold + worst
                root = _forest(iter([(q[sure], p[sure])]), end - lo)
                hung = np.flatnonzero(root != np.arange(end - lo))
                open_ = ~sure & (root[p] != root[q])
                u, w = np.concatenate((hung, p[open_])), np.concatenate((root[hung], q[open_]))
                if len(u):
                    out.append(pa.RecordBatch.from_arrays([pa.array(vec[u + lo + a]), pa.array(vec[w + lo + a]), pa.array(np.arange(len(u)) < len(hung))], names=["u", "v", "sure"]))
        return out, t, seen

    kind, label = kind_of("vec_id"), kind_of("label")
    nothing = {f.name: f.type for f in to_arrow_schema(good.limit(0).select(F.lit(1).alias("turn"), "label", F.lit(1).alias("dim"), F.col("vec_id").alias("vec"), F.lit(b"").alias("packed"), F.col("vec_id").alias("u"), F.col("vec_id").alias("v"), F.lit(True).alias("sure"), F.lit(1).alias("part"), F.lit(1).alias("side"), F.lit(1).cast("long").alias("pos")).schema)}
    keyed = good.select("label", "embedding", "vec_id").mapInArrow(keys, f"turn int, label {label}, dim int, key long, vec {kind}, packed binary")
    dealt = keyed.repartitionByRange(parts, "turn", "label", "dim", "key", "packed", "vec").sortWithinPartitions("turn", "label", "dim", "key", "packed", "vec")
    found = cut(dealt.mapInArrow(links, ", ".join(f"{c} {k}" for c, k in (ids | row | place).items())))
    edges, ends = found.where("u is not null").select(*ids), found.where("part is not null").select(*row, *place)
    if parts > 1:
        # Between two partitions of more than a window lies one end; smaller ones between them belong to it with all of their rows.
        known = ends.groupBy("part").agg(F.min("side").alias("side")).select("part", F.coalesce(F.sum(F.when(F.col("side") < 2, 1).otherwise(0)).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        met = ends.join(F.broadcast(known), "part").withColumn("end", F.col("before") + F.when(F.col("side") == 1, 1).otherwise(0))
        across = met.repartition("end").sortWithinPartitions("end", "part", "pos").mapInArrow(over_ends, ", ".join(f"{c} {k}" for c, k in ids.items()))
        edges = edges.unionByName(across)
    return edges.where("u != v").distinct()


def _cosine(x: str, y: str) -> Column:
    """Cosine of two arrays in double precision, in one order of sums as for every pair."""
    def total(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    def scaled(c: str) -> Column:
        most = F.array_max(F.transform(c, lambda z: F.abs(z.cast("double"))))
        return F.transform(c, lambda z: z.cast("double") / most)

    one, two = scaled(x), scaled(y)
    return total(one, two) / F.sqrt(total(one, one) * total(two, two))


def _edges(good: DataFrame, turns: range, threshold: float, window: int, seed: int, rows_per_part: int, n: int) -> DataFrame:
    """Edges (u, v), all true links, of some passes; a written table."""
    found = cut(_window_edges(good, turns, threshold, window, seed, max(1, n * len(turns) // max(rows_per_part, 8 * window))))
    sure, open_ = found.where("sure").select("u", "v"), found.where("not sure").select("u", "v")
    if open_.isEmpty():
        return sure
    ids = open_.select(F.col("u").alias("vec_id")).union(open_.select("v")).distinct()
    asked = good.join(ids, "vec_id", "left_semi").select("vec_id", "label", "embedding")
    x, y = (asked.select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"), F.col("embedding").alias(f"of_{c}")) for c in "uv")
    near = open_.join(x, "u").join(y, "v").where((F.col("label_u") == F.col("label_v")) & (F.size("of_u") == F.size("of_v"))).where(_cosine("of_u", "of_v") >= threshold)
    return cut(sure.unionByName(near.select("u", "v")))


def _components(good: DataFrame, copies: DataFrame, n: int, largest: int, threshold: float, window: int, recall: float, seed: int, rows_per_part: int) -> DataFrame:
    """(node, component), from passes until a batch of them joins nothing that was apart."""
    done = passes_for(largest, threshold, window, recall)
    edges = _edges(good, range(done), threshold, window, seed, rows_per_part, n).unionByName(copies)
    while True:
        found = cut(connected_components(edges))
        if largest <= window:
            return found
        more = max(1, math.ceil(CONTROL * done))
        fresh = _edges(good, range(done, done + more), threshold, window, seed, rows_per_part, n)
        done += more
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        placed = fresh.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")).where("u != v").distinct()
        fresh = cut(placed)
        if fresh.isEmpty():
            return found
        # Components so far are stars; the new edges join their centres.
        edges = cut(found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(fresh))


def _count_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(component, h1, h2, linked): rows of other vectors of its component that each distinct vector links with; every pair is compared once."""
    # Written tables between the steps keep the sides of the joins plain shuffles, so that a large component can be split.
    sizes = cut(members.groupBy("component", "label", "dim").agg(F.count("*").alias("size")))
    dealt = members.join(sizes, ["component", "label", "dim"]).withColumn("tiles", F.ceil(F.col("size") / tile)).withColumn("tile", F.pmod(F.col("h1"), F.col("tiles")))
    keys = ["component", "label", "dim"]
    tiles = cut(dealt.groupBy(*keys, "tile").agg(F.max("tiles").alias("tiles"), F.collect_list(F.struct("h1", "h2", "copies", "embedding")).alias("rows")))
    # Each tile writes out the tiles that it meets; what is joined is (group, tile), so a large component is spread over tasks.
    met = tiles.select(*keys, F.col("tile").alias("own"), F.col("rows").alias("x"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tile"))
    both = met.join(tiles.select(*keys, "tile", F.col("rows").alias("y")), [*keys, "tile"])
    kind = members.schema["component"].dataType.simpleString()

    def unpack(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = cell.values
        return np.stack([rows.field(c).to_numpy() for c in ("h1", "h2")]), rows.field("copies").to_numpy(), _unit(_matrix(rows.field("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                same = b.column("same")[k].as_py()
                ids, copies, v = unpack(b.column("x")[k])
                ids2, copies2, w = (ids, copies, v) if same else unpack(b.column("y")[k])
                close = v @ w.T >= threshold
                if same:
                    np.fill_diagonal(close, False)
                out, n = [ids], [close @ copies2]
                if not same:
                    out, n = [ids, ids2], [*n, copies @ close]
                at = np.concatenate(out, 1)
                component = pa.array([b.column("component")[k].as_py()] * at.shape[1], b.column("component").type)
                yield pa.RecordBatch.from_arrays([component, pa.array(at[0]), pa.array(at[1]), pa.array(np.concatenate(n).astype(np.int64))], names=["component", "h1", "h2", "linked"])

    pairs = both.select((F.col("own") == F.col("tile")).alias("same"), "component", "x", "y")
    return pairs.mapInArrow(run, f"component {kind}, h1 long, h2 long, linked long").groupBy("component", "h1", "h2").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, tile: int = TILE, seed: int = 11, rows_per_part: int = 200_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Only vectors of equal, non-null label (and equal length) link. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do rows
    with a null vec_id (their component_id is null and kept false). Copies link with each
    other; rows that share a vec_id are one node of the graph. Other columns are ignored.
    An empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    hashed = _hashed(vectors)
    rows, good = cut(hashed.select("vec_id", "h1", "h2", "label")), hashed.where("h1 is not null").select("vec_id", "label", "embedding", "h1", "h2")
    by_label = rows.where("h1 is not null").groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    # Equal vectors link whatever the passes find.
    again = cut(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    copies = rows.join(again, ["h1", "h2"]).where("vec_id != first").select(F.col("vec_id").alias("u"), F.col("first").alias("v")).distinct()
    found = _components(good, copies, by_label[1] or 0, by_label[0] or 0, threshold, window, recall, seed, rows_per_part)
    met = good.join(found.withColumnRenamed("node", "vec_id"), "vec_id")
    members = cut(met.groupBy("component", "label", F.size("embedding").alias("dim"), "h1", "h2").agg(F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")))
    linked = members.select("component", "h1", "h2", "copies").join(_count_links(members, threshold, tile), ["component", "h1", "h2"], "left")
    known = cut(linked.select("component", "h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    placed = rows.join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "h1", "h2", F.coalesce("component", "vec_id").alias("component"))
    # Rows that repeat only their own vec_id have links and no component.
    counted = placed.join(known, ["component", "h1", "h2"], "left").join(again.select("h1", "h2", "copies"), ["h1", "h2"], "left")
    return counted.select("vec_id", F.coalesce("n_links", F.col("copies") - 1, F.lit(0)).alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and near-duplicate component at cosine 0.93."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
