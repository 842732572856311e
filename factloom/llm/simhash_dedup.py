"""SimHash near-duplicates by tiled exact comparison (operator 3).

Fingerprints are exact 64-bit majority votes over XXH64 hashes of word shingles.
Distinct fingerprints are sorted by their population counts (whole, then by 16-bit
quarter), cut into tiles, and tiles are compared pairwise with numpy exclusive-or
and bit counts. Two fingerprints differ in at least |popcount(a) - popcount(b)|
bits, and in at least the sum of that over their quarters, so tile pairs (and blocks
inside a pair) whose population counts are further apart than the radius are never
compared; nothing else is skipped, so no link is lost.

Shuffled data are fingerprints (8 bytes) and forest edges; texts never move. A group
of copies collapses to one fingerprint by a pre-aggregated minimum before any
comparison, and a tile pair returns at most one edge a fingerprint (a spanning
forest), never all pairs of a group.

Work grows with the square of the number of *distinct* fingerprints, divided by what
the population counts rule out; the README has figures.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, free_name, read_table

#: Fingerprints to a tile; two tiles are in memory at once (8 bytes each).
TILE = 16384
#: Fingerprints to a block inside a tile, the unit of one numpy comparison.
BLOCK = 256
#: Tasks that tile pairs are dealt over at most.
MOST_TASKS = 20_000
#: A fingerprint is hot if it has over one in so many of the rows; so there are fewer hot ones than this.
HOT_SHARE = 1000

_GAPS = re.compile(rb"[\x20\x09-\x0d]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, chunk: int = 1 << 15) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no word (or is null).

    Only A-Z are lower-cased. Words are runs outside space and U+0009 to U+000D;
    shingles are ``shingle`` words joined by one space, repeats included; with fewer
    words the whole sequence is the one shingle. Bit k is 1 if it is set in over half
    of the hashes. Long texts are counted ``chunk`` shingles at a time.
    """
    if not text:
        return 0
    # In UTF-8 no byte of a multi-byte character is below 128, so bytes can be split and lower-cased.
    flat = _GAPS.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(flat)]))
    k = min(shingle, len(starts))
    starts, ends = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, chunk):
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk])), np.uint64, min(chunk, n - at))
        counts += _bit_counts(h)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest bit first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): a hash of every row's text, and the signed 64-bit form of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view(np.int64))], names=["doc_id", "mark", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row a fingerprint."""
    return np.bitwise_count(x.astype("<u8").view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _block_bounds(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    q, at = _quarters(x), np.arange(0, len(x), block)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int, block: int = BLOCK, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in x, j in y) at ``radius`` differing bits or fewer, block by block; ``same``: x is y, and only i < j."""
    if not len(x) or not len(y):
        return
    (xl, xh), (yl, yh) = _block_bounds(x, block), _block_bounds(y, block)
    for i in range(len(xl)):
        apart = np.maximum(0, np.maximum(yl - xh[i], xl[i] - yh)).sum(1)
        a = x[i * block : (i + 1) * block]
        for j in np.flatnonzero(apart <= radius):
            if same and j < i:
                continue
            b = y[j * block : (j + 1) * block]
            p, q = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            p, q = p + i * block, q + j * block
            if same:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield p, q


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs; memory is n, however many pairs there are."""
    root = np.arange(n)
    for p, q in pairs:
        while True:
            a, b = root[p], root[q]
            differ = a != b
            if not differ.any():
                break
            p, q, a, b = p[differ], q[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := root[root], root):
                root = nxt
    return root


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints of a partition to packed tiles with the bounds of their population counts: of the whole, then by quarter."""
    from pyspark import TaskContext

    part, k, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

    def tile(x: np.ndarray) -> pa.RecordBatch:
        pops, quarters = np.bitwise_count(x.view(np.uint64)), _quarters(x.view(np.uint64))
        bounds = [pa.array([[int(getattr(pops, f)()), *getattr(quarters, f)(0).tolist()]], pa.list_(pa.int32())) for f in ("min", "max")]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), *bounds, pa.array([x.tobytes()], pa.binary())], names=["part", "k", "low", "high", "packed"])

    for b in batches:
        held = np.concatenate((held, b.column(0).to_numpy(zero_copy_only=False)))
        while len(held) >= size:
            yield tile(held[:size])
            held, k = held[size:], k + 1
    if len(held):
        yield tile(held)


def link_fingerprints(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Forest edges (u, v) between distinct signed fingerprints ``fp`` at ``radius`` bits or fewer.

    Tiles are numbered in sorted order, so those that a tile can link with are a stretch
    of numbers: from its own to the last whose least population count is within the
    radius. Each tile writes out its own stretch; no two tiles ever meet on a
    population count, of which there are only 65. Pairs whose quarters are apart go,
    the rest are dealt one by one over the tasks. Edges of a tile pair span exactly
    the components that its close pairs form.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    order = [F.bit_count("fp"), *quarter, F.col("fp")]
    made = cut(
        distinct.select("fp", *(o.alias(f"o{k}") for k, o in enumerate(order[:-1])))
        .repartitionByRange(*(f"o{k}" for k in range(len(order) - 1)), "fp")
        .sortWithinPartitions(*(f"o{k}" for k in range(len(order) - 1)), "fp")
        .select("fp")
        .mapInArrow(lambda it: _tiles(it, tile), "part int, k int, low array<int>, high array<int>, packed binary")
    )
    # How many tiles each partition holds by the population count that they start at: 65 numbers a partition at most.
    held = made.groupBy("part", F.col("low")[0].alias("level")).agg(F.count("*").alias("count"), F.sum(F.octet_length("packed") / 8).alias("n")).collect()
    if not held:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    starts, sizes = [0] * 66, {}
    for r in held:
        starts[r.level + 1] += r["count"]
        sizes[r.part] = sizes.get(r.part, 0) + r["count"]
    reach = [sum(starts[: min(64, level + radius) + 2]) - 1 for level in range(65)]
    total, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    # One row a partition.
    before = F.broadcast(distinct.sparkSession.createDataFrame(offsets, "part int, before long"))
    tiles = made.join(before, "part").select((F.col("before") + F.col("k")).alias("tile"), "low", "high", "packed")
    last = F.element_at(F.array(*map(F.lit, reach)), F.col("high")[0] + 1)
    bounds = tiles.select("tile", "low", "high")
    apart = sum((F.greatest(F.lit(0), F.col("b.low")[q] - F.col("a.high")[q], F.col("a.low")[q] - F.col("b.high")[q]) for q in range(1, 5)), F.lit(0))
    pairs = (
        bounds.select(F.col("tile").alias("s"), F.explode(F.sequence("tile", last.cast("long"))).alias("t"), "low", "high").alias("a")
        .join(bounds.alias("b"), F.col("t") == F.col("b.tile"))
        .where(apart <= radius)
        .select("s", "t")
    )
    # Tasks by the comparisons that there are, as many as half a pair of full tiles has to each: well under a second.
    tasks = min(math.ceil((sum(r.n for r in held) / tile) ** 2), MOST_TASKS)
    both = pairs.join(tiles.select(F.col("tile").alias("s"), F.col("packed").alias("x")), "s").join(tiles.select(F.col("tile").alias("t"), F.col("packed").alias("y")), "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = np.frombuffer(b.column("x")[k].as_py(), np.uint64)
                if b.column("s")[k].as_py() == b.column("t")[k].as_py():
                    nodes, found = x, close_pairs(x, x, radius, same=True)
                else:
                    y = np.frombuffer(b.column("y")[k].as_py(), np.uint64)
                    nodes, found = np.concatenate((x, y)), ((p, q + len(x)) for p, q in close_pairs(x, y, radius))
                root = _forest(found, len(nodes))
                hung = np.flatnonzero(root != np.arange(len(root)))
                if len(hung):
                    signed = nodes.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signed[hung]), pa.array(signed[root[hung]])], names=["u", "v"])

    # Dealt one by one: those of a tile go to tasks in turn, and adaptive execution doesn't put small but long comparisons together again.
    return both.repartitionById(tasks, F.pmod(F.col("s") * 7919 + F.col("t"), F.lit(tasks)).cast("int")).select("s", "t", "x", "y").mapInArrow(compare, "u long, v long").distinct()


def _judged(docs: DataFrame, radius: int, shingle: int, seed: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, mark, fp) of every row, (fp, held, first): each fingerprint's rows and the first row of its group).

    mark is a hash of the text; rows are in order of (null doc_id last, doc_id, mark).
    """
    own = cut(fingerprints(docs, shingle, seed))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = cut(own.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("held")))
    found = connected_components(link_fingerprints(classes.select("fp"), radius, tile))
    # Written before its join back, so that both sides are plain shuffles and a large group can be split.
    hung = cut(found.join(classes.select(F.col("fp").alias("node"), "first"), "node"))
    firsts = cut(hung.groupBy("component").agg(F.min("first").alias("group_first")))
    linked = hung.join(firsts, "component").select(F.col("node").alias("fp"), "group_first")
    return own, classes.join(linked, "fp", "left").select("fp", "held", F.coalesce("group_first", "first").alias("first"))


def _named_rows(own: DataFrame, named: DataFrame) -> DataFrame:
    """Every row of ``own`` with the first row of its fingerprint's group.

    Rows of hot fingerprints, of which there are fewer than ``HOT_SHARE`` whatever the
    input, meet a broadcast of these; the rest are shuffled, no more than one in
    ``HOT_SHARE`` of all rows to one key.
    """
    named, least = cut(named), own.count() / HOT_SHARE
    hot = F.broadcast(named.where(F.col("held") > least).select("fp", "first"))
    return own.join(hot, "fp").unionByName(own.join(hot.select("fp"), "fp", "left_anti").join(named.where(F.col("held") <= least).select("fp", "first"), "fp"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; other columns are ignored.

    component_id is the smallest doc_id reachable over links of at most ``radius``
    differing bits. Null, empty and wordless texts have fingerprint zero and link
    like any other. Rows with a null doc_id keep their fingerprint and join their
    component, and don't name it (null if it holds no other row). Repeated rows stay.
    An empty table gives an empty result.
    """
    own, named = _judged(docs, radius, shingle, seed, tile)
    return _named_rows(own, named).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group: that of the smallest doc_id (null last), then of the smallest text hash.

    Rows are told apart by doc_id and text, so another text under a repeated doc_id is
    judged by itself; of rows equal in both one stays. All columns stay, whatever their
    names. Null and empty texts are one group. An empty table gives an empty result.
    """
    own, named = _judged(docs, radius, shingle, seed)
    stays = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").eqNullSafe(F.col("first"))
    judged = cut(_named_rows(own, named).groupBy("doc_id", "mark").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("times")).where("not stays or times > 1"))
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text")).alias("d")

    def of(rows: DataFrame, kind: str) -> DataFrame:
        return marked.join(rows.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{mark}") == F.col("g.mark")), kind)

    once = of(judged, "left_anti")
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        once = once.unionByName(of(repeated, "left_semi").dropDuplicates(["doc_id", mark]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint and near-duplicate group at radius 4."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
