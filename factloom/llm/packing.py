"""Vector best-fit packing of documents into token sequences (operator 10).

Documents become pieces of at most the sequence length; pieces are packed into bins
under three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Documents and cost default to capacities that bins never exceed
(``length`` and its square), because the fewest sequences are wanted by default; there
the two still steer the choice of a bin, and smaller capacities bind. Of all bins that a piece fits under every constraint, the one with
the least weighted residual norm after placing it wins (or the largest weighted dot
product of piece and residual). Pieces go by decreasing length.

Tokenising is one narrow pass; only 40-byte piece rows are shuffled, dealt evenly by a
hash of their place in that pass (not by document, source or text), so no key can be
hot. A deal of ``GROUP`` pieces is packed in one task; what a deal leaves open is at
most its own last bins, a fraction of a percent at this size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_batches, cut, read_table

LENGTH = 2048
#: Weights of tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.02, 0.05)
#: Pieces packed by one task.
GROUP = 4096


def pack_bins(lengths: np.ndarray, length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins count from 0.

    Bins with equal residuals are kept together, by residual tokens, so a piece meets
    each distinct state once and stops where the token term alone is no better.
    ``by``: norm (least residual norm after placing) or dot (largest dot product).
    """
    max_docs = length if max_docs is None else max_docs
    max_cost = length * length if max_cost is None else max_cost
    wt, wd, wc = weights[0] / length**2, weights[1] / max_docs**2, weights[2] / max_cost**2
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    states: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(length + 1)]
    open_levels, made = 0, 0  # bit r: some bin has r tokens left
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        cost, best, at = n * n, None, None
        if cost > max_cost or n > length:
            raise ValueError("a piece is over a whole sequence's capacity")
        rest, r = open_levels >> n, n
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            token_part = wt * (r - n) ** 2
            if by == "norm" and best is not None and token_part >= best:
                break
            for docs, left in states[r]:
                if docs and left >= cost:
                    score = token_part + wd * (docs - 1) ** 2 + wc * (left - cost) ** 2 if by == "norm" else -(wt * r * n + wd * docs + wc * left * cost)
                    if best is None or score < best:
                        best, at = score, (r, docs, left)
            r, rest = r + 1, rest >> 1
        if at is None:
            number, r, docs, left = made, length, max_docs, max_cost
            made += 1
        else:
            r, docs, left = at
            same = states[r][docs, left]
            number = same.pop()
            if not same:
                del states[r][docs, left]
                if not states[r]:
                    open_levels &= ~(1 << r)
        bins[k], offsets[k] = number, length - r
        r -= n
        if r and docs > 1:
            states[r].setdefault((docs - 1, left - cost), []).append(number)
            open_levels |= 1 << r
    return bins, offsets


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is the ids of its whole text (null: empty), then id 0. Only one longer
    than ``length`` is cut; its first piece takes what is over, the others are full.
    ``row`` is the place in this pass, which tells repeated doc_ids apart.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = tokens.load(path or tokens.default_path()), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, text in enumerate(b.column(1)):
                ids = encoder.packed(text.as_py()) + b"\0\0\0\0"
                n = len(ids) // 4
                at = [0, *range((n - 1) % length + 1, n, length), n]
                for piece, (x, y) in enumerate(zip(at, at[1:])):
                    part = ids[4 * x : 4 * y]
                    for to, value in zip(out, (row, k, piece, x, y - x, zlib.crc32(part), part)):
                        to.append(value)
                row += 1
            arrays = [pa.array(out[0], pa.int64()), b.column(0).take(pa.array(out[1], pa.int32())), pa.array(out[2], pa.int32()), *(pa.array(x, pa.int64()) for x in out[3:6])]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[6], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(cut_pieces: DataFrame, length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm", group: int = GROUP) -> DataFrame:
    """``cut_pieces`` (a written table with row, piece, length) with sequence_id and offset."""
    deals = max(1, -(-cut_pieces.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = pack_bins(pdf["length"].to_numpy(), length, max_docs, max_cost, weights, by)
        out = pdf.drop(columns=["deal"])
        return out.assign(sequence_id=(pdf["deal"].to_numpy(np.int64) << 24) | bins, offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"
    return cut_pieces.withColumn("deal", F.pmod(F.xxhash64("row", "piece"), F.lit(deals))).groupBy("deal").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, **options) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed: null and empty texts are the one id 0, repeated
    rows are packed as often as they occur (their doc_id and piece then repeat), null
    doc_ids stay null. Other columns are ignored. An empty table gives no piece.
    """
    return pack(cut(pieces(docs, path, length)), length, **options).drop("row")


def packed_sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, **options) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, n_docs, doc_ids and ids (packed little-endian) in order of offset."""
    placed = pack(cut(pieces(docs, path, length, with_ids=True)), length, **options)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_docs"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", "n_docs", F.col("parts.doc_id").alias("doc_ids"), F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
