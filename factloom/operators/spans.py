"""Span operators: interval joins, greedy suppression, chains.

Spans are half-open [start, end) of one document. Every join has the document as its
equi key, so the interval conditions are residuals of a hash or merge join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def strictly_larger(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Contains and is longer."""
    return contains(outer_start, outer_end, start, end) & ((outer_end - outer_start) > (end - start))


def inside(spans: DataFrame, clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans with the clause that fully holds them: (all of spans, clause_idx, clause_start, clause_end).

    Clauses of a document don't overlap, so the only one that can hold a span is the last
    that starts at or before it: both go through one sort by place, not a join of all
    spans with all clauses of their document.
    """
    c = clauses.select(doc, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct("clause_idx", F.col("start").alias("clause_start"), F.col("end").alias("clause_end")).alias("__c"))
    s = spans.select(doc, F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.struct(*spans.columns).alias("__s"))
    so_far = Window.partitionBy(doc).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    met = c.unionByName(s, allowMissingColumns=True).withColumn("__c", F.last("__c", ignorenulls=True).over(so_far))
    return met.where((F.col("__kind") == 1) & (F.col("__s.end") <= F.col("__c.clause_end"))).select("__s.*", "__c.*")


def clause_of_point(points: DataFrame, clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Points (column start) with the first clause whose closed range [start, end] holds them; points in none are left out."""
    c = clauses.select(F.col(doc).alias("__doc"), "clause_idx", F.col("start").alias("clause_start"), F.col("end").alias("clause_end"))
    met = points.join(c, (F.col(doc) == F.col("__doc")) & F.col("start").between(F.col("clause_start"), F.col("clause_end"))).drop("__doc")
    keys = [x for x in points.columns]
    first = F.min(F.struct("clause_idx", "clause_start", "clause_end")).alias("__c")
    return met.groupBy(*keys).agg(first).select(*keys, "__c.*")


#: Characters of a bucket of places; a span inside another begins in one of the buckets that the other touches.
PLACE = 64


def _bucket(c: Column) -> Column:
    return F.floor(c / PLACE)


def _held(spans: DataFrame) -> DataFrame:
    """Spans that may hold others, once for each bucket ``__place`` that they touch."""
    return spans.withColumn("__place", F.explode(F.sequence(_bucket(F.col("__s")), _bucket(F.greatest("__s", "__e")))))


def suppress_covered(spans: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Spans that no better-ranked span of their group contains.

    ``order`` ranks the spans of a group and must be total. Because containment is
    transitive, dropping what any better span contains equals the greedy rule that
    compares with kept spans only, so one self anti-join does it, among spans of one place.
    """
    ranked = spans.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    better = _held(ranked.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("__rank").alias("__r")))
    same = [F.col(g) == F.col(f"__{g}") for g in group]
    cond = (F.col("__place") == _bucket(F.col("start"))) & (F.col("__r") < F.col("__rank")) & contains(F.col("__s"), F.col("__e"), F.col("start"), F.col("end"))
    for s in same:
        cond = s & cond
    return ranked.join(better, cond, "left_anti").drop("__rank")


def suppress_nested(spans: DataFrame, group: Sequence[str], seq: str) -> DataFrame:
    """Spans, by start and then length, that end after everything before them: nested ones go (a running maximum decides)."""
    before = Window.partitionBy(*group).orderBy("start", F.desc("end"), seq).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__max", F.max("end").over(before)).where("__max is null or end > __max").drop("__max")


def non_overlapping(spans: Column) -> Column:
    """Greedy left-to-right choice from an array of struct<start,end,...>: the longest at each start, none that begins before the last one ended."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.element_at(acc, -1)["end"]), F.array_append(acc, x)).otherwise(acc))


def drop_less_specific(spans: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Spans without those inside a strictly larger span of the same keys that is as confident, or two longer and at most 0.2 less so."""
    o = _held(spans.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("confidence").alias("__c"), F.col(seq).alias("__q")))
    longer = (F.col("__e") - F.col("__s")) - (F.col("end") - F.col("start"))
    wins = (F.col("__c") >= F.col("confidence")) | ((longer >= 2) & (F.col("__c") >= F.col("confidence") - 0.2))
    cond = (F.col("__place") == _bucket(F.col("start"))) & strictly_larger(F.col("__s"), F.col("__e"), F.col("start"), F.col("end")) & wins & (F.col("__q") != F.col(seq))
    for k in keys:
        cond = (F.col(k) == F.col(f"__{k}")) & cond
    return spans.join(o, cond, "left_anti")


def bundled(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Many small batches as few of at least so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Characters that are gone through together, and what stands between two texts.
TOGETHER, BETWEEN = 1 << 20, "\n"


def stretches(texts: list[str], most: int = TOGETHER) -> Iterator[slice]:
    """Whole texts that follow each other, up to about so many characters or one longer text."""
    part = np.cumsum(list(map(len, texts))) // most
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    yield from (slice(a, b) for a, b in zip(ends, ends[1:]) if a < b)


def laid_out(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts one behind the other, where each begins, and how long each is."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return BETWEEN.join(texts), np.cumsum(size + 1) - size - 1, size


def codes_of(text: str) -> np.ndarray:
    """A text's characters as numbers; those beyond the first plane are one number, which no table marks."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)


def finder(pattern: str) -> Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]:
    """Starts and ends of a pattern's occurrences in (texts, where each begins among all, the codes of all); words of one character are looked up, not searched for."""
    if re.fullmatch(r"\w(?:\|\w)*", pattern) and max(map(ord, pattern)) < 0xFFFF:
        one = np.zeros(1 << 16, bool)
        one[list(map(ord, pattern.split("|")))] = True

        def look(texts: list[str], begins: np.ndarray, codes: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(one[codes])
            return np.stack((at, at + 1), axis=1)

        return look
    exact = re.compile(pattern)

    def search(texts: list[str], begins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        found = [[x for m in exact.finditer(t) for x in m.span()] for t in texts]
        flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        return flat.reshape(-1, 2) + np.repeat(begins, [len(x) // 2 for x in found])[:, None]

    return search


def gathered(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, __spans): a document's whole spans in one array."""
    return spans.groupBy(doc).agg(F.collect_list(F.struct(*(c for c in spans.columns if c != doc))).alias("__spans"))


def spread(met: DataFrame, doc: str, *beside: str) -> DataFrame:
    """Spans of ``gathered`` as rows again, with the fields of the arrays that go ``beside`` them."""
    each = met.select(doc, F.inline(F.arrays_zip("__spans", *beside)))
    return each.select(doc, "__spans.*", *(f"{c}.*" for c in beside))


def _cells(left: int, right: int):
    """An Arrow function: texts with the starts and ends of their places to (before, word, after) of each place."""

    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        cells: tuple[list[str], ...] = ([], [], [])
        for text, s, e in zip(texts, starts, ends):
            text, s, e = text.as_py() or "", s.values.to_pylist(), e.values.to_pylist()
            cells[0].extend([text[max(0, x - left) : x] for x in s])
            cells[1].extend([text[x:y] for x, y in zip(s, e)])
            cells[2].extend([text[y : y + right] for y in e])
        found = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cells], names=["before", "word", "after"])
        return pa.ListArray.from_arrays(offsets(starts), found)

    return cut


def offsets(lists: pa.Array) -> pa.Array:
    """Where each list begins among the elements of all, and the end."""
    return pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int32))


def with_text(spans: DataFrame, docs: DataFrame, left: int = 0, right: int = 0, doc: str = "doc_id") -> DataFrame:
    """Spans with their own ``word`` and up to ``left`` characters ``before`` and ``right`` ``after`` them.

    A document's spans meet its text once, in one row, and are cut there by code points; a
    ``substring`` for each span would read the text from its start each time. What else a
    span holds waits in the row, so nothing is joined back.
    """
    met = docs.select(doc, F.col("text").alias("__text")).join(gathered(spans, doc), doc)
    place = lambda c: F.transform("__spans", lambda x: x[c].cast("int"))
    beside = F.arrow_udf(_cells(left, right), "array<struct<before:string,word:string,after:string>>")
    return spread(met.withColumn("__beside", beside("__text", place("start"), place("end"))), doc, "__beside")


def gather(marks: DataFrame, doc: str, *columns: str) -> DataFrame:
    """(doc, __marks): a document's marks in one array, as long as the document has marks."""
    return marks.groupBy(doc).agg(F.collect_list(F.struct("start", "end", *columns)).alias("__marks"))


def is_near(mark: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Whether a mark ends at most ``before`` before a span or begins at most ``after`` after it."""
    return (start - mark["end"]).between(0, before) | (mark["start"] - end).between(0, after)


def near(spans: DataFrame, marks: DataFrame, before: int, after: int, doc: str, flag: str) -> DataFrame:
    """Spans with whether a mark of their document is near; one join, the band is tested inside the document's array."""
    met = spans.join(gather(marks, doc), doc, "left")
    hit = F.exists("__marks", lambda m: is_near(m, F.col("start"), F.col("end"), before, after))
    return met.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__marks")


def chains(spans: DataFrame, doc: str, max_gap: int, most: int = 5) -> DataFrame:
    """(doc, start, end, n) of runs of 2 to ``most`` spans from each start, each at most ``max_gap`` after the last; contained runs with fewer members go."""
    w = Window.partitionBy(doc).orderBy("start", "end")
    numbered = spans.select(doc, "start", "end").withColumn("__k", F.row_number().over(w))
    linked = numbered.withColumn("__next", (F.lead("start").over(w) - F.col("end")).between(0, max_gap))
    island = linked.withColumn("__island", F.sum(F.when(F.lag("__next", 1, False).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(doc, "__island").orderBy("__k").rowsBetween(0, most - 1)
    made = island.select(doc, "__island", "start", F.max("end").over(run).alias("end"), F.count("*").over(run).cast("int").alias("n"), "__k").where("n >= 2")
    # Of one island, a run is inside an earlier one exactly if it ends no later.
    before = Window.partitionBy(doc, "__island").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("__max", F.max("end").over(before)).where("__max is null or end > __max").select(doc, "start", "end", "n")
