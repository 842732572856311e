"""Chains of neighbouring spans joined by connectors (compound species): a bounded search of paths over gaps.

Each span has at most one way on: the first span that begins where it ends or a few
characters later, found by a search in a text's sorted places. What stands in the gap decides
whether a path may go on, and for weak gaps so does a marker near all of the path. Where the
next marker stands is one number a span, so no path looks at all markers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import bundled, codes_of, finder, laid_out, stretches

#: Components of a compound at most.
MOST = 5


@dataclass(frozen=True)
class GapRule:
    """What may stand between two components, and what a compound is worth."""

    longest: int
    marker_distance: int
    connectors: tuple[str, ...]
    weak: tuple[str, ...]
    trimmed: bool
    base: float
    plain_bonus: float
    marker_bonus: float


#: Fixed: by locale, the longest gap, how near a marker of hybrids must be, connectors that join, those that join only near a marker, whether
#: white space round them counts for nothing, and confidence: of any compound, added for a plain joint, added near a marker.
RULES = {
    "zh": GapRule(2, 6, ("", "+", "/", "／", "-", "－", "×", "x", "X"), ("和", "与", "及", "加"), False, 0.82, 0.08, 0.08),
    "en": GapRule(8, 14, ("-", "–", "—", "/", "\\", "+", "×", "x", "X", "&"), ("", "and", "with"), True, 0.78, 0.1, 0.1),
}
#: Fixed: what tells an English connector anywhere between the first and the last component.
CONNECTOR = r"[-–—/+×xX\\&]"
CONNECTOR_CHARS = re.compile(CONNECTOR)


def _walk(text: str, begins: np.ndarray, size: np.ndarray, spans: np.ndarray, markers: np.ndarray, rule: GapRule, touch: bool, most: int) -> dict[str, pa.Array]:
    """Paths of two components and more, from each span of texts that lie one behind the other; ``row`` is the text."""
    start, end = spans[np.lexsort((-spans[:, 1], spans[:, 0]))].T
    flat = end > np.concatenate(([-1], np.maximum.accumulate(end)))[: len(end)]  # nested spans go
    start, end = start[flat], end[flat]
    row, n = np.searchsorted(begins, start, "right") - 1, len(start)
    to = np.searchsorted(start, end)
    to, inside = np.minimum(to, max(n - 1, 0)), to < n
    near = np.flatnonzero(inside & (row[to] == row) & (start[to] - end <= rule.longest))
    free, edge, gap = np.zeros(n, bool), np.zeros(n, bool), start[to] - end
    bare = [text[a:b] for a, b in zip(end[near].tolist(), start[to[near]].tolist())]
    bare = [x.strip(" ") for x in bare] if rule.trimmed else bare
    weak = [x.lower() for x in bare] if rule.trimmed else bare
    free[near] = [x in rule.connectors for x in bare]
    edge[near] = [x in rule.weak for x in weak]
    edge |= free
    # The first marker that doesn't end too far before a span: markers by their ends, the least start from each on.
    markers = markers[np.argsort(markers[:, 1], kind="stable")]
    least = np.append(np.minimum.accumulate(markers[::-1, 0])[::-1], np.iinfo(np.int64).max)
    mark = least[np.searchsorted(markers[:, 1], np.maximum(start - rule.marker_distance, begins[row]))]
    mark = np.where(mark <= (begins + size)[row], mark, np.iinfo(np.int64).max)
    at = np.flatnonzero(edge)
    last, going, count, touching, path = at, np.ones(len(at), bool), np.ones(len(at), np.int64), np.ones(len(at), bool), [at]
    for _ in range(most - 1):
        going = going & edge[last] & (free[last] | (mark[at] <= end[to[last]] + rule.marker_distance))
        touching &= ~going | (gap[last] == 0)
        last = np.where(going, to[last], last)
        count += going
        path.append(last)
    made = count >= 2
    at, last, count, touching = at[made], last[made], count[made], touching[made]
    found = list(zip(start[at].tolist(), end[at].tolist(), start[last].tolist(), end[last].tolist()))
    joined = touching if touch else np.array([CONNECTOR_CHARS.search(text, b, c) is not None for _, b, c, _ in found], bool)
    starts = (start[np.stack(path, axis=1)[made]] - begins[row[at]][:, None])[np.arange(most) < count[:, None]]
    return {
        "row": pa.array(row[at]), "start": pa.array((start[at] - begins[row[at]]).astype(np.int32)), "end": pa.array((end[last] - begins[row[at]]).astype(np.int32)), "text": pa.array([text[a:d] for a, _, _, d in found], pa.string()), "n": pa.array(count.astype(np.int32)),
        "marked": pa.array(mark[at] <= end[last] + rule.marker_distance), "joined": pa.array(joined), "starts": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(starts.astype(np.int32))),
    }


def _rule(locale: str) -> tuple[GapRule, bool]:
    zh = locale.lower().startswith("zh")
    return RULES["zh" if zh else "en"], zh


def _outer(made: DataFrame, rule: GapRule, most: int) -> DataFrame:
    """Compounds with their confidence, without those inside a longer one with more components."""
    sure = F.least(F.lit(1.0), F.lit(rule.base) + F.when(F.col("joined"), rule.plain_bonus).otherwise(0.0) + F.when(F.col("marked"), rule.marker_bonus).otherwise(0.0))
    # One compound begins at a place, so what holds another begins before it: running maxima by the number of components.
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    larger = made.withColumns({f"__{k}": F.max(F.when(F.col("n") > k, F.col("end"))).over(before) for k in range(2, most)})
    covered = F.lit(False)
    for k in range(2, most):
        covered = covered | ((F.col("n") == k) & F.coalesce(F.col(f"__{k}") >= F.col("end"), F.lit(False)))
    return larger.where(~covered).select("doc_id", "start", "end", "text", "n", sure.alias("confidence"), "marked", "joined", "starts")


_MADE = "start int, end int, text string, n int, marked boolean, joined boolean, starts array<int>"


def _batch(idents: pa.Array, made: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": idents.take(made.pop("row"))} | made)


def compounds(spans: DataFrame, markers: DataFrame, docs: DataFrame, locale: str = "en", most: int = MOST) -> DataFrame:
    """(doc_id, start, end, text, n, confidence, marked, joined, starts) of the compounds of spans (doc_id, start, end), by the locale's gap rule.

    From each span a path goes on as far as gaps allow, ``most`` components at most. ``joined`` says
    that all components touch (Chinese) or that a connector is written (otherwise);
    ``starts`` are the components' places. Nested spans are dropped before, compounds inside a longer one with more
    components after. ``docs`` holds the texts on which the offsets count. A document's spans
    and markers meet its text once, in one row.
    """
    rule, zh = _rule(locale)
    places = lambda df, name: df.groupBy("doc_id").agg(*(F.collect_list(F.col(c).cast("int")).alias(f"__{name}_{c}") for c in ("start", "end")))
    met = docs.select("doc_id", F.col("text").alias("__text")).join(places(spans, "span"), "doc_id").join(places(markers, "mark"), "doc_id", "left")
    lists = [f"__{name}_{c}" for name in ("span", "mark") for c in ("start", "end")]
    met = met.select("doc_id", "__text", *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            for own in stretches(texts):
                text, begins, size = laid_out(texts[own])
                shifted = []
                for c in lists:
                    x = b.column(c)[own]
                    shifted.append(x.flatten().to_numpy(zero_copy_only=False) + np.repeat(begins, pc.list_value_length(x).to_numpy(zero_copy_only=False)))
                yield _batch(b.column("doc_id")[own], _walk(text, begins, size, np.stack(shifted[:2], axis=1), np.stack(shifted[2:], axis=1), rule, zh, most))

    return _outer(met.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_MADE}"), rule, most)


def compounds_found(docs: DataFrame, parts: str, marks: str, locale: str = "en", most: int = MOST) -> DataFrame:
    """``compounds`` of what two patterns find, in Python's syntax: components and markers are found where the text is, so that only compounds are dealt anew."""
    rule, zh = _rule(locale)
    find, find_marks = finder(parts), finder(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for own in stretches(texts):
                text, begins, size = laid_out(texts[own])
                codes = codes_of(text)
                yield _batch(b.column(0)[own], _walk(text, begins, size, find(texts[own], begins, codes), find_marks(texts[own], begins, codes), rule, zh, most))

    return _outer(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_MADE}"), rule, most)


def literal_spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start, end, found) of a pattern's occurrences from left to right, without overlaps, in one pass over each text; the pattern in Python's syntax."""
    exact = re.compile(pattern)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, text in zip(b.column(0), b.column(1)):
                hits = [(m.start(), m.end(), m.group()) for m in exact.finditer(text.as_py() or "")]
                start, end, found = zip(*hits) if hits else ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.repeat(ident, len(hits)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.string())], names=["doc_id", "start", "end", "found"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: bundled(find(batches)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, found string")
