"""Names grown from type words: a bounded scan to both sides, and what remains when several grow alike.

Chinese writes no blanks, so a name is what stands before its type word up to a boundary or a
particle, without the grammar that leads to it. The scan is a pattern on a few characters beside each
span; the text itself is met once a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import QUALITY_TIERS, tier, weakest_link
from ..functions.text import comparison_form
from . import span_quality
from .spans import TOGETHER, codes_of, finder, laid_out, stretches, with_text

#: Fixed: characters before and behind a type word that a Chinese name may take in.
LEFT, RIGHT = 12, 4
#: Fixed: what bounds a name, and particles at which it stops.
BOUNDS = r"\s，。！？；：、,.!?;:\"“”'‘’（）()\[\]【】<>《》"
PARTICLES = "的了在由与和及为是于向从把被"
#: Fixed: grammar that may lead to a name and is no part of it.
COUNTED = "一名|一位|一个|一座"
LEADS = "来自|源自|源于|出身于|位于|坐落于|坐落在|地处|隶属于|隶属|属于|归属于|归属|加入|任职于|就职于|供职于|居住在|住在|定居于|出生于|出生在|生于"
#: Fixed: names of three characters (or two words), and suffix words, are surer; the shortest name.
LONGER, SUFFIX, SHORTEST = 0.08, 0.05, 2


#: Fixed: stop terms that every executor may hold; more are joined by shuffles.
TERMS = 1 << 16


def _rejected(names: DataFrame, terms: DataFrame | None, locale: str, compose: bool) -> DataFrame:
    """Names (with their comparison ``form``) without those that are generic or stop terms (column term)."""
    out = names.where(F.length("form") >= SHORTEST)
    if terms is not None:
        forms = terms.select(comparison_form(F.col("term"), locale, compose).alias("form")).distinct()
        out = out.join(F.broadcast(forms) if forms.limit(TERMS + 1).count() <= TERMS else forms, "form", "left_anti")
    return out


def grow_chinese(spans: DataFrame, docs: DataFrame, terms: DataFrame | None = None, doc: str = "doc_id", compose: bool = False) -> DataFrame:
    """(doc, seq, name, start, end, likely_type, role, confidence, evidence) of the names round entity-type spans.

    A name counts only if it ends with its type word: a word inside a name says nothing about all of it.
    """
    inner = f"[^{BOUNDS}{PARTICLES}]*"
    met = with_text(spans.where("kind = 'entity-type'"), docs, LEFT, RIGHT, doc)
    left, right = F.regexp_extract("before", rf"({inner})\z", 1), F.regexp_extract("after", f"^({inner})", 1)
    grown = met.select(doc, "seq", "start", "end", "concept_id", "expression", "evidence_type", "strength", "confidence", left.alias("__left"), F.concat(left, F.col("word"), right).alias("__value"), F.length(right).alias("__more"))
    lead = F.regexp_extract("__value", rf"^(?:(?:(?:{COUNTED})\s*)?(?:{LEADS}))+", 0)
    cut = grown.withColumn("__lead", lead).select(
        doc, "seq", F.expr("substring(__value, length(__lead) + 1)").alias("name"), (F.col("start") - F.length("__left") + F.length("__lead")).cast("int").alias("start"), (F.col("end") + F.col("__more")).cast("int").alias("end"),
        "concept_id", "expression", "evidence_type", "strength", F.col("confidence").alias("__sure"),
    )
    kept = _rejected(cut.withColumn("form", comparison_form(F.col("name"), "zh", compose)), terms, "zh", compose)
    form = comparison_form(F.col("expression"), "zh", compose)
    sure = F.least(F.lit(1.0), F.col("__sure") + F.when(F.length("name") >= 3, LONGER).otherwise(0.0) + F.when(F.col("evidence_type") == "suffix", SUFFIX).otherwise(0.0))
    evidence = F.struct("concept_id", "expression", "evidence_type", "strength", F.col("__sure").alias("confidence"))
    return kept.where((form != "") & F.col("form").endswith(form)).select(doc, "seq", "name", "start", "end", F.col("concept_id").alias("likely_type"), F.lit(None).cast("string").alias("role"), sure.alias("confidence"), evidence.alias("evidence"))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By character: whether a name stops there, and whether comparison passes over it."""
    kinds = re.compile(f"[{BOUNDS}{PARTICLES}]", re.ASCII), re.compile(r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\"'`“”‘’「」『』《》]")
    return tuple(np.array([k.match(chr(c)) is not None for c in range(1 << 16)]) for k in kinds)


def _reach(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters that a name takes in left and right of each place, whether it may end with what stands there, and whether comparison leaves it as it is."""
    stop, loose = (np.flatnonzero(t[codes]) for t in _tables())
    stops = np.concatenate(([-1], stop, [len(codes)]))
    start, end = places.T
    left = np.minimum(LEFT, start - 1 - stops[np.searchsorted(stops, start) - 1])
    right = np.minimum(RIGHT, stops[np.searchsorted(stops, end)] - end)
    size, last, ends = end - start, len(codes) - 1, np.ones(len(start), bool)
    for k in range(size.max(initial=0)):
        ends &= (size <= k) | (codes[np.minimum(end + right - size + k, last)] == codes[np.minimum(start + k, last)])
    plain = np.searchsorted(loose, end + right) == np.searchsorted(loose, start - left)
    return left, right, ends | ~plain, plain


def _without_lead(text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where names begin behind the grammar that leads to them."""
    first, lead = _leads()
    out = start.copy()
    for k in np.flatnonzero(first[codes[start]]).tolist():
        if m := lead.match(text, start[k], end[k]):
            out[k] = m.end()
    return out


@cache
def _leads() -> tuple[np.ndarray, re.Pattern]:
    """By character, whether a lead may begin there; the leads."""
    first = np.zeros(1 << 16, bool)
    first[[ord(w[0]) for w in f"{COUNTED}|{LEADS}".split("|")]] = True
    return first, re.compile(rf"(?:(?:(?:{COUNTED})\s*)?(?:{LEADS}))+", re.ASCII)


def _evidence(words: Sequence[tuple], k: np.ndarray, seq: np.ndarray, length: np.ndarray, found: list[str]) -> pa.Array:
    """Structs of what each found word says of its name."""
    concept, kind, strength = (pa.array([w[c] for w in words], pa.string()).take(pa.array(k)) for c in (1, 2, 3))
    sure = np.array([w[4] for w in words], float)[k]
    raised = np.minimum(1.0, sure + np.where(length >= 3, LONGER, 0.0) + np.array([SUFFIX if w[2] == "suffix" else 0.0 for w in words])[k])
    proof = pa.StructArray.from_arrays([concept, pa.array(found, pa.string()), kind, strength, pa.array(sure)], names=["concept_id", "expression", "evidence_type", "strength", "confidence"])
    return pa.StructArray.from_arrays([pa.array(seq), concept, pa.nulls(len(k), pa.string()), pa.array(raised), proof], names=["seq", "likely_type", "role", "confidence", "evidence"])


def grow_found(docs: DataFrame, words: Sequence[tuple[str, str, str, str | None, float]], matches: DataFrame | None = None, terms: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """What ``merge`` makes of ``grow_chinese`` without composing, for the type words that patterns find: words (pattern, concept_id, evidence_type, strength, confidence), in Python's syntax.

    Words are found and grown where the text is, so that the many that no name ends with are
    never rows, and those of one place, in the order of ``words``, come as one name. Names have
    the characters beside them (before, after), and what they cut of ``matches``, if given.
    """
    finders = [finder(w[0]) for w in words]
    cut = list(span_quality.kinds_cut())

    def grown(idents: pa.Array, texts: list[str], others: pa.Array) -> pa.RecordBatch:
        text, begins, size = laid_out(texts)  # what stands between two texts ends every name
        codes = codes_of(text)
        hits = [find(texts, begins, codes) for find in finders]
        k, places = np.repeat(np.arange(len(hits)), list(map(len, hits))), np.concatenate(hits)
        left, right, ends, plain = _reach(codes, places)
        k, s, e, grown_from, to, plain = (x[ends] for x in (k, *places.T, places[:, 0] - left, places[:, 1] + right, plain))
        start = _without_lead(text, codes, grown_from, to)
        plain &= start == grown_from
        # Words of one place are one name, in their order.
        seq, place = s * len(words) + k, start * (len(text) + 1) + to
        order = np.lexsort((seq, place))
        heads = np.flatnonzero(np.diff(place[order], prepend=-1))
        k, s, e, seq, plain, start, to = (x[order] for x in (k, s, e, seq, plain, start, to))
        said = _evidence(words, k, seq - begins[np.searchsorted(begins, s, "right") - 1] * len(words), to - start, [text[x:y] for x, y in zip(s.tolist(), e.tolist())])
        start, to = start[heads], to[heads]
        row = np.searchsorted(begins, start, "right") - 1
        at = list(zip(start.tolist(), to.tolist(), (start == begins[row]).tolist(), (to == (begins + size)[row]).tolist()))
        columns = {
            doc: idents.take(pa.array(row)), "start": pa.array((start - begins[row]).astype(np.int32)), "end": pa.array((to - begins[row]).astype(np.int32)), "name": pa.array([text[x:y] for x, y, _, _ in at], pa.string()),
            "before": pa.array(["" if first else text[x - 1] for x, _, first, _ in at], pa.string()), "after": pa.array(["" if last else text[y] for _, y, _, last in at], pa.string()), "__plain": pa.array(np.logical_and.reduceat(plain, heads) if len(heads) else plain),
            "said": pa.ListArray.from_arrays(pa.array(np.append(heads, len(k)).astype(np.int32)), said),
        }
        counts = span_quality.overlaps(start, to, others, begins, size, cut)
        return pa.RecordBatch.from_pydict(columns | {n: pa.array(c) for n, c in zip(cut, counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for own in stretches(texts, TOGETHER):
                yield grown(b.column("__doc")[own], texts[own], b.column("__others")[own])

    said = "array<struct<seq:bigint,likely_type:string,role:string,confidence:double,evidence:struct<concept_id:string,expression:string,evidence_type:string,strength:string,confidence:double>>>"
    none = F.array().cast(f"array<struct<start:int,end:int,{','.join(f'{n}:boolean' for n in cut)}>>")
    texts = docs.select(doc, F.col(doc).alias("__doc"), "text")
    met = texts.withColumn("__others", none) if matches is None else span_quality.with_others(texts, span_quality.of_kinds(matches), span_quality.kinds_cut(), doc)
    out = met.select("__doc", "text", "__others").mapInArrow(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, start int, end int, name string, before string, after string, __plain boolean, said {said}, {', '.join(f'{n} bigint' for n in cut)}")
    form = F.when(F.col("__plain"), F.col("name")).otherwise(comparison_form(F.col("name"), "zh", False))
    own = lambda x: comparison_form(x["evidence"]["expression"], "zh", False)
    fits = F.when(F.col("__plain"), F.col("said")).otherwise(F.filter("said", lambda x: (own(x) != "") & F.col("form").endswith(own(x))))
    kept = _rejected(out.withColumn("form", form), terms, "zh", False).withColumn("said", fits).where("size(said) > 0").drop("form", "__plain")
    return _settled(kept if matches is not None else kept.drop(*cut), doc)


def _folded(said: Column) -> Column:
    """struct<best,role,sure,beside> of one name's evidence in order: the surest type so far leads, and every type that loses to it or comes beside it stands ``beside``."""
    first = said[0]
    zero = F.struct(first["likely_type"].alias("best"), first["role"].alias("role"), first["confidence"].alias("sure"), F.array().cast("array<struct<k:string,c:double>>").alias("beside"))
    pair = lambda k, c: F.struct(k.alias("k"), c.alias("c"))

    def step(s: Column, x: Column) -> Column:
        kind, c = x["likely_type"], x["confidence"]
        wins, other = c > s["sure"], ~kind.eqNullSafe(s["best"])
        came = F.when(kind.isNotNull() & other, F.array_append(s["beside"], pair(kind, c))).otherwise(s["beside"])
        lost = F.when(wins & s["best"].isNotNull() & other, F.array_append(came, pair(s["best"], s["sure"]))).otherwise(came)
        won = lambda new, old: F.when(wins, new).otherwise(s[old]).alias(old)
        return F.struct(won(kind, "best"), won(F.coalesce(F.nullif(x["role"], F.lit("")), s["role"]), "role"), won(c, "sure"), lost.alias("beside"))

    return F.aggregate(F.slice(said, 2, F.size(said)), zero, step)


def merge(names: DataFrame, locale: str, doc: str = "doc_id", compose: bool = False) -> DataFrame:
    """One row a name and place: (doc, name, start, end, likely_type, role, confidence, evidence (each kind once, in order), alternatives).

    A place has few type words, so what comes together is short; most names have one. The
    first mention of an alternative counts, and of equally sure ones the first goes first.
    """
    form = comparison_form(F.col("name"), locale, compose)
    said = F.array_sort(F.collect_list(F.struct("seq", "name", "likely_type", "role", "confidence", "evidence")))
    return _settled(names.groupBy(doc, "start", "end", form.alias("__form")).agg(said.alias("said")).drop("__form").withColumn("name", F.col("said")[0]["name"]), doc)


def _settled(grouped: DataFrame, doc: str) -> DataFrame:
    """Names (doc, name, start, end, more) with what is ``said`` of each, in order, folded."""
    more = [c for c in grouped.columns if c not in (doc, "name", "start", "end", "said")]
    several = F.size("said") > 1
    first = F.col("said")[0]
    fold = grouped.withColumn("__f", F.when(several, _folded(F.col("said"))))
    folded = lambda field, alone: F.when(several, F.col("__f")[field]).otherwise(first[alone]).alias(alone)
    beside, best = F.col("__f.beside"), F.col("__f.best")
    kinds = F.filter(F.array_distinct(F.transform(beside, lambda b: b["k"])), lambda k: ~k.eqNullSafe(best))
    ranked = F.array_sort(F.transform(kinds, lambda k, i: F.struct((-F.filter(beside, lambda b: b["k"] == k)[0]["c"]).alias("n"), i.alias("i"), k.alias("k"))))
    proof = F.transform("said", lambda x: x["evidence"])
    same = lambda a, b: a["concept_id"].eqNullSafe(b["concept_id"]) & a["expression"].eqNullSafe(b["expression"]) & a["evidence_type"].eqNullSafe(b["evidence_type"])
    once = F.filter(proof, lambda e, i: ~F.exists(F.slice(proof, 1, i), lambda x: same(x, e)))
    return fold.select(doc, "name", "start", "end", folded("best", "likely_type"), folded("role", "role"), folded("sure", "confidence"), F.when(several, once).otherwise(proof).alias("evidence"), F.when(several, F.transform(ranked, lambda x: x["k"])).otherwise(F.array().cast("array<string>")).alias("alternatives"), *more)


def judged(names: DataFrame, spans: DataFrame, docs: DataFrame, locale: str, doc: str = "doc_id", compose: bool = False) -> DataFrame:
    """Merged names with lexical_confidence, span_confidence, confidence (the weaker of both counts most) and disposition; ``spans`` holds all matches with kinds."""
    cands = names.withColumn("locale", F.lit("zh-CN" if locale.startswith("zh") else "en")).withColumnRenamed("confidence", "lexical_confidence")
    out = span_quality.candidate_quality(cands, spans, docs, compose)
    sure = weakest_link(F.col("lexical_confidence"), F.col("span_confidence"))
    return out.withColumn("confidence", sure).select(doc, "name", "start", "end", "likely_type", "role", "lexical_confidence", "span_confidence", "confidence", "quality", tier(sure, QUALITY_TIERS).alias("disposition"), "evidence", "alternatives")


def first_by_place(names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Names with their number in the order of places, the surer first (``place``, from 0)."""
    return names.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("start", F.desc("confidence"), "end")) - 1)
