"""How likely a stretch of text is a mention of an entity at all: additive features, none of which is a rule by itself.

How much of other spans a candidate cuts is counted without meeting them: spans that begin
before its end, less those that ended by its start, by two searches in sorted places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import QUALITY_TIERS, clamp01, tier
from ..functions.text import collapse_space, nfkc
from .spans import gathered, offsets, spread, with_text

#: Fixed: what every candidate starts from; lexical evidence by kind and strength, all of it within bounds.
BASE = 0.48
LEXICAL = {"exact": 0.12, "suffix": 0.08, "other": 0.03}
STRONG, WEAK, LEXICAL_LEAST, LEXICAL_MOST = 0.04, -0.03, -0.05, 0.16
#: Fixed: what it costs to cut a relation or event, and a field or role.
CUTS_PREDICATE, CUTS_MEANING = -0.48, -0.16
#: Fixed: shape of names: nothing there, grammar, one character, a plausible length, long without support in a role, too long, a particle inside.
EMPTY, GRAMMAR, SINGLE, LENGTH_ZH, LONG_ZH, EXCESSIVE_ZH, PARTICLE_ZH, TOKENS_EN, LONG_EN = -1.0, -0.62, -0.52, 0.08, -0.45, -0.22, -0.24, 0.07, -0.30
#: Fixed: a boundary at either end; a role in a structure, a fact behind it, and support by an independent mention.
BOUNDARY, ROLE, ANCHOR, SUPPORT = 0.04, 0.12, 0.04, 0.34
#: Fixed: closed classes of grammar that are no names.
PRONOUNS_ZH = "他|她|它|他们|她们|它们"
ALONE_ZH = f"{PRONOUNS_ZH}|这|那|这里|那里|哪里|此处|彼处|当地|目前|现在|后来|随后|然后|接着|最终|最后|经常|常常|仍|仍然|则|又|也|还|曾|曾经|已经|正在|当"
AFTER_PRONOUN_ZH = "仍|仍然|也|又|则|还|曾|已经|正在|会|将"
PARTICLES_ZH = "则|仍|仍然|又|也|还|已经|正在"
ALONE_EN = "he|she|it|they|him|her|them|here|there|where|now|currently|later|then|still|again|often|usually|already"
#: Fixed: what bounds a name.
BOUNDS_ZH = r"[\s，。！？；：、,.!?;:\"“”'‘’（）()]"
BOUNDS_EN = r"[\s,.;:!?()\"“”'‘’]"


def _is_zh(locale: Column) -> Column:
    return F.lower(F.coalesce(locale, F.lit(""))).startswith("zh")


def text_locale(c: Column) -> Column:
    """zh-CN if there is a Han character, else en."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"\p{IsHan}"), "zh-CN").otherwise("en")


def name_form(c: Column, compose: bool = True) -> Column:
    """NFKC, single spaces, lower case."""
    return F.lower(collapse_space(nfkc(F.coalesce(c, F.lit(""))) if compose else c))


def overlaps(start: np.ndarray, end: np.ndarray, others: pa.Array, begins: np.ndarray, size: np.ndarray, names: Sequence[str]) -> list[np.ndarray]:
    """For each flag, how many of the others (lists of start, end, flags by text) overlap each span: what begins before its end, less what ends by its start.

    Spans count from the first text's begin. What ends in the texts before a span's cancels what begins there.
    """
    flat = others.flatten()
    row = np.repeat(np.arange(len(others)), pc.list_value_length(others).to_numpy(zero_copy_only=False))
    at = [np.minimum(flat.field(c).to_numpy(zero_copy_only=False), size[row]) + begins[row] for c in ("start", "end")]
    out = []
    for n in names:
        held = flat.field(n).to_numpy(zero_copy_only=False).astype(bool)
        begun, ended = (np.sort(x[held]) for x in at)
        out.append(np.searchsorted(begun, end) - np.searchsorted(ended, start, "right"))
    return out


def _overlaps(names: Sequence[str]):
    """An Arrow function: starts and ends of each text's spans, and its others, to the counts of each span."""

    def count(starts: pa.Array, ends: pa.Array, others: pa.Array) -> pa.Array:
        s, e = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ends))
        far = 1 + max(s.max(initial=0), e.max(initial=0), pc.max(others.flatten().field("end")).as_py() or 0)
        begins = far * np.arange(len(starts))
        row = np.repeat(begins, pc.list_value_length(starts).to_numpy(zero_copy_only=False))
        counts = overlaps(s + row, e + row, others, begins, np.full(len(starts), far - 1), names)
        return pa.ListArray.from_arrays(offsets(starts), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], names=list(names)))

    return count


def gathered_others(others: DataFrame, counts: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """(doc, __others): a document's spans that aren't empty in one array, with a flag for each of ``counts``."""
    flags = [F.coalesce(c, F.lit(False)).alias(name) for name, c in counts.items()]
    return others.where("start < end").select(doc, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), *flags).alias("__o")).groupBy(doc).agg(F.collect_list("__o").alias("__others"))


def with_others(rows: DataFrame, others: DataFrame, counts: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """Rows of documents with ``__others``, which is empty where a document has none."""
    held = gathered_others(others, counts, doc)
    return rows.join(held, doc, "left").withColumn("__others", F.coalesce("__others", F.array().cast(held.schema["__others"].dataType)))


def overlap_counts(spans: DataFrame, others: DataFrame, counts: dict[str, Column], doc: str = "doc_id") -> DataFrame:
    """``spans`` (doc, start, end, more) with, for each of ``counts``, how many of ``others`` (doc, start, end) that it holds for overlap a span.

    A document's spans meet the sorted places of the others once, in one row.
    """
    place = lambda c: F.transform("__spans", lambda x: x[c])
    count = F.arrow_udf(_overlaps(list(counts)), f"array<struct<{','.join(f'{n}:bigint' for n in counts)}>>")
    met = with_others(gathered(spans, doc), others, counts, doc)
    return spread(met.withColumn("__counts", count(place("start"), place("end"), "__others")), doc, "__counts")


def lexical_support(evidence: Column) -> Column:
    """What an array of (evidence_type, strength) adds, within bounds."""
    worth = lambda e: F.when(e["evidence_type"] == "exact", LEXICAL["exact"]).when(e["evidence_type"] == "suffix", LEXICAL["suffix"]).otherwise(LEXICAL["other"]) + F.when(e["strength"] == "strong", STRONG).when(e["strength"] == "weak", WEAK).otherwise(0.0)
    total = F.coalesce(F.aggregate(evidence, F.lit(0.0), lambda s, e: s + worth(e)), F.lit(0.0))
    return F.greatest(F.lit(LEXICAL_LEAST), F.least(F.lit(LEXICAL_MOST), total))


def is_grammar(name: Column, locale: Column) -> Column:
    """Whether a name in ``name_form`` is only grammar."""
    zh = [*ALONE_ZH.split("|"), *(a + b for a in PRONOUNS_ZH.split("|") for b in AFTER_PRONOUN_ZH.split("|"))]
    return (name == "") | F.when(_is_zh(locale), name.isin(zh)).otherwise(name.isin(ALONE_EN.split("|")))


def name_shape(name: Column, locale: Column, supported: Column, role: Column | None = None) -> Column:
    """What the form of a name adds; ``name`` in ``name_form``."""
    n = F.length(name)
    in_role = F.lit(False) if role is None else F.coalesce(role.isin("subject", "object"), F.lit(False))
    given = lambda c, score: F.when(c, score).otherwise(0.0)
    zh = F.when(n == 1, SINGLE).when(n.between(2, 8), LENGTH_ZH).otherwise(0.0) + given(~supported & in_role & (n >= 5), LONG_ZH) + given(n > 12, EXCESSIVE_ZH) + given(~supported & name.rlike(PARTICLES_ZH), PARTICLE_ZH)
    tokens = F.size(F.split(name, " "))
    en = given(tokens.between(1, 4), TOKENS_EN) + given(~supported & (tokens > 5), LONG_EN)
    return F.when(name == "", EMPTY).otherwise(given(is_grammar(name, locale), GRAMMAR) + F.when(_is_zh(locale), zh).otherwise(en))


def boundaries(before: Column, after: Column, locale: Column) -> Column:
    """What clean ends add; the characters beside a span, null at the ends of the text."""
    clean = lambda c: F.when(c.isNull() | F.when(_is_zh(locale), c.rlike(BOUNDS_ZH)).otherwise(c.rlike(BOUNDS_EN)), BOUNDARY).otherwise(0.0)
    return clean(before) + clean(after)


def kinds_cut() -> dict[str, Column]:
    """What may be cut, by kind."""
    return {"predicates": F.col("kind").isin("relation", "event"), "meanings": F.col("kind").isin("field", "role-signal")}


def of_kinds(matches: DataFrame) -> DataFrame:
    """Matches that count against a candidate which cuts them."""
    return matches.where("kind in ('relation', 'event', 'field', 'role-signal')")


def candidate_quality(candidates: DataFrame, matches: DataFrame, docs: DataFrame, compose: bool = True) -> DataFrame:
    """Candidates (doc_id, cand_id, name, start, end, locale, evidence) with lexical, shape, contamination, edges, span_confidence and quality.

    matches: (doc_id, start, end, kind); entity types inside a name don't count against it. ``docs``
    holds the texts, from which the characters beside each candidate are taken. Candidates that have
    ``predicates`` and ``meanings``, or ``before`` and ``after``, keep what they have.
    """
    cut = {"predicates", "meanings"} <= set(candidates.columns)
    counted = candidates.withColumnsRenamed({"predicates": "__predicates", "meanings": "__meanings"}) if cut else overlap_counts(candidates, of_kinds(matches), {f"__{n}": c for n, c in kinds_cut().items()})
    met = counted if {"before", "after"} <= set(candidates.columns) else with_text(counted, docs, 1, 1)
    beside = met.withColumns({"__before": F.nullif(F.col("before"), F.lit("")), "__after": F.nullif(F.col("after"), F.lit(""))}).drop("before", "word", "after")
    name, where = name_form(F.col("name"), compose), F.coalesce("locale", text_locale(F.col("name")))
    supported = F.exists("evidence", lambda e: e["evidence_type"].isin("exact", "suffix"))
    out = beside.withColumns({"__name": name, "__where": where, "__held": F.coalesce(supported, F.lit(False))})
    out = out.withColumns({
        "lexical": lexical_support(F.col("evidence")), "shape": name_shape(F.col("__name"), F.col("__where"), F.col("__held")),
        "contamination": F.col("__predicates") * CUTS_PREDICATE + F.col("__meanings") * CUTS_MEANING, "edges": boundaries(F.col("__before"), F.col("__after"), F.col("__where")),
    })
    score = clamp01(F.round(F.lit(BASE) + F.col("lexical") + F.col("shape") + F.col("contamination") + F.col("edges"), 12))
    return out.withColumn("span_confidence", score).withColumn("quality", tier(F.col("span_confidence"), QUALITY_TIERS)).drop(*(c for c in out.columns if c.startswith("__")))


def hint_quality(hints: DataFrame, known: DataFrame, keys: Sequence[str] = ("doc_id",), compose: bool = True) -> DataFrame:
    """Hints (keys, hint, role, anchored, locale) with support, span_confidence and quality.

    ``anchored`` says that a relation, event or field proposed the hint; ``known`` (keys, name, span_confidence) are
    mentions found independently, of which the surest of the same name supports it.
    """
    best = known.groupBy(*keys, name_form(F.col("name"), compose).alias("__name")).agg(F.max("span_confidence").alias("support")).where("__name != ''")
    met = hints.withColumn("__name", name_form(F.col("hint"), compose)).join(best, [*keys, "__name"], "left")
    supported = F.col("support").isNotNull()
    given = lambda c, score: F.when(c, score).otherwise(0.0)
    raw = F.lit(BASE) + given(F.col("role").isin("subject", "object", "field-value"), ROLE) + given(F.col("anchored"), ANCHOR) + F.coalesce(SUPPORT * clamp01(F.col("support")), F.lit(0.0)) + name_shape(F.col("__name"), F.coalesce("locale", text_locale(F.col("hint"))), supported, F.col("role"))
    return met.withColumn("span_confidence", clamp01(F.round(raw, 12))).withColumn("quality", tier(F.col("span_confidence"), QUALITY_TIERS)).drop("__name")
