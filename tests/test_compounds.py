"""Compound chains and span quality on hand-written cases."""

import pytest

from factloom.operators import compounds, span_quality


def found(spark, text, words, markers, locale, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = compounds.literal_spans(docs, "|".join(words))
    return {r.text: r for r in compounds.compounds(spans, compounds.literal_spans(docs, "|".join(markers)), docs, locale, **options).collect()}


ZH, ZH_MARKS = ["虎鲸", "狼", "狐狸", "狐", "龙", "猫"], ["混种"]
EN, EN_MARKS = ["wolf", "dragon", "fox", "cat"], ["hybrid"]


@pytest.mark.parametrize("text, want", [
    ("夜岚是一只狼龙。", {"狼龙": (2, 0.90)}),
    ("这个角色是狼狐龙混种。", {"狼狐龙": (3, 0.98)}),
    ("墨海是一只虎鲸猫。", {"虎鲸猫": (2, 0.90)}),
    ("这个角色是狼和龙的混种。", {"狼和龙": (2, 0.90)}),
    ("森林里生活着狼和狐狸。", {}),
    ("狼/龙", {"狼/龙": (2, 0.82)}),
    ("狼。龙", {}),
    ("狼狐龙猫狼狐", {"狼狐龙猫狼": (5, 0.90), "狐龙猫狼狐": (5, 0.90)}),
])
def test_chinese_gaps(spark, text, want):
    assert {t: (r.n, round(r.confidence, 6)) for t, r in found(spark, text, ZH, ZH_MARKS, "zh-CN").items()} == want


@pytest.mark.parametrize("text, want", [
    ("My fursona is a wolf-dragon.", {"wolf-dragon": (2, 0.88)}),
    ("She is a fox/wolf hybrid.", {"fox/wolf": (2, 0.98)}),
    ("This character is a wolf dragon hybrid.", {"wolf dragon": (2, 0.88)}),
    ("A wolf dragon, far from any hybrid.", {}),
    ("wolf and fox live here", {}),
    ("a hybrid of wolf and fox", {"wolf and fox": (2, 0.88)}),
    ("wolf  x  dragon & cat", {"wolf  x  dragon & cat": (3, 0.88)}),
    # The connector is looked for anywhere between the first and the last component.
    ("wolf fox dragon hybrid", {"wolf fox dragon": (3, 0.98)}),
    ("wolf -- dragon", {}),
    ("wolf          -dragon", {}),
])
def test_english_gaps(spark, text, want):
    assert {t: (r.n, round(r.confidence, 6)) for t, r in found(spark, text, EN, EN_MARKS, "en").items()} == want


def test_nested_spans_and_documents_stay_apart(spark):
    docs = spark.createDataFrame([(1, "虎鲸猫"), (2, "狼"), (3, "龙")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (3, 1, 2)], "doc_id long, start int, end int")
    none = spans.limit(0)
    got = compounds.compounds(spans, none, docs, "zh-CN").collect()
    assert [(r.doc_id, r.text, r.n, r.starts, r.marked, r.joined) for r in got] == [(1, "虎鲸猫", 2, [0, 2], False, True)]
    assert compounds.compounds(none, none, docs, "en").isEmpty()


def quality(spark, name, text, matches=(), locale=None, evidence=(), start=None):
    at = text.index(name) if start is None else start
    cands = spark.createDataFrame([(1, 7, name, at, at + len(name), locale, [(e, s) for e, s in evidence])], "doc_id long, cand_id long, name string, start int, end int, locale string, evidence array<struct<evidence_type:string,strength:string>>")
    kinds = spark.createDataFrame([(1, *m) for m in matches], "doc_id long, start int, end int, kind string")
    return span_quality.candidate_quality(cands, kinds, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize("name, text, matches, evidence, score", [
    ("河谷城", "她来到河谷城。", [(5, 6, "entity-type")], [("suffix", "strong")], 0.48 + 0.12 + 0.08 + 0.04),
    ("北境采集", "北境采集稀有药材", [(2, 4, "event")], [], 0.48 + 0.08 - 0.48 + 0.04),
    ("她仍", "她仍", [], [], 0.48 - 0.62 + 0.08 - 0.24 + 0.08),
    ("城", "城", [], [], 0.48 - 0.52 + 0.08),
    ("Old Harbor", "In Old Harbor, at night", [(0, 2, "relation"), (13, 14, "field")], [("exact", "strong"), ("exact", None)], 0.48 + 0.16 + 0.07 + 0.08),
    ("there", "there it is", [], [("alias", "weak")], 0.48 + 0.0 - 0.62 + 0.07 + 0.08),
    ("a b c d e f", "xa b c d e fx", [(0, 1, "event"), (1, 3, "role-signal"), (2, 5, "field"), (5, 9, "relation")], [], 0.48 - 0.30 - 0.32 - 0.48),
])
def test_features_of_candidates(spark, name, text, matches, evidence, score):
    r = quality(spark, name, text, matches, None, evidence)
    assert round(r.span_confidence, 9) == round(max(0.0, min(1.0, score)), 9)
    assert r.quality == ("normal" if r.span_confidence >= 0.72 else "low-confidence" if r.span_confidence >= 0.45 else "suppressed")


def test_overlaps_are_counted_by_place(spark):
    import random

    rng = random.Random(3)
    spans = [(d, k, s, s + rng.randrange(1, 30)) for k, (d, s) in enumerate((rng.randrange(3), rng.randrange(200)) for _ in range(300))]
    others = [(rng.randrange(4), s, s + rng.randrange(0, 40), rng.choice("ab")) for s in (rng.randrange(220) for _ in range(300))]
    got = span_quality.overlap_counts(spark.createDataFrame(spans, "doc_id long, cand_id long, start int, end int"), spark.createDataFrame(others, "doc_id long, start int, end int, kind string"), {"a": __import__("pyspark.sql.functions", fromlist=["col"]).col("kind") == "a"})
    assert {r.cand_id: r.a for r in got.collect()} == {k: sum(o[0] == d and o[3] == "a" and o[1] < e and o[2] > s and o[1] < o[2] for o in others) for d, k, s, e in spans}


def test_hints_need_support(spark):
    known = spark.createDataFrame([(1, "Gray  Tower", 0.8), (1, "gray tower", 0.5)], "doc_id long, name string, span_confidence double")
    hints = spark.createDataFrame([(1, "Gray Tower", "object", True, None), (1, "朋友艾琳留下", "subject", True, None), (1, " ", None, False, None)], "doc_id long, hint string, role string, anchored boolean, locale string")
    got = {r.hint: r for r in span_quality.hint_quality(hints, known).collect()}
    assert round(got["Gray Tower"].span_confidence, 9) == round(0.48 + 0.12 + 0.04 + 0.34 * 0.8 + 0.07, 9)
    assert round(got["朋友艾琳留下"].span_confidence, 9) == round(0.48 + 0.12 + 0.04 + 0.08 - 0.45, 9) and got["朋友艾琳留下"].quality == "suppressed"
    assert got[" "].span_confidence == 0
