"""Names grown where the text is, against names grown from spans; spans with their text; counts of overlaps."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import compounds, names, span_quality, spans

WORDS = [("城|港|宗", "place", "suffix", "normal", 0.75), ("白银城|帝国", "old", "exact", "strong", 0.9), ("骑士团", "order", "alias", None, 0.8)]


def texts():
    rng = random.Random(7)
    pieces = ["诺兰", "帝国", "城", "港", "宗", "白银城", "骑士团", "来自", "一名", "位于", "的", "，", "\n", "\n\n", " ", "　", "\xa0", "“", "「", "黑月", "a", "B", "𠀀", "后来", "城城"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    return [(k, t) for k, t in enumerate([*made, "", None, "城", "\n城", "黑月\n城"])]


def from_spans(docs, events, terms):
    found = None
    for k, (pattern, concept, kind, strength, sure) in enumerate(WORDS):
        own = compounds.literal_spans(docs, pattern).select("doc_id", (len(WORDS) * F.col("start") + k).alias("seq"), F.lit(concept).alias("concept_id"), F.col("found").alias("expression"), F.lit(kind).alias("evidence_type"), F.lit(strength).cast("string").alias("strength"), F.lit(sure).alias("confidence"), F.lit("entity-type").alias("kind"), "start", "end")
        found = own if found is None else found.unionByName(own)
    return names.judged(names.merge(names.grow_chinese(found, docs, terms), "zh"), events, docs, "zh")


@pytest.mark.parametrize("together", [1 << 20, 40])
def test_found_names_are_those_of_spans(spark, monkeypatch, together):
    monkeypatch.setattr(names, "TOGETHER", together)
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    events = compounds.literal_spans(docs, "后来|黑").select("doc_id", F.lit("event").alias("kind"), "start", "end").unionByName(compounds.literal_spans(docs, "兰").select("doc_id", F.lit("field").alias("kind"), "start", "end"))
    terms = spark.createDataFrame([("城城",), ("白银 城",)], "term string")
    order = lambda df: sorted((str(r.asDict(True)) for r in df.select(sorted(df.columns)).collect()))
    want = order(from_spans(docs, events, terms))
    for matches in (events, None):
        assert order(names.judged(names.grow_found(docs, WORDS, matches, terms), events, docs, "zh")) == want
    assert len(want) > 100


def test_a_line_break_bounds_a_name(spark):
    docs = spark.createDataFrame([(1, "黑月\n城")], "doc_id long, text string")
    span = spark.createDataFrame([(1, 0, "place", "城", "suffix", "normal", 0.75, "entity-type", 3, 4)], "doc_id long, seq int, concept_id string, expression string, evidence_type string, strength string, confidence double, kind string, start int, end int")
    assert names.grow_chinese(span, docs).isEmpty()


def test_spans_meet_their_text_in_one_row(spark):
    docs = spark.createDataFrame([(1, "abc𠀀def"), (2, None), (3, "xyz")], "doc_id long, text string")
    own = spark.createDataFrame([(1, 0, 2, "p"), (1, 3, 5, "q"), (1, 3, 5, "r"), (2, 0, 1, "s"), (4, 0, 1, "t")], "doc_id long, start int, end int, more string")
    got = spans.with_text(own, docs, 2, 9)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2, "p", "", "ab", "c𠀀def"), (1, 3, 5, "q", "bc", "𠀀d", "ef"), (1, 3, 5, "r", "bc", "𠀀d", "ef"), (2, 0, 1, "s", "", "", "")]
    # One join, of a document's spans with its text; none that leads back to the spans.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_growing_deals_no_spans(spark):
    """Only texts and what names may cut go through shuffles, not the type words, of which there are many more than names."""
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    events = compounds.literal_spans(docs, "后来").select("doc_id", F.lit("event").alias("kind"), "start", "end")
    plan = names.judged(names.grow_found(docs, WORDS, events), events, docs, "zh")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan


def test_no_others_are_no_overlaps(spark):
    own = spark.createDataFrame([(1, 0, 5), (2, 3, 3)], "doc_id long, start int, end int")
    others = spark.createDataFrame([(1, 2, 2, True), (1, 0, 9, False), (2, 0, 9, True), (2, 3, 4, True)], "doc_id long, start int, end int, flag boolean")
    assert sorted(map(tuple, span_quality.overlap_counts(own, others, {"a": F.col("flag"), "b": ~F.col("flag")}).collect())) == [(1, 0, 5, 0, 1), (2, 3, 3, 1, 0)]
