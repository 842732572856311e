"""Chinese names round type words, on hand-written cases."""

import pytest

from factloom.operators import names, span_quality

LEXICON = [("entityType.country", "帝国", "suffix", "strong", 1.0), ("entityType.port", "港", "suffix", "normal", 0.75), ("entityType.city", "城", "suffix", "normal", 0.75), ("entityType.organization", "骑士团", "suffix", "strong", 1.0), ("entityType.organization", "宗", "suffix", "normal", 0.75), ("entityType.river", "河", "suffix", "normal", 0.75), ("entityType.settlement", "白银城", "exact", "strong", 1.0)]


def discover(spark, text, terms=("国内", "城内"), extra=()):
    spans = [(1, c, w, e, s, v, "entity-type", k, k + len(w)) for c, w, e, s, v in LEXICON for k in range(len(text)) if text.startswith(w, k)]
    spans = sorted(spans + [(1, kind, text[a:b], "exact", "strong", 1.0, kind, a, b) for kind, a, b in extra], key=lambda r: (r[-2], -r[-1]))
    df = spark.createDataFrame([(r[0], k, *r[1:]) for k, r in enumerate(spans)], "doc_id long, seq int, concept_id string, expression string, evidence_type string, strength string, confidence double, kind string, start int, end int")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    stop = spark.createDataFrame([(t,) for t in terms], "term string")
    return names.first_by_place(names.judged(names.merge(names.grow_chinese(df, docs, stop), "zh"), df, docs, "zh")).orderBy("place").collect()


@pytest.mark.parametrize("text, want", [
    ("牙牙从诺兰帝国来到银月港，后来进入白银城。", ["诺兰帝国来到银月港", "后来进入白银城"]),
    ("黑月骑士团与天机宗后来结盟。", ["黑月骑士团"]),
    ("诺兰帝国的黑月骑士团", ["诺兰帝国", "黑月骑士团"]),
    ("一名来自河谷城的人", ["河谷城"]),
    ("她位于 银港。", ["银港"]),
    ("他后来进了城内，又去了山上，最后回到国内。", []),
    ("城", []),
    ("一二三四五六七八九十甲乙丙丁城。", ["三四五六七八九十甲乙丙丁城"]),
])
def test_growth(spark, text, want):
    got = discover(spark, text)
    assert [r.name for r in got] == want
    assert all(text[r.start : r.end] == r.name for r in got)


def test_types_of_one_place_are_merged(spark):
    r = discover(spark, "白银城，")[0]
    assert (r.likely_type, r.alternatives, r.lexical_confidence) == ("entityType.settlement", ["entityType.city"], 1.0)
    assert [e.expression for e in r.evidence] == ["白银城", "城"]
    assert round(r.span_confidence, 9) == round(min(1, 0.48 + 0.16 + 0.08 + 0.08), 9) and r.disposition == "normal"


def test_long_names_that_cut_events_are_suppressed(spark):
    r = discover(spark, "诺兰帝国来到银月港，", extra=[("event", 4, 6)])[0]
    assert round(r.span_confidence, 9) == round(0.48 + 0.08 + 0.08 - 0.48 + 0.0 - 0.0, 9) if len(r.name) <= 8 else round(r.span_confidence, 9) == round(0.48 + 0.08 - 0.48 + 0.08, 9)
    assert r.disposition == "suppressed"


def test_losing_types_keep_their_first_confidence(spark):
    rows = [(1, k, "河谷城", 0, 3, t, None, c, (t, str(k), "suffix", None, c)) for k, (t, c) in enumerate([("a", 0.5), ("b", 0.7), ("a", 0.9), ("c", 0.6), ("a", 0.2)])]
    df = spark.createDataFrame(rows, "doc_id long, seq int, name string, start int, end int, likely_type string, role string, confidence double, evidence struct<concept_id:string,expression:string,evidence_type:string,strength:string,confidence:double>")
    r = names.merge(df, "zh").first()
    assert (r.likely_type, r.confidence, r.alternatives) == ("a", 0.9, ["b", "c"]) and len(r.evidence) == 5
    assert names.merge(df.limit(0), "zh").isEmpty() and span_quality.BASE == 0.48
