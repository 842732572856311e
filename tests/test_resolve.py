"""Resolution of schema fields, redundant facts, deep values and references, on hand-written cases."""

import random

from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators import resolve


def test_every_status_and_side_table(spark):
    fields = spark.createDataFrame([
        ("t1", "age", "Age", None, "Number", None, None), ("t1", "mood", "x", "field.mood", "select", ["Happy", "sad"], None), ("t1", "home", "x", "field.home", "entity_reference", None, ["city"]),
        ("t1", "a", "x", "field.twice", "text", None, None), ("t1", "b", "x", "field.twice", "text", None, None), ("t2", None, None, None, None, None, None),
    ], "type_id string, field_key string, label string, concept string, kind string, options array<string>, allowed array<string>")
    labels = spark.createDataFrame([("field.age", "the_AGE"), ("field.age", "age")], "concept string, label string")
    canonical = spark.createDataFrame([("field.age", "number"), ("field.mood", "text"), ("field.home", "entity-reference")], "concept string, kind string")
    entities = spark.createDataFrame([("e1", "Silverport", "city"), ("e2", "Silverport", "ship"), ("e3", "Twin", "city"), ("e4", "twin", "city")], "entity_id string, name string, type_id string")
    rows = [
        ("field.age", "24", "t1", None, False), ("field.age", "24", None, None, True), ("field.age", "24", None, None, False), ("field.age", "24", "t9", None, False), ("field.age", "24", "t2", None, False), ("field.age", " 24", None, "t2", True), ("field.age", "30", None, "t2", True),
        ("field.mood", " HAPPY ", "t1", None, False), ("field.mood", "Angry", "t1", None, False), ("field.mood", "angry ", "t1", None, False), ("field.home", "the silverport", "t1", None, False), ("field.home", "Twin", "t1", None, False), ("field.home", "Nowhere", "t1", None, False), ("field.home", " ", "t1", None, False), ("field.twice", "v", "t1", None, False),
    ]
    cands = spark.createDataFrame([(k, c, v, s, d, h, "text", 0.5 + k / 100, [f"x{k % 2}"]) for k, (c, v, s, d, h) in enumerate(rows)], "cand_id int, field_concept string, value string, subject_type string, draft_type string, has_draft boolean, runtime string, confidence double, expected array<string>")
    got = resolve.resolve_fields(cands, fields, labels, canonical, entities)
    out = {r.cand_id: r for r in got["resolved"].collect()}
    assert [out[k].status for k in range(15)] == ["resolved", "draft-subject-type-unmaterialized", "missing-subject-type", "missing-entity-type-schema", "missing", "missing", "missing", *["resolved"] * 7, "ambiguous"]
    assert [out[k].value_status for k in (0, 7, 8, 10, 11, 12, 13, 14)] == ["not-needed", "resolved", "missing-option", "resolved", "ambiguous-reference", "missing-reference", "missing-reference-hint", None]
    assert (out[0].field_key, out[0].fit, out[7].stored_value, out[10].stored_value, out[12].stored_value, out[11].stored_value) == ("age", "exact", "Happy", "e1", None, None)
    assert [(r.type_id, r.field_concept, r.examples, r.confidence) for r in got["schema_suggestions"].collect()] == [("t2", "field.age", ["24", "30"], 0.56)]
    assert [(r.field_key, r.value, r.confidence) for r in got["option_suggestions"].collect()] == [("mood", "Angry", 0.59)]
    assert [(r.name, r.field_concept, r.expected, r.allowed) for r in got["reference_suggestions"].collect()] == [("Nowhere", "field.home", ["x0"], ["city"])]


def test_redundant_births_are_the_plain_rule(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    events = [(rng.randrange(25), k, pick("event.birth", "event.birth", "event.join"), pick(None, "1", "2"), pick(None, "Ann ", "bob", " ")) for k in range(300)]
    fields = [(rng.randrange(25), pick("field.birthplace", "field.age"), pick(None, "1", "2"), pick(None, "ann", "BOB")) for _ in range(40)]
    clean = lambda x: (x or "").strip().lower() or None

    def said(e, f):
        if e[0] != f[0] or f[1] != "field.birthplace":
            return False
        if e[3] and f[2]:
            return e[3] == f[2]
        if clean(e[4]) and clean(f[3]):
            return clean(e[4]) == clean(f[3])
        return not e[3] and not clean(e[4])

    want = sorted(e[1] for e in events if e[2] != "event.birth" or not any(said(e, f) for f in fields))
    got = resolve.not_redundant(spark.createDataFrame(events, "doc_id long, event_id int, concept string, subject_id string, subject string"), spark.createDataFrame(fields, "doc_id long, concept string, subject_id string, subject string"))
    assert sorted(r.event_id for r in got.collect()) == want and len(want) < 280


def test_relations_said_by_fields(spark):
    relations = spark.createDataFrame([(1, "r.from", "The Ann", "Oak"), (1, "r.from", "Bo", None), (2, "r.from", "Ann", "Oak"), (1, "r.to", "Ann", "Oak")], "doc_id long, relation string, subject string, object string")
    fields = spark.createDataFrame([(1, "r.from", "ann", " OAK "), (1, "r.from", "Bo", None)], "doc_id long, relation string, subject string, value string")
    assert sorted((r.doc_id, r.relation, r.subject) for r in resolve.not_said_by_fields(relations, fields).collect()) == [(1, "r.from", "Bo"), (1, "r.to", "Ann"), (2, "r.from", "Ann")]


def test_deep_values(spark):
    pairs = [('{"a":1,"b":{"y":[1,2],"x":null}}', '{"b":{"x":null,"y":[1.0,2]},"a":1}', True), ("[1,2]", "[2,1]", False), ('{"a":null}', "{}", False), (None, None, True), (None, "null", False), ("not json", "not json", True), ("not json", "other", False), ('"1"', "1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.same == r.got for r in df.withColumn("got", values.values_equal(F.col("a"), F.col("b"))).collect())
    assert [r.h is None for r in df.select(values.value_hash(F.col("a")).alias("h")).collect()] == [False, False, False, True, True, True, True, False]


def test_references_are_applied_level_by_level(spark):
    batch = spark.createDataFrame([
        (1, "s1", "a", []), (1, "s2", "b", ["a"]), (1, "s3", None, ["b", "kept"]), (1, "s4", None, ["lost", "also"]), (1, "s5", "c", ["s"]), (1, "s6", "s", ["c"]), (2, "s1", None, ["a"]), (2, "s7", None, None), (1, "s8", None, ["c"]), (1, "s9", "self", ["self"]),
    ], "doc_id long, suggestion_id string, draft_key string, needs array<string>")
    accepted = spark.createDataFrame([(1, "kept", "e9")], "doc_id long, draft_key string, entity_id string")
    got = {(r.doc_id, r.suggestion_id): r for r in resolve.apply_in_order(batch, accepted).collect()}
    assert {k: r.level for k, r in got.items() if r.level is not None} == {(1, "s1"): 0, (1, "s2"): 1, (1, "s3"): 2, (2, "s7"): 0}
    assert {k: r.missing for k, r in got.items() if r.level is None} == {(1, "s4"): "also", (1, "s5"): "s", (1, "s6"): "c", (2, "s1"): "a", (1, "s8"): "c", (1, "s9"): "self"}
    again = {(r.doc_id, r.suggestion_id): r.entity_id for r in resolve.apply_in_order(batch, accepted).collect()}
    assert again == {k: r.entity_id for k, r in got.items()} and got[1, "s1"].entity_id and got[1, "s3"].entity_id is None
    assert resolve.apply_in_order(batch.limit(0), accepted).isEmpty()
