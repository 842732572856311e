"""Schemas as data, edits and versioned saves."""

from pyspark.sql import functions as F

from factloom.operators import matching, relational, schema, suggest
from factloom.functions import text


def test_fields(spark):
    types = spark.range(1).select(F.lit("t").alias("type_id"), F.array().cast(f"array<{schema.FIELD}>").alias("fields"))
    one = schema.add_field(types, "t", schema.field(F.lit("a"), F.lit(" Color "), F.lit("select"), F.array(F.lit("Red"), F.lit("red "), F.lit("Blue")))).drop("error")
    two = schema.add_field(one, "t", schema.field(F.lit("b"), F.lit("Age"), F.lit("number"), F.array(F.lit("x"))))
    assert two.first().error is None
    assert [(f.key, f.label, f.options, f.order) for f in two.first().fields] == [("a", "Color", ["Red", "Blue"], 0), ("b", "Age", [], 1)]
    assert schema.add_field(two.drop("error"), "t", schema.field(F.lit("c"), F.lit("COLOR"), F.lit("text"))).first().error == "duplicate-label"
    renamed = schema.update_field(two.drop("error"), "t", "b", label="Years", kind="text")
    assert [(f.label, f.type) for f in renamed.first().fields] == [("Color", "select"), ("Years", "text")]
    assert schema.update_field(two.drop("error"), "t", "b", label="color").first().error == "duplicate-label"
    assert [(f.key, f.order) for f in schema.delete_field(two.drop("error"), "t", "a").first().fields] == [("b", 0)]


def test_find_or_create(spark):
    types = spark.createDataFrame([("w", "t1", "Heroes", "type.hero"), ("w", "t2", "Towns", None), ("w", "t3", "Ships", None), ("w", "t4", "ships", None)], "world string, type_id string, name string, concept string")
    wanted = spark.createDataFrame([("w", c) for c in ("type.hero", "type.person", "type.town", "type.ship")], "world string, concept string")
    family = spark.createDataFrame([("type.person", "type.hero", 0)], "concept string, related string, rank int")
    aliases = spark.createDataFrame([("type.town", "towns"), ("type.ship", "ships")], "concept string, alias string")
    got = {r.concept: (r.type_id, r.how) for r in schema.find_or_create_types(types, wanted, family, aliases).collect()}
    assert got["type.hero"] == ("t1", "concept") and got["type.person"] == ("t1", "family") and got["type.town"] == ("t2", "alias") and got["type.ship"][1] == "created"


def test_edits_and_saves(spark):
    s = spark.createDataFrame([("a", "p", None, False, []), ("b", "q", "o", True, ["q"]), ("c", "r", None, False, [])], "suggestion_id string, payload string, original_payload string, edited boolean, edit_history array<string>")
    e = spark.createDataFrame([("a", "p2"), ("b", "q2"), ("c", "r")], "suggestion_id string, payload string")
    got = {r.suggestion_id: tuple(r)[1:] for r in schema.record_edit(s, e).collect()}
    assert got == {"a": ("p2", "p", True, ["p2"]), "b": ("q2", "o", True, ["q", "q2"]), "c": ("r", None, False, [])}
    docs = spark.createDataFrame([(1, "T", "x", 4), (2, "U", "y", 1)], "doc_id long, title string, content string, version long")
    saves = spark.createDataFrame([(1, "New", "x", 1), (1, " ", "z", 2), (1, None, "z", 3), (1, None, None, 4), (1, None, "x", 5)], "doc_id long, title string, content string, seq int")
    assert sorted(tuple(r) for r in schema.save_documents(docs, saves).collect()) == [(1, "New", "x", 6), (2, "U", "y", 1)]


def test_plural_words(spark):
    docs = spark.createDataFrame([(1, "Wolves and foxes met a dragon; berries.")], "doc_id int, text string")
    species = spark.createDataFrame([("wolf", "s.wolf", 1.0), ("fox", "s.fox", 0.75), ("dragon", "s.dragon", 1.0)], "expression string, concept_id string, confidence double")
    got = matching.plural_spans(matching.tokens(docs), species, text.singular).collect()
    assert sorted((r.token, r.start, r.end, r.concept_id, round(r.confidence, 2)) for r in got) == [("Wolves", 0, 6, "s.wolf", 0.95), ("foxes", 11, 16, "s.fox", 0.7)]


def test_payloads_keep_null_and_drop_missing(spark):
    df = spark.createDataFrame([("field-update", "e", None, "k", None, 'a"b', "ready"), ("create-entity", None, None, None, None, None, "informational")], "kind string, target_entity_id string, target_draft_key string, field_key string, field_concept string, value string, status string")
    got = [r.x for r in df.select(relational.json_without_missing(df, ["value", "field_key"], F.array(F.lit("value"))).alias("x")).collect()]
    assert got == ['{"value":"a\\"b"}', '{"value":null}']
    assert df.select(suggest.payload(df).alias("x")).first().x == '{"target_entity_id":"e","target_draft_key":null,"field_key":"k","field_concept":null,"value":"a\\"b"}'
    stored, skipped = suggest.split_informational(df)
    assert [r.kind for r in stored.collect()] == ["field-update"] and skipped.count() == 1
