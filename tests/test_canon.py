"""Baselines and first types on hand-written cases."""

from factloom.operators import canon, discovery, inference


def test_every_kind_of_baseline(spark):
    columns = "record_id int, kind string, target_id string, target_name string, field_key string, value string, subject_id string, object_id string, relation string, type_id string, concept string, label string"
    rows = [
        ("field-update", "e1", None, "age", "24", *[None] * 6), ("field-update", None, " ANN后来", "age", "25", *[None] * 6), ("field-update", "gone", "Nobody", "age", "25", *[None] * 6), ("field-update", "e2", None, "age", "1", *[None] * 6), ("field-update", "e2", None, "age", None, *[None] * 6),
        ("relation-update", None, None, None, None, "e1", "e2", "relation.knows", None, None, None), ("relation-update", None, None, None, None, "e2", "e1", "knows", None, None, None),
        ("create-schema-field", None, None, None, None, None, None, None, "t1", "field.age", "x"), ("create-schema-field", None, None, None, None, None, None, None, "t1", None, " AGE "), ("create-schema-field", None, None, None, None, None, None, None, "t2", "field.age", "age"),
        ("create-select-option", None, None, "mood", " happy", None, None, None, "t1", None, None), ("create-select-option", None, None, "mood", "sad", None, None, None, "t1", None, None),
        ("create-entity", None, "Ann今年", None, None, *[None] * 6), ("create-entity", None, "ann", None, None, *[None] * 6), ("event-history", *[None] * 10), ("other", *[None] * 10), (None, *[None] * 10),
    ]
    records = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], columns)
    entities = spark.createDataFrame([("e1", "Ann"), ("e2", "Bo")], "entity_id string, name string")
    values = spark.createDataFrame([("e1", "age", "24.0")], "entity_id string, field_key string, stored string")
    relations = spark.createDataFrame([("e1", "e2", "knows")] * 2, "subject_id string, object_id string, relation string")
    fields = spark.createDataFrame([("t1", "age", "Age", "field.age", None), ("t1", "mood", "Mood", None, ["Happy ", "happy"])], "type_id string, field_key string, label string, concept string, options array<string>")
    got = {r.record_id: r for r in canon.with_baseline(records, entities, values, relations, fields).collect()}
    assert len(got) == len(rows)
    assert [got[k].satisfied or got[k].baseline for k in range(len(rows))] == [
        "field-already-matches-canonical", "field-value", "field-target-missing", "field-value", "field-already-matches-canonical", "relation-already-exists", "relation-presence", "schema-field-already-exists", "schema-field-already-exists", "schema-field-missing",
        "select-option-already-exists", "select-option-missing", "entity-missing", "entity-already-exists", "timeline-not-yet-persisted", "analysis-only", "analysis-only",
    ]
    assert (got[1].entity_id, got[1].entity_name, got[1].current, got[13].entity_name) == ("e1", "Ann", "24", "Ann")


def test_names_alike_by_their_endings(spark):
    hints = ["Tower", "the Gray Tower", "y", "Gray Tower", "wer", "", "ab"]
    names = ["Gray Tower", "Tower", "gray tower", "y", "er", "ab", "b"]
    df = lambda xs, c: spark.createDataFrame([(1, x) for x in xs] + [(2, "Tower")], f"doc_id long, {c} string")

    def alike(h, n):
        h, n = h.lower(), n.lower()
        return 1.0 if h == n and h else 0.88 if len(h) >= 2 and n.endswith(h) else 0.8 if len(n) >= 3 and h.endswith(n) else None

    want = {(h, n, alike(h, n)) for h in hints for n in names if alike(h, n)}
    got = [(r.hint, r.name, r.similarity) for r in discovery.similar_names(df(hints, "hint"), df(names, "name")).where("doc_id = 1").collect()]
    assert set(got) == want and len(got) == len(want)


def test_first_inference(spark):
    table = spark.createDataFrame([("event", "event.join", "subject", ["c"]), ("event", "event.join", "object", ["o", "o"]), ("relation", "r.owns", "object", ["i"]), ("field", "f.age", "subject", ["c"]), ("field", "f.age", "object", ["x"])], "kind string, concept string, role string, expected array<string>")
    cands = spark.createDataFrame([(1, "event.join", "r.owns", None), (2, None, "r.owns", "f.age"), (3, None, None, "f.age"), (4, None, None, None)], "id int, event_concept string, relation_concept string, field_concept string")
    got = {(r.id, r.role): r.expected for r in inference.expected_types(cands, table).collect()}
    assert got == {(1, "subject"): ["c"], (1, "object"): ["o"], (2, "subject"): [], (2, "object"): ["i"], (3, "subject"): ["c"], (3, "object"): [], (4, "subject"): [], (4, "object"): []}
    up = spark.createDataFrame([("type.city", "entityType.location")], "concept string, ancestor string")
    names = spark.createDataFrame([(1, "Old Harbor", "type.city", 0.9, [("type.ship", 0.5), ("type.cat", None)], "suffix", "strong")], "doc_id long, name string, likely_type string, confidence double, alternatives array<struct<concept_id:string,confidence:double>>, evidence_type string, strength string")
    hints = spark.createDataFrame([(1, "Harbor", ["entityType.location"]), (1, "Zed", ["entityType.character"]), (1, "Bo", []), (2, "Harbor", [])], "doc_id long, hint string, expected array<string>")
    out = {(r.doc_id, r.hint): r for r in inference.infer_types(hints, names, up).collect()}
    assert [out[k].status for k in ((1, "Harbor"), (1, "Zed"), (1, "Bo"), (2, "Harbor"))] == ["semantic-scored", "semantic-only", "unresolved", "unresolved"]
    assert out[1, "Harbor"].likely_type == "entityType.location" and out[1, "Harbor"].conflicting == ["type.city"]
    evidence = [(r.concept, round(r.confidence, 6)) for r in inference.type_evidence(hints, names).orderBy("place").collect()]
    assert evidence == [("type.city", 0.792), ("type.cat", 0.528), ("type.ship", 0.44)] and inference.type_evidence(hints, names, 1).count() == 1
    pick = hints.select(inference.fallback_type(hints.expected).alias("f"))
    assert [r.f for r in pick.collect()] == ["entityType.location", "entityType.character", None, None]
