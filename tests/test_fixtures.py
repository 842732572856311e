"""Hand-written cases of every family of operators."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import context, extract, lifecycle, linking, matching, relational, spans, state, trees
from factloom.sources import lexicons


def value(spark, expr, **columns):
    """One expression over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()])
    got = df.select(expr.alias("x")).first().x
    return got.asDict() if hasattr(got, "asDict") else got


def test_scalars(spark):
    X = F.col("x")
    cases = [
        (text.age_value(X), "24", 24), (text.age_value(X), "10001", None), (text.age_value(X), "none", None),
        (text.gravity_value(X), "1.2G", {"value": 1.2, "unit": "g"}), (text.gravity_value(X), "3", {"value": 3, "unit": None}), (text.gravity_value(X), "x", None),
        *((text.singular(X), a, b) for a, b in (("berries", "berry"), ("foxes", "fox"), ("species", "species"), ("glass", "glass"), ("cats", "cat"), ("Wolves", "wolf"), ("churches", "church"), ("bus", "bus"))),
        (text.prefixed(X, "relation."), "member_of", "relation.member_of"), (text.unprefixed(X, "relation."), "relation.member_of", "member_of"), (text.prefixed(X, "relation."), " ", None),
        (text.detect_locale(X), "plain words", "en"), (text.detect_locale(X), "龙与城", "zh-CN"), (text.detect_locale(X), "", "en"), (text.detect_locale(X), "abcdef 龙", "zh-CN"),
        (text.select_options(X), [" Red", "red", "", "Blue "], ["Red", "Blue"]),
        (text.normalize_text(X), "  Ａ\tB　 c\r\n d ", "a b c \n d"), (text.comparison_form(X), ' "Oak  Tree" ', "oaktree"), (text.entity_name_form(X), " The  Gray Tower ", "gray tower"),
        (text.strip_marks(X), "： = red, ", "red"), (text.label_form(X), "Home-World Name", "homeworldname"),
        (text.coordinated(X), "Alice, John, and Mary", ["Alice", "John", "Mary"]), (text.coordinated(X), "Later Alice and Alice", ["Alice"]), (text.coordinated(X), "Alice", []), (text.coordinated(X), "the dog and the cat", []), (text.coordinated(X), "The House of Black & Canada", ["The House of Black", "Canada"]),
        (text.promotable(X), "Oak  Guild", "Oak Guild"), (text.promotable(X), "One. Two! ", None), (text.valid_email(X), " A@B.org ", "a@b.org"), (text.valid_email(X), "a@b", None),
        (text.sentences(X), "One. Two! Three\nfour", ["One. Two!", "Three", "four"]),
        (scores.tier(X), 0.72, "normal"), (scores.tier(X), 0.45, "low-confidence"), (scores.tier(X), 0.4499, "suppressed"), (scores.tier(X, scores.SUGGESTION_TIERS), 0.37, "suppressed"), (scores.tier(X, scores.SUGGESTION_TIERS), 0.38, "very-low-confidence"),
        (F.round(scores.noisy_or(X), 4), [0.7, 0.7], 0.8932), (F.round(scores.saturate(X), 6), 1.0, 0.632121), (scores.salience(X), 1, 0.47), (scores.salience(X), 6, 1.0), (F.round(scores.weakest_link(X, F.lit(0.2)), 6), 0.95, 0.35),
        (scores.clamp01(X), float("nan"), 0.0), (scores.clamp01(X), 3.0, 1.0), (F.round(scores.repetition_bonus(X, F.lit(4)), 6), 0.5, 0.62), (scores.repetition_bonus(X, F.lit(4)), 0.3, 0.3),
        (linking.field_type(X), "Entity-Reference", "entity-reference"), (linking.field_type(X), "Textarea", "long-text"), (linking.select_value(X, F.array(F.lit("Red"), F.lit("Blue"))), " red", {"status": "resolved", "option": "Red"}), (linking.select_value(X, F.array(F.lit("Red"))), "x", {"status": "missing", "option": None}),
        (lifecycle.transition(X, "ignored"), "pending", "ignored"), (lifecycle.transition(X, "ignored"), "accepted", None),
    ]
    for k, (expr, x, want) in enumerate(cases):
        assert value(spark, expr, x=x) == want, (k, x)


def test_joined_key(spark):
    assert value(spark, text.joined_key(F.lit("a"), F.lit(None), F.lit(""), F.lit("b"))) == "a::b"


@pytest.mark.parametrize(
    ("schema", "canonical", "runtime", "want"),
    [
        (None, "text", "text", ("unknown-schema-type", None, "as-is", 0.0)), ("text", None, "text", ("canonical-type-unknown", None, "as-is", 0.5)), ("number", "number", "measured-number", ("compatible", True, "numeric-component", 0.95)),
        ("date", "date", "text", ("exact", True, "as-is", 1.0)), ("long-text", "text", "text", ("compatible", True, "as-is", 0.95)), ("text", "entity-reference", "text", ("compatible-with-warning", True, "reference-name-as-text", 0.85)),
        ("entity-reference", "text", "text", ("requires-reference-resolution", None, "resolve-entity-reference", 0.7)), ("select", "number", "text", ("requires-select-option-check", None, "validate-select-option", 0.8)), ("text", "number", "number", ("compatible-with-warning", True, "stringify", 0.75)), ("date", "number", "number", ("incompatible", False, None, 1.0)),
    ],
)
def test_type_compatibility(spark, schema, canonical, runtime, want):
    got = value(spark, linking.compatibility(F.col("s"), F.col("c"), F.col("r")), s=schema, c=canonical, r=runtime)
    assert (got["status"], got["compatible"], got["strategy"], got["confidence"]) == want


def test_event_replay(spark):
    rows = [(0, "produce", "Rin", "Oak", 0.8), (1, "produce", "Rin", "Oak", 0.9), (2, "end", "Rin", "Oak", 0.7), (3, "end", "Rin", "Oak", 0.9), (4, "produce", "Rin", "Elm", 1.0), (5, "produce", "Rin", "Elm", 1.0), (6, "produce", None, "Elm", 1.0), (7, "end", "Rin", None, 1.0), (8, None, "Rin", "Port", 1.0)]
    events = spark.createDataFrame([("w", s, a, u, "member_of", o, s == 5, s == 4, s == 5, c) for s, a, u, o, c in rows], "world string, seq int, action string, subject string, relation string, object string, negated boolean, intended boolean, uncertain boolean, confidence double")
    history = {r.seq: (r.applied, r.reason) for r in state.replay_history(events).collect()}
    assert history == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, "no-active-relation"), 4: (False, "intended"), 5: (False, "negated"), 6: (False, "missing-subject"), 7: (False, "missing-object"), 8: (False, "non-relation")}
    (row,) = state.replay_state(events).collect()
    assert (row.state, row.started_by, row.last_changed_by, row.ended_by, row.derived_from, row.confidence) == ("ended", 0, 2, 2, [0, 1, 2], 0.7)
    active = state.replay_state(events.where("seq < 2")).first()
    assert (active.state, active.confidence, active.ended_by) == ("active", 0.9, None)


def test_revision_merge(spark):
    stored = {"pending": [("pending", False)], "edited": [("pending", True)], "ignored": [("ignored", False), ("accepted", False)], "corrected": [("accepted", True), ("pending", False)], "accepted": [("accepted", False)], "superseded": [("superseded", False)]}
    rows = [(f"{k}{tail}", n + 1, s, e, "old", 0.5) for k, revs in stored.items() for tail in ("", "-gone") for n, (s, e) in enumerate(revs)]
    revisions = spark.createDataFrame(rows, "semantic_key string, revision int, status string, edited boolean, payload string, confidence double")
    incoming = spark.createDataFrame([(k, "new", 0.9) for k in [*stored, "fresh"]] + [("fresh", "worse", 0.1)], "semantic_key string, payload string, confidence double")
    plan = {r.semantic_key: (r.action, r.revision) for r in lifecycle.plan_merge(incoming, revisions).collect()}
    assert {k: v for k, v in plan.items() if "-gone" not in k} == {"pending": ("refresh", 1), "edited": ("refresh-metadata", 1), "ignored": ("preserve", None), "corrected": ("preserve", None), "accepted": ("create-revision", 2), "superseded": ("reactivate", 1), "fresh": ("create", 1)}
    assert {k[:-5]: v[0] for k, v in plan.items() if "-gone" in k} == {"pending": "supersede", "edited": "supersede", "ignored": "unchanged", "corrected": "supersede", "accepted": "unchanged", "superseded": "unchanged"}
    after = {(r.semantic_key, r.revision): (r.status, r.payload) for r in lifecycle.merge_revisions(incoming, revisions).collect()}
    assert after["pending", 1] == ("pending", "new") and after["edited", 1] == ("pending", "old") and after["accepted", 2] == ("pending", "new") and after["superseded", 1] == ("pending", "new") and after["fresh", 1] == ("pending", "new") and after["pending-gone", 1] == ("superseded", "old")
    assert len(after) == len(rows) + 2


def test_span_rules(spark):
    def made(rows):
        return spark.createDataFrame([(1, "c", "k", "alias", n, *r) for n, r in enumerate(rows)], "doc_id int, concept_id string, category string, evidence_type string, seq int, start int, end int, confidence double")

    kept = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert kept(matching.collapse_evidence(made([(0, 4, 0.75), (1, 3, 1.0)]))) == [(0, 4), (1, 3)]
    assert kept(matching.collapse_evidence(made([(0, 4, 1.0), (1, 3, 1.0)]))) == [(0, 4)]
    assert kept(spans.suppress_nested(made([(0, 5, 1.0), (1, 3, 1.0), (4, 7, 1.0)]), ["doc_id"], "seq")) == [(0, 5), (4, 7)]
    arr = made([(0, 5, 1.0), (0, 10, 1.0), (6, 12, 1.0)]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s")).select(spans.non_overlapping(F.col("s")).alias("s")).first().s
    assert [(x.start, x.end) for x in arr] == [(0, 10)]
    assert kept(spans.drop_less_specific(made([(0, 5, 0.8), (1, 3, 0.9), (6, 7, 0.1)]), ["doc_id"], "seq")) == [(0, 5), (6, 7)]


def test_linking(spark):
    entities = spark.createDataFrame([("e1", "Gray Tower", ["The Spire"], "type.place"), ("e2", "Nova", [], "type.city"), ("e3", "Nova", [], "type.ship")], "entity_id string, name string, aliases array<string>, type string")
    hints = spark.createDataFrame([(1, "the Gray  Tower", []), (2, "spire", []), (3, "Nova", ["type.city"]), (4, "Nova", []), (5, "Zed", []), (6, "nova", ["type.place"])], "hint_id int, hint string, expected array<string>")
    up = lexicons.closure(spark.createDataFrame([("type.place", None), ("type.city", "type.place"), ("type.ship", None)], "concept_id string, parent string"))
    got = {r.hint_id: (r.status, r.strategy, r.entity_id, r.confidence) for r in linking.link(hints, entities, up).collect()}
    assert got[1] == ("resolved", "exact-name", "e1", 1.0) and got[2] == ("resolved", "exact-alias", "e1", 0.98) and got[3] == ("resolved", "exact-name", "e2", 1.0)
    assert got[4][:3] == ("ambiguous", None, None) and got[5][0] == "missing" and got[6][2] == "e2"


def test_field_mapping_and_drafts(spark):
    fields = spark.createDataFrame([("t", "f1", "Age", "field.age"), ("t", "f2", "Home World", None), ("t", "f3", "home-world", None), ("u", "f4", "Years", None)], "type_id string, field_key string, label string, concept string")
    labels = spark.createDataFrame([("field.age", "years"), ("field.home", "homeworld")], "concept string, label string")
    wanted = spark.createDataFrame([("t", "field.age"), ("t", "field.home"), ("u", "field.age"), ("u", "field.home")], "type_id string, concept string")
    got = {(r.type_id, r.concept): (r.status, r.field_key, r.confidence) for r in linking.map_fields(wanted, fields, labels).collect()}
    assert got == {("t", "field.age"): ("resolved", "f1", 1.0), ("t", "field.home"): ("ambiguous", None, None), ("u", "field.age"): ("resolved", "f4", 0.95), ("u", "field.home"): ("missing", None, None)}
    drafts = spark.createDataFrame([("rin",)], "draft_key string")
    cands = spark.createDataFrame([("The Rin", None, "Oak", "e1")], "subject_hint string, subject_id string, object_hint string, object_id string")
    row = linking.attach_drafts(cands, drafts).first()
    assert row.subject_draft == "rin" and row.object_draft is None


def test_ordered_tree(spark):
    nodes = spark.createDataFrame([("w", "A", None, 0), ("w", "B", None, 1), ("w", "C", None, 2), ("w", "X", "B", 0), ("w", "Y", "B", 1)], "world string, node string, parent string, order int")
    order = lambda df, parent: [r.node for r in df.where(F.col("parent").eqNullSafe(F.lit(parent))).orderBy("order").collect()]
    assert order(trees.move(nodes, "C", None, 0), None) == ["C", "A", "B"]
    assert order(trees.move(nodes, "A", "B", 1), "B") == ["X", "A", "Y"]
    assert order(trees.delete(nodes, "B"), None) == ["A", "X", "Y", "C"]
    with pytest.raises(ValueError):
        trees.move(nodes, "B", "X", 0)


def test_matching_and_chinese_rules(spark, tmp_path):
    lex = lexicons.from_rows(spark, [("fields", "field.color", "alias", "strong", "color"), ("events", "event.join", "alias", "normal", "joined the")])
    docs = spark.createDataFrame([(1, "The color is Red, and Colors; color: blue."), (2, "Ann  joined the Guild"), (3, None)], "doc_id int, text string")
    found = matching.match_lexicon(docs, lex)
    assert sorted((r.doc_id, r.expression, r.start, r.confidence) for r in found.collect()) == [(1, "color", 4, 1.0), (1, "color", 30, 1.0), (2, "joined the", 4, 0.75)]
    clause = docs.select("doc_id", F.explode(text.clauses(text.normalize_text(F.col("text"), compose=False))).alias("c")).select("doc_id", "c.*")
    got = sorted((r.value, round(r.confidence, 2)) for r in extract.extract_labeled(found, clause).collect())
    assert got == [("blue", 0.95), ("red", 0.95)]
    zh = spark.createDataFrame([(1, "林恩24岁。她出生于灰塔城，后来离开。")], "doc_id int, text string")
    clause = zh.select("doc_id", F.explode(text.clauses(F.col("text"), "zh-CN")).alias("c")).select("doc_id", "c.*")
    assert sorted((r.field_concept, r.value, r.start) for r in extract.extract_patterns(clause, "zh-CN").collect()) == [("field.age", "24", 2), ("field.birthplace", "灰塔城", 7)]
    path = tmp_path / "fields.json"
    path.write_text('{"entries": [{"conceptId": "field.age", "aliases": {"strong": ["age", " "], "weak": ["years"]}, "suffixes": {"normal": ["old"]}}]}')
    read = lexicons.read_category(spark, str(path), "en", "fields")
    assert sorted((r.expression, r.evidence_type, r.score) for r in read.collect()) == [("age", "alias", 1.0), ("old", "suffix", 0.6), ("years", "alias", 0.45)]
    with pytest.raises(ValueError):
        lexicons.read_category(spark, str(path), "en", "nothing")
    with pytest.raises(ValueError):
        lexicons.checked(read, spark.createDataFrame([("x",)], "concept_id string"))


def test_antecedents(spark):
    df = spark.createDataFrame([(1, 0, 10, True, False, True, 2), (2, 3, 200, False, False, False, 1)], "id int, back int, gap int, subj boolean, obj boolean, disc boolean, n int")
    got = {r.id: r.s for r in df.select("id", F.round(context.antecedent_score(F.col("back"), F.col("gap"), F.col("subj"), F.col("obj"), F.col("disc"), F.col("n")), 6).alias("s")).collect()}
    assert got == {1: round(1 - 2.718281828459045 ** -(0.42 + 0.26 + 0.34 + 0.26 + 0.06), 6), 2: 0.0}


def test_guards(spark):
    df = spark.createDataFrame([("Oak",), ("oak",), ("Elm",)], "name string")
    assert [relational.exact_name(df, "name", F.lit(x)).first().status for x in ("OAK", "elm", "x")] == ["ambiguous", "resolved", "missing"]
