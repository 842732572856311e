"""Relations, names, type evidence, dependencies."""

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import context, discovery, linking
from factloom.sources import lexicons

KINDS = {"role.captain": "role-signal", "relation.lives_in": "relation", "relation.friend": "relation", "type.guild": "entity-type", "event.join": "event"}
LEXICON = (("titles", "role.captain", "alias", "strong", "captain"), ("relations", "relation.lives_in", "alias", "strong", "lives in"), ("relations", "relation.friend", "alias", "normal", "is a friend of"), ("entityTypes", "type.guild", "suffix", "strong", "guild"), ("events", "event.join", "alias", "strong", "joined"))


def made(spark, body):
    from factloom.operators import matching

    docs = spark.createDataFrame([(1, body)], "doc_id int, text string")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    found = matching.match_lexicon(docs, lexicons.from_rows(spark, LEXICON)).withColumn("kind", kind[F.col("concept_id")])
    clauses = docs.select("doc_id", F.explode(text.clauses(F.col("text"))).alias("c")).select("doc_id", "c.*")
    return docs, found, clauses


def test_relations_and_preferred_fields(spark):
    _, found, clauses = made(spark, "Captain Rin Ash lives in the Oak City, and sleeps. Bob is a friend of Ann who joined the Guild. He lives in Port.")
    rel = discovery.extract_relations(found, clauses)
    got = sorted((r.clause_idx, r.relation, r.subject, r.object, round(r.confidence, 2)) for r in rel.collect())
    assert got == [(0, "relation.lives_in", "Rin Ash", "Oak City", 0.98), (1, "relation.friend", "Bob", "Ann", 0.81), (2, "relation.lives_in", "He", "Port", 0.98)]
    assert sorted((r.field_concept, r.subject, r.value, round(r.confidence, 2)) for r in discovery.preferred_fields(rel).collect()) == [("field.residence", "He", "Port", 0.96), ("field.residence", "Rin Ash", "Oak City", 0.96)]


def test_names_around_evidence(spark):
    docs, found, _ = made(spark, "They met the Iron Hand Guild and a guild. Old Captain came.")
    names = discovery.discover_names(found, docs, ["guild"])
    got = sorted((r.name, r.start, r.end, r.likely_type, round(r.confidence, 2)) for r in names.collect())
    assert got == [("Iron Hand Guild", 13, 28, "type.guild", 0.93), ("Old Captain", 42, 53, "entityType.character", 1.0)]
    kept = discovery.reject_terms(names, spark.createDataFrame([("old captain",)], "term string"))
    assert [r.name for r in kept.collect()] == ["Iron Hand Guild"]


def test_similarity_and_types(spark):
    hints = spark.createDataFrame([(1, "Hand Guild", ["type.group"]), (1, "Rin", [])], "doc_id int, hint string, expected array<string>")
    names = spark.createDataFrame([(1, "Iron Hand Guild", "type.guild", "suffix", "strong", 0.9), (1, "rin", "type.person", "alias", "weak", 0.8), (2, "Rin", "type.x", "alias", "weak", 0.8)], "doc_id int, name string, likely_type string, evidence_type string, strength string, confidence double")
    alike = discovery.similar_names(hints, names)
    assert sorted((r.hint, r.name, r.similarity) for r in alike.collect()) == [("Hand Guild", "Iron Hand Guild", 0.88), ("Rin", "rin", 1.0)]
    evidence = discovery.lexical_evidence(alike.join(names, ["doc_id", "name"])).unionByName(discovery.expected_evidence(hints))
    closure = lexicons.closure(spark.createDataFrame([("type.group", None), ("type.guild", "type.group"), ("type.person", None)], "concept_id string, parent string"))
    ranked = {r.hint: r for r in context.rank_types(discovery.with_expectation(evidence, hints, closure), ["doc_id", "hint"], "concept", "score").collect()}
    assert ranked["Hand Guild"].best == "type.group" and ranked["Hand Guild"].alternatives == ["type.guild"] and ranked["Rin"].best == "type.person"
    assert abs(ranked["Hand Guild"].score - (1 - 2.718281828459045 ** -(0.72 + 0.12))) < 1e-9
    prior = discovery.prior_evidence(spark.createDataFrame([(1, "Rin", "t", 0.5)], "doc_id int, hint string, concept string, confidence double")).first()
    memory = discovery.memory_evidence(spark.createDataFrame([(1, "Rin", "t", 0.5, 2, 9, 1.0)], "doc_id int, hint string, concept string, confidence double, n int, mentions int, salience double")).first()
    assert prior.score == 0.12 and abs(memory.score - (0.58 * 0.5 * 0.78 + 0.24)) < 1e-9


def test_pronouns_only_when_resolved(spark):
    rows = [(1, "She", "Ann", "resolved"), (1, "her", "Ann", None), (1, "he", "Bob", "ambiguous"), (1, "they", "Cy", "resolved"), (1, "她", None, "resolved"), (2, "他", "Lin", "resolved")]
    got = discovery.pronoun_genders(spark.createDataFrame(rows, "doc_id int, pronoun string, subject string, status string")).collect()
    assert sorted((r.doc_id, r.subject, r.value, r.confidence) for r in got) == [(1, "Ann", "female", 0.93), (2, "Lin", "male", 0.93)]


def test_scores(spark):
    one = spark.range(1).select(
        discovery.relation_score(F.lit(True), F.lit(False), F.lit(1.0), F.lit(0.5), F.lit(1.0), F.lit(None).cast("double"), F.lit(True)).alias("r"),
        discovery.event_score(F.lit(0.9), F.lit(0.5), F.lit(None).cast("double")).alias("e"),
    ).first()
    assert abs(one.r - (1 - 2.718281828459045 ** -(0.46 + 0.24 - 0.48 + 0.08 + 0.18))) < 1e-9
    assert abs(one.e - (0.58 + (0.9 - 0.58) * 0.2)) < 1e-9


def test_mention_rules(spark):
    sentences = spark.createDataFrame([(1, 0, "Rin married Bob and Bob knows Elm")], "doc_id int, sentence_idx int, text string")
    mentions = spark.createDataFrame([(1, 0, "rin", 0, 3), (1, 0, "bob", 12, 15), (1, 0, "bob", 20, 23), (1, 0, "elm", 30, 33)], "doc_id int, sentence_idx int, entity_id string, start int, end int")
    got = discovery.mention_relations(mentions, sentences, [("spouse", "Married", 0.9), ("knows", "knows", 0.5)]).collect()
    assert sorted((r.subject, r.object, r.relation) for r in got) == [("bob", "elm", "knows"), ("rin", "bob", "spouse"), ("rin", "elm", "spouse")]


def test_dependencies_and_renames(spark):
    schema = "doc_id int, id int, subject_entity_id string, subject_draft_key string, subject_name string, edit_history array<string>"
    pending = spark.createDataFrame([(1, 1, None, "rin", "Rin", []), (1, 2, None, None, "Oak", []), (1, 3, None, "elm", "Oak", []), (1, 4, "e0", None, "Oak", []), (2, 5, None, "rin", "Rin", [])], schema)
    accepted = spark.createDataFrame([(1, "rin", "Rin", "e1"), (1, None, "Oak", "e2")], "doc_id int, draft_key string, name string, entity_id string")
    got = {r.id: (r.subject_entity_id, r.subject_draft_key) for r in discovery.materialize(pending, accepted, ["subject"]).collect()}
    assert got == {1: ("e1", None), 2: ("e2", None), 3: (None, "elm"), 4: ("e0", None), 5: (None, "rin")}
    renamed = {r.id: (r.subject_name, r.edit_history) for r in discovery.rename_drafts(pending, spark.createDataFrame([(1, "rin", "Rina")], "doc_id int, draft_key string, new_name string"), "subject").collect()}
    assert renamed[1] == ("Rina", ["Rin -> Rina"]) and renamed[5] == ("Rin", []) and renamed[2] == ("Oak", [])


def test_draft_types_and_variants(spark):
    drafts = spark.createDataFrame([("a", "type.group", ["type.place"]), ("b", "type.place", []), ("c", "type.x", ["type.group"])], "draft_key string, likely string, expected array<string>")
    types = spark.createDataFrame([("t1", "type.guild", 1), ("t2", "type.place", 0)], "type_id string, type_concept string, seq int")
    closure = lexicons.closure(spark.createDataFrame([("type.group", None), ("type.guild", "type.group"), ("type.place", None), ("type.x", None)], "concept_id string, parent string"))
    got = {r.draft_key: (r.type_id, r.tier) for r in linking.best_type(drafts, types, closure).collect()}
    assert got == {"a": ("t1", 1), "b": ("t2", 0), "c": ("t1", 2)}
    forms = spark.range(1).select(linking.variants(F.lit("林恩后来")).alias("v")).first().v
    assert [(x.priority, x.form) for x in forms] == [(0, "林恩后来"), (1, "林恩")]
