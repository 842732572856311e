"""Linking, contracts, applying and time windows over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import events as event_ops
from ..operators import linking, matching, state, suggest
from ..sources import lexicons
from ..streaming import replay
from .registry import query

_CONTRACT = """s AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'field-update' WHEN 1 THEN 'relation-update' WHEN 2 THEN 'create-entity' WHEN 3 THEN 'create-schema-field' WHEN 4 THEN 'event-history' WHEN 5 THEN 'nothing' ELSE NULL END AS kind,
CASE WHEN event_id % 2 = 0 THEN 'e' || user_id END AS target_entity_id, CASE WHEN event_id % 3 = 0 THEN 'k' END AS field_key, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS value, CASE WHEN event_id % 4 = 0 THEN 'r' END AS relation_concept,
CASE WHEN event_id % 3 = 1 THEN 'a' END AS subject_entity_id, CASE WHEN event_id % 2 = 1 THEN 'b' END AS object_draft_key, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'n' END AS name, CASE WHEN event_id % 8 = 0 THEN 'v' END AS event_concept FROM events)"""


@query(f"""WITH {_CONTRACT} SELECT event_id, concat_ws('|', CASE WHEN kind IS NULL OR kind = 'nothing' THEN 'kind' END, CASE WHEN kind = 'field-update' AND target_entity_id IS NULL THEN 'target_entity_id' END, CASE WHEN kind = 'field-update' AND field_key IS NULL THEN 'field_key' END, CASE WHEN kind = 'field-update' AND trim(value) = '' THEN 'value' END,
CASE WHEN kind = 'relation-update' AND subject_entity_id IS NULL THEN 'subject_entity_id' END, CASE WHEN kind = 'relation-update' AND relation_concept IS NULL THEN 'relation_concept' END, CASE WHEN kind = 'relation-update' AND object_draft_key IS NULL THEN 'object_entity_id' END, CASE WHEN kind = 'create-entity' AND trim(name) = '' THEN 'name' END,
CASE WHEN kind = 'create-schema-field' THEN 'target_type_id|field_concept|suggested_label|suggested_value_type' END, CASE WHEN kind = 'event-history' AND event_concept IS NULL THEN 'event_concept' END) AS errors FROM s""")
def contract_check(spark, t):
    """what each suggestion lacks by its kind."""
    k = F.col("event_id")
    kind = F.when(k % 7 == 0, "field-update").when(k % 7 == 1, "relation-update").when(k % 7 == 2, "create-entity").when(k % 7 == 3, "create-schema-field").when(k % 7 == 4, "event-history").when(k % 7 == 5, "nothing")
    rows = t("events").select("event_id", kind.alias("kind"), F.when(k % 2 == 0, F.concat(F.lit("e"), "user_id")).alias("target_entity_id"), F.when(k % 3 == 0, "k").alias("field_key"), F.when(k % 5 == 0, "").otherwise(F.col("event_type")).alias("value"), F.when(k % 4 == 0, "r").alias("relation_concept"), F.when(k % 3 == 1, "a").alias("subject_entity_id"), F.when(k % 2 == 1, "b").alias("object_draft_key"), F.when(k % 9 == 0, " ").otherwise("n").alias("name"), F.when(k % 8 == 0, "v").alias("event_concept"))
    return rows.select("event_id", F.array_join(suggest.contract_errors(rows), "|").alias("errors"))


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS entity_id FROM (SELECT p.p_partkey, count(s.s_suppkey) AS n, min(s.s_suppkey) AS id FROM part p LEFT JOIN supplier s ON 'supplier of ' || (s.s_nationkey * 3) = 'supplier of ' || (p.p_size * 2) GROUP BY 1)""")
def entity_linking(spark, t):
    """Hints to entities by normal form; ties are ambiguous."""
    entities = t("supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("The  Supplier of "), F.col("s_nationkey") * 3).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("type"))
    hints = t("part").select(F.col("p_partkey").alias("hint_id"), F.concat(F.lit("supplier OF "), F.col("p_size") * 2).alias("hint"), F.array().cast("array<string>").alias("expected"))
    return linking.link(hints, entities).select(F.col("hint_id").alias("p_partkey"), "status", "entity_id")


@query("""WITH x AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN 'text' WHEN 2 THEN 'long-text' WHEN 3 THEN 'number' WHEN 4 THEN 'date' WHEN 5 THEN 'entity-reference' WHEN 6 THEN 'select' ELSE 'boolean' END AS s,
CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'text' WHEN 2 THEN 'number' WHEN 3 THEN 'entity-reference' WHEN 4 THEN 'date' ELSE 'long-text' END AS c, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'number' ELSE 'measured-number' END AS r FROM part)
SELECT p_partkey, CASE WHEN s IS NULL THEN 'unknown-schema-type' WHEN c IS NULL THEN 'canonical-type-unknown' WHEN c = 'number' AND s = 'number' AND r = 'measured-number' THEN 'compatible' WHEN c = s THEN 'exact' WHEN c IN ('text', 'long-text') AND s IN ('text', 'long-text') THEN 'compatible'
WHEN c = 'entity-reference' AND s IN ('text', 'long-text') THEN 'compatible-with-warning' WHEN (c = 'text' OR r = 'text') AND s = 'entity-reference' THEN 'requires-reference-resolution' WHEN (c = 'text' OR r = 'text') AND s = 'select' THEN 'requires-select-option-check' WHEN s IN ('text', 'long-text') THEN 'compatible-with-warning' ELSE 'incompatible' END AS status FROM x""")
def type_compatibility(spark, t):
    """the ordered decision table."""
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int") + 1)
    s = pick(F.col("p_size"), None, "text", "long-text", "number", "date", "entity-reference", "select", "boolean")
    c = pick(F.col("p_partkey"), None, "text", "number", "entity-reference", "date", "long-text")
    r = pick(F.col("p_partkey"), "text", "number", "measured-number", "measured-number")
    return t("part").select("p_partkey", linking.compatibility(s, c, r)["status"].alias("status"))


@query("""WITH e AS (SELECT user_id, 'f' || event_id % 3 AS f, arg_max(event_type, event_id) AS v FROM events GROUP BY 1, 2) SELECT c_custkey AS entity_id, concat_ws('|', coalesce((SELECT v FROM e WHERE user_id = c_custkey AND f = 'f0'), c_mktsegment), (SELECT v FROM e WHERE user_id = c_custkey AND f = 'f1'), (SELECT v FROM e WHERE user_id = c_custkey AND f = 'f2')) AS "values" FROM customer""")
def apply_updates(spark, t):
    """M7: accepted field updates on entities; the last of a field wins."""
    entities = t("customer").select(F.col("c_custkey").alias("entity_id"), F.create_map(F.lit("f0"), "c_mktsegment").alias("values"))
    accepted = t("events").select(F.col("user_id").alias("entity_id"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("field_key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    done = suggest.apply_field_updates(entities, accepted)
    return done.select("entity_id", F.concat_ws("|", *(F.try_element_at("values", F.lit(f)) for f in ("f0", "f1", "f2"))).alias("values"))


@query("""SELECT world, subject, relation, object, version FROM (SELECT o_custkey % 50 AS world, 's' || o_orderkey % 9 AS subject, 'r' AS relation, o_orderpriority AS object, 1 AS version, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 9, o_orderpriority) AS k FROM orders WHERE o_orderkey % 2 = 0) WHERE k = 1
UNION ALL SELECT DISTINCT world, subject, relation, object, 2 FROM (SELECT o_custkey % 50 AS world, 's' || o_orderkey % 9 AS subject, 'r' AS relation, o_orderpriority AS object FROM orders WHERE o_orderkey % 2 = 1) n WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 2 = 0 AND o.o_custkey % 50 = n.world AND 's' || o.o_orderkey % 9 = n.subject AND o.o_orderpriority = n.object)""")
def apply_relations(spark, t):
    """Accepted edges that don't exist yet are added once."""
    edge = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("world"), F.concat(F.lit("s"), F.col("o_orderkey") % 9).alias("subject"), F.lit("r").alias("relation"), F.col("o_orderpriority").alias("object"))
    keys = ["world", "subject", "relation", "object"]
    old = edge.where("o_orderkey % 2 = 0").select(*keys).distinct().withColumn("version", F.lit(1))
    return suggest.apply_relations(old, edge.where("o_orderkey % 2 = 1").select(*keys).withColumn("version", F.lit(2)), keys)


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, t):
    """Counts by hour of event time (batch form of the streaming query)."""
    return replay.windowed_counts(t("events"), "ts", "1 hour", "10 minutes", "event_type")


@query("""SELECT user_id, string_agg(f, '|' ORDER BY s) AS fields FROM (SELECT user_id, event_type AS f, min(event_id) AS s FROM events GROUP BY 1, 2) GROUP BY 1""")
def recommended_fields(spark, t):
    """A draft's distinct fields in the order of their first sighting."""
    out = linking.recommended_fields(t("events").withColumnRenamed("event_type", "f"), "user_id", "f", "event_id")
    return out.select("user_id", F.array_join("fields", "|").alias("fields"))


@query("""WITH g AS (SELECT user_id, event_type, max(value) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM g) SELECT user_id, max(event_type) FILTER (WHERE k = 1) AS kind, max(c) AS confidence, string_agg(event_type, '|' ORDER BY k) FILTER (WHERE k > 1) AS alternatives FROM r GROUP BY 1""")
def merged_evidence(spark, t):
    """A5: the surest kind of an entity and its alternatives."""
    e = t("events").select("user_id", F.col("event_type").alias("kind"), F.col("value").alias("confidence"), "props")
    out = linking.merge_evidence(e, ["user_id"], "kind", "confidence", "props")
    return out.select("user_id", "kind", "confidence", F.array_join("alternatives", "|").alias("alternatives"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, max(value / 150) AS c FROM events GROUP BY 1) SELECT user_id, n AS occurrences, round(CASE WHEN c >= 0.32 THEN greatest(c, least(0.95, c + least(0.12, (n - 1) * 0.05))) ELSE c END, 6) AS confidence FROM g""")
def repeated_suggestions(spark, t):
    """Sightings of a name joined; repetition makes them surer."""
    e = t("events").select("user_id", F.col("event_type").alias("kind"), (F.col("value") / 150).alias("confidence"), "event_id")
    return linking.merge_suggestions(e, "user_id", "kind", "confidence", "event_id").select("user_id", "occurrences", F.round("confidence", 6).alias("confidence"))


_STORY = "Alice and John joined the Guild. Later Alice left, and Bob joined Port Elm. She did not join the Crew. Bob left."
#: Events of the story, with what they do to relations.
STORY_LEXICON = (("events", "event.join", "alias", "normal", "joined"), ("events", "event.join", "alias", "normal", "join"), ("events", "event.leave", "alias", "normal", "left"), ("modifiers", "modifier.negation", "alias", "strong", "did not"))


def story_events(spark, docs):
    """Events of (doc_id, text) by the story lexicon."""
    lex = lexicons.from_rows(spark, STORY_LEXICON)
    concepts = spark.createDataFrame([("event.join", "member_of", None), ("event.leave", None, "member_of")], "concept_id string, produces string, ends string")
    clauses = text.clause_rows(docs)
    return event_ops.assemble(clauses, matching.match_lexicon(docs, lex), concepts)


_SECOND = "Mara joined the Fleet. Oswin did not join the Fleet. Later Oswin joined Port Elm."


@query("""SELECT n.doc_id, v.subject, v.object, v.state FROM documents n JOIN (VALUES (0, 'Alice', 'Guild', 'active'), (0, 'John', 'Guild', 'active'), (0, 'Bob', 'Port Elm', 'active'), (1, 'Mara', 'Fleet', 'active'), (1, 'Oswin', 'Port Elm', 'active')) v(k, subject, object, state) ON n.doc_id % 2 = v.k""")
def story_state(spark, t):
    """Whole texts, each with a story at its end, to events to the relations that hold."""
    story = F.when(F.col("doc_id") % 2 == 0, _STORY).otherwise(_SECOND)
    docs = t("documents").select("doc_id", F.concat("text", F.lit("\n"), story).alias("text"))
    return state.replay_state(event_ops.relation_log(story_events(spark, docs))).select(F.col("world").alias("doc_id"), "subject", "object", "state")


@query("""WITH e AS (SELECT s_suppkey AS id, s_nationkey AS world, 'n' || s_suppkey % 7 AS name FROM supplier), h AS (SELECT c_custkey, c_nationkey AS world, 'n' || c_custkey % 9 AS name FROM customer)
SELECT c_custkey, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS entity_id FROM (SELECT h.c_custkey, count(e.id) AS n, min(e.id) AS id FROM h LEFT JOIN e ON e.world = h.world AND e.name = h.name GROUP BY 1)""")
def linking_in_world(spark, t):
    """A hint meets the entities of its own world only."""
    none = F.array().cast("array<string>")
    entities = t("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("world"), F.concat(F.lit("N"), F.col("s_suppkey") % 7).alias("name"), none.alias("aliases"), F.lit(None).cast("string").alias("type"))
    hints = t("customer").select(F.col("c_custkey").alias("hint_id"), F.col("c_nationkey").alias("world"), F.concat(F.lit("the n"), F.col("c_custkey") % 9).alias("hint"), none.alias("expected"))
    return linking.link(hints, entities, world="world").select(F.col("hint_id").alias("c_custkey"), "status", "entity_id")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'field-update' WHEN 1 THEN 'create-entity' ELSE 'create-select-option' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'name' WHEN p_size % 3 = 1 THEN 'value' ELSE 'likely_type_concept' END AS k, p_brand, p_name FROM part),
y AS (SELECT *, CASE kind WHEN 'create-entity' THEN k IN ('name', 'likely_type_concept') ELSE k = 'value' END AS ok FROM x)
SELECT p_partkey, ok AS accepted, CASE WHEN ok THEN CASE WHEN k = 'name' THEN p_brand ELSE p_name END END AS name, CASE WHEN ok AND k <> 'name' THEN p_brand END AS changed FROM y""")
def edited_suggestions(spark, t):
    """A user's patch changes the editable keys of a kind and is refused for any other."""
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 3).cast("int") + 1)
    key = pick("p_size", "name", "value", "likely_type_concept")
    out = suggest.edited_payload(pick("p_partkey", "field-update", "create-entity", "create-select-option"), F.create_map(F.lit("name"), "p_name"), F.create_map(key, F.col("p_brand")))
    row = t("part").select("p_partkey", key.alias("k"), out.alias("x"))
    return row.select("p_partkey", F.col("x").isNotNull().alias("accepted"), F.col("x")["name"].alias("name"), F.when(F.col("k") != "name", F.try_element_at("x", "k")).alias("changed"))
