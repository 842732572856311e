"""Suggestions against what is stored, and first types of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canon, inference
from .registry import query

_KINDS = ("field-update", "relation-update", "create-schema-field", "create-select-option", "create-entity", "event-history")


@query(f"""WITH r AS (SELECT event_id AS record_id, {list(_KINDS)}[event_id % 6 + 1] AS kind, user_id AS u, event_id AS k FROM events), e AS (SELECT s_suppkey AS id, 'Supplier ' || s_suppkey AS name FROM supplier),
f AS (SELECT s_suppkey % 25 AS t, 'f' || s_suppkey % 8 AS key, 'label ' || s_suppkey % 13 AS label, 'c' || s_suppkey % 10 AS concept, 'opt ' || s_nationkey % 6 AS opt FROM supplier),
m AS (SELECT r.*, CASE kind WHEN 'field-update' THEN (SELECT id FROM e WHERE e.id = r.u) WHEN 'create-entity' THEN (SELECT id FROM e WHERE e.id = r.u) END AS entity_id FROM r),
s AS (SELECT *, CASE kind WHEN 'field-update' THEN CASE WHEN entity_id % 3 > 0 AND entity_id % 5 = k % 5 THEN 'field-already-matches-canonical' END WHEN 'relation-update' THEN CASE WHEN EXISTS (SELECT 1 FROM supplier x WHERE x.s_suppkey = u AND x.s_nationkey % 7 = k % 7) THEN 'relation-already-exists' END
  WHEN 'create-schema-field' THEN CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.t = u % 20 AND (f.concept = 'c' || k % 9 OR f.label = 'label ' || k % 11)) THEN 'schema-field-already-exists' END WHEN 'create-select-option' THEN CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.t = u % 20 AND f.key = 'f' || k % 8 AND f.opt = 'opt ' || k % 10) THEN 'select-option-already-exists' END
  WHEN 'create-entity' THEN CASE WHEN entity_id IS NOT NULL THEN 'entity-already-exists' END END AS satisfied FROM m)
SELECT record_id, kind, satisfied, CASE WHEN satisfied IS NULL THEN CASE kind WHEN 'field-update' THEN CASE WHEN entity_id IS NULL THEN 'field-target-missing' ELSE 'field-value' END WHEN 'relation-update' THEN 'relation-presence' WHEN 'create-schema-field' THEN 'schema-field-missing' WHEN 'create-select-option' THEN 'select-option-missing' WHEN 'create-entity' THEN 'entity-missing' ELSE 'timeline-not-yet-persisted' END END AS baseline,
  CASE WHEN kind = 'field-update' AND entity_id % 3 > 0 THEN '{{"a":1,"b":' || entity_id % 5 || '}}' END AS current, entity_id, CASE WHEN entity_id IS NOT NULL THEN 'Supplier ' || entity_id END AS entity_name FROM s""")
def canon_baseline(spark, t):
    """Suggestions of every kind against stored values, relations, fields, options and entities."""
    k, u, s = F.col("event_id"), F.col("user_id"), F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int"))
    value = F.when(k % 6 == 0, F.concat(F.lit('{"b": '), k % 5, F.lit(', "a": 1.0}'))).otherwise(F.concat(F.lit(" OPT "), k % 10))
    records = t("events").select(
        k.alias("record_id"), kind.alias("kind"), F.when(k % 12 == 0, u).alias("target_id"), F.concat(F.lit(" SUPPLIER "), u, F.when(k % 4 == 2, "后来").otherwise("")).alias("target_name"), F.when(k % 6 == 0, "mood").otherwise(F.concat(F.lit("f"), k % 8)).alias("field_key"), value.alias("value"),
        u.alias("subject_id"), (k % 7).alias("object_id"), F.lit("relation.knows").alias("relation"), (u % 20).alias("type_id"), F.concat(F.lit("c"), k % 9).alias("concept"), F.concat(F.lit(" Label "), k % 11).alias("label"),
    )
    base = t("supplier")
    entities = base.select(s.alias("entity_id"), F.concat(F.lit("Supplier "), s).alias("name"))
    stored = base.where(s % 3 > 0).select(s.alias("entity_id"), F.lit("mood").alias("field_key"), F.concat(F.lit('{"a": 1, "b": '), s % 5, F.lit("}")).alias("stored"))
    relations = base.select(s.alias("subject_id"), (F.col("s_nationkey") % 7).cast("long").alias("object_id"), F.lit("knows").alias("relation"))
    fields = base.select((s % 25).alias("type_id"), F.concat(F.lit("f"), s % 8).alias("field_key"), F.concat(F.lit("label "), s % 13).alias("label"), F.concat(F.lit("c"), s % 10).alias("concept"), F.array(F.concat(F.lit("Opt "), F.col("s_nationkey") % 6), F.lit(" X ")).alias("options"))
    return canon.with_baseline(records, entities, stored, relations, fields).select("record_id", "kind", "satisfied", "baseline", "current", "entity_id", "entity_name")


@query("""WITH n AS (SELECT p_brand AS doc_id, p_name AS name, max(length(p_type) % 3) AS m, max(p_size) AS p FROM part GROUP BY 1, 2), h AS (SELECT DISTINCT p_brand AS doc_id, string_split(p_name, ' ')[-1] AS hint FROM part UNION SELECT DISTINCT p_brand, 'old ' || p_name FROM part),
met AS (SELECT h.doc_id, h.hint, n.*, CASE WHEN lower(h.hint) = lower(n.name) THEN 1.0 WHEN length(h.hint) >= 2 AND ends_with(lower(n.name), lower(h.hint)) THEN 0.88 WHEN length(n.name) >= 3 AND ends_with(lower(h.hint), lower(n.name)) THEN 0.8 END::DOUBLE AS similarity FROM h JOIN n ON n.doc_id = h.doc_id),
ev AS (SELECT doc_id, hint, name, 0 AS k, 'type.' || m AS concept, least(1.0, CAST(p AS DOUBLE) / 50 * similarity) AS confidence FROM met WHERE similarity IS NOT NULL UNION ALL SELECT doc_id, hint, name, 1, 'type.other', least(1.0, CAST(0.6 AS DOUBLE) * similarity) FROM met WHERE similarity IS NOT NULL AND m = 1)
SELECT doc_id, hint, concept, round(confidence, 6) AS confidence, CAST(row_number() OVER (PARTITION BY doc_id, hint ORDER BY confidence DESC, name, k, concept) - 1 AS INTEGER) AS place FROM ev""")
def name_types(spark, t):
    """Types of names that are like a hint, primary and alternative, as sure as the names are alike."""
    own = t("part").groupBy(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("name")).agg(F.max(F.length("p_type") % 3).alias("m"), F.max("p_size").alias("p"))
    other = F.array(F.struct(F.lit("type.other").alias("concept_id"), F.lit(None).cast("double").alias("confidence")))
    names = own.select("doc_id", "name", F.concat(F.lit("type."), "m").alias("likely_type"), (F.col("p") / 50).alias("confidence"), F.when(F.col("m") == 1, other).alias("alternatives"), F.lit("suffix").alias("evidence_type"), F.lit(None).cast("string").alias("strength"))
    part = t("part")
    hints = part.select(F.col("p_brand").alias("doc_id"), F.element_at(F.split("p_name", " "), -1).alias("hint")).union(part.select("p_brand", F.concat(F.lit("old "), "p_name"))).distinct()
    return inference.type_evidence(hints, names).select("doc_id", "hint", "concept", F.round("confidence", 6).alias("confidence"), "place")
