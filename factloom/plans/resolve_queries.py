"""Schema resolution, facts said better elsewhere, deep values, and applying in the order of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import resolve
from .registry import query

#: Candidates from parts: concepts by brand, values by type and size; schemas from suppliers; entities are nations.
_RESOLVED = """cand AS (SELECT p_partkey AS cand_id, 'c' || p_partkey % 9 AS field_concept, CASE p_partkey % 4 WHEN 0 THEN ' ' || lower(p_brand) WHEN 1 THEN 'Nation ' || p_partkey % 30 WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE '' END AS value, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS subject_type, CASE WHEN p_partkey % 5 < 3 THEN p_size + 1 END AS draft_type, p_partkey % 5 < 4 AS has_draft, CAST(p_size AS DOUBLE) / 50 AS confidence FROM part),
fields AS (SELECT s_suppkey % 45 AS type_id, 'f' || s_suppkey AS field_key, 'c' || s_suppkey % 7 AS concept, CASE s_suppkey % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'entity-reference' ELSE 'number' END AS kind FROM supplier),
typed AS (SELECT *, coalesce(subject_type, draft_type) AS type_id FROM cand), hits AS (SELECT type_id, concept, count(*) AS n, min(field_key) AS field_key FROM fields GROUP BY 1, 2),
one AS (SELECT t.*, CASE WHEN t.type_id IS NULL THEN CASE WHEN has_draft THEN 'draft-subject-type-unmaterialized' ELSE 'missing-subject-type' END WHEN t.type_id NOT IN (SELECT type_id FROM fields) THEN 'missing-entity-type-schema' WHEN h.n IS NULL THEN 'missing' WHEN h.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN h.n = 1 THEN h.field_key END AS field_key FROM typed t LEFT JOIN hits h ON h.type_id = t.type_id AND h.concept = t.field_concept),
two AS (SELECT o.*, f.kind, (SELECT count(*) FROM nation n WHERE lower('Nation ' || n.n_nationkey % 20) = lower(o.value) AND n.n_regionkey < 4) AS entities FROM one o LEFT JOIN fields f USING (field_key)),
three AS (SELECT *, CASE WHEN status <> 'resolved' THEN NULL WHEN kind = 'select' THEN CASE WHEN lower(trim(value)) IN ('brand#11', 'brand#12', 'brand#23') THEN 'resolved' WHEN lower(trim(value)) = 'brand#31' THEN 'ambiguous-option' ELSE 'missing-option' END WHEN kind = 'entity-reference' THEN CASE WHEN trim(value) = '' THEN 'missing-reference-hint' WHEN entities = 0 THEN 'missing-reference' WHEN entities > 1 THEN 'ambiguous-reference' ELSE 'resolved' END ELSE 'not-needed' END AS value_status FROM two)"""


def _resolved(spark, t):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    value = F.when(k % 4 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).when(k % 4 == 1, F.concat(F.lit("Nation "), k % 30)).when(k % 4 == 2, F.col("p_size").cast("string")).otherwise("")
    cands = t("part").select(k.alias("cand_id"), F.concat(F.lit("c"), k % 9).alias("field_concept"), value.alias("value"), F.when(k % 5 == 0, F.col("p_size")).alias("subject_type"), F.when(k % 5 < 3, F.col("p_size") + 1).alias("draft_type"), (k % 5 < 4).alias("has_draft"), F.lit("text").alias("runtime"), (F.col("p_size") / 50).alias("confidence"), F.array(F.lit("entityType.location")).alias("expected"))
    kind = F.when(s % 3 == 0, "Select").when(s % 3 == 1, "Entity Reference").otherwise("Number")
    fields = t("supplier").select((s % 45).cast("int").alias("type_id"), F.concat(F.lit("f"), s).alias("field_key"), F.lit("none").alias("label"), F.concat(F.lit("c"), s % 7).alias("concept"), kind.alias("kind"), F.array(*map(F.lit, ("Brand#11", "brand#12 ", "Brand#23", "Brand#31", "brand#31"))).alias("options"), F.array(*map(F.lit, "0123")).alias("allowed"))
    canonical = spark.range(9).select(F.concat(F.lit("c"), "id").alias("concept"), F.lit("text").alias("kind"))
    labels = canonical.select("concept", F.lit("unknown").alias("label"))
    entities = t("nation").select(F.col("n_nationkey").alias("entity_id"), F.concat(F.lit("Nation "), F.col("n_nationkey") % 20).alias("name"), F.col("n_regionkey").cast("string").alias("type_id"))
    return resolve.resolve_fields(cands, fields, labels, canonical, entities)


@query(f"""WITH {_RESOLVED} SELECT cand_id, type_id, CASE WHEN subject_type IS NOT NULL THEN 'canonical-entity' WHEN draft_type IS NOT NULL THEN 'draft-inferred-type' END AS type_source, status, field_key, value_status FROM three""")
def field_resolution(spark, t):
    """Field candidates against the user's schemas, their types and values."""
    return _resolved(spark, t)["resolved"].select("cand_id", "type_id", "type_source", "status", "field_key", "value_status")


@query(f"""WITH {_RESOLVED}
SELECT 'schema' AS side, type_id || ':' || field_concept AS key, array_to_string(list(value ORDER BY o), '|') AS what, max(confidence) AS confidence FROM (SELECT type_id, field_concept, value, min(cand_id) AS o, max(confidence) AS confidence FROM three WHERE status = 'missing' GROUP BY 1, 2, 3) GROUP BY type_id, field_concept
UNION ALL SELECT 'option', field_key, arg_min(value, cand_id), max(confidence) FROM three WHERE value_status = 'missing-option' GROUP BY field_key, lower(trim(value))
UNION ALL SELECT 'reference', field_concept, arg_min(value, cand_id), max(confidence) FROM three WHERE value_status = 'missing-reference' GROUP BY field_concept, lower(trim(value))""")
def schema_gaps(spark, t):
    """Fields, options and entities that the schemas lack, each once."""
    got = _resolved(spark, t)
    row = lambda side, df, key, what: df.select(F.lit(side).alias("side"), key.alias("key"), what.alias("what"), "confidence")
    schema = row("schema", got["schema_suggestions"], F.concat_ws(":", "type_id", "field_concept"), F.array_join("examples", "|"))
    return schema.unionByName(row("option", got["option_suggestions"], F.col("field_key"), F.col("value"))).unionByName(row("reference", got["reference_suggestions"], F.col("field_concept"), F.col("name")))


_STATED = """ev AS (SELECT user_id AS doc_id, event_id, CASE WHEN event_type = 'view' THEN 'event.birth' ELSE 'event.' || event_type END AS concept, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) % 20 END AS id, CASE WHEN event_id % 5 < 2 THEN 'Name ' || event_id % 11 END AS name FROM events WHERE event_type <> 'purchase'),
fl AS (SELECT user_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'field.birthplace' ELSE 'field.age' END AS concept, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) % 20 END AS id, CASE WHEN event_id % 5 < 2 THEN 'name ' || event_id % 11 END AS name FROM events WHERE event_type = 'purchase' AND value > 80)"""


@query(f"""WITH {_STATED} SELECT doc_id, event_id FROM ev e WHERE NOT (concept = 'event.birth' AND EXISTS (SELECT 1 FROM fl f WHERE f.doc_id = e.doc_id AND f.concept = 'field.birthplace' AND CASE WHEN e.id IS NOT NULL AND f.id IS NOT NULL THEN e.id = f.id WHEN e.name IS NOT NULL AND f.name IS NOT NULL THEN lower(e.name) = lower(f.name) ELSE e.id IS NULL AND e.name IS NULL END))""")
def births_not_told(spark, t):
    """Births that no birthplace tells: by id, else by name, else by any of the document."""
    k = F.col("event_id")
    e = t("events").where("event_type != 'purchase'")
    events = e.select(F.col("user_id").alias("doc_id"), k, F.when(F.col("event_type") == "view", "event.birth").otherwise(F.concat(F.lit("event."), "event_type")).alias("concept"), F.when(k % 3 == 0, F.floor("value") % 20).alias("subject_id"), F.when(k % 5 < 2, F.concat(F.lit(" Name "), k % 11)).alias("subject"))
    fields = t("events").where("event_type = 'purchase' and value > 80").select(F.col("user_id").alias("doc_id"), F.when(k % 2 == 0, "field.birthplace").otherwise("field.age").alias("concept"), F.when(k % 4 == 0, F.floor("value") % 20).alias("subject_id"), F.when(k % 5 < 2, F.concat(F.lit("name "), k % 11)).alias("subject"))
    return resolve.not_redundant(events, fields).select("doc_id", "event_id")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority AND f.o_orderkey % 7 = o.o_orderkey % 7 AND f.o_orderkey % 11 <> 0 AND o.o_orderkey % 7 > 0) AND o.o_orderstatus <> 'F'""")
def relations_not_told(spark, t):
    """Relations that no preferred field says, by relation, subject and object."""
    k = F.col("o_orderkey")
    side = lambda lead: F.when(k % 7 > 0, F.concat(F.lit(lead), k % 7)).otherwise(" ")
    base = lambda where: t("orders").where(where).select(k, F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("relation"), side("The  Clerk ").alias("subject"), side("Desk ").alias("object"))
    fields = base("o_orderstatus = 'F'").select("doc_id", "relation", F.regexp_replace(F.lower("subject"), "the  ", "").alias("subject"), F.when(k % 11 > 0, F.upper("object")).alias("value"))
    return resolve.not_said_by_fields(base("o_orderstatus != 'F'"), fields).select("o_orderkey")


@query("""SELECT event_id, event_type = 'view' OR value < 50 OR event_id % 4 <> 1 AS same, event_id % 4 = 3 AS broken FROM events""")
def deep_values(spark, t):
    """JSON values of any depth, equal whatever the order of their keys."""
    k, v = F.col("event_id"), F.col("value").cast("string")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    changed = F.when((F.col("event_type") == "view") | (F.col("value") < 50) | (k % 4 != 1), k).otherwise(-k)
    left = text('{"kind": "', F.col("event_type"), '", "at": {"z": [1, {"q": null, "p": 1.50}], "id": ', k, ', "a": ', v, "}}")
    right = text('{"at":{"a":', v, ',"id":', changed.cast("string"), ',"z":[1.0,{"p":1.5,"q":null}]},"kind":"', F.col("event_type"), '"}')
    cut = F.when(k % 4 == 3, F.substring(left, 1, 20)).otherwise(left)
    other = F.when(k % 4 == 3, F.substring(left, 1, 20)).otherwise(right)
    return t("events").select("event_id", values.values_equal(cut, other).alias("same"), values.value_hash(cut).isNull().alias("broken"))


@query("""WITH RECURSIVE b AS (SELECT o_custkey AS doc_id, o_orderkey AS suggestion_id, k AS own, CASE WHEN k % 6 < 5 THEN 'd' || k END AS draft_key, CASE WHEN k % 7 = 6 THEN ['d' || k // 2, 'lost'] WHEN k > 1 THEN ['d' || k // 2] ELSE [] END AS needs FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)),
go AS (SELECT doc_id, suggestion_id, draft_key, 0 AS level FROM b WHERE len(needs) = 0 UNION ALL SELECT b.doc_id, b.suggestion_id, b.draft_key, g.level + 1 FROM go g JOIN b ON b.doc_id = g.doc_id AND len(b.needs) = 1 AND b.needs[1] = g.draft_key)
SELECT b.doc_id, b.suggestion_id, CAST(g.level AS INTEGER) AS level, CASE WHEN g.level IS NULL THEN list_min(list_filter(b.needs, lambda n: n = 'lost' OR NOT EXISTS (SELECT 1 FROM go h WHERE h.doc_id = b.doc_id AND h.draft_key = n))) END AS missing, g.level IS NOT NULL AND b.draft_key IS NOT NULL AS made FROM b LEFT JOIN go g USING (doc_id, suggestion_id)""".replace("list_min(list_filter(b.needs, lambda n: n = 'lost' OR NOT EXISTS (SELECT 1 FROM go h WHERE h.doc_id = b.doc_id AND h.draft_key = n)))", "(SELECT min(n) FROM (SELECT unnest(b.needs) AS n) WHERE n NOT IN (SELECT h.draft_key FROM go h WHERE h.doc_id = b.doc_id AND h.draft_key IS NOT NULL))"))
def ordered_apply(spark, t):
    """Drafts of one batch applied level by level; who waits for a draft that nobody makes is deferred."""
    from pyspark.sql import Window

    k = F.col("k")
    numbered = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("suggestion_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    parent = F.concat(F.lit("d"), F.floor(k / 2))
    needs = F.when(k % 7 == 6, F.array(parent, F.lit("lost"))).when(k > 1, F.array(parent)).otherwise(F.array().cast("array<string>"))
    batch = numbered.select("doc_id", "suggestion_id", F.when(k % 6 < 5, F.concat(F.lit("d"), k)).alias("draft_key"), needs.alias("needs"))
    accepted = spark.createDataFrame([], "doc_id long, draft_key string, entity_id string")
    return resolve.apply_in_order(batch, accepted).select("doc_id", "suggestion_id", "level", "missing", F.col("entity_id").isNotNull().alias("made"))
