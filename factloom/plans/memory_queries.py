"""Working memory and the second pass over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, refine
from .registry import query

#: Neighbouring capitalised words of a turn are a candidate; ids and drafts hang on the lengths and first letters of words, so that they clash with names.
_CAND = r"""words AS (SELECT conv_id, turn, role, x, unnest(range(1, len(x))) AS k FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Z][a-z]+') AS x FROM conversations)),
cand AS (SELECT conv_id AS doc_id, turn AS start, k AS seq, x[k] AS subject, x[k + 1] AS object, CAST(length(x[k]) % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN role = 'user' AND length(x[k]) % 3 = 0 THEN CAST(length(x[k]) AS VARCHAR) END AS subject_id, CASE WHEN role = 'assistant' AND length(x[k + 1]) % 2 = 0 THEN lower(x[k + 1][1:2]) END AS object_draft,
  CASE length(x[k]) % 4 WHEN 0 THEN 'entityType.character' WHEN 1 THEN 'type.guild' WHEN 2 THEN 'entityType.location' END AS subject_type, CASE length(x[k + 1]) % 3 WHEN 0 THEN 'entityType.item' END AS object_type, CASE length(x[k + 1]) % 4 WHEN 0 THEN 'field.age' WHEN 1 THEN 'field.motto' END AS field_concept, CASE WHEN length(x[k + 1]) % 4 > 1 THEN 'relation.knows' END AS relation_concept FROM words)"""
_FOLD = f"""{_CAND},
m AS (SELECT doc_id, start, seq, 0 AS side, coalesce('entity:' || subject_id, 'name:' || subject) AS key, subject AS name, subject_id AS entity_id, CAST(NULL AS VARCHAR) AS draft_key FROM cand UNION ALL SELECT doc_id, start, seq, 1, coalesce('draft:' || object_draft, 'name:' || object), object, CAST(NULL AS VARCHAR), object_draft FROM cand),
said AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, seq, side) AS i FROM m),
fold(doc_id, i, created, named, entity) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST(NULL AS VARCHAR) FROM said UNION ALL
  SELECT doc_id, i, CASE WHEN e = key AND NOT list_contains(created, key) THEN list_append(created, key) ELSE created END, map_concat(named, MAP {{name: e}}), e FROM (SELECT s.doc_id, s.i, s.key, s.name, f.created, f.named, CASE WHEN list_contains(f.created, s.key) THEN s.key ELSE coalesce(f.named[s.name], s.key) END AS e FROM fold f JOIN said s ON s.doc_id = f.doc_id AND s.i = f.i + 1)),
known AS (SELECT s.*, f.entity FROM said s JOIN fold f USING (doc_id, i)),
subj AS (SELECT c.*, k.entity FROM cand c JOIN known k USING (doc_id, start, seq) WHERE k.side = 0), obj AS (SELECT c.*, k.entity FROM cand c JOIN known k USING (doc_id, start, seq) WHERE k.side = 1),
typed AS (SELECT doc_id, entity, start, seq, 0 AS part, subject_type AS concept, confidence, 'candidate-subject-type' AS source FROM subj WHERE subject_type IS NOT NULL UNION ALL SELECT doc_id, entity, start, seq, 1, 'entityType.character', greatest(0.7, confidence), 'field:field.age' FROM subj WHERE field_concept = 'field.age' UNION ALL SELECT doc_id, entity, start, seq, 2, object_type, confidence, 'candidate-object-type' FROM obj WHERE object_type IS NOT NULL),
types AS (SELECT doc_id, entity, concept, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(CAST(confidence AS DOUBLE) ORDER BY start, seq, part)), lambda s, c: 1 - (1 - 0.92 * s) * (1 - c)) AS confidence, count(DISTINCT source) AS sources, min((start, seq, part)) AS first FROM typed GROUP BY ALL),
best AS (SELECT * FROM types QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY confidence DESC, first) = 1),
fields AS (SELECT * FROM subj WHERE field_concept IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, entity, field_concept ORDER BY confidence DESC, start DESC, seq DESC) = 1),
names AS (SELECT doc_id, name, arg_max(entity, i) AS entity FROM known GROUP BY ALL)"""


def _candidates(t):
    x, k = F.col("x"), F.col("k")
    turns = t("conversations").select("conv_id", "turn", "role", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("x")).where("size(x) > 1")
    pairs = turns.select("conv_id", "turn", "role", F.posexplode(F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))).alias("k", "p")).select("conv_id", "turn", "role", (k + 1).alias("k"), "p.a", "p.b")
    own, other = F.length("a"), F.length("b")
    return pairs.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("start"), k.alias("seq"), F.col("a").alias("subject"), F.col("b").alias("object"), (own % 10 / 10).alias("confidence"),
        F.when((F.col("role") == "user") & (own % 3 == 0), own.cast("string")).alias("subject_id"), F.when((F.col("role") == "assistant") & (other % 2 == 0), F.lower(F.substring("b", 1, 2))).alias("object_draft"),
        F.when(own % 4 == 0, "entityType.character").when(own % 4 == 1, "type.guild").when(own % 4 == 2, "entityType.location").alias("subject_type"), F.when(other % 3 == 0, "entityType.item").alias("object_type"),
        F.when(other % 4 == 0, "field.age").when(other % 4 == 1, "field.motto").alias("field_concept"), F.col("b").alias("value"), F.when(other % 4 > 1, "relation.knows").alias("relation_concept"),
    )


@query(f"""WITH RECURSIVE {_FOLD}
SELECT e.*, b.concept AS best_type, round(b.confidence, 6) AS best_confidence, f.fields, r.targets FROM (SELECT doc_id, entity, arg_max(name, i) AS name, arg_max(entity_id, i) FILTER (entity_id IS NOT NULL) AS entity_id, arg_max(draft_key, i) FILTER (draft_key IS NOT NULL) AS draft_key, count(*) AS mention_count, least(1.0, CAST(0.35 AS DOUBLE) + CAST(0.12 AS DOUBLE) * count(*)) AS salience, arg_max(start, i) AS last_mention FROM known GROUP BY 1, 2) e
LEFT JOIN best b USING (doc_id, entity) LEFT JOIN (SELECT doc_id, entity, string_agg(field_concept || '=' || object, '|' ORDER BY field_concept) AS fields FROM fields GROUP BY 1, 2) f USING (doc_id, entity) LEFT JOIN (SELECT doc_id, entity, count(DISTINCT object) AS targets FROM subj WHERE relation_concept IS NOT NULL GROUP BY 1, 2) r USING (doc_id, entity)""")
def working_memory(spark, t):
    """What is believed of every entity after reading a conversation in order."""
    got = memory.working_memory(_candidates(t))
    fields = got["fields"].groupBy("doc_id", "entity").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field_concept", "value"))), "|").alias("fields"))
    targets = got["relations"].groupBy("doc_id", "entity").agg(F.count("*").alias("targets"))
    out = got["entities"].withColumn("best_confidence", F.round("best_confidence", 6))
    return out.join(fields, ["doc_id", "entity"], "left").join(targets, ["doc_id", "entity"], "left")


#: Types of the query (concept, ancestor) and stored ones.
_TYPES = (("type.guild", "entityType.organization"), ("type.city", "entityType.location"), ("type.port", "type.city"), ("type.port", "entityType.location"), ("entityType.person", "entityType.character"))
_CANON = ("entityType.person", "entityType.organization")
_UP = ", ".join(map(str, _TYPES))


@query(f"""WITH RECURSIVE {_FOLD},
hints AS (SELECT *, CASE WHEN length(hint) % 2 = 0 THEN ['entityType.character'] WHEN length(hint) % 3 = 0 THEN ['entityType.location', 'entityType.item'] ELSE CAST([] AS VARCHAR[]) END AS expected, CASE WHEN length(hint) % 5 < 3 THEN 'type.port' END AS prior_concept, CAST(length(hint) % 7 AS DOUBLE) / 7 AS prior_confidence FROM (SELECT DISTINCT doc_id, subject AS hint FROM cand UNION SELECT conv_id, role FROM conversations) LEFT JOIN (SELECT doc_id, name AS hint, entity FROM names) USING (doc_id, hint)),
asked AS (SELECT * FROM hints WHERE entity IS NOT NULL),
up(concept, other) AS (VALUES {_UP}), related AS (SELECT concept, other FROM up UNION SELECT other, concept FROM up),
memtypes AS (SELECT h.doc_id, h.hint, h.entity, t.concept, t.confidence, t.sources, t.first, 4 * t.first[1] + t.first[3] AS place FROM asked h JOIN types t USING (doc_id, entity)),
one AS (SELECT doc_id, hint, unnest(expected) AS concept, 0.72 AS score, 0 AS stage, unnest(range(len(expected))) AS place FROM asked
  UNION ALL SELECT doc_id, hint, 'type.guild', CASE WHEN length(hint) % 3 = 0 THEN 0.68 WHEN length(hint) % 3 = 1 THEN 0.58 WHEN length(hint) % 2 = 0 THEN 0.18 ELSE 0.38 END * (CAST(length(hint) % 9 AS DOUBLE) / 9), 1, 0 FROM asked WHERE contains(hint, 'e')
  UNION ALL SELECT doc_id, hint, prior_concept, 0.24 * prior_confidence, 2, 0 FROM asked WHERE prior_concept IS NOT NULL
  UNION ALL SELECT doc_id, hint, concept, 0.58 * confidence * CASE WHEN sources <= 1 THEN 0.55 WHEN sources = 2 THEN 0.78 ELSE 1 END, 3, place FROM memtypes
  UNION ALL SELECT doc_id, hint, 'entityType.character', least(0.52, sum(0.2 * f.confidence)), 4, 0 FROM asked h JOIN fields f USING (doc_id, entity) WHERE f.field_concept = 'field.age' GROUP BY 1, 2 HAVING sum(f.confidence) > 0
  UNION ALL SELECT doc_id, hint, concept, least(0.14, 0.035 * n) + 0.10 * least(1.0, 0.35 + 0.12 * n), 3, place FROM memtypes JOIN (SELECT doc_id, entity, count(*) AS n FROM known GROUP BY 1, 2) USING (doc_id, entity)),
wanted AS (SELECT DISTINCT doc_id, hint, unnest(expected) AS other FROM asked),
stored AS (SELECT DISTINCT doc_id, hint, concept FROM one WHERE concept IN {_CANON} UNION SELECT w.doc_id, w.hint, c.concept FROM wanted w JOIN (SELECT unnest({list(_CANON)}) AS concept) c ON c.concept = w.other OR (c.concept, w.other) IN (SELECT (concept, other) FROM related)),
five AS (SELECT * FROM one UNION ALL SELECT doc_id, hint, concept, 0.34, 5, list_position({list(_CANON)}, concept) FROM stored),
named AS (SELECT DISTINCT doc_id, hint, concept FROM five),
six AS (SELECT n.doc_id, n.hint, n.concept, CASE WHEN bool_or(n.concept = w.other OR (n.concept, w.other) IN (SELECT (concept, other) FROM related)) THEN 0.12 ELSE -0.48 END AS score, 6 AS stage, 0 AS place FROM named n JOIN wanted w USING (doc_id, hint) GROUP BY 1, 2, 3),
seven AS (SELECT n.doc_id, n.hint, n.concept, -0.34 AS score, 7 AS stage, 0 AS place FROM named n JOIN asked h USING (doc_id, hint) JOIN best b USING (doc_id, entity) WHERE b.confidence >= 0.78 AND b.sources >= 2 AND n.concept <> b.concept AND (n.concept, b.concept) NOT IN (SELECT (concept, other) FROM related)),
sums AS (SELECT doc_id, hint, concept, round(sum(score), 12) AS raw, min((stage, place)) AS f FROM (FROM five UNION ALL FROM six UNION ALL FROM seven) GROUP BY 1, 2, 3),
scored AS (SELECT *, CASE WHEN raw > 0 THEN 1 - exp(-raw) ELSE 0 END AS score FROM sums),
high AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hint ORDER BY score DESC, concept) AS p FROM scored),
led AS (SELECT *, 1 AS g, score AS lead FROM high WHERE p = 1 UNION ALL SELECT h.*, CASE WHEN l.lead - h.score > 0.025 THEN l.g + 1 ELSE l.g END, CASE WHEN l.lead - h.score > 0.025 THEN h.score ELSE l.lead END FROM led l JOIN high h ON h.doc_id = l.doc_id AND h.hint = l.hint AND h.p = l.p + 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hint ORDER BY g, coalesce(nullif(list_position({list(refine.BROAD)}, concept), 0), 6), f, concept) AS r FROM led),
out AS (SELECT doc_id, hint, max(concept) FILTER (r = 1) AS best, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, list(concept ORDER BY r) FILTER (r BETWEEN 2 AND 4 AND score > 0) AS alternatives FROM ranks GROUP BY 1, 2)
SELECT h.doc_id, h.hint, coalesce(o.best, h.prior_concept) AS likely_type, round(coalesce(o.s1, h.prior_confidence), 6) AS type_confidence, round(o.s1 - coalesce(o.s2, 0), 6) AS margin, CASE WHEN o.best IS NOT NULL THEN CASE WHEN o.s2 IS NOT NULL AND o.s1 - o.s2 < 0.12 THEN 'semantic-memory-ambiguous' ELSE 'semantic-memory-refined' END END AS type_status, CASE WHEN o.best IS NOT NULL THEN CASE WHEN o.s2 IS NOT NULL AND o.s1 - o.s2 < 0.12 THEN 'ambiguous' ELSE 'refined' END WHEN h.entity IS NOT NULL THEN 'no-result' END AS refinement, array_to_string(coalesce(o.alternatives, CAST([] AS VARCHAR[])), '|') AS conflicts FROM hints h LEFT JOIN out o USING (doc_id, hint)""")
def type_refinement(spark, t):
    """Types of names from nine kinds of evidence, after a second pass that knows the working memory."""
    cands = _candidates(t)
    known = memory.working_memory(cands)
    n = F.length("hint")
    hints = cands.select("doc_id", F.col("subject").alias("hint")).union(t("conversations").select("conv_id", "role")).distinct()
    expected = F.when(n % 2 == 0, F.array(F.lit("entityType.character"))).when(n % 3 == 0, F.array(F.lit("entityType.location"), F.lit("entityType.item"))).otherwise(F.array().cast("array<string>"))
    suggestions = hints.select("*", expected.alias("expected"), F.when(n % 5 < 3, "type.port").alias("prior_concept"), (n % 7 / 7).alias("prior_confidence"), F.lit(None).cast("array<string>").alias("conflicting"))
    lexical = hints.where(F.contains("hint", F.lit("e"))).select("doc_id", "hint", F.lit(0).alias("place"), F.lit("type.guild").alias("concept"), F.when(n % 3 == 0, "exact").when(n % 3 == 1, "suffix").alias("evidence_type"), F.when(n % 2 == 0, "weak").alias("strength"), (n % 9 / 9).alias("confidence"))
    closure = spark.createDataFrame(_TYPES, "concept string, ancestor string")
    out = refine.refine(suggestions, lexical, known, closure, _CANON)
    return out.select("doc_id", "hint", "likely_type", F.round("type_confidence", 6).alias("type_confidence"), F.round("margin", 6).alias("margin"), "type_status", "refinement", F.array_join("conflicts", "|").alias("conflicts"))
