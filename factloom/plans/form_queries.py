"""Normal forms, values, drafts and schema fields over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import discovery, linking, suggest
from ..sources import lexicons
from .registry import query

_SHOWN = "' The  \"' || p_name || '\"_' || p_size || ' '"


@query(rf"""WITH v AS (SELECT p_partkey, {_SHOWN} AS v FROM part)
SELECT p_partkey, regexp_replace(lower(v), '[\s"''`]', '', 'g') AS compared, lower(regexp_replace(trim(regexp_replace(trim(v), '^(the|a|an)\s+', '', 'i')), '\s+', ' ', 'g')) AS entity, regexp_replace(lower(trim(v)), '[\s_-]+', '', 'g') AS label FROM v""")
def compared_names(spark, t):
    """The forms in which spans, entity names and schema labels are equal."""
    v = F.concat(F.lit(' The  "'), "p_name", F.lit('"_'), "p_size", F.lit(" "))
    return t("part").select("p_partkey", text.comparison_form(v).alias("compared"), text.draft_key(v).alias("entity"), text.label_form(v).alias("label"))


_IRREGULAR = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in text.IRREGULAR_PLURALS.items())


@query(rf"""WITH n AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS own FROM part), w AS (SELECT p_partkey, unnest([own, own || 's', own || 'es', own || 'ies', own || 'xes', {', '.join(repr(k) for k in text.IRREGULAR_PLURALS)}]) AS w FROM n)
SELECT DISTINCT w, CASE {_IRREGULAR} WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, -2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN left(w, -1) ELSE w END AS one FROM w""")
def singular_words(spark, t):
    """English plurals to their singular."""
    own = t("part").select(F.explode(F.split("p_name", " ")).alias("own"))
    endings = [F.concat("own", F.lit(x)) for x in ("", "s", "es", "ies", "xes")]
    w = own.select(F.explode(F.array(*endings, *map(F.lit, text.IRREGULAR_PLURALS))).alias("w")).distinct()
    return w.select("w", text.singular(F.col("w")).alias("one"))


@query(r"""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '@Mail.org ' WHEN 1 THEN 'a b@' || c_name WHEN 2 THEN '@' || c_name || '.x' ELSE lower(c_name) || '@x.y' END AS mail, ': ' || c_name || CASE c_custkey % 3 WHEN 0 THEN '!' WHEN 1 THEN '; more' ELSE repeat('x', 70) END AS v, CASE WHEN c_custkey % 2 = 0 THEN 'relation.' ELSE ' ' END || c_mktsegment AS r FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(lower(trim(mail)), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN lower(trim(mail)) END AS email, CASE WHEN length(trim(v)) <= 80 AND NOT regexp_matches(v, '[!?;]') THEN trim(v) END AS promoted, trim(regexp_replace(regexp_replace(v, '^[:\s]+', ''), '[!;]+$', '')) AS bare, regexp_replace(trim(r), '^relation\.', '') AS plain FROM v""")
def checked_values(spark, t):
    """E-mail addresses, values that may become entities, values without marks, concepts without prefix."""
    k = F.col("c_custkey")
    mail = F.when(k % 4 == 0, F.concat("c_name", F.lit("@Mail.org "))).when(k % 4 == 1, F.concat(F.lit("a b@"), "c_name")).when(k % 4 == 2, F.concat(F.lit("@"), "c_name", F.lit(".x"))).otherwise(F.concat(F.lower("c_name"), F.lit("@x.y")))
    v = F.concat(F.lit(": "), "c_name", F.when(k % 3 == 0, "!").when(k % 3 == 1, "; more").otherwise("x" * 70))
    r = F.concat(F.when(k % 2 == 0, "relation.").otherwise(" "), "c_mktsegment")
    return t("customer").select("c_custkey", text.valid_email(mail).alias("email"), text.promotable(v).alias("promoted"), text.strip_marks(v).alias("bare"), text.unprefixed(r, "relation.").alias("plain"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Ann' || p_partkey || '|Bob' || p_size || '|Cy' WHEN 1 THEN 'Ann|Order of Bob' || p_size ELSE '' END AS names FROM part""")
def coordinated_names(spark, t):
    """The names of an explicit coordination; nothing where one part is no name."""
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("Later Ann"), k, F.lit(", Bob"), "p_size", F.lit(", and Cy"))).when(k % 3 == 1, F.concat(F.lit("Ann & Order of Bob"), "p_size")).otherwise(F.concat(F.lit("Ann and "), "p_name"))
    return t("part").select("p_partkey", F.array_join(text.coordinated(v), "|").alias("names"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ambiguous' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'resolved' ELSE 'missing' END AS status, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile' WHEN 'MACHINERY' THEN 'machinery' END AS option, CASE WHEN lower(c_mktsegment) = 'automobile' THEN 'Automobile|red' ELSE 'Automobile|red|' || c_mktsegment END AS options FROM customer""")
def option_values(spark, t):
    """A value met with a field's options; options without blanks and doubles."""
    found = text.select_options(F.array(F.lit(" Automobile"), F.lit(""), F.lit("red"), F.lit("RED "), F.col("c_mktsegment")))
    value = linking.select_value(F.concat(F.lit(" "), "c_mktsegment"), F.array(*map(F.lit, ("Automobile", "Building", "building ", "machinery"))))
    return t("customer").select("c_custkey", value["status"].alias("status"), value["option"].alias("option"), F.array_join(found, "|").alias("options"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_custkey % 50 < 40 THEN 'clerk ' || o_custkey % 50 END AS subject_draft, CASE WHEN o_custkey % 60 < 40 THEN 'clerk ' || o_custkey % 60 END AS object_draft FROM orders""")
def attached_drafts(spark, t):
    """Sides without a stored entity get the draft of their name."""
    rows = t("orders").select("o_orderkey", F.concat(F.lit("The  Clerk "), F.col("o_custkey") % 50).alias("subject_hint"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("subject_id"), F.concat(F.lit("CLERK "), F.col("o_custkey") % 60).alias("object_hint"), F.lit(None).cast("long").alias("object_id"))
    drafts = spark.range(40).select(F.concat(F.lit("clerk "), "id").alias("draft_key"))
    return linking.attach_drafts(rows, drafts).select("o_orderkey", "subject_draft", "object_draft")


@query("""WITH wanted AS (SELECT DISTINCT p_size AS type_id, 'c' || p_partkey % 7 AS concept FROM part), fields AS (SELECT s_suppkey % 40 AS type_id, 'f' || s_suppkey AS field_key, 'The_label ' || s_suppkey % 9 AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey % 7 END AS concept FROM supplier),
hits AS (SELECT w.type_id, w.concept, f.field_key, 1.0 AS c FROM wanted w JOIN fields f ON f.type_id = w.type_id AND f.concept = w.concept UNION SELECT w.type_id, w.concept, f.field_key, 0.95 FROM wanted w JOIN fields f ON f.type_id = w.type_id AND f.concept IS NULL AND f.label = 'The_label ' || substr(w.concept, 2)),
best AS (SELECT type_id, concept, count(*) AS n, min(field_key) AS field_key, any_value(c) AS c FROM (SELECT *, max(c) OVER (PARTITION BY type_id, concept) AS m FROM hits) WHERE c = m GROUP BY 1, 2)
SELECT w.type_id, w.concept, CASE WHEN b.n IS NULL THEN 'missing' WHEN b.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN b.n = 1 THEN b.field_key END AS field_key, CASE WHEN b.n = 1 THEN CAST(b.c AS DOUBLE) END AS confidence FROM wanted w LEFT JOIN best b ON b.type_id = w.type_id AND b.concept = w.concept""")
def mapped_fields(spark, t):
    """A type's field for a concept: bound to it, else by a known label."""
    wanted = t("part").select(F.col("p_size").alias("type_id"), F.concat(F.lit("c"), F.col("p_partkey") % 7).alias("concept")).distinct()
    s = F.col("s_suppkey")
    fields = t("supplier").select((s % 40).alias("type_id"), F.concat(F.lit("f"), s).alias("field_key"), F.concat(F.lit("The_label "), s % 9).alias("label"), F.when(s % 3 == 0, F.concat(F.lit("c"), s % 7)).alias("concept"))
    labels = spark.range(9).select(F.concat(F.lit("c"), "id").alias("concept"), F.concat(F.lit("the-LABEL "), "id").alias("label"))
    return linking.map_fields(wanted, fields, labels)


@query("""WITH types AS (SELECT n_nationkey AS type_id, 't' || n_nationkey % 11 AS type_concept, n_nationkey AS seq FROM nation), up AS (SELECT 't' || k AS concept, 't' || (k >> d) AS ancestor, d AS depth FROM range(1, 16) a(k), range(0, 4) b(d) WHERE k >> d > 0),
drafts AS (SELECT c_custkey AS draft_key, 't' || c_custkey % 14 AS likely, 't' || (c_custkey % 3 + 1) AS e FROM customer),
hits AS (SELECT d.draft_key, t.seq, t.type_id, 0 AS tier FROM drafts d JOIN types t ON t.type_concept = d.likely UNION ALL SELECT d.draft_key, t.seq, t.type_id, 1 FROM drafts d JOIN up u ON u.depth > 0 AND u.ancestor = d.likely JOIN types t ON t.type_concept = u.concept UNION ALL SELECT d.draft_key, t.seq, t.type_id, 2 FROM drafts d JOIN up u ON u.ancestor = d.e JOIN types t ON t.type_concept = u.concept)
SELECT d.draft_key, h.type_id, h.tier FROM drafts d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY draft_key ORDER BY tier, seq, type_id) AS k FROM hits) h ON h.draft_key = d.draft_key AND h.k = 1""")
def draft_types(spark, t):
    """The user's type for a draft: the same concept, a child of it, one that fits what is expected."""
    n = F.col("n_nationkey")
    types = t("nation").select(n.alias("type_id"), F.concat(F.lit("t"), n % 11).alias("type_concept"), n.alias("seq"))
    pairs = spark.range(1, 16).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("depth")).withColumn("a", F.expr("shiftright(k, depth)")).where("a > 0")
    up = pairs.select(F.concat(F.lit("t"), "k").alias("concept"), F.concat(F.lit("t"), "a").alias("ancestor"), "depth")
    c = F.col("c_custkey")
    drafts = t("customer").select(c.alias("draft_key"), F.concat(F.lit("t"), c % 14).alias("likely"), F.array(F.concat(F.lit("t"), c % 3 + 1)).alias("expected"))
    return linking.best_type(drafts, types, up).select("draft_key", "type_id", F.col("tier").cast("int").alias("tier"))


@query("""WITH s AS (SELECT *, least(1.0, greatest(0.0, value / 100)) AS c, (event_id % 10) / 10.0::DOUBLE AS q, CASE WHEN event_id % 3 > 0 THEN (event_id % 7) / 7.0::DOUBLE END AS o FROM events), a AS (SELECT event_id, c, o, least(c, q) + abs(c - q) * 0.2 AS one FROM s)
SELECT event_id, round(least(one, coalesce(o, c)) + abs(one - coalesce(o, c)) * 0.2, 6) AS score FROM a""")
def event_scores(spark, t):
    """An event is as sure as its weakest part."""
    k = F.col("event_id")
    return t("events").select("event_id", F.round(discovery.event_score(F.col("value") / 100, (k % 10) / 10.0, F.when(k % 3 > 0, (k % 7) / 7.0)), 6).alias("score"))


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [{'p': 0, 'f': c_name || '后来'}, {'p': 1, 'f': c_name}] ELSE [{'p': 0, 'f': c_name}] END, recursive := true) FROM customer""".replace("'p'", "'priority'").replace("'f'", "'form'"))
def name_variants(spark, t):
    """A name, then the name without a Chinese time word at its end."""
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "后来").otherwise(""))
    return t("customer").select("c_custkey", F.inline(linking.variants(name)))


@query("""SELECT status = 'informational' AS skipped, status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'informational' ELSE 'pending' END AS status FROM events) GROUP BY 1, 2""")
def skipped_records(spark, t):
    """Records that are stored, and informational ones that aren't."""
    rows = t("events").select(F.when(F.col("event_type") == "view", "informational").otherwise("pending").alias("status"))
    kept, skipped = suggest.split_informational(rows)
    return kept.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True))).groupBy("skipped", "status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'furry|sciFi' WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS packs, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, c_mktsegment) AS title FROM customer""")
def option_defaults(spark, t):
    """A missing list of packs means the usual ones, blanks go; the first of alternative fields that is set."""
    k = F.col("c_custkey")
    packs = F.when(k % 4 == 1, F.array(F.lit(" "))).when(k % 4 > 1, F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("")))
    return t("customer").select("c_custkey", F.array_join(lexicons.chosen_packs(packs), "|").alias("packs"), text.first_set(F.when(k % 3 == 0, F.col("c_name")), F.lit(" "), F.col("c_mktsegment")).alias("title"))
