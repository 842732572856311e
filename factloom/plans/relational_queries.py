"""Lookups, guards, sets, trees and merges over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import lifecycle, relational, suggest, trees
from .registry import query


@query("""SELECT o.o_orderkey, o.o_totalprice, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def nested_lookup(spark, t):
    """Order to customer to nation to region."""
    out = relational.lookup(t("orders"), t("customer"), "o_custkey", "c_custkey", ["c_name", "c_nationkey"])
    out = relational.lookup(out, t("nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    return relational.lookup(out, t("region"), "n_regionkey", "r_regionkey", ["r_name"]).select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, p.p_name, s.s_name FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def lookup_populate(spark, t):
    """Three lookups with a subset of columns; missing rows are null."""
    out = relational.lookup(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", ["o_orderstatus"])
    out = relational.lookup(out, t("part"), "l_partkey", "p_partkey", ["p_name"])
    return relational.lookup(out, t("supplier"), "l_suppkey", "s_suppkey", ["s_name"]).select("l_orderkey", "l_linenumber", "o_orderstatus", "p_name", "s_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#12' OR p_size = 15")
def filtered_projection(spark, t):
    """Equality and disjunction with a projection; both reach the scan."""
    return t("part").where("p_brand = 'Brand#12' or p_size = 15").select("p_partkey", "p_name", "p_brand")


@query("SELECT lower(trim(p_brand || ' ' || p_size % 17 || p_partkey % 11)) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1")
def unambiguous_names(spark, t):
    """Names that exactly one row has."""
    return relational.unambiguous(t("part"), F.concat("p_brand", F.lit(" "), F.col("p_size") % 17, F.col("p_partkey") % 11), "p_partkey")


@query("SELECT CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, n FROM (SELECT count(*) FILTER (WHERE lower(n_name) = lower('NATION_3')) AS n FROM nation)")
def exact_name_lookup(spark, t):
    """Case-insensitive whole-name lookup with its guard."""
    return relational.exact_name(t("nation"), "n_name", F.lit("NATION_3"))


@query("""SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) k FROM events) WHERE k = 1""")
def dedupe_argmax(spark, t):
    """The surest row of each key, the first of ties."""
    return relational.arg_max(t("events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", ["event_id"])


@query("""WITH absent AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)),
roots AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1)
SELECT a.c_nationkey, a.c_custkey, coalesce(r.n, 0) + row_number() OVER (PARTITION BY a.c_nationkey ORDER BY a.c_custkey) - 1 AS "order"
FROM absent a LEFT JOIN roots r ON a.c_nationkey = r.c_nationkey""")
def missing_nodes(spark, t):
    """Customers without an order follow those that have one."""
    have = t("orders").where("o_totalprice > 300000").select("o_custkey").distinct()
    nodes = t("customer").join(have, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_nationkey", F.col("c_custkey").alias("item"), F.lit(None).cast("long").alias("parent"))
    return relational.missing_nodes(t("customer").select("c_nationkey", "c_custkey"), nodes, "c_nationkey", "c_custkey", "item")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def integrity_violations(spark, t):
    """Lines whose part isn't of the required kind."""
    parts = t("part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return relational.integrity_violations(t("lineitem"), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def tenancy(spark, t):
    """Rows of one owner's worlds."""
    worlds = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("owner_id"))
    return relational.owned(t("orders"), worlds, "o_custkey", F.lit(3)).select("o_orderkey", "o_custkey")


@query("""SELECT e.user_id, count(*) AS total, count(*) FILTER (WHERE e.event_type = 'error') AS errors, count(*) FILTER (WHERE e.event_type = 'purchase') AS purchases FROM events e GROUP BY 1""")
def status_counts(spark, t):
    """A1: total and counts by status."""
    return t("events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("""SELECT p_brand, used, greatest(0, 30 - used) AS remaining, used >= 30 AS exhausted FROM (SELECT p_brand, count(*) FILTER (WHERE p_size IS DISTINCT FROM 7) AS used FROM part GROUP BY 1)""")
def quota_check(spark, t):
    """Uses that count (null passes), what remains, whether it is exhausted."""
    return relational.quota(t("part").withColumn("max_uses", F.lit(30).cast("long")), "p_brand", ~F.col("p_size").eqNullSafe(7), "max_uses")


@query("""SELECT doc_id, n_chars % 3 <> n_chars % 2 AS content_changed, length(lang) % 2 <> doc_id % 2 AS canon_changed, (n_chars % 3 <> n_chars % 2) OR (length(lang) % 2 <> doc_id % 2) AS needs_analysis FROM documents""")
def stale_documents(spark, t):
    """Documents whose content or canon moved on."""
    docs = t("documents").select("doc_id", F.col("lang").alias("world"), (F.col("n_chars") % 3).alias("content_version"), (F.col("n_chars") % 2).alias("synced_version"), (F.col("doc_id") % 2).alias("last_canon_version"))
    worlds = docs.select("world").distinct().withColumn("canon_version", (F.length("world") % 2).cast("long"))
    return relational.stale(docs, worlds, "world").select("doc_id", "content_changed", "canon_changed", "needs_analysis")


@query("""SELECT n_regionkey, n_nationkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name), n_nationkey) - 1 AS INTEGER) AS "order" FROM nation""")
def sibling_order(spark, t):
    """Siblings numbered without gaps."""
    nodes = t("nation").select(F.lit(0).alias("world"), F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("node"), F.length("n_name").alias("order"), "n_name")
    return trees.renumber(nodes, "node").select(F.col("parent").alias("n_regionkey"), F.col("node").alias("n_nationkey"), "n_name", "order")


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey AS ord FROM region UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier)"""


def _tree(t):
    region = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("order"))
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("order"))
    supplier = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_suppkey").alias("order"))
    return region.unionByName(nation).unionByName(supplier).withColumn("world", F.lit(0))


@query(f"""WITH RECURSIVE {_NODES}, up AS (SELECT node, node AS ancestor, 0 AS depth FROM nodes UNION ALL
SELECT u.node, n.parent, u.depth + 1 FROM up u JOIN nodes n ON u.ancestor = n.node WHERE n.parent IS NOT NULL) SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM up""")
def tree_closure(spark, t):
    """H1, H5: every node with all its ancestors."""
    return trees.ancestors(_tree(t))


@query(f"""WITH {_NODES}, kept AS (SELECT * FROM nodes WHERE node <> 'n4'),
placed AS (SELECT node, parent, row_number() OVER (PARTITION BY parent ORDER BY ord, node) - 1.0 AS ord FROM kept
UNION ALL SELECT 'n4', 'r2', 0.5) SELECT node, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY ord, node) - 1 AS INTEGER) AS "order" FROM placed""")
def move_node(spark, t):
    """One node moves to the second place of another family."""
    return trees.move(_tree(t), "n4", "r2", 1, "node").select("node", "parent", "order")


@query(f"""WITH {_NODES}, gone AS (SELECT * FROM nodes WHERE node = 'n4'),
kept AS (SELECT n.node, CASE WHEN n.parent = 'n4' THEN g.parent ELSE n.parent END AS parent, CASE WHEN n.parent = 'n4' THEN g.ord ELSE n.ord END AS ord,
CASE WHEN n.parent = 'n4' THEN n.ord END AS inner_ord FROM nodes n, gone g WHERE n.node <> 'n4')
SELECT node, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY ord, inner_ord NULLS FIRST, node) - 1 AS INTEGER) AS "order" FROM kept""")
def delete_node(spark, t):
    """H4: a deleted node's children take its place."""
    return trees.delete(_tree(t), "n4", "node").select("node", "parent", "order")


@query("SELECT n_regionkey AS parent, string_agg(n_name, '|' ORDER BY n_nationkey) AS children FROM nation GROUP BY 1")
def ordered_children(spark, t):
    """H2, H3: each parent's children in order."""
    nodes = t("nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("order"), F.col("n_name").alias("node"))
    return trees.children(nodes).select("parent", F.array_join("children", "|").alias("children"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0)
SELECT s.o_orderkey, s.v AS status_value, c.v AS stored, CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN s.v IS NOT DISTINCT FROM c.v THEN 'satisfied' ELSE 'drift' END AS status FROM s LEFT JOIN c ON s.o_orderkey = c.o_orderkey""")
def canonical_diff(spark, t):
    """Suggestions that canon already holds, differs from, or lacks."""
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status_value"))
    canon = o.where("o_orderkey % 4 != 0").withColumn("status_value", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("status_value")))
    return lifecycle.canonical_diff(o.where("o_orderkey % 3 != 0"), canon, ["o_orderkey"], "status_value")


_REVISIONS = """revisions AS (SELECT user_id AS k, event_id AS revision, CASE event_type WHEN 'view' THEN 'superseded' WHEN 'click' THEN 'superseded' WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'accepted' ELSE 'ignored' END AS status, event_id % 2 = 0 AS edited FROM events),
incoming AS (SELECT DISTINCT user_id + 3 AS k FROM events WHERE user_id % 2 = 0),
groups AS (SELECT k, bool_or(status = 'ignored') AS ign, bool_or(status = 'accepted' AND edited) AS cor, bool_or(status = 'accepted') AS acc, bool_or(status = 'pending') AS pen, bool_or(status = 'superseded') AS sup,
max(revision) FILTER (WHERE status = 'pending') AS pr, max(revision) FILTER (WHERE status = 'superseded') AS sr, arg_max(edited, revision) FILTER (WHERE status = 'pending') AS pe, max(revision) + 1 AS nx FROM revisions GROUP BY 1),
met AS (SELECT coalesce(i.k, g.k) AS k, i.k IS NOT NULL AS seen, g.* EXCLUDE (k) FROM incoming i FULL JOIN groups g ON i.k = g.k),
plan AS (SELECT *, CASE WHEN NOT seen THEN CASE WHEN pen THEN 'supersede' ELSE 'unchanged' END WHEN ign OR cor THEN 'preserve' WHEN pen THEN CASE WHEN pe THEN 'refresh-metadata' ELSE 'refresh' END WHEN acc THEN 'create-revision' WHEN sup THEN 'reactivate' ELSE 'create' END AS action FROM met)"""


@query(f"""WITH {_REVISIONS} SELECT k AS semantic_key, action, CAST(CASE WHEN action IN ('create', 'create-revision') THEN coalesce(nx, 1) WHEN action IN ('refresh', 'refresh-metadata', 'supersede') THEN pr WHEN action = 'reactivate' THEN sr END AS INTEGER) AS revision FROM plan""")
def revision_merge(spark, t):
    """What a re-analysis does to every group of revisions."""
    e = t("events")
    status = F.when(F.col("event_type").isin("view", "click"), "superseded").when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "accepted").otherwise("ignored")
    revisions = e.select(F.col("user_id").alias("semantic_key"), F.col("event_id").alias("revision"), status.alias("status"), (F.col("event_id") % 2 == 0).alias("edited"))
    return lifecycle.plan_merge(e.where("user_id % 2 = 0").select((F.col("user_id") + 3).alias("semantic_key")), revisions)


@query("SELECT action, count(*) AS n FROM (WITH " + _REVISIONS + " SELECT action FROM plan) GROUP BY 1")
def revision_counts(spark, t):
    """M5: how many groups were created, refreshed, preserved, superseded."""
    return revision_merge(spark, t).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def cascade_delete(spark, t):
    """M2: a table without the rows of deleted worlds."""
    worlds = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return lifecycle.cascade_delete({"customer": t("customer")}, worlds, "c_nationkey")["customer"].select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ignored' WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS next_status, o_shippriority AS version FROM (SELECT *, o_custkey + CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS o_shippriority FROM orders)""")
def status_transition(spark, t):
    """M9, M8: guarded status change; a version that rises on real change only."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "accepted").otherwise("ignored")
    nxt = lifecycle.transition(status, "ignored")
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.when(nxt.isNotNull(), F.col("o_orderstatus"))).otherwise(nxt).alias("next_status"), lifecycle.bump_version(F.col("o_custkey"), F.col("o_totalprice") > 100000).alias("version"))


@query("""SELECT doc_id, toxic, CASE WHEN c >= 0.72 THEN 'normal' WHEN c >= 0.55 THEN 'low-confidence' WHEN c >= 0.38 THEN 'very-low-confidence' ELSE 'suppressed' END AS tier,
CASE WHEN c >= 0.72 THEN 10 WHEN c >= 0.55 THEN 20 WHEN c >= 0.38 THEN 30 ELSE 40 END AS priority FROM (SELECT *, (doc_id % 100) / 100.0 AS c FROM labels)""")
def confidence_tiers(spark, t):
    """Tiers and their priorities."""
    tier = scores.tier((F.col("doc_id") % 100) / 100.0, scores.SUGGESTION_TIERS)
    return t("labels").select("doc_id", "toxic", tier.alias("tier"), scores.tier_priority(tier).alias("priority"))


@query("""SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= 72 THEN 10 WHEN value >= 55 THEN 20 ELSE 30 END, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, -round(value, 3), event_id) AS INTEGER) AS place FROM events""")
def suggestion_order(spark, t):
    """Display order by tier, dependency, bucketed confidence, place."""
    tier = F.when(F.col("value") >= 72, 10).when(F.col("value") >= 55, 20).otherwise(30)
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return suggest.display_order(t("events"), ["user_id"], tier, kind, "value", "event_id").select("user_id", "event_id", "event_type", "place")


@query("""WITH r AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN ' TRUE ' WHEN event_id % 3 = 1 THEN event_type END AS flag, CASE WHEN event_id % 4 > 0 THEN CAST(value AS VARCHAR) ELSE ' ' END AS worth FROM events),
c AS (SELECT event_id, TRY_CAST(k AS DOUBLE) AS number, CASE WHEN lower(trim(flag)) IN ('true', 'false') THEN lower(trim(flag)) END AS flag_, CASE WHEN k IS NULL OR trim(k) = '' THEN 'k:required' WHEN TRY_CAST(k AS DOUBLE) IS NULL THEN 'k:number' WHEN trim(flag) <> '' AND lower(trim(flag)) NOT IN ('true', 'false') THEN 'flag:boolean' WHEN worth = ' ' THEN 'worth:required' END AS error, TRY_CAST(nullif(trim(worth), '') AS DOUBLE) AS worth_ FROM r)
SELECT event_id, number AS k, flag_ AS flag, worth_ AS worth, error FROM c""")
def schema_cast(spark, t):
    """a value read by its schema, cast or refused."""
    k = F.col("event_id")
    values = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("flag"), F.when(k % 3 == 0, " TRUE ").when(k % 3 == 1, F.col("event_type")), F.lit("worth"), F.when(k % 4 > 0, F.col("value").cast("string")).otherwise(" "), F.lit("unknown"), F.lit("x"))
    read = suggest.cast_values(t("events").select("event_id", values.alias("values")), {"k": ("number", True), "flag": ("boolean", False), "worth": ("number", True)})
    at = lambda name: F.try_element_at("clean", F.lit(name))
    return read.select("event_id", at("k").cast("double").alias("k"), at("flag").alias("flag"), at("worth").cast("double").alias("worth"), "error")


@query("""SELECT p_partkey, 'part::' || p_brand || CASE WHEN p_size % 2 = 0 THEN '::' || p_size ELSE '' END AS suggestion_id, 'relation.' || lower(p_brand) AS relation FROM part""")
def suggestion_ids(spark, t):
    """joined keys without empty parts; prefixes."""
    return t("part").select("p_partkey", text.joined_key(F.lit("part"), F.lit(""), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("suggestion_id"), text.prefixed(F.lower("p_brand"), "relation.").alias("relation"))


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def key_sets(spark, t):
    """U3 and set membership: keys in two sets and not in a third."""
    e = t("events")
    of = lambda c: e.where(c).select("user_id")
    return of("event_type = 'signup'").intersect(of("event_type = 'purchase'")).subtract(of("event_type = 'error' and value > 90"))


@query("""SELECT user_id, count(DISTINCT event_type) AS sources, max(value) AS confidence, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1""")
def evidence_union(spark, t):
    """Set unions, maxima and distinct sources by key."""
    return t("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("sources"), F.max("value").alias("confidence"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


@query("""SELECT a.user_id, a.event_id FROM events a WHERE a.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.value > a.value)""")
def represented_elsewhere(spark, t):
    """Rows that a preferred row of another kind doesn't represent."""
    b = t("events").where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("value").alias("v"))
    return t("events").where("event_type = 'view'").join(b, (F.col("user_id") == F.col("u")) & (F.col("v") > F.col("value")), "left_anti").select("user_id", "event_id")
