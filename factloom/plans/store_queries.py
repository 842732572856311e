"""Listings, defaults, deadlines, set building and discovery over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, discovery, relational, spans
from ..sources import scratch
from ..streaming import manifest
from .registry import query


@query("SELECT event_id, user_id, value AS confidence FROM events WHERE event_type = 'signup' AND user_id % 3 = 0 ORDER BY value DESC, ts")
def suggestion_listing(spark, t):
    """Suggestions of a status and version, the surest first."""
    rows = t("events").select("event_id", "user_id", F.col("event_id").cast("string").alias("suggestion_id"), F.when(F.col("event_type") == "signup", "pending").otherwise("ignored").alias("status"), (F.col("user_id") % 3).alias("document_version"), F.col("value").alias("confidence"), F.col("ts").alias("created_at"))
    return relational.list_suggestions(rows, "pending", F.lit(0)).select("event_id", "user_id", "confidence")


@query("SELECT o_orderkey, o_orderdate <= TIMESTAMP '1996-01-01 00:00:00' AS expired FROM orders")
def deadlines(spark, t):
    """whether a deadline has passed."""
    return t("orders").select("o_orderkey", relational.expired(F.col("o_orderdate"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'unknown') AS name, 'draft' AS status FROM supplier")
def row_defaults(spark, t):
    """Projections with what stands for null."""
    rows = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"))
    return relational.with_defaults(rows, {"name": "unknown", "status": "draft"})


@query("SELECT n_nationkey, coalesce(r.r_name, 'Nation ' || n_nationkey) AS label FROM nation LEFT JOIN region r ON n_nationkey = r.r_regionkey")
def concept_labels(spark, t):
    """Labels of concepts, with their fallbacks."""
    concepts = t("nation").select("n_nationkey", F.concat(F.lit("type.nation_"), "n_nationkey").alias("concept_id"))
    labels = t("region").select(F.concat(F.lit("type.nation_"), "r_regionkey").alias("concept_id"), F.lit("en").alias("locale"), F.col("r_name").alias("label"), F.lit("icon").alias("icon"))
    return relational.presentation(concepts, labels, "de").select("n_nationkey", "label")


@query("""SELECT user_id, string_agg(event_type, '|' ORDER BY k) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS k FROM events WHERE event_type <> 'view' GROUP BY 1, 2) GROUP BY 1""")
def distinct_kinds(spark, t):
    """Values in order, each once, blanks dropped."""
    e = t("events").withColumn("k", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda x: x["k"])
    out = e.groupBy("user_id").agg(relational.distinct_in_order(seen).alias("k"))
    return out.where("size(k) > 0").select("user_id", F.array_join("k", "|").alias("kinds"))


@query("""SELECT p_partkey AS id, p_size AS start, 'part' AS kind FROM part UNION ALL SELECT s_suppkey, NULL, 'supplier' FROM supplier""")
def candidate_union(spark, t):
    """Streams of candidates as one, the placeless last."""
    parts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("start"), F.lit("part").alias("kind"))
    return relational.union_by_start([parts, t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))]).select("id", "start", "kind")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END, 99) AS owner_id FROM customer")
def unowned_worlds(spark, t):
    """Worlds without an owner get one."""
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("owner_id"))
    return relational.claim_unowned(rows, F.lit(99))


@query("""SELECT c_custkey, c_name, 1 AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 2 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def insert_missing(spark, t):
    """Upsert that only inserts."""
    c = t("customer").select("c_custkey", "c_name")
    return relational.insert_missing(c.where("c_custkey % 2 = 0").withColumn("version", F.lit(1)), c.where("c_custkey % 3 = 0").withColumn("version", F.lit(2)), ["c_custkey"])


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_check(spark, t):
    """Partial unique keys: what is there more than once."""
    return relational.duplicates(t("part"), ["p_brand", "p_size"])


@query("""SELECT a.n_regionkey, a.n_name AS hint, b.n_name AS name, CASE WHEN lower(a.n_name) = lower(b.n_name) THEN 1.0 ELSE 0.88 END::DOUBLE AS similarity FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN substr(n_name, 4) ELSE n_name END AS n_name FROM nation) a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (lower(a.n_name) = lower(b.n_name) OR (length(a.n_name) >= 2 AND ends_with(lower(b.n_name), lower(a.n_name))))""")
def similar_names(spark, t):
    """Names alike within a document."""
    hints = t("nation").select(F.col("n_regionkey").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, F.expr("substr(n_name, 4)")).otherwise(F.col("n_name")).alias("hint"))
    names = t("nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("name"))
    return discovery.similar_names(hints, names).select(F.col("doc_id").alias("n_regionkey"), "hint", "name", "similarity")


@query("""WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT a.conv_id, a.turn, (SELECT string_agg(b.role, '|' ORDER BY b.k) FROM m b WHERE b.conv_id = a.conv_id AND b.k BETWEEN a.k - 3 AND a.k - 1) AS recent, (SELECT count(*) FROM m b WHERE b.conv_id = a.conv_id AND b.k < a.k AND b.role = a.role) AS seen FROM m a""")
def mention_memory(spark, t):
    """The last mentions before each, and how often its own came before."""
    out = context.recent_mentions(t("conversations"), "conv_id", "turn", "role", 3)
    return out.select("conv_id", "turn", F.when(F.size("recent") > 0, F.array_join("recent", "|")).alias("recent"), "seen")


@query("""WITH c AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS clause_idx, o_orderkey AS s, o_orderkey + 5000 AS e FROM orders), p AS (SELECT o_custkey, o_orderkey + 11 AS o_orderkey FROM orders)
SELECT p.o_custkey AS doc_id, p.o_orderkey AS start, min(c.clause_idx) AS clause_idx FROM p JOIN c ON c.o_custkey = p.o_custkey AND p.o_orderkey BETWEEN c.s AND c.e GROUP BY 1, 2""")
def point_in_clause(spark, t):
    """The first clause whose closed range holds a point."""
    o = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("start"))
    from ..operators.linking import number_in_order

    c = number_in_order(o, ["doc_id"], ["start"], "clause_idx").withColumn("end", F.col("start") + 5000)
    return spans.clause_of_point(o.withColumn("start", F.col("start") + 11), c).select("doc_id", "start", "clause_idx")


@query("""WITH u AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'orders' AS tab, o_orderkey AS key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS value, CAST(NULL AS BIGINT) AS version FROM orders
UNION ALL SELECT 'log', o_custkey, CAST(o_orderkey AS VARCHAR), 2 FROM u UNION ALL SELECT 'log', o_custkey, CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM u)""")
def committed_tables(spark, t):
    """Two tables through two commits, each of which switches both; the second rewrites what it touches."""
    import uuid

    path = f"{scratch.shared_folder(spark)}/factloom/{uuid.uuid4().hex}"
    store = manifest.Store(spark, path, {"orders": "key long, value string", "log": "key long, value string, version long"}, {"orders": ["key"], "log": ["key"]}, {"orders": manifest.upsert("key"), "log": manifest.replace_documents("key")}, buckets=4)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    rows = t("orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("cust"), "o_orderstatus", "o_orderpriority")
    log = lambda df: df.select(F.col("cust").alias("key"), F.col("order").cast("string").alias("value"), F.lit(None).cast("long").alias("version"))
    store.commit(0, {"orders": rows.select(F.col("order").alias("key"), F.col("o_orderstatus").alias("value")), "log": log(rows)})
    urgent = rows.where("o_orderpriority = '1-URGENT'")
    store.commit(1, {"orders": urgent.select(F.col("order").alias("key"), F.lit("U").alias("value")), "log": log(urgent)})
    return store.table("orders").select(F.lit("orders").alias("tab"), "key", "value", F.lit(None).cast("long").alias("version")).unionByName(store.table("log").select(F.lit("log").alias("tab"), "key", "value", "version"))
