"""Document-store operators: lookups, guards, ordered distinct, arg-max, merges of sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, on: str, key: str, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Left join that fetches ``columns`` of the row of ``right`` whose ``key`` is ``on``; missing rows give nulls.

    No hint: Catalyst broadcasts ``right`` only when its statistics say it is small.
    """
    side = right.select(F.col(key).alias("__key"), *(F.col(c).alias(prefix + c) for c in columns))
    return left.join(side, F.col(on) == F.col("__key"), "left").drop("__key")


def arg_max(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the greatest score of each key; ties go to the first in the order of ``tie``.

    One aggregation with map-side combining (min of a struct), so a hot key is no hot task.
    """
    rest = [c for c in df.columns if c not in (*keys, score, *tie)]
    best = F.min(F.struct((-F.col(score)).alias("__low"), *(F.col(t) for t in tie), *(F.col(c) for c in rest), F.col(score))).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in (score, *tie, *rest)))


def unambiguous(df: DataFrame, name: Column, ident: str) -> DataFrame:
    """(name, ident) of names, without case, that exactly one row has; blank names are left out."""
    key = F.lower(F.trim(name))
    return df.select(key.alias("name"), F.col(ident)).where("name != ''").groupBy("name").agg(F.count("*").alias("n"), F.min(ident).alias(ident)).where("n = 1").drop("n")


def exact_name(df: DataFrame, name: str, wanted: Column) -> DataFrame:
    """One row: (status, n) of a case-insensitive whole-name lookup: resolved, ambiguous or missing."""
    n = F.count_if(F.lower(F.col(name)) == F.lower(wanted))
    return df.agg(n.alias("n")).select(F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("status"), "n")


def missing_nodes(items: DataFrame, nodes: DataFrame, world: str, item: str, node_item: str) -> DataFrame:
    """(world, item, order) of items without a node; they follow the world's root nodes in the order of ``item``.

    The rank inside a world is taken among the missing only.
    """
    roots = nodes.where("parent is null").groupBy(world).agg(F.count("*").alias("__roots"))
    absent = items.join(nodes.select(F.col(node_item).alias(item)).distinct(), item, "left_anti")
    rank = F.row_number().over(Window.partitionBy(world).orderBy(item)) - 1
    return absent.join(roots, world, "left").select(world, item, (F.coalesce("__roots", F.lit(0)) + rank).cast("long").alias("order"))


def integrity_violations(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``child`` whose keys are set and that no row of ``parent`` has."""
    return child.where(" and ".join(f"{k} is not null" for k in keys)).join(parent.select(*keys).distinct(), list(keys), "left_anti")


def owned(child: DataFrame, worlds: DataFrame, world: str, owner: Column) -> DataFrame:
    """Rows of ``child`` in worlds of one owner."""
    return child.join(worlds.where(F.col("owner_id") == owner).select(world), world, "left_semi")


def summarize(df: DataFrame, status: str, kind: str, key: str | None = None) -> DataFrame:
    """total, count by status as columns of a map, count by kind as a map."""
    group = df.groupBy(*([key] if key else []), status, kind).agg(F.count("*").alias("n"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))) for c in (status, kind)]
    by_status = group.groupBy(*([key] if key else []), status).agg(F.sum("n").alias("n"))
    by_kind = group.groupBy(*([key] if key else []), kind).agg(F.sum("n").alias("n"))
    if key is None:
        return by_status.agg(F.sum("n").alias("total"), maps[0].alias("by_status")).crossJoin(F.broadcast(by_kind.agg(maps[1].alias("by_kind"))))
    return by_status.groupBy(key).agg(F.sum("n").alias("total"), maps[0].alias("by_status")).join(by_kind.groupBy(key).agg(maps[1].alias("by_kind")), key)


def quota(df: DataFrame, code: str, counts: Column, max_uses: str) -> DataFrame:
    """(code, used, remaining, exhausted) of uses that count; a null limit is none."""
    used = F.count_if(counts)
    return df.groupBy(code).agg(used.alias("used"), F.max(max_uses).alias("limit")).select(code, "used", F.greatest(F.lit(0), F.col("limit") - F.col("used")).alias("remaining"), F.coalesce(F.col("used") >= F.col("limit"), F.lit(False)).alias("exhausted"))


def stale(documents: DataFrame, worlds: DataFrame, world: str) -> DataFrame:
    """Documents with whether content or canon moved on since the last analysis."""
    met = documents.join(worlds.select(world, "canon_version"), world, "left")
    content = ~F.col("content_version").eqNullSafe(F.col("synced_version"))
    canon = ~F.col("canon_version").eqNullSafe(F.col("last_canon_version"))
    return met.withColumns({"content_changed": content, "canon_changed": canon, "needs_analysis": content | canon})


#: Statuses that a listing may ask for.
STATUSES = ("pending", "accepted", "ignored", "superseded", "all")


def list_suggestions(df: DataFrame, status: str, version: Column | None = None) -> DataFrame:
    """Rows of one status (pending ones of the given document version only) that have an identifier; the surest first, then the oldest. An unknown status is an error."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    out = df.where("suggestion_id is not null and suggestion_id != ''")
    if status != "all":
        out = out.where(F.col("status") == status)
    if status == "pending" and version is not None:
        out = out.where(F.col("document_version") == version)
    return out.orderBy(F.desc("confidence"), "created_at")


def expired(expires_at: Column, now: Column) -> Column:
    """Whether a deadline has passed; none has always passed."""
    return F.coalesce(expires_at <= now, F.lit(True))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns with what stands for null; columns that are missing are added."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def presentation(concepts: DataFrame, labels: DataFrame, locale: str) -> DataFrame:
    """concepts (concept_id) with label and icon in a locale, else in English, else from the identifier's last part."""
    own = labels.where(F.col("locale") == locale).select("concept_id", F.col("label").alias("__own"), "icon")
    en = labels.where("locale = 'en'").select("concept_id", F.col("label").alias("__en"), F.col("icon").alias("__icon"))
    last = F.initcap(F.regexp_replace(F.element_at(F.split("concept_id", "\\."), -1), "[_-]", " "))
    met = concepts.join(own, "concept_id", "left").join(en, "concept_id", "left")
    return met.select(*concepts.columns, F.coalesce("__own", "__en", last).alias("label"), F.coalesce("icon", "__icon").alias("icon"))


def json_without_missing(df: DataFrame, columns: Sequence[str], present: Column) -> Column:
    """JSON of the columns named in the array ``present``; a null among them stays a null."""
    pairs = [F.when(F.array_contains(present, c), F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2), F.lit("null")))) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def distinct_in_order(c: Column) -> Column:
    """An array without null, empty and repeated values, in its order."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def union_by_start(parts: Sequence[DataFrame], start: str = "start") -> DataFrame:
    """Candidates of several streams, by where they start; those without a place last."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.asc_nulls_last(start))


def claim_unowned(worlds: DataFrame, owner: Column) -> DataFrame:
    """Worlds without an owner get one."""
    return worlds.withColumn("owner_id", F.coalesce("owner_id", owner))


def insert_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored and the rows of ``new`` whose keys it lacks, one a key."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that aren't unique, nulls left out: the check before a snapshot is switched to."""
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
