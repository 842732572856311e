"""Suggestion lifecycle: canonical diff, revision merge, status transitions.

Mutations are pure: old snapshot and delta give a new snapshot, which the caller writes
beside the old one and switches to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_diff(suggested: DataFrame, canon: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Suggestions with the stored value: ``status`` is satisfied (equal, nulls included), drift (another value) or missing (no row)."""
    stored = canon.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("__there"))
    met = suggested.join(stored, keys, "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.col(value).eqNullSafe(F.col("stored")), "satisfied").otherwise("drift")
    return met.withColumn("status", status).drop("__there")


def revision_summary(revisions: DataFrame, key: str = "semantic_key") -> DataFrame:
    """Per key: whether some revision is ignored, accepted and edited, accepted, pending (edited?), superseded; the newest number of each; the next number."""
    flag = lambda c: F.max(F.when(c, F.lit(True)).otherwise(F.lit(False)))
    status = F.col("status")
    newest = lambda s: F.max(F.when(status == s, F.col("revision")))
    return revisions.groupBy(key).agg(
        flag(status == "ignored").alias("ignored"), flag((status == "accepted") & F.col("edited")).alias("corrected"), flag(status == "accepted").alias("accepted"),
        flag(status == "pending").alias("pending"), F.max_by(F.col("edited"), F.when(status == "pending", F.col("revision"))).alias("pending_edited"), flag(status == "superseded").alias("superseded"),
        newest("pending").alias("pending_revision"), newest("superseded").alias("superseded_revision"), (F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("next_revision"),
    )


def merge_action(incoming: Column) -> Column:
    """The action on a key's group: what the user decided stands before what is pending, and that before making or waking a revision."""
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    seen = (
        F.when(there("ignored"), "preserve").when(there("corrected"), "preserve")
        .when(there("pending"), F.when(there("pending_edited"), "refresh-metadata").otherwise("refresh"))
        .when(there("accepted"), "create-revision").when(there("superseded"), "reactivate").otherwise("create")
    )
    return F.when(incoming, seen).otherwise(F.when(there("pending"), "supersede").otherwise("unchanged"))


def plan_merge(incoming: DataFrame, revisions: DataFrame, key: str = "semantic_key") -> DataFrame:
    """(key, action, revision): what a re-analysis does to every group, stored or new."""
    met = incoming.select(key).distinct().withColumn("__in", F.lit(True)).join(revision_summary(revisions, key), key, "full")
    action = merge_action(F.coalesce("__in", F.lit(False)))
    revision = F.when(action.isin("create", "create-revision"), F.coalesce("next_revision", F.lit(1))).when(action.isin("refresh", "refresh-metadata", "supersede"), F.col("pending_revision")).when(action == "reactivate", F.col("superseded_revision"))
    return met.select(key, action.alias("action"), revision.cast("int").alias("revision"))


def merge_revisions(incoming: DataFrame, revisions: DataFrame, key: str = "semantic_key") -> DataFrame:
    """The new snapshot (key, revision, status, edited, payload, confidence) after a re-analysis.

    ``incoming`` has key, payload and confidence; of several rows of a key the surest counts.
    """
    best = incoming.groupBy(key).agg(F.max(F.struct("confidence", "payload")).alias("new"))
    plan = plan_merge(best, revisions, key)
    todo = plan.join(best, key, "left").select(key, "action", F.col("revision").alias("__r"), "new")
    hit = (F.col("revision") == F.col("__r")) & F.col("action").isin("refresh", "refresh-metadata", "supersede", "reactivate")
    kept = revisions.join(todo, key, "left").select(
        key, "revision",
        F.when(hit & (F.col("action") == "supersede"), "superseded").when(hit, "pending").otherwise(F.col("status")).alias("status"),
        "edited",
        F.when(hit & F.col("action").isin("refresh", "reactivate"), F.col("new.payload")).otherwise(F.col("payload")).alias("payload"),
        F.when(hit & (F.col("action") != "supersede"), F.col("new.confidence")).otherwise(F.col("confidence")).alias("confidence"),
    )
    made = todo.where(F.col("action").isin("create", "create-revision")).select(key, F.col("__r").alias("revision"), F.lit("pending").alias("status"), F.lit(False).alias("edited"), F.col("new.payload").alias("payload"), F.col("new.confidence").alias("confidence"))
    return kept.unionByName(made)


def transition(status: Column, to: str) -> Column:
    """The status after a request: pending rows move, a repeated request changes nothing, all else is refused (null)."""
    return F.when(status == "pending", to).when(status == to, status)


def bump_version(version: Column, changed: Column) -> Column:
    """The version, one higher if anything really changed."""
    return version + F.when(changed, 1).otherwise(0)


def cascade_delete(tables: dict[str, DataFrame], worlds: DataFrame, world: str = "world") -> dict[str, DataFrame]:
    """Every table without the rows of the given worlds."""
    return {name: t.join(worlds.select(world), world, "left_anti") for name, t in tables.items()}
