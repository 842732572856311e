"""Event-sourced relation state: replay of produce and end events by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Why an event doesn't count, the first that holds.
IGNORED = ("negated", "intended", "uncertain")


def judge_events(events: DataFrame) -> DataFrame:
    """Events with ``verdict``: confirmed, negated, intended, uncertain, missing-subject, missing-object or non-relation."""
    verdict = F.when(F.col("action").isNull(), "non-relation")
    for flag in IGNORED:
        verdict = verdict.when(F.coalesce(F.col(flag), F.lit(False)), flag)
    verdict = verdict.when(F.coalesce("subject", F.lit("")) == "", "missing-subject").when(F.coalesce("object", F.lit("")) == "", "missing-object")
    return events.withColumn("verdict", verdict.otherwise("confirmed"))


def _episodes(events: DataFrame, world: str, seq: str) -> DataFrame:
    """Confirmed events with ``applied`` and the number of their episode of the relation.

    Among confirmed events of a key an end applies exactly if the event before it
    produces, and a new episode begins after an end (or at the start), so windows over the
    key replay the log; the long history of one key is its own window partition.
    """
    w = Window.partitionBy(world, "subject", "relation", "object").orderBy(seq)
    ok = events.where("verdict = 'confirmed'").withColumn("__last", F.lag("action").over(w))
    ok = ok.withColumn("applied", (F.col("action") == "produce") | F.coalesce(F.col("__last") == "produce", F.lit(False)))
    opens = F.when((F.col("action") == "produce") & (F.coalesce("__last", F.lit("end")) == "end"), 1).otherwise(0)
    return ok.withColumn("episode", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__last")


def replay_history(events: DataFrame, world: str = "world", seq: str = "seq") -> DataFrame:
    """Every event with ``applied`` and ``reason`` (null if applied)."""
    judged = judge_events(events)
    done = _episodes(judged, world, seq).select(world, seq, "applied")
    met = judged.join(done, [world, seq], "left")
    reason = F.when(F.col("verdict") != "confirmed", F.col("verdict")).when(~F.col("applied"), "no-active-relation")
    return met.withColumns({"applied": F.coalesce("applied", F.lit(False)), "reason": reason}).drop("verdict")


def replay_state(events: DataFrame, world: str = "world", seq: str = "seq") -> DataFrame:
    """One row an episode of a relation: state (active, ended), when it started, last changed and ended, from which events, how sure.

    An active relation is as sure as its surest event; an ended one at most as the end.
    """
    steps = _episodes(judge_events(events), world, seq).where("applied")
    sure = F.max(F.when(F.col("action") == "produce", F.col("confidence")))
    ended = F.max(F.when(F.col("action") == "end", F.col(seq)))
    by = F.max(F.when(F.col("action") == "end", F.col("confidence")))
    return (
        steps.groupBy(world, "subject", "relation", "object", "episode")
        .agg(F.min(seq).alias("started_by"), F.max(seq).alias("last_changed_by"), ended.alias("ended_by"), F.array_sort(F.collect_list(seq)).alias("derived_from"), F.least(sure, F.coalesce(by, sure)).alias("confidence"))
        .withColumn("state", F.when(F.col("ended_by").isNull(), "active").otherwise("ended"))
    )
