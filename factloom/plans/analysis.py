"""The analysis of whole corpora: documents to spans, clauses, candidates, links, suggestions.

One lazily built plan; the only shared intermediate is the table of spans, which the
caller may persist (``keep``) because several branches read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import SUGGESTION_TIERS, tier, weakest_link
from ..operators import discovery, events, extract, linking, matching, state, suggest


def analyse(docs: DataFrame, lexicon: DataFrame, concepts: DataFrame, entities: DataFrame, locale: str = "en", closure: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Tables of an analysis of (doc_id, text): spans, clauses, fields, relations, events, state, suggestions.

    concepts: (concept_id, kind, produces, ends). entities: (entity_id, name, aliases,
    type). Texts keep their case for clauses; both read the same offsets, so texts must
    be normalised but for case (``clean``).
    """
    docs = docs.select("doc_id", clean(F.col("text")).alias("text"))
    kinds = concepts.select("concept_id", "kind")
    spans = keep(matching.collapse_evidence(matching.match_lexicon(docs, lexicon, locale)).join(kinds, "concept_id", "left"))
    clauses = text.clause_rows(docs, locale=locale)
    relations = discovery.extract_relations(spans, clauses)
    patterns = extract.extract_patterns(clauses, locale)
    subject = discovery.subject_left(F.substring(F.col("text"), F.lit(1), F.col("start") - F.col("__from")), F.lit(""))
    fields = patterns.join(clauses.select("doc_id", "clause_idx", "text", F.col("start").alias("__from")), ["doc_id", "clause_idx"]).withColumn("subject", subject).select("doc_id", "subject", "field_concept", "value", "confidence", "start")
    fields = fields.unionByName(discovery.preferred_fields(relations).select("doc_id", "subject", "field_concept", "value", "confidence", "start"))
    assembled = events.assemble(clauses, spans, concepts.select("concept_id", "produces", "ends"))
    return {
        "spans": spans, "clauses": clauses, "fields": fields, "relations": relations, "events": assembled,
        "state": state.replay_state(events.relation_log(assembled)),
        "suggestions": suggestions(fields, relations, assembled, entities, closure),
    }


def clean(c):
    """A text in normal form but for its case and composition."""
    return text.normalize_text(c, "zh", compose=False)


def suggestions(fields: DataFrame, relations: DataFrame, assembled: DataFrame, entities: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(doc_id, suggestion_id, kind, status, subject, object, concept, value, confidence, tier) of what the texts say and canon may lack."""
    empty = F.lit(None).cast("string")
    rows = (
        fields.where("subject is not null").select("doc_id", F.lit("field-update").alias("kind"), "subject", empty.alias("object"), F.col("field_concept").alias("concept"), "value", "confidence", F.lit(False).alias("unsure"))
        .unionByName(relations.where(f"subject is not null and relation not in ({', '.join(repr(r) for r in discovery.PREFERRED_FIELDS)})").select("doc_id", F.lit("relation-update").alias("kind"), "subject", "object", F.col("relation").alias("concept"), empty.alias("value"), "confidence", F.lit(False).alias("unsure")))
        .unionByName(assembled.select("doc_id", F.lit("event-history").alias("kind"), "subject", "object", F.col("event_concept").alias("concept"), empty.alias("value"), "confidence", (F.col("negated") | F.col("intended") | F.col("uncertain")).alias("unsure")))
    )
    hints = rows.select(F.explode(F.array("subject", "object")).alias("hint")).where("hint is not null").distinct().select(F.col("hint").alias("hint_id"), "hint", F.array().cast("array<string>").alias("expected"))
    linked = linking.link(hints, entities, closure).select("hint", "status", "entity_id")
    made = rows
    for side in ("subject", "object"):
        made = made.join(linked.select(F.col("hint").alias(side), F.col("status").alias(f"{side}_link"), F.col("entity_id").alias(f"{side}_id")), side, "left")
    ready = F.col("subject_id").isNotNull() & ((F.col("kind") != "relation-update") | F.col("object_id").isNotNull())
    status = F.when(F.col("kind") == "event-history", F.when(F.col("unsure"), "informational").otherwise("needs-user-confirmation")).when(ready, "ready").otherwise("needs-user-confirmation")
    facts = made.select("doc_id", suggest.suggestion_id(F.col("kind"), F.coalesce("subject_id", text.draft_key(F.col("subject"), False)), F.col("concept"), F.coalesce("object_id", text.draft_key(F.col("object"), False)), F.col("value")).alias("suggestion_id"), "kind", status.alias("status"), "subject", "object", "concept", "value", "confidence")
    named = made.where("subject is not null").select("doc_id", F.col("subject").alias("name"), F.col("subject_link").alias("link"), "confidence").unionByName(made.where("object is not null and kind = 'relation-update'").select("doc_id", F.col("object").alias("name"), F.col("object_link").alias("link"), "confidence"))
    fresh = named.where("link = 'missing'").where(~F.lower("name").isin(*discovery.PRONOUNS, "it", "they", "its", "their"))
    new = fresh.groupBy("doc_id", text.draft_key(F.col("name"), False).alias("k")).agg(F.min("name").alias("name"), F.max("confidence").alias("c"), F.count("*").alias("n"))
    entity = new.select("doc_id", suggest.suggestion_id(F.lit("create-entity"), F.col("k")).alias("suggestion_id"), F.lit("create-entity").alias("kind"), F.lit("needs-user-confirmation").alias("status"), F.col("name").alias("subject"), empty.alias("object"), empty.alias("concept"), empty.alias("value"), weakest_link(F.col("c"), F.least(F.lit(1.0), 0.6 + 0.1 * F.col("n"))).alias("confidence"))
    # The same fact said twice in a document is one suggestion, as sure as its surest saying.
    every = facts.unionByName(entity)
    rest = [c for c in every.columns if c not in ("doc_id", "suggestion_id", "confidence")]
    once = every.groupBy("doc_id", "suggestion_id").agg(F.max(F.struct("confidence", *rest)).alias("b")).select("doc_id", "suggestion_id", *(F.col(f"b.{c}").alias(c) for c in (*rest, "confidence")))
    return once.withColumn("tier", tier(F.col("confidence"), SUGGESTION_TIERS)).where("tier != 'suppressed'")


def split_by_canon(found: DataFrame, canon_fields: DataFrame) -> DataFrame:
    """Field suggestions with whether the stored value (subject, concept, stored) already says so."""
    met = found.where("kind = 'field-update'").join(canon_fields, ["subject", "concept"], "left")
    return met.withColumn("satisfied", F.col("stored").eqNullSafe(F.col("value")))
