"""What may be stored: schema fields and values for candidates, facts said better elsewhere, and references that wait for others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_name_form
from ..functions.values import canonical_json
from ..sources.scratch import forget, stored
from .linking import compatibility, field_type, map_fields, select_value

#: Fixed: an event and the field that says it better.
BIRTH, BIRTHPLACE = "event.birth", "field.birthplace"


def _form(c: str) -> Column:
    return F.lower(F.trim(c))


def resolve_fields(candidates: DataFrame, fields: DataFrame, labels: DataFrame, canonical: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Field candidates against the user's schemas: ``resolved`` (every candidate) and three side tables of what the schemas lack.

    candidates: (cand_id, field_concept, value, subject_type, draft_type, has_draft, runtime, confidence, expected); a stored subject's
    type goes before a draft's. fields: (type_id, field_key, label, concept, kind, options, allowed), one row a field, types
    without fields as a row with a null key; labels: (concept, label); canonical: (concept, kind) of values; entities:
    (entity_id, name, type_id). ``resolved`` is a stored table, so its four readers don't run it again.
    ``schema_suggestions`` (type_id, field_concept, examples, confidence), ``option_suggestions`` (field_key, value, confidence) and
    ``reference_suggestions`` (name, field_concept, expected, allowed, confidence) hold each thing once.
    """
    typed = candidates.withColumns({"type_id": F.coalesce("subject_type", "draft_type"), "type_source": F.when(F.col("subject_type").isNotNull(), "canonical-entity").when(F.col("draft_type").isNotNull(), "draft-inferred-type")})
    there = fields.select("type_id").distinct().withColumn("__there", F.lit(True))
    wanted = typed.where("type_id is not null").select("type_id", F.col("field_concept").alias("concept")).distinct()
    real = fields.where("field_key is not null")
    mapped = map_fields(wanted, real, labels).select("type_id", F.col("concept").alias("field_concept"), F.col("status").alias("__status"), "field_key", F.col("confidence").alias("field_confidence"))
    met = typed.join(there, "type_id", "left").join(mapped, ["type_id", "field_concept"], "left")
    status = (
        F.when(F.col("type_id").isNull(), F.when(F.col("has_draft"), "draft-subject-type-unmaterialized").otherwise("missing-subject-type"))
        .when(F.col("__there").isNull(), "missing-entity-type-schema").otherwise(F.coalesce("__status", F.lit("missing")))
    )
    met = met.withColumn("status", status).withColumn("field_key", F.when(F.col("status") == "resolved", F.col("field_key"))).drop("__there", "__status")
    met = met.join(real.select("type_id", "field_key", field_type(F.col("kind")).alias("kind"), "options", "allowed"), ["type_id", "field_key"], "left").join(canonical.select(F.col("concept").alias("field_concept"), F.col("kind").alias("__canonical")), "field_concept", "left")
    # References meet entities by name, of the allowed types only.
    known = entities.select(entity_name_form(F.col("name"), False).alias("__name"), "entity_id", F.col("type_id").alias("__type"))
    asked = met.where("kind = 'entity-reference'").select("cand_id", entity_name_form(F.col("value"), False).alias("__name"), "allowed").where("__name != ''")
    found = asked.join(known, "__name").where(F.col("allowed").isNull() | (F.size("allowed") == 0) | F.array_contains("allowed", F.col("__type"))).groupBy("cand_id").agg(F.count_distinct("entity_id").alias("__n"), F.min("entity_id").alias("__id"))
    met = met.join(found, "cand_id", "left")
    option = select_value(F.col("value"), F.coalesce("options", F.array().cast("array<string>")))
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    is_ref, is_select = F.col("kind") == "entity-reference", F.col("kind") == "select"
    value_status = (
        F.when(F.col("status") != "resolved", None)
        .when(is_select, F.when(option["status"] == "resolved", "resolved").when(option["status"] == "ambiguous", "ambiguous-option").otherwise("missing-option"))
        .when(is_ref, F.when(blank, "missing-reference-hint").when(F.col("__n").isNull(), "missing-reference").when(F.col("__n") > 1, "ambiguous-reference").otherwise("resolved"))
        .otherwise("not-needed")
    )
    fit = compatibility(F.col("kind"), F.col("__canonical"), F.col("runtime"))
    met = met.withColumns({"fit": F.when(F.col("status") == "resolved", fit), "value_status": value_status, "__option": option["option"]})
    # An unresolved name is never stored as if it were a reference.
    kept = F.when(F.col("value_status") == "resolved", F.when(is_ref, F.col("__id").cast("string")).otherwise(F.col("__option"))).when((F.col("value_status") == "missing-option") | (F.col("value_status") == "ambiguous-option") | (F.col("value_status") == "not-needed"), F.when(F.coalesce(F.col("fit.compatible"), F.lit(True)), F.col("value")))
    resolved = stored(met.withColumn("stored_value", kept).select(*candidates.columns, "type_id", "type_source", "status", "field_key", "field_confidence", F.col("fit.status").alias("fit"), "value_status", "stored_value", "allowed"))
    order = F.col("cand_id")
    first = lambda c: F.min_by(c, order)
    lacking = resolved.where("status = 'missing'").groupBy("type_id", "field_concept", F.coalesce(canonical_json(F.col("value")), F.col("value")).alias("__v")).agg(first("value").alias("value"), F.min(order).alias("__o"), F.max("confidence").alias("confidence"))
    schema = lacking.groupBy("type_id", "field_concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "value"))), lambda x: x["value"]).alias("examples"), F.max("confidence").alias("confidence"))
    options = resolved.where("value_status = 'missing-option'").groupBy("field_key", _form("value").alias("__v")).agg(first("value").alias("value"), F.max("confidence").alias("confidence")).drop("__v")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    references = resolved.where("value_status = 'missing-reference'").groupBy(_form("value").alias("__v"), "field_concept").agg(first("value").alias("name"), union(F.col("expected")).alias("expected"), union(F.col("allowed")).alias("allowed"), F.max("confidence").alias("confidence")).drop("__v")
    return {"resolved": resolved, "schema_suggestions": schema, "option_suggestions": options, "reference_suggestions": references}


def not_said_by_fields(relations: DataFrame, fields: DataFrame, doc: str = "doc_id", compose: bool = False) -> DataFrame:
    """Relations (doc, relation, subject, object) that no field-first candidate (doc, relation, subject, value) says; a side without a name is said by none."""
    key = lambda c: F.nullif(entity_name_form(F.col(c), compose), F.lit(""))
    said = fields.select(F.col(doc).alias("__d"), F.col("relation").alias("__r"), key("subject").alias("__s"), key("value").alias("__o")).where("__s is not null and __o is not null").distinct()
    own = relations.withColumns({"__ks": key("subject"), "__ko": key("object")})
    return own.join(said, (F.col(doc) == F.col("__d")) & (F.col("relation") == F.col("__r")) & (F.col("__ks") == F.col("__s")) & (F.col("__ko") == F.col("__o")), "left_anti").drop("__ks", "__ko")


def not_redundant(events: DataFrame, fields: DataFrame, doc: str = "doc_id", event: str = BIRTH, field: str = BIRTHPLACE) -> DataFrame:
    """Events (doc, event_id, concept, subject_id, subject) without those of kind ``event`` that a ``field`` candidate (doc, concept, subject_id, subject) says.

    Two known ids decide by themselves; else two known names do; an event that knows neither is said by any such field of its
    document. Each case is an equi-join, on what it compares.
    """
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    f = fields.where(F.col("concept") == field).select(F.col(doc).alias("__d"), F.col("subject_id").alias("__id"), name("subject").alias("__n")).distinct()
    e = events.where(F.col("concept") == event).select(doc, "event_id", "subject_id", name("subject").alias("__own"))
    same = F.col(doc) == F.col("__d")
    by_id = e.join(f.where("__id is not null").select("__d", "__id").distinct(), same & (F.col("subject_id") == F.col("__id")), "left_semi")
    one_id = lambda side, other: e.where(f"subject_id is {side}").join(f.where(f"__id is {other}").select("__d", "__n").where("__n is not null").distinct(), same & (F.col("__own") == F.col("__n")), "left_semi")
    by_name = one_id("null", "not null").unionByName(one_id("null", "null")).unionByName(one_id("not null", "null"))
    bare = e.where("subject_id is null and __own is null").join(f.select("__d").distinct(), same, "left_semi")
    said = by_id.unionByName(by_name).unionByName(bare).select(doc, "event_id").distinct()
    return events.join(said, [doc, "event_id"], "left_anti")


def apply_in_order(batch: DataFrame, accepted: DataFrame, keys: Sequence[str] = ("doc_id",), most: int = 1000) -> DataFrame:
    """A batch of suggestions (keys, suggestion_id, draft_key, needs) with ``level`` and ``entity_id`` where they can be applied, and ``missing`` where they must wait.

    A suggestion that needs drafts (an array of keys) can be applied once each of these was accepted before (keys, draft_key,
    entity_id) or is made by a suggestion of the batch that was itself applied on an earlier level; what it makes gets an id from its
    keys. One round applies a whole level; the rest, cycles included, is deferred with the first missing
    draft. Of two makers of one draft the one that is applied first counts.
    """
    keys = list(keys)
    open_ = batch.select(*keys, "suggestion_id", "draft_key", F.explode_outer("needs").alias("need"))
    waits = stored(open_.where("need is not null").select(*keys, "suggestion_id", "need").distinct())
    made = stored(accepted.select(*keys, "draft_key", F.lit(-1).alias("level")).distinct())
    done = None
    for level in range(most):
        # Who still waits for something that isn't there yet.
        blocked = waits.join(made.select(*keys, F.col("draft_key").alias("need")).distinct(), [*keys, "need"], "left_anti").select(*keys, "suggestion_id").distinct()
        rest = batch.select(*keys, "suggestion_id", "draft_key") if done is None else batch.select(*keys, "suggestion_id", "draft_key").join(done.select(*keys, "suggestion_id"), [*keys, "suggestion_id"], "left_anti")
        now = stored(rest.join(blocked, [*keys, "suggestion_id"], "left_anti").withColumn("level", F.lit(level)))
        if now.isEmpty():
            break
        done = now if done is None else done.unionByName(now)
        # Only a draft that is new can free anybody.
        made = made.unionByName(now.where("draft_key is not null").select(*keys, "draft_key", "level")).groupBy(*keys, "draft_key").agg(F.min("level").alias("level"))
    forget(now)
    applied = (done if done is not None else batch.select(*keys, "suggestion_id", "draft_key").limit(0).withColumn("level", F.lit(0))).select(*keys, "suggestion_id", "level")
    lacking = waits.join(made.select(*keys, F.col("draft_key").alias("need")).distinct(), [*keys, "need"], "left_anti").groupBy(*keys, "suggestion_id").agg(F.min("need").alias("missing"))
    ident = F.sha2(F.concat_ws("::", *keys, "draft_key"), 256).substr(1, 16)
    out = batch.join(applied, [*keys, "suggestion_id"], "left").join(lacking, [*keys, "suggestion_id"], "left")
    return out.withColumns({"entity_id": F.when(F.col("level").isNotNull() & F.col("draft_key").isNotNull(), ident), "missing": F.when(F.col("level").isNull(), F.col("missing"))})
