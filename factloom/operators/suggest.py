"""Suggestions: contract, identifiers, emission order, payloads, editing and applying."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import SUGGESTION_TIERS, tier
from ..functions.text import joined_key

#: Fixed: kinds in the order in which they are emitted, and what each must have: groups of which one is set.
KINDS = ("create-schema-field", "create-select-option", "create-entity", "field-update", "relation-update", "event-history")
REQUIRED: dict[str, tuple[tuple[str, ...], ...]] = {
    "field-update": (("target_entity_id", "target_draft_key"), ("field_key", "field_concept"), ("value",)),
    "relation-update": (("subject_entity_id", "subject_draft_key"), ("relation_concept",), ("object_entity_id", "object_draft_key")),
    "create-entity": (("name",),),
    "create-schema-field": (("target_type_id",), ("field_concept",), ("suggested_label",), ("suggested_value_type",)),
    "create-select-option": (("target_type_id",), ("field_key", "field_concept"), ("option",)),
    "event-history": (("event_concept",),),
}
#: Fixed: payload keys that a user may edit, by kind.
EDITABLE: dict[str, tuple[str, ...]] = {
    "field-update": ("value",),
    "relation-update": ("subject_entity_id", "subject_name", "relation_concept", "object_entity_id", "object_name"),
    "event-history": ("subject_entity_id", "subject_name", "event_concept", "object_entity_id", "object_name"),
    "create-entity": ("name", "entity_type_id", "likely_type_concept", "recommended_type_name", "recommended_type_icon", "recommended_fields"),
    "create-schema-field": ("suggested_label", "suggested_value_type"),
    "create-select-option": ("value",),
}


def _set(name: str, columns: Sequence[str]) -> Column:
    return F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "") if name in columns else F.lit(False)


def contract_errors(suggestions: DataFrame) -> Column:
    """Array of what a row lacks: the first column of every group of which none is set; ``kind`` if that is unknown."""
    cols, errors = suggestions.columns, [F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS), F.lit("kind"))]
    for kind, groups in REQUIRED.items():
        for group in groups:
            any_set = F.lit(False)
            for name in group:
                any_set = any_set | _set(name, cols)
            errors.append(F.when((F.col("kind") == kind) & ~any_set, F.lit(group[0])))
    return F.array_compact(F.array(*errors))


def validated(suggestions: DataFrame) -> DataFrame:
    """Suggestions with ``errors`` and ``valid``."""
    return suggestions.withColumn("errors", contract_errors(suggestions)).withColumn("valid", F.size("errors") == 0)


def field_update_status(entity_id: Column, draft: Column, field_key: Column, concept: Column, compatible: Column, resolution: Column, value: Column) -> Column:
    """ready, needs-user-confirmation, or null if nothing is suggested: a target, a field, a value that fits are needed; ready needs them stored."""
    dropped = (entity_id.isNull() & draft.isNull()) | (field_key.isNull() & concept.isNull()) | compatible.eqNullSafe(False) | F.coalesce(resolution, F.lit("")).isin("missing-option", "ambiguous-reference", "missing-reference-hint") | value.isNull()
    return F.when(~dropped, F.when(entity_id.isNotNull() & field_key.isNotNull(), "ready").otherwise("needs-user-confirmation"))


def field_update_warnings(entity_id: Column, field_key: Column) -> Column:
    return F.array_compact(F.array(F.when(entity_id.isNull(), "TARGET_ENTITY_IS_DRAFT"), F.when(field_key.isNull(), "FIELD_SCHEMA_NOT_MATERIALIZED")))


def event_status(negated: Column, intended: Column, uncertain: Column) -> Column:
    """Events that didn't surely happen only inform."""
    return F.when(F.coalesce(negated, F.lit(False)) | F.coalesce(intended, F.lit(False)) | F.coalesce(uncertain, F.lit(False)), "informational").otherwise("needs-user-confirmation")


def deduplicate(suggestions: DataFrame, key: str = "suggestion_id", seq: str = "seq") -> DataFrame:
    """One row an identifier: the first, with the greatest confidence and all warnings; tiers are set and suppressed ones go."""
    rest = [c for c in suggestions.columns if c not in (key, "confidence", "warnings", seq)]
    g = suggestions.groupBy(key).agg(F.min(F.struct(seq, *rest)).alias("f"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("warnings", F.array().cast("array<string>")))))).alias("warnings"))
    out = g.select(key, F.col(f"f.{seq}").alias(seq), *(F.col(f"f.{c}").alias(c) for c in rest), "confidence", "warnings").withColumn("tier", tier(F.col("confidence"), SUGGESTION_TIERS))
    return out.where("tier != 'suppressed'")


def emission_rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out


def suggestion_id(kind: Column, *parts: Column) -> Column:
    return joined_key(kind, *parts)


def revision_id(key: Column, revision: Column) -> Column:
    return F.concat_ws("::", key, F.lit("revision"), revision.cast("string"))


def payload(suggestions: DataFrame) -> Column:
    """The kind's own columns as JSON; a null that the row has stays in it."""
    out = F.lit(None).cast("string")
    for kind, groups in REQUIRED.items():
        names = [n for g in groups for n in g if n in suggestions.columns]
        if names:
            out = F.when(F.col("kind") == kind, F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).otherwise(out)
    return out


def edited_payload(kind: Column, stored: Column, patch: Column) -> Column:
    """map payload after a user's patch: only the kind's editable keys change; null if the patch touches any other."""
    allowed = F.lit(None).cast("array<string>")
    for k, names in EDITABLE.items():
        allowed = F.when(kind == k, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(allowed)
    ok = F.forall(F.map_keys(patch), lambda x: F.array_contains(allowed, x))
    return F.when(ok, F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch))


def display_order(suggestions: DataFrame, group: Sequence[str], tier: Column, dependency: Column, confidence: str, seq: str, to: str = "place") -> DataFrame:
    """All suggestions with their place (from 1) in their group's display: by tier, what others depend on first, confidence to a thousandth, then sighting."""
    w = Window.partitionBy(*group).orderBy(tier, dependency, -F.round(confidence, 3), seq)
    return suggestions.withColumn(to, F.row_number().over(w))


def split_informational(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to store, skipped)."""
    return records.where("status != 'informational'"), records.where("status = 'informational'")


def apply_field_updates(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """entities (entity_id, values map) after accepted updates (entity_id, field_key, value, seq): the last of a field wins; applying twice changes nothing."""
    last = accepted.groupBy("entity_id", "field_key").agg(F.max(F.struct("seq", "value")).alias("v")).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", F.col("v.value").alias("value"))))).alias("__new"))
    met = entities.join(last, "entity_id", "left")
    keep = F.map_filter("values", lambda k, v: ~F.array_contains(F.map_keys("__new"), k))
    return met.withColumn("values", F.when(F.col("__new").isNull(), F.col("values")).otherwise(F.map_concat(keep, F.col("__new")))).drop("__new")


def apply_create_entities(entities: DataFrame, accepted: DataFrame, world: str = "world") -> DataFrame:
    """entities after accepted creations (world, entity_id, name): names that the world already has, without case, aren't made again, nor is one twice."""
    w = Window.partitionBy(world, "__n").orderBy("entity_id")
    new = accepted.withColumn("__n", F.lower(F.trim("name"))).withColumn("__k", F.row_number().over(w)).where("__k = 1").join(entities.select(world, F.lower(F.trim("name")).alias("__n")), [world, "__n"], "left_anti").drop("__n", "__k")
    return entities.unionByName(new, allowMissingColumns=True)


def apply_relations(relations: DataFrame, accepted: DataFrame, keys: Sequence[str] = ("world", "subject_id", "relation", "object_id")) -> DataFrame:
    """relations after accepted ones: an edge that exists isn't added again."""
    return relations.unionByName(accepted.dropDuplicates(list(keys)).join(relations.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def apply_options(fields: DataFrame, accepted: DataFrame) -> DataFrame:
    """fields (type_id, field_key, options) after accepted options: new without case, in order."""
    new = accepted.groupBy("type_id", "field_key").agg(F.array_sort(F.collect_set("option")).alias("__o"))
    met = fields.join(new, ["type_id", "field_key"], "left")
    fresh = F.filter(F.coalesce("__o", F.array().cast("array<string>")), lambda o: ~F.exists(F.coalesce("options", F.array().cast("array<string>")), lambda x: F.lower(x) == F.lower(o)))
    return met.withColumn("options", F.concat(F.coalesce("options", F.array().cast("array<string>")), fresh)).drop("__o")


def cast_values(entities: DataFrame, schema: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """entities with their values map read by (type, required) of each key: ``clean`` keeps what casts, ``error`` names the first that doesn't; unknown keys go."""
    clean, errors = [], []
    for key, (kind, required) in schema.items():
        raw = F.try_element_at("values", F.lit(key))
        low = F.lower(F.trim(raw))
        good = {"number": raw.try_cast("double").cast("string"), "boolean": F.when(low.isin("true", "false"), low), "date": raw.try_cast("timestamp").cast("string")}.get(kind, raw)
        empty = raw.isNull() | (F.trim(raw) == "")
        errors.append(F.when(empty & F.lit(required), F.lit(f"{key}:required")).when(~empty & good.isNull(), F.lit(f"{key}:{kind}")))
        clean.append(F.when(~empty & good.isNotNull(), F.struct(F.lit(key).alias("key"), good.alias("value"))))
    return entities.withColumns({"clean": F.map_from_entries(F.array_compact(F.array(*clean))), "error": F.get(F.array_compact(F.array(*errors)), F.lit(0))})
