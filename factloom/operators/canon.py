"""Suggestions against what is stored already: which are satisfied, and what the others start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unprefixed
from ..functions.values import canonical_json, values_equal
from .linking import variants

#: Fixed: why a suggestion of each kind needn't be asked, and from what it starts otherwise.
SATISFIED = {"field-update": "field-already-matches-canonical", "relation-update": "relation-already-exists", "create-schema-field": "schema-field-already-exists", "create-select-option": "select-option-already-exists", "create-entity": "entity-already-exists"}
BASELINE = {"field-update": "field-value", "relation-update": "relation-presence", "create-schema-field": "schema-field-missing", "create-select-option": "select-option-missing", "create-entity": "entity-missing", "event-history": "timeline-not-yet-persisted"}
NO_TARGET, OTHER = "field-target-missing", "analysis-only"


def _lower(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def by_name(rows: DataFrame, ident: str, name: str, entities: DataFrame) -> DataFrame:
    """(ident, entity_id, entity_name): the stored entity of a name, else of the name without a time word at its end; the first of equals."""
    forms = rows.where(F.col(name).isNotNull()).select(ident, F.inline(variants(F.trim(name))))
    known = entities.select(_lower("name").alias("__f"), "entity_id", F.col("name").alias("entity_name"))
    met = forms.select(ident, "priority", F.lower("form").alias("__f")).join(known, "__f")
    return met.groupBy(ident).agg(F.min(F.struct("priority", "entity_id", "entity_name")).alias("b")).select(ident, "b.entity_id", "b.entity_name")


def with_baseline(records: DataFrame, entities: DataFrame, stored_values: DataFrame, relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Records with ``satisfied`` (the reason, or null), ``baseline`` (from what they start), ``current`` (the stored value) and ``entity_id``, ``entity_name`` of their target.

    records: (record_id, kind, target_id, target_name, field_key, value, subject_id, object_id, relation, type_id, concept, label); values are
    JSON text and equal at any depth. entities: (entity_id, name); stored_values: (entity_id, field_key, stored); relations:
    (subject_id, object_id, relation); fields: (type_id, field_key, label, concept, options). Each kind is a branch with joins of its own: rows of
    other kinds would all carry the same null keys. Store ``records`` first if they are dear to make.
    """
    keep = records.columns
    of = lambda kind: records.where(F.col("kind") == kind)

    def done(df: DataFrame, kind: str, met: Column, baseline: Column | None = None) -> DataFrame:
        there = F.coalesce(met, F.lit(False))
        given = {"entity_id": F.lit(None).cast(entities.schema["entity_id"].dataType), "entity_name": F.lit(None).cast("string"), "current": F.lit(None).cast("string")}
        out = df.withColumns({c: v for c, v in given.items() if c not in df.columns})
        start = F.lit(BASELINE[kind]) if baseline is None else baseline
        return out.select(*keep, F.when(there, SATISFIED.get(kind)).alias("satisfied"), F.when(~there, start).alias("baseline"), "current", "entity_id", "entity_name")

    # A field: the target by id, else by name; then its stored value, which may be missing.
    f = of("field-update")
    known = entities.select(F.col("entity_id").alias("__id"), F.col("name").alias("__name"))
    f = f.join(known, F.col("target_id") == F.col("__id"), "left")
    named = by_name(f.where("__id is null"), "record_id", "target_name", entities)
    f = f.join(named, "record_id", "left").withColumns({"entity_id": F.coalesce("__id", "entity_id"), "entity_name": F.coalesce("__name", "entity_name")}).drop("__id", "__name")
    values = stored_values.select(F.col("entity_id").alias("__e"), F.col("field_key").alias("__k"), F.col("stored").alias("current"))
    f = f.join(values, (F.col("entity_id") == F.col("__e")) & (F.col("field_key") == F.col("__k")), "left").drop("__e", "__k")
    same = F.col("entity_id").isNotNull() & values_equal(F.col("current"), F.col("value"))
    out = done(f.withColumn("current", F.coalesce(canonical_json(F.col("current")), F.col("current"))), "field-update", same, F.when(F.col("entity_id").isNull(), NO_TARGET).otherwise(BASELINE["field-update"]))
    r = relations.select(F.col("subject_id").alias("__s"), F.col("object_id").alias("__o"), unprefixed(F.col("relation"), "relation.").alias("__r")).distinct().withColumn("__there", F.lit(True))
    q = of("relation-update").join(r, (F.col("subject_id") == F.col("__s")) & (F.col("object_id") == F.col("__o")) & (unprefixed(F.col("relation"), "relation.") == F.col("__r")), "left").drop("__s", "__o", "__r")
    out = out.unionByName(done(q, "relation-update", F.col("__there")))
    # A schema field is there by its concept or by its label: two joins, so that each is on equal keys.
    s = of("create-schema-field")
    by_concept = fields.where("concept is not null").select(F.col("type_id").alias("__t"), F.col("concept").alias("__c")).distinct().withColumn("__one", F.lit(True))
    by_label = fields.select(F.col("type_id").alias("__u"), _lower("label").alias("__l")).where("__l is not null").distinct().withColumn("__two", F.lit(True))
    s = s.join(by_concept, (F.col("type_id") == F.col("__t")) & (F.col("concept") == F.col("__c")), "left").join(by_label, (F.col("type_id") == F.col("__u")) & (_lower("label") == F.col("__l")), "left").drop("__t", "__c", "__u", "__l")
    out = out.unionByName(done(s, "create-schema-field", F.coalesce("__one", "__two")))
    options = fields.select(F.col("type_id").alias("__t"), F.col("field_key").alias("__k"), F.explode("options").alias("__v")).select("__t", "__k", F.lower(F.trim("__v")).alias("__v")).distinct().withColumn("__there", F.lit(True))
    o = of("create-select-option").join(options, (F.col("type_id") == F.col("__t")) & (F.col("field_key") == F.col("__k")) & (F.lower(F.trim(F.coalesce("value", F.lit("")))) == F.col("__v")), "left").drop("__t", "__k", "__v")
    out = out.unionByName(done(o, "create-select-option", F.col("__there")))
    e = of("create-entity")
    e = e.join(by_name(e, "record_id", "target_name", entities), "record_id", "left")
    out = out.unionByName(done(e, "create-entity", F.col("entity_id").isNotNull()))
    rest = records.where(F.col("kind").isNull() | ~F.col("kind").isin(*(k for k in BASELINE if k != "event-history")))
    return out.unionByName(done(rest, "event-history", F.lit(False), F.when(F.col("kind") == "event-history", BASELINE["event-history"]).otherwise(OTHER)))
