"""Entity linking, type compatibility, schema mapping, evidence merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import repetition_bonus
from ..functions.text import entity_name_form, label_form

#: Fixed: what an exact name and an exact alias are worth; what a fitting, a narrower and a foreign type add; how close is a tie.
NAME, ALIAS, EXACT_TYPE, CHILD_TYPE, FOREIGN_TYPE, TIE = 1.0, 0.98, 0.12, 0.08, -0.15, 1e-6
#: Fixed: time words that may hang on a Chinese name.
TIME_WORDS = "后来|之后|以后|随后|现在|目前|当时|如今"
#: Fixed: similar names: one ends with the other.
HINT_SUFFIX, NAME_SUFFIX = 0.88, 0.8


def type_bonus(actual: Column, expected: Column, up: Column) -> Column:
    """Of an entity's type against the expected ones; ``up`` is the array of its ancestors. Nothing known adds nothing."""
    return F.when(actual.isNull() | (F.size(expected) <= 0), 0.0).when(F.array_contains(expected, actual), EXACT_TYPE).when(F.arrays_overlap(expected, up), CHILD_TYPE).otherwise(FOREIGN_TYPE)


def link(hints: DataFrame, entities: DataFrame, ancestors: DataFrame | None = None, compose: bool = False, world: str | None = None) -> DataFrame:
    """Hints (hint_id, hint, expected) with status, strategy, entity_id, confidence and alternatives.

    entities: (entity_id, name, aliases, type). Names and aliases meet hints in one
    equi-join on their normal form; the best score wins, ties are ambiguous, none is
    missing. Confidence is the score, clamped to 1. ``world`` names a column of both
    tables: a hint then meets the entities of its own world only. Entities meet each
    different question once, not each hint.
    """
    scope = [world] if world else []
    forms = entities.select("entity_id", "type", *scope, F.explode(F.concat(F.array(F.struct(F.col("name").alias("n"), F.lit("exact-name").alias("strategy"), F.lit(NAME).alias("worth"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("n"), F.lit("exact-alias").alias("strategy"), F.lit(ALIAS).alias("worth"))))).alias("f"))
    keyed = forms.select("entity_id", "type", *scope, entity_name_form(F.col("f.n"), compose).alias("__key"), "f.strategy", "f.worth").where("__key != ''")
    if ancestors is not None:
        up = ancestors.where("depth > 0").groupBy(F.col("concept").alias("type")).agg(F.collect_set("ancestor").alias("__up"))
        keyed = keyed.join(up, "type", "left")
    else:
        keyed = keyed.withColumn("__up", F.lit(None).cast("array<string>"))
    # Hints that say and expect the same have one answer, however many they are.
    asked = hints.select(F.col("hint").alias("__hint"), *(F.col(c).alias(f"__{c}") for c in scope), F.col("expected").alias("__expected")).distinct().withColumn("__key", entity_name_form(F.col("__hint"), compose))
    question = ["__key", *(f"__{c}" for c in scope), "__expected"]
    met = asked.select(*question).distinct().join(keyed.withColumnsRenamed({c: f"__{c}" for c in scope}), question[:-1])
    scored = met.withColumn("score", F.col("worth") + type_bonus(F.col("type"), F.col("__expected"), F.coalesce("__up", F.array().cast("array<string>"))))
    # An entity counts once, by its best form; scores are few, so the entities of each are put together first.
    once = scored.groupBy(*question, "entity_id").agg(F.max(F.struct("score", "worth", "strategy")).alias("s"))
    level = once.groupBy(*question, "s.score").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"), F.collect_list("entity_id").alias("ids"), F.max("s.strategy").alias("strategy"))
    top = level.withColumn("top", F.max("score").over(Window.partitionBy(*question))).where(F.col("top") - F.col("score") < TIE)
    tied = top.groupBy(*question).agg(F.sum("n").alias("n"), F.min("entity_id").alias("entity_id"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("strategy").alias("strategy"), F.max("top").alias("top"))
    tied = tied.withColumnRenamed("__expected", "__e")
    answers = asked.join(tied, question[:-1]).where(F.col("__expected").eqNullSafe(F.col("__e"))).drop("__e", "__key")
    same = (F.col("hint") == F.col("__hint")) & F.col("expected").eqNullSafe(F.col("__expected"))
    for c in scope:
        same = same & (F.col(c) == F.col(f"__{c}"))
    out = hints.join(answers, same, "left")
    alone = F.col("n") == 1
    return out.select(*hints.columns, F.when(F.col("n").isNull(), "missing").when(alone, "resolved").otherwise("ambiguous").alias("status"), F.when(alone, F.col("strategy")).alias("strategy"), F.when(alone, F.col("entity_id")).alias("entity_id"), F.when(alone, F.least(F.lit(1.0), F.col("top"))).alias("confidence"), F.when(~alone, F.col("ids")).alias("alternatives"))


def name_similarity(hint: Column, name: Column) -> Column:
    """1 for equal names; 0.88 if the name ends with the hint, 0.8 the other way; short ones don't count; else null."""
    return F.when(hint == name, 1.0).when((F.length(hint) >= 2) & name.endswith(hint), HINT_SUFFIX).when((F.length(name) >= 3) & hint.endswith(name), NAME_SUFFIX)


def map_fields(wanted: DataFrame, fields: DataFrame, labels: DataFrame, compose: bool = False) -> DataFrame:
    """wanted (type_id, concept) with the schema field that holds it: status, field_key, confidence.

    fields: (type_id, field_key, label, concept); labels: (concept, label) known for a
    concept. A field bound to the concept is sure (1.0), one with a known label nearly
    (0.95); several of the best kind are ambiguous.
    """
    bound = wanted.join(fields.select("type_id", "field_key", "concept"), ["type_id", "concept"]).select("type_id", "concept", "field_key", F.lit(1.0).alias("c"))
    known = labels.select("concept", label_form(F.col("label"), compose).alias("__l")).distinct()
    named = wanted.join(known, "concept").join(fields.where("concept is null").select("type_id", "field_key", label_form(F.col("label"), compose).alias("__l")), ["type_id", "__l"]).select("type_id", "concept", "field_key", F.lit(0.95).alias("c"))
    best = bound.unionByName(named).distinct().groupBy("type_id", "concept", "c").agg(F.count("*").alias("n"), F.min("field_key").alias("field_key")).groupBy("type_id", "concept").agg(F.max(F.struct("c", "n", "field_key")).alias("b"))
    out = wanted.join(best, ["type_id", "concept"], "left")
    alone = F.col("b.n") == 1
    return out.select(*wanted.columns, F.when(F.col("b").isNull(), "missing").when(alone, "resolved").otherwise("ambiguous").alias("status"), F.when(alone, F.col("b.field_key")).alias("field_key"), F.when(alone, F.col("b.c")).alias("confidence"))


def merge_evidence(candidates: DataFrame, keys: Sequence[str], kind: str, confidence: str, evidence: str) -> DataFrame:
    """(keys, best kind, confidence, evidence, alternatives): the kinds of one span or name, the surest first, and all its evidence."""
    per = candidates.groupBy(*keys, kind).agg(F.max(confidence).alias("__c"), F.collect_set(evidence).alias("__e"))
    out = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("__c")).alias("n"), F.col(kind).alias("k")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__e")))).alias(evidence))
    return out.select(*keys, F.col("r")[0]["k"].alias(kind), (-F.col("r")[0]["n"]).alias(confidence), evidence, F.transform(F.slice("r", 2, 1 << 20), lambda x: x["k"]).alias("alternatives"))


def merge_suggestions(suggestions: DataFrame, key: str, kind: str, confidence: str, seq: str) -> DataFrame:
    """(key, occurrences, kind, confidence): sightings of a name joined; repeated ones are surer."""
    g = suggestions.groupBy(key).agg(F.count("*").alias("occurrences"), F.max(confidence).alias("__c"), F.max(F.struct(F.col(confidence), (-F.col(seq)).alias("s"), F.col(kind).alias("k"))).alias("b"))
    return g.select(key, "occurrences", F.col("b.k").alias(kind), repetition_bonus(F.col("__c"), F.col("occurrences")).alias(confidence))


def attach_drafts(candidates: DataFrame, drafts: DataFrame, sides: Sequence[str] = ("subject", "object"), compose: bool = False) -> DataFrame:
    """Candidates whose unresolved sides get the draft entity of their name: ``{side}_draft``; a stored id stays and has none."""
    out = candidates
    for side in sides:
        d = drafts.select(F.col("draft_key").alias(f"__{side}"))
        out = out.withColumn("__k", entity_name_form(F.col(f"{side}_hint"), compose)).join(d, (F.col("__k") == F.col(f"__{side}")) & F.col(f"{side}_id").isNull(), "left").withColumnRenamed(f"__{side}", f"{side}_draft").drop("__k")
    return out


def variants(name: Column) -> Column:
    """array<struct<priority,form>>: a name, then the name without a trailing Chinese time word."""
    bare = F.regexp_replace(name, f"(?:{TIME_WORDS})$", "")
    return F.filter(F.array(F.struct(F.lit(0).alias("priority"), name.alias("form")), F.struct(F.lit(1).alias("priority"), bare.alias("form"))), lambda x: (x["form"] != "") & ((x["priority"] == 0) | (x["form"] != name)))


def compatibility(schema_type: Column, canonical: Column, runtime: Column) -> Column:
    """struct<status,compatible,strategy,confidence>: the ordered decision table for a value against a field's type."""
    yes, no, maybe = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    row = lambda status, ok, strategy, c: F.struct(F.lit(status).alias("status"), ok.alias("compatible"), F.lit(strategy).cast("string").alias("strategy"), F.lit(float(c)).alias("confidence"))
    texts = ("text", "long-text")
    is_text = canonical.isin("text") | F.coalesce(runtime, F.lit("")).isin("text")
    return (
        F.when(F.coalesce(schema_type, F.lit("")) == "", row("unknown-schema-type", maybe, "as-is", 0))
        .when(F.coalesce(canonical, F.lit("")) == "", row("canonical-type-unknown", maybe, "as-is", 0.5))
        .when((canonical == "number") & (schema_type == "number") & (runtime == "measured-number"), row("compatible", yes, "numeric-component", 0.95))
        .when(canonical == schema_type, row("exact", yes, "as-is", 1))
        .when(canonical.isin(*texts) & schema_type.isin(*texts), row("compatible", yes, "as-is", 0.95))
        .when((canonical == "entity-reference") & schema_type.isin(*texts), row("compatible-with-warning", yes, "reference-name-as-text", 0.85))
        .when(is_text & (schema_type == "entity-reference"), row("requires-reference-resolution", maybe, "resolve-entity-reference", 0.7))
        .when(is_text & (schema_type == "select"), row("requires-select-option-check", maybe, "validate-select-option", 0.8))
        .when(schema_type.isin(*texts), row("compatible-with-warning", yes, "stringify", 0.75))
        .otherwise(row("incompatible", no, None, 1))
    )


def field_type(c: Column) -> Column:
    """A schema's type names to the seven types; unknown ones are null."""
    low = F.regexp_replace(F.lower(F.trim(c)), "[ _]+", "-")
    return (
        F.when(low.isin("text", "string", "short-text"), "text").when(low.isin("long-text", "longtext", "textarea", "rich-text"), "long-text").when(low.isin("number", "integer", "int", "float", "double", "decimal"), "number")
        .when(low.isin("boolean", "bool"), "boolean").when(low.isin("date", "datetime"), "date").when(low.isin("entity-reference", "entityreference", "reference", "relation"), "entity-reference").when(low.isin("select", "enum", "option", "dropdown"), "select")
    )


def select_value(value: Column, options: Column) -> Column:
    """struct<status,option>: the option equal to a value without case and spacing: resolved, missing or ambiguous."""
    form = lambda x: F.lower(F.trim(x))
    hits = F.filter(options, lambda o: form(o) == form(value))
    return F.struct(F.when(F.size(hits) == 1, "resolved").when(F.size(hits) > 1, "ambiguous").otherwise("missing").alias("status"), F.when(F.size(hits) == 1, hits[0]).alias("option"))


def recommended_fields(candidates: DataFrame, draft: str, field: str, seq: str, most: int | None = None) -> DataFrame:
    """(draft, fields): each draft's distinct fields in the order of their first sighting."""
    first = candidates.groupBy(draft, field).agg(F.min(seq).alias("__s"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__s", field))), lambda x: x[field])
    return first.groupBy(draft).agg((listed if most is None else F.slice(listed, 1, most)).alias("fields"))


def best_type(drafts: DataFrame, types: DataFrame, ancestors: DataFrame) -> DataFrame:
    """drafts (draft_key, likely, expected) with the user's type for them: the same concept, then a child of it, then one that fits what is expected; first by type order."""
    up = ancestors.where("depth > 0").select(F.col("concept").alias("type_concept"), "ancestor")
    same = drafts.join(types, F.col("likely") == F.col("type_concept")).select("draft_key", "type_id", "seq", F.lit(0).alias("tier"))
    child = drafts.join(up, F.col("likely") == F.col("ancestor")).join(types, "type_concept").select("draft_key", "type_id", "seq", F.lit(1).alias("tier"))
    wanted = drafts.select("draft_key", F.explode("expected").alias("e"))
    fits = wanted.join(ancestors.select(F.col("concept").alias("type_concept"), F.col("ancestor").alias("e")), "e").join(types, "type_concept").select("draft_key", "type_id", "seq", F.lit(2).alias("tier"))
    ranked = same.unionByName(child).unionByName(fits).groupBy("draft_key").agg(F.min(F.struct("tier", "seq", "type_id")).alias("b"))
    return drafts.join(ranked.select("draft_key", F.col("b.type_id").alias("type_id"), F.col("b.tier").alias("tier")), "draft_key", "left")


def number_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "sequence_index") -> DataFrame:
    """Rows numbered from 0 within their keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
