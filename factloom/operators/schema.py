"""User schemas and documents as data: fields of a type, edits with history, versioned saves.

types: (type_id, world, name, concept, fields array<struct<key,label,type,required,options,concept,order>>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_form, select_options, trim_all

FIELD = "struct<key:string,label:string,type:string,required:boolean,options:array<string>,concept:string,order:int>"


def field(key: Column, label: Column, kind: Column, options: Column | None = None, concept: Column | None = None, required: Column | None = None) -> Column:
    """A field; only a select keeps options, cleaned."""
    none = F.array().cast("array<string>")
    kept = F.when(kind == "select", select_options(F.coalesce(options if options is not None else none, none))).otherwise(none)
    return F.struct(key.alias("key"), trim_all(label).alias("label"), kind.alias("type"), (required if required is not None else F.lit(False)).alias("required"), kept.alias("options"), (concept if concept is not None else F.lit(None).cast("string")).alias("concept"), F.lit(0).alias("order")).cast(FIELD)


def has_label(fields: Column, label: Column, but: Column | None = None) -> Column:
    """Whether a field has a label, without case and outer spaces; the field with key ``but`` doesn't count."""
    same = lambda f: F.lower(trim_all(f["label"])) == F.lower(trim_all(label))
    return F.exists(fields, (lambda f: same(f)) if but is None else (lambda f: same(f) & (f["key"] != but)))


def _ordered(fields: Column) -> Column:
    return F.transform(fields, lambda f, i: f.withField("order", i.cast("int")))


def add_field(types: DataFrame, type_id: object, new: Column) -> DataFrame:
    """types with a field appended to one of them; ``error`` is ``duplicate-label`` or ``blank-label`` where it isn't."""
    own = F.col("type_id") == F.lit(type_id)
    error = F.when(own & (new["label"] == ""), "blank-label").when(own & has_label(F.col("fields"), new["label"]), "duplicate-label")
    return types.withColumn("error", error).withColumn("fields", F.when(own & F.col("error").isNull(), _ordered(F.array_append("fields", new))).otherwise(F.col("fields")))


def update_field(types: DataFrame, type_id: object, key: str, label: str | None = None, kind: str | None = None, options: Sequence[str] | None = None) -> DataFrame:
    """types with one field changed; its key stays, and so does its label if another field has the new one (``error``)."""
    own = F.col("type_id") == F.lit(type_id)
    clash = has_label(F.col("fields"), F.lit(label), F.lit(key)) if label is not None else F.lit(False)

    def change(f: Column) -> Column:
        out = f
        if label is not None:
            out = out.withField("label", trim_all(F.lit(label)))
        if kind is not None:
            out = out.withField("type", F.lit(kind))
        if options is not None:
            out = out.withField("options", select_options(F.array(*map(F.lit, options))))
        return F.when(f["key"] == key, out).otherwise(f)

    return types.withColumn("error", F.when(own & clash, "duplicate-label")).withColumn("fields", F.when(own & ~clash, F.transform("fields", change)).otherwise(F.col("fields")))


def delete_field(types: DataFrame, type_id: object, key: str) -> DataFrame:
    """types without one field; the entities' values under its key stay."""
    own = F.col("type_id") == F.lit(type_id)
    return types.withColumn("fields", F.when(own, _ordered(F.filter("fields", lambda f: f["key"] != key))).otherwise(F.col("fields")))


def find_or_create_types(types: DataFrame, wanted: DataFrame, family: DataFrame, aliases: DataFrame, compose: bool = False) -> DataFrame:
    """wanted (world, concept) with type_id and how: a type of the concept, of its family, one with an alias for a name, or a new one.

    family: (concept, related, rank); aliases: (concept, alias). A name that several types
    of the world have doesn't decide. New ids are a hash of world and concept, so that a
    second run finds the same.
    """
    own = wanted.join(types.select("world", "concept", "type_id"), ["world", "concept"]).select("world", "concept", "type_id", F.lit(0).alias("rank"), F.lit("concept").alias("how"))
    kin = wanted.join(family, "concept").join(types.select("world", F.col("concept").alias("related"), "type_id"), ["world", "related"]).select("world", "concept", "type_id", (F.col("rank") + 1).alias("rank"), F.lit("family").alias("how"))
    named = types.where("concept is null").select("world", "type_id", label_form(F.col("name"), compose).alias("__n"))
    alone = named.groupBy("world", "__n").agg(F.count("*").alias("n"), F.min("type_id").alias("type_id")).where("n = 1")
    alias = wanted.join(aliases.select("concept", label_form(F.col("alias"), compose).alias("__n")).distinct(), "concept").join(alone, ["world", "__n"]).select("world", "concept", "type_id", F.lit(1 << 20).alias("rank"), F.lit("alias").alias("how"))
    best = own.unionByName(kin).unionByName(alias).groupBy("world", "concept").agg(F.min(F.struct("rank", "type_id", "how")).alias("b"))
    met = wanted.distinct().join(best, ["world", "concept"], "left")
    fresh = F.concat(F.lit("type_"), F.substring(F.sha2(F.concat_ws("::", "world", "concept"), 256), 1, 16))
    return met.select("world", "concept", F.coalesce("b.type_id", fresh).alias("type_id"), F.coalesce("b.how", F.lit("created")).alias("how"))


def record_edit(suggestions: DataFrame, edits: DataFrame, key: str = "suggestion_id") -> DataFrame:
    """suggestions (payload, original_payload, edited, edit_history) after edits (key, payload): the first payload is kept once, every edit joins the history."""
    met = suggestions.join(edits.select(key, F.col("payload").alias("__new")), key, "left")
    hit = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("payload"))
    return met.withColumns({
        "original_payload": F.when(hit, F.coalesce("original_payload", "payload")).otherwise(F.col("original_payload")),
        "edit_history": F.when(hit, F.array_append("edit_history", F.col("__new"))).otherwise(F.col("edit_history")),
        "edited": F.col("edited") | hit,
        "payload": F.when(hit, F.col("__new")).otherwise(F.col("payload")),
    }).drop("__new").select(*suggestions.columns)


def save_documents(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """stored (doc_id, title, content, version) after saves (doc_id, title, content, seq): each distinct content in order is a version; a blank title or null content changes nothing."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    first = stored.select("doc_id", F.lit(None).cast("string").alias("title"), "content", F.lit(-1).cast("long").alias("seq"))
    log = first.unionByName(saves.select("doc_id", "title", "content", F.col("seq").cast("long")))
    filled = log.withColumn("content", F.last("content", ignorenulls=True).over(w)).withColumn("__was", F.lag("content").over(w))
    moved = (F.col("seq") >= 0) & ~F.col("content").eqNullSafe(F.col("__was"))
    after = filled.groupBy("doc_id").agg(F.count_if(moved).alias("n"), F.max_by("content", "seq").alias("content"), F.max(F.when(trim_all(F.coalesce("title", F.lit(""))) != "", F.struct("seq", "title"))).alias("t"))
    return stored.select("doc_id", F.col("title").alias("__title"), "version").join(after, "doc_id").select("doc_id", F.coalesce("t.title", "__title").alias("title"), "content", (F.col("version") + F.col("n")).cast("long").alias("version"))
