"""First inference of types: what roles expect, and names found elsewhere that are alike, with all their types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import refine
from .discovery import similar_names

#: Fixed: how sure a name's type and an alternative are if nothing says it; types that a role falls back to, in this order.
PRIMARY, ALTERNATIVE = 0.7, 0.6
FALLBACK = ("entityType.character", "entityType.organization", "entityType.location", "entityType.vehicle", "entityType.spacecraft", "entityType.planet", "entityType.spaceStation")


def expected_types(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """Candidates (event_concept, relation_concept, field_concept) once for each role, with ``expected``.

    table: (kind, concept, role, expected array). An event decides, else a relation, else a field, which
    expects something of its subject only; nothing known is an empty array.
    """
    kind = F.when(F.col("event_concept").isNotNull(), "event").when(F.col("relation_concept").isNotNull(), "relation").when(F.col("field_concept").isNotNull(), "field")
    each = candidates.withColumns({"role": F.explode(F.array(F.lit("subject"), F.lit("object"))), "__kind": kind, "__concept": F.coalesce("event_concept", "relation_concept", "field_concept")})
    rows = table.where("kind != 'field' or role = 'subject'").select(F.col("kind").alias("__kind"), F.col("concept").alias("__concept"), "role", F.array_distinct("expected").alias("expected"))
    out = each.join(rows, ["__kind", "__concept", "role"], "left").drop("__kind", "__concept")
    return out.withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))


def fallback_type(expected: Column) -> Column:
    """The broad type among expected ones, by the fixed order; else the only one."""
    once = F.array_distinct(F.filter(expected, lambda x: x.isNotNull() & (x != "")))
    broad = F.filter(F.array(*map(F.lit, FALLBACK)), lambda x: F.array_contains(once, x))
    return F.when(F.size(broad) > 0, broad[0]).when(F.size(once) == 1, once[0])


def type_evidence(hints: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, hint, place, concept, evidence_type, strength, confidence, source) from names that are like a hint: a name's type and its alternatives, as sure as the name is alike.

    names: (doc_id, name, likely_type, confidence, alternatives array of (concept_id, confidence), evidence_type,
    strength). ``place`` numbers a hint's evidence from the surest on; ``most`` keeps that many.
    """
    met = similar_names(hints.select("doc_id", "hint").distinct(), names.select("doc_id", "name").distinct()).join(names, ["doc_id", "name"])
    typed = lambda t, c, source: F.struct(t.alias("concept"), F.least(F.lit(1.0), c * F.col("similarity")).alias("confidence"), F.lit(source).alias("source"))
    primary = F.array(typed(F.col("likely_type"), F.coalesce("confidence", F.lit(PRIMARY)), "primary"))
    others = F.transform(F.coalesce("alternatives", F.array().cast("array<struct<concept_id:string,confidence:double>>")), lambda x: typed(x["concept_id"], F.coalesce(x["confidence"], F.lit(ALTERNATIVE)), "alternative"))
    each = met.select("doc_id", "hint", "name", "evidence_type", "strength", F.posexplode(F.concat(primary, others)).alias("k", "t")).select("doc_id", "hint", "name", "k", "evidence_type", "strength", "t.*").where("concept is not null")
    order = Window.partitionBy("doc_id", "hint").orderBy(F.desc("confidence"), "name", "k", "concept")
    out = each.withColumn("place", F.row_number().over(order) - 1).drop("name", "k")
    return out if most is None else out.where(F.col("place") < most)


def infer_types(hints: DataFrame, names: DataFrame, closure: DataFrame, canon: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Hints (doc_id, hint, expected) with likely_type, confidence, status and conflicting types.

    ``unresolved`` if nothing scores, ``ambiguous-scored`` if two are close, ``semantic-scored`` with names that are
    alike and ``semantic-only`` by the role alone.
    """
    evidence = type_evidence(hints, names, most)
    asked = hints.withColumns({"prior_concept": F.lit(None).cast("string"), "prior_confidence": F.lit(0.0), "entity": F.lit(None).cast("string")})
    ranked = refine.rank(refine.staged(asked, evidence, closure, canon))
    found = evidence.groupBy("doc_id", "hint").agg(F.count("*").alias("__n"))
    met = hints.join(ranked, ["doc_id", "hint"], "left").join(found, ["doc_id", "hint"], "left")
    status = F.when(F.col("best").isNull(), "unresolved").when(F.col("ambiguous"), "ambiguous-scored").when(F.col("__n") > 0, "semantic-scored").otherwise("semantic-only")
    return met.select(*hints.columns, F.col("best").alias("likely_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"), F.coalesce("alternatives", F.array().cast("array<string>")).alias("conflicting"))
