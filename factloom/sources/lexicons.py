"""Lexicon and ontology sources: JSON category files, packs, overlays, checks.

A category file holds {"entries": [{"conceptId", "aliases": {"strong": [], "normal": [],
"weak": []}, "suffixes": {...}}]}; support files hold {"terms": [...]}. Files lie in
``root/locale/category.json`` and overlays of a pack in ``root/packs/pack/part/category.json``.
Everything becomes one flat dimension: (locale, pack, category, concept_id, evidence_type,
strength, expression, score, overlay).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: category files that are matched in texts, and the one of plain terms.
MATCHABLE = ("entityTypes", "events", "fields", "modifiers", "relations", "titles", "discourse", "units")
SUPPORT = ("genericTerms",)
#: Fixed: what an expression's evidence is worth; a suffix is worth 0.8 of it.
STRENGTH = {"strong": 1.0, "normal": 0.75, "weak": 0.45}
SUFFIX_FACTOR = 0.8
#: Overlays of a pack, in the order in which they are read; the last two only if asked for.
OVERLAYS = ("shared", "{locale}", "nsfw/shared", "nsfw/{locale}")

_LISTS = "struct<strong:array<string>,normal:array<string>,weak:array<string>>"
_FILE = f"entries array<struct<conceptId:string,aliases:{_LISTS},suffixes:{_LISTS}>>, terms array<string>"
SCHEMA = "locale string, pack string, category string, concept_id string, evidence_type string, strength string, expression string, score double, overlay int"


def from_rows(spark: SparkSession, rows: Iterable[tuple], locale: str = "en") -> DataFrame:
    """A lexicon from (category, concept_id, evidence_type, strength, expression)."""
    return spark.createDataFrame([(locale, None, c, i, e, s, x, round(STRENGTH[s] * (SUFFIX_FACTOR if e == "suffix" else 1.0), 6), 0) for c, i, e, s, x in rows], SCHEMA)


def read_category(spark: SparkSession, path: str, locale: str, category: str, pack: str | None = None, overlay: int = 0) -> DataFrame:
    """One category file; an unknown category or a missing file raises."""
    if category not in MATCHABLE + SUPPORT:
        raise ValueError(f"unknown lexicon category {category!r}")
    entries = spark.read.schema(_FILE).json(path, multiLine=True).select(F.explode("entries").alias("e"))
    parts = [F.struct(F.lit(kind).alias("evidence_type"), F.lit(s).alias("strength"), F.lit(round(v * (SUFFIX_FACTOR if kind == "suffix" else 1.0), 6)).alias("score"), F.coalesce(F.col(f"e.{field}.{s}"), F.array().cast("array<string>")).alias("expressions")) for kind, field in (("alias", "aliases"), ("suffix", "suffixes")) for s, v in STRENGTH.items()]
    flat = entries.select(F.col("e.conceptId").alias("concept_id"), F.explode(F.array(*parts)).alias("p")).select("concept_id", "p.*").withColumn("expression", F.explode("expressions"))
    return flat.where("trim(expression) != ''").select(F.lit(locale).alias("locale"), F.lit(pack).cast("string").alias("pack"), F.lit(category).alias("category"), "concept_id", "evidence_type", "strength", "expression", "score", F.lit(overlay).alias("overlay"))


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A support file's terms, in order, distinct."""
    rows = spark.read.schema(_FILE).json(path, multiLine=True).select(F.array_distinct("terms").alias("t")).collect()
    return [x for r in rows for x in r.t or ()]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts: matchable categories are not made distinct."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unknown_concepts(lexicon: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entries whose concept the ontology doesn't know."""
    return lexicon.join(concepts.select(F.col("concept_id")), "concept_id", "left_anti")


def checked(lexicon: DataFrame, concepts: DataFrame) -> DataFrame:
    """The lexicon, if the ontology knows all its concepts; else an error that names some."""
    bad = [r.concept_id for r in unknown_concepts(lexicon, concepts).select("concept_id").distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"concepts without a definition: {bad}")
    return lexicon


def enabled(lexicon: DataFrame, packs: Sequence[str] = (), nsfw: bool = False) -> DataFrame:
    """The base lexicon and the enabled packs; packs that don't exist are passed over."""
    out = lexicon.where(F.col("pack").isNull() | F.col("pack").isin(*packs)) if packs else lexicon.where("pack is null")
    return out if nsfw else out.where("overlay < 3")


def closure(concepts: DataFrame) -> DataFrame:
    """(concept, ancestor, depth) of an ontology (concept_id, parent)."""
    from ..operators.trees import ancestors

    return ancestors(concepts.select(F.col("concept_id").alias("node"), "parent")).select(F.col("node").alias("concept"), "ancestor", "depth")


def pack_parts(locale: str, nsfw: bool = False) -> list[tuple[int, str]]:
    """(overlay, folder) of a pack in reading order: shared, the locale's own, and the two that are read only if asked for."""
    return [(k, p.format(locale=locale)) for k, p in enumerate(OVERLAYS, start=1) if nsfw or not p.startswith("nsfw")]


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_locale(spark: SparkSession, root: str, locale: str) -> DataFrame:
    """All matchable categories of a locale; each file must exist."""
    return union([read_category(spark, f"{root}/{locale}/{c}.json", locale, c) for c in MATCHABLE])


def read_pack(spark: SparkSession, root: str, pack: str, locale: str, nsfw: bool = False) -> DataFrame:
    """All overlays of a pack, in order; categories that an overlay doesn't have are left out, and a pack without files is empty."""
    parts = [read_category(spark, f"{root}/packs/{pack}/{p}/{c}.json", locale, c, pack, k) for k, p in pack_parts(locale, nsfw) for c in MATCHABLE if _there(spark, f"{root}/packs/{pack}/{p}/{c}.json")]
    return union(parts) if parts else spark.createDataFrame([], SCHEMA)


def build(spark: SparkSession, root: str, locale: str, packs: Sequence[str] = (), nsfw: bool = False) -> DataFrame:
    """The base lexicon of a locale and the packs that exist."""
    return union([read_locale(spark, root, locale), *(read_pack(spark, root, p, locale, nsfw) for p in dict.fromkeys(packs))])


def aliases(lexicon: DataFrame, concept: str) -> list[str]:
    """A concept's expressions, the base lexicon's first, each once."""
    rows = lexicon.where((F.col("concept_id") == concept) & (F.col("evidence_type") == "alias")).select("overlay", F.expr("case strength when 'strong' then 0 when 'normal' then 1 else 2 end").alias("s"), "expression").orderBy("overlay", "s", "expression").collect()
    return list(dict.fromkeys(r.expression for r in rows))


def type_concepts(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """types (type_id, name, concept) with type_concept: the bound one, else that of the only concept with the name for an alias."""
    from ..functions.text import label_form

    named = lexicon.where("category = 'entityTypes'").select(label_form(F.col("expression"), False).alias("__n"), "concept_id").distinct().groupBy("__n").agg(F.count("*").alias("n"), F.min("concept_id").alias("__c")).where("n = 1")
    met = types.withColumn("__n", label_form(F.col("name"), False)).join(named.select("__n", "__c"), "__n", "left")
    return met.select(*types.columns, F.coalesce("concept", "__c").alias("type_concept"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, enabled, max_uses) of a JSON file {"codes": [{code, enabled, maxUses}]}: enabled unless false, unlimited unless maxUses is a number."""
    rows = spark.read.schema("codes array<struct<code:string,enabled:boolean,maxUses:string>>").json(path, multiLine=True).select(F.explode("codes").alias("c"))
    return rows.select(F.trim("c.code").alias("code"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"), F.col("c.maxUses").try_cast("long").alias("max_uses")).where("code != ''")


#: Fixed: the packs that are on where none are named.
USUAL_PACKS = ("furry", "sciFi")


def chosen_packs(c: Column) -> Column:
    """An array of pack names trimmed and without blanks; null means the usual ones."""
    named = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(named, F.array(*map(F.lit, USUAL_PACKS)))
