"""Field extraction from clauses by closed rules, English and Chinese.

Input: clauses (doc_id, clause_idx, start, end, text). Output: candidates (doc_id,
clause_idx, field_concept, value, source_text, start, end, confidence, extractor). All
are column expressions; a rule takes its first match in a clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_value, is_zh, strip_marks

#: Fixed: the rules (field, extractor, pattern with the value as group 1), and their confidence.
RULES = {
    "en": (
        ("field.age", "pattern.age.en", r"(?i)(\d{1,4})\s+years?\s+old"),
        ("field.age", "pattern.age.en", r"(?i)aged\s+(\d{1,4})"),
        ("field.birthplace", "pattern.birthplace.en", r"(?i)(?:was\s+born\s+in|born\s+in)\s+([^,.;!?]{1,50})"),
    ),
    "zh": (
        ("field.age", "pattern.age.zh", r"(\d{1,4})\s*岁"),
        ("field.birthplace", "pattern.birthplace.zh", r"(?:出生于|出生在|生于)\s*([^，。！？；]{1,30})"),
    ),
}
PATTERN_CONFIDENCE = 0.98
#: Fixed: what makes a field word a label, and where its value ends.
ASSIGNED = {"en": r"(?i)^\s*(?:(?:is|are|was|were|has|have)\b|:|=)", "zh": r"^\s*(?:是|为|叫|有|：|:|=|很|较|比较|约为|大约为)"}
VALUE_ENDS = {"en": r"[,.;!?\n]|\s+(?:and|but|while|because)\s+", "zh": "[，。！？；]"}


def first_match(text: Column, pattern: str) -> Column:
    """struct<start,source,value>: where the pattern first matches, all of it and its group 1; null without a match."""
    source, value = F.regexp_extract(text, pattern, 0), F.regexp_extract(text, pattern, 1)
    return F.when(source != "", F.struct((F.regexp_instr(text, F.lit(pattern)) - 1).alias("start"), source.alias("source"), value.alias("value")))


def extract_patterns(clauses: DataFrame, locale: str = "en", doc: str = "doc_id") -> DataFrame:
    """Ages and birthplaces: the first rule of a field that matches a clause."""
    rules = RULES["zh" if is_zh(locale) else "en"]
    found = []
    for field in dict.fromkeys(r[0] for r in rules):
        own = [F.when(first_match(F.col("text"), p).isNotNull(), F.struct(first_match(F.col("text"), p).alias("m"), F.lit(name).alias("extractor"))) for f, name, p in rules if f == field]
        found.append(F.struct(F.lit(field).alias("field_concept"), F.coalesce(*own).alias("hit")))
    met = clauses.where(" or ".join(["text rlike '" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for _, _, p in rules])).select(doc, "clause_idx", F.col("start").alias("__at"), F.explode(F.array(*found)).alias("f")).where("f.hit is not null")
    start = F.col("__at") + F.col("f.hit.m.start")
    value = F.when(F.col("f.field_concept") == "field.birthplace", strip_marks(F.col("f.hit.m.value"))).otherwise(F.col("f.hit.m.value"))
    return met.select(doc, "clause_idx", F.col("f.field_concept").alias("field_concept"), value.alias("value"), F.when(F.col("f.field_concept") == "field.age", age_value(value)).alias("number"), F.col("f.hit.m.source").alias("source_text"), start.cast("int").alias("start"), (start + F.length("f.hit.m.source")).cast("int").alias("end"), F.lit(PATTERN_CONFIDENCE).alias("confidence"), F.col("f.hit.extractor").alias("extractor"))


def extract_labeled(spans: DataFrame, clauses: DataFrame, locale: str = "en", doc: str = "doc_id", longest: int = 50) -> DataFrame:
    """``label is value``: field spans that an assignment follows in their clause; confidence rises by 0.08, to 0.95 at most."""
    from .spans import inside

    zh = is_zh(locale)
    met = inside(spans.where("category = 'fields'").where(~F.col("concept_id").isin("field.age", "field.birthplace", "field.species")), clauses.drop("text"), doc).join(clauses.select(doc, "clause_idx", "text"), [doc, "clause_idx"])
    right = F.substring(F.col("text"), F.col("end") - F.col("clause_start") + 1, F.lit(30 if zh else 60))
    assigned, ends = (d["zh" if zh else "en"] for d in (ASSIGNED, VALUE_ENDS))
    value = strip_marks(F.element_at(F.split(F.regexp_replace(right, assigned + (r"[\s：:=]*" if zh else r"[\s:=]*(?:(?:a|an|the)\s+)?"), ""), ends), 1))
    out = met.where(right.rlike(assigned)).withColumn("value", value).where((F.col("value") != "") & (F.length("value") <= longest))
    return out.select(doc, "clause_idx", F.col("concept_id").alias("field_concept"), "value", F.col("start").cast("int"), (F.col("end") + F.length("value")).cast("int").alias("end"), F.least(F.lit(0.95), F.col("confidence") + 0.08).alias("confidence"), F.lit("pattern.field-label").alias("extractor"))


def extract_roles(spans: DataFrame, clauses: DataFrame, concepts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Role words as values of the field that their concept names (occupation where it names none)."""
    from .spans import inside

    met = inside(spans.where("kind = 'role-signal'"), clauses.drop("text"), doc).join(concepts.select("concept_id", "field_concept"), "concept_id", "left")
    return met.select(doc, "clause_idx", F.coalesce("field_concept", F.lit("field.occupation")).alias("field_concept"), F.col("expression").alias("value"), "start", "end", "confidence", F.lit("pattern.role").alias("extractor"))


def extract_direct(spans: DataFrame, clauses: DataFrame, values: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Field words that are values themselves (concept_id, expression), but not inside a longer field span."""
    from .spans import inside, strictly_larger

    field = inside(spans.where("category = 'fields'"), clauses.drop("text"), doc)
    larger = field.select(F.col(doc).alias("__d"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    free = field.join(larger, (F.col(doc) == F.col("__d")) & strictly_larger(F.col("__s"), F.col("__e"), F.col("start"), F.col("end")), "left_anti")
    kept = free.join(values.select("concept_id", F.lower("expression").alias("expression")), ["concept_id", "expression"], "left_semi")
    return kept.select(doc, "clause_idx", F.col("concept_id").alias("field_concept"), F.col("expression").alias("value"), "start", "end", "confidence", F.lit("pattern.direct-value").alias("extractor"))


def extract_gravity_prefix(spans: DataFrame, clauses: DataFrame, doc: str = "doc_id", reach: int = 12) -> DataFrame:
    """A number right before a gravity word (1.2G 重力), from the ``reach`` characters before it."""
    from ..functions.text import gravity_value
    from .spans import inside

    met = inside(spans.where("concept_id = 'field.gravity'"), clauses.drop("text"), doc).join(clauses.select(doc, "clause_idx", "text"), [doc, "clause_idx"])
    rel = F.col("start") - F.col("clause_start")
    left = F.substring(F.col("text"), F.greatest(F.lit(1), rel - reach + 1), F.least(rel, F.lit(reach)))
    rule = r"(-?\d+(?:\.\d+)?\s*[gG]?)\s*的?\s*$"
    met = met.withColumn("__n", F.length(F.regexp_extract(left, rule, 0)))
    return met.withColumn("value", F.regexp_extract(left, rule, 1)).where("value != ''").select(doc, "clause_idx", F.lit("field.gravity").alias("field_concept"), F.trim("value").alias("value"), gravity_value(F.col("value")).alias("measured"), (F.col("start") - F.col("__n")).cast("int").alias("start"), "end", "confidence", F.lit("pattern.gravity-prefix").alias("extractor"))


def extract_species(species: DataFrame, compounds: DataFrame, clauses: DataFrame, doc: str = "doc_id", reach: int = 16) -> DataFrame:
    """Compounds, and single species after a copula in the ``reach`` characters before them, outside compounds."""
    from .spans import contains, inside

    one = inside(species, clauses.drop("text"), doc).join(clauses.select(doc, "clause_idx", "text"), [doc, "clause_idx"])
    c = compounds.select(F.col(doc).alias("__d"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    rel = F.col("start") - F.col("clause_start")
    left = F.substring(F.col("text"), F.greatest(F.lit(1), rel - reach + 1), F.least(rel, F.lit(reach)))
    # Fixed: what stands before a species that somebody is.
    copular = left.rlike(r"(?i)(?:\b(?:is|was|are|were|be|become|becomes|became)(?:\s+(?:a|an|the))?(?:\s+[\w-]+)?\s*$)|(?:是|为|变成|成为)(?:一[只个名位条头])?\s*$")
    single = one.where(copular).join(c, (F.col(doc) == F.col("__d")) & contains(F.col("__s"), F.col("__e"), F.col("start"), F.col("end")), "left_anti")
    both = inside(compounds, clauses.drop("text"), doc).select(doc, "clause_idx", "start", "end", F.lit("pattern.compound-species").alias("extractor"))
    return both.unionByName(single.select(doc, "clause_idx", "start", "end", F.lit("pattern.species").alias("extractor")))


def drop_contained_values(candidates: DataFrame, keys: tuple = ("doc_id", "clause_idx", "field_concept"), seq: str = "seq") -> DataFrame:
    """Candidates of a field without those whose range lies inside another's, or whose value another longer value holds; of equal ranges the surer stays, then the first."""
    o = candidates.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__s"), F.col("end").alias("__e"), F.lower("value").alias("__v"), F.col("confidence").alias("__c"), F.col(seq).alias("__q"))
    cond = F.col("__q") != F.col(seq)
    for k in keys:
        cond = (F.col(k) == F.col(f"__{k}")) & cond
    same = (F.col("__s") == F.col("start")) & (F.col("__e") == F.col("end"))
    inner = (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e")) & ~same
    longer = (F.length("__v") > F.length("value")) & F.contains(F.col("__v"), F.lower("value"))
    tie = same & ((F.col("__c") > F.col("confidence")) | ((F.col("__c") == F.col("confidence")) & (F.col("__q") < F.col(seq))))
    return candidates.join(o, cond & (inner | longer | tie), "left_anti")
