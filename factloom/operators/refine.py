"""What type an entity has, scored in stages from nine kinds of evidence, with a second pass that knows the working memory.

Evidence is a table (keys, concept, source, score, stage, place). Later stages read what
earlier ones scored: which stored types are candidates at all, which candidates fit what a
role expects, and which contradict a well supported memory. Ontology tests are equi-joins with the
closure of the type tree, never a comparison of all types with all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp01, saturate
from ..sources.scratch import stored
from .discovery import EXPECTED, FITS, MEMORY, MEMORY_SOURCES, MISFIT, PRIOR
from .memory import CHARACTER

#: Fixed: what lexical evidence is worth by its kind.
LEXICAL = {"exact": 0.68, "suffix": 0.58, "weak": 0.18, "other": 0.38}
#: Fixed: what a stored type adds, what a remembered field adds and all together at most, a mention, all mentions at most, and salience.
CANON, FIELD, FIELDS_MOST, MENTION, MENTIONS_MOST, SALIENT = 0.34, 0.20, 0.52, 0.035, 0.14, 0.10
#: Fixed: what contradicting memory costs; how sure and by how many sources memory must be for that.
CONTRADICTS, SURE, SOURCES = -0.34, 0.78, 2
#: Fixed: fields that a character has.
CHARACTER_LIKE = ("field.age", "field.gender", "field.pronouns", "field.occupation", "field.birthplace")
#: Fixed: scores this near are equal, and these broad types then go first, in this order; a lead under the margin is ambiguous.
NEAR, MARGIN = 0.025, 0.12
BROAD = ("entityType.character", "entityType.organization", "entityType.location", "entityType.item", "entityType.vehicle")


def _rows(df: DataFrame, keys: Sequence[str], source: str, stage: int, score: Column, place: Column | None = None) -> DataFrame:
    place = F.lit(0) if place is None else place
    return df.select(*keys, "concept", F.lit(source).alias("source"), score.cast("double").alias("score"), F.lit(stage).alias("stage"), place.cast("long").alias("place")).where("trim(concept) != ''")


def first_stage(hints: DataFrame, lexical: DataFrame, memory: dict[str, DataFrame] | None = None, keys: Sequence[str] = ("doc_id", "hint")) -> DataFrame:
    """Evidence that stands by itself: expectation, words, an earlier guess, remembered types, fields and salience.

    hints: (keys, expected, prior_concept, prior_confidence, entity); lexical: (keys, place,
    concept, evidence_type, strength, confidence); memory as ``working_memory`` gives it.
    """
    expected = hints.select(*keys, F.posexplode(F.array_distinct(F.filter("expected", lambda x: F.trim(x) != ""))).alias("place", "concept"))
    out = _rows(expected, keys, "semantic-expectation", 0, F.lit(EXPECTED), F.col("place"))
    kind = F.when(F.col("evidence_type") == "exact", LEXICAL["exact"]).when(F.col("evidence_type") == "suffix", LEXICAL["suffix"]).when(F.col("strength") == "weak", LEXICAL["weak"]).otherwise(LEXICAL["other"])
    out = out.unionByName(_rows(lexical, keys, "lexical", 1, kind * clamp01(F.coalesce("confidence", F.lit(0.6))), F.col("place")))
    prior = hints.where("prior_concept is not null").select(*keys, F.col("prior_concept").alias("concept"), "prior_confidence")
    out = out.unionByName(_rows(prior, keys, "prior-inference", 2, PRIOR * clamp01(F.col("prior_confidence"))))
    if memory is None:
        return out
    owners = hints.where("entity is not null").select("doc_id", "entity", *(k for k in keys if k != "doc_id"))
    types = owners.join(memory["types"], ["doc_id", "entity"]).withColumn("place", F.col("first.start") * 4 + F.col("first.part"))
    by_sources = F.when(F.col("sources") <= 1, MEMORY_SOURCES[0]).when(F.col("sources") == 2, MEMORY_SOURCES[1]).otherwise(MEMORY_SOURCES[2])
    out = out.unionByName(_rows(types, keys, "semantic-memory", 3, MEMORY * F.col("confidence") * by_sources, F.col("place")))
    fields = owners.join(memory["fields"].where(F.col("field_concept").isin(*CHARACTER_LIKE)), ["doc_id", "entity"]).groupBy(*keys).agg(F.sum(FIELD * F.col("confidence")).alias("s")).where("s > 0").withColumn("concept", F.lit(CHARACTER))
    out = out.unionByName(_rows(fields, keys, "semantic-memory-fields", 4, F.least(F.lit(FIELDS_MOST), F.col("s"))))
    lasting = types.join(memory["entities"].select("doc_id", "entity", "mention_count", "salience"), ["doc_id", "entity"])
    return out.unionByName(_rows(lasting, keys, "semantic-memory-salience", 3, F.least(F.lit(MENTIONS_MOST), MENTION * F.col("mention_count")) + SALIENT * F.col("salience"), F.col("place")))


def _related(closure: DataFrame) -> DataFrame:
    """(concept, other) where one is the other or an ancestor of it, both ways."""
    up = closure.select("concept", F.col("ancestor").alias("other"))
    return up.unionByName(up.select(F.col("other").alias("concept"), F.col("concept").alias("other"))).distinct()


def _fitting(scored: DataFrame, wanted: DataFrame, closure: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, concept) of ``scored`` that are, or are related to, one of ``wanted`` (keys, other)."""
    met = scored.select(*keys, "concept").join(_related(closure), "concept").unionByName(scored.select("concept", *keys, F.col("concept").alias("other")))
    return met.join(wanted, [*keys, "other"], "left_semi").select(*keys, "concept").distinct()


def staged(hints: DataFrame, lexical: DataFrame, closure: DataFrame, canon: Sequence[str] = (), memory: dict[str, DataFrame] | None = None, keys: Sequence[str] = ("doc_id", "hint")) -> DataFrame:
    """All evidence of ``first_stage`` and of the three stages that read the scores so far: stored types, fit with the context, and contradiction of memory.

    closure: (concept, ancestor), a concept's own row may be there. ``canon`` are the types of
    the user's schema, a short list. The first stage is a stored table, as the others read it.
    """
    first = stored(first_stage(hints, lexical, memory, keys))
    named = first.select(*keys, "concept").distinct()
    wanted = hints.select(*keys, F.explode(F.filter("expected", lambda x: F.trim(x) != "")).alias("other")).distinct()
    everything = first
    if canon:
        known = F.explode(F.array(*map(F.lit, dict.fromkeys(canon))))
        there = named.where(F.col("concept").isin(*canon))
        offered = wanted.select(*keys).distinct().select(*keys, known.alias("concept"))
        offers = there.unionByName(_fitting(offered, wanted, closure, keys)).distinct()
        order = F.array_position(F.array(*map(F.lit, dict.fromkeys(canon))), F.col("concept"))
        everything = first.unionByName(_rows(offers, keys, "existing-canon", 5, F.lit(CANON), order))
        named = named.unionByName(offers).distinct()
    asked = named.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    fits = _fitting(asked, wanted, closure, keys).withColumn("__fits", F.lit(True))
    judged = asked.join(fits, [*keys, "concept"], "left")
    everything = everything.unionByName(_rows(judged, keys, "semantic-compatibility", 6, F.when(F.col("__fits"), FITS).otherwise(MISFIT)))
    if memory is None:
        return everything
    strongest = memory["types"].groupBy("doc_id", "entity").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "first", "concept", "sources")).alias("b")).where((-F.col("b.less") >= SURE) & (F.col("b.sources") >= SOURCES))
    held = hints.select(*keys, "entity").join(strongest.select("doc_id", "entity", F.col("b.concept").alias("other")), ["doc_id", "entity"]).select(*keys, "other")
    under = named.join(held.select(*keys).distinct(), list(keys), "left_semi")
    against = under.join(_fitting(under, held, closure, keys), [*keys, "concept"], "left_anti")
    return everything.unionByName(_rows(against, keys, "semantic-memory-conflict", 7, F.lit(CONTRADICTS)))


def near_order(scored: Column, near: float = NEAR, broad: Sequence[str] = BROAD) -> Column:
    """An array of (score, rest, concept) structs in the order of ranks.

    Nearness isn't transitive, so groups are led: the highest score leads all that are within
    ``near`` of it, the highest of the others leads the next group. In a group broad types go first,
    as listed; then what was scored earlier (``stage``, ``place``), then names.
    """
    listed = F.array(*map(F.lit, broad))
    high = F.array_sort(scored, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["concept"] < y["concept"], -1).when(x["concept"] > y["concept"], 1).otherwise(0))
    start = F.struct(F.lit(0).alias("group"), F.lit(None).cast("double").alias("lead"), F.array().cast("array<int>").alias("groups"))

    def step(s: Column, x: Column) -> Column:
        new = s["lead"].isNull() | (s["lead"] - x["score"] > near)
        group = s["group"] + F.when(new, 1).otherwise(0)
        return F.struct(group.alias("group"), F.when(new, x["score"]).otherwise(s["lead"]).alias("lead"), F.array_append(s["groups"], group).alias("groups"))

    groups = F.aggregate(high, start, step)["groups"]
    rank = lambda x: F.when(F.array_position(listed, x["concept"]) > 0, F.array_position(listed, x["concept"])).otherwise(len(broad) + 1)
    keyed = F.zip_with(high, groups, lambda x, g: F.struct(g.alias("g"), rank(x).alias("r"), x["stage"].alias("stage"), x["place"].alias("place"), x["concept"].alias("concept"), x["score"].alias("score")))
    return F.array_sort(keyed)


def rank(evidence: DataFrame, keys: Sequence[str] = ("doc_id", "hint"), near: float = NEAR, margin: float = MARGIN, keep: int = 4) -> DataFrame:
    """(keys, best, confidence, margin, ambiguous, alternatives): evidence summed by concept, saturated, and ranked with a tolerance.

    A key has as many concepts as the ontology at most, so its array is short. Alternatives are the next
    three that have a score at all.
    """
    sums = evidence.groupBy(*keys, "concept").agg(F.sum("score").alias("raw"), F.min(F.struct("stage", "place")).alias("f"))
    ranked = sums.groupBy(*keys).agg(F.collect_list(F.struct(saturate(F.round("raw", 12)).alias("score"), F.col("f.stage").alias("stage"), F.col("f.place").alias("place"), "concept")).alias("all")).select(*keys, near_order(F.col("all"), near).alias("r"))
    best, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    lead = best["score"] - F.coalesce(second["score"], F.lit(0.0))
    return ranked.select(
        *keys, best["concept"].alias("best"), best["score"].alias("confidence"), lead.alias("margin"), (second.isNotNull() & (lead < margin)).alias("ambiguous"),
        F.transform(F.filter(F.slice("r", 2, keep - 1), lambda x: x["score"] > 0), lambda x: x["concept"]).alias("alternatives"),
    )


def refine(suggestions: DataFrame, lexical: DataFrame, memory: dict[str, DataFrame], closure: DataFrame, canon: Sequence[str] = ()) -> DataFrame:
    """Entity suggestions (doc_id, hint, expected, prior_concept, prior_confidence, conflicting) after a second pass with memory.

    Adds likely_type, type_confidence, type_status and refinement, and joins alternatives to
    ``conflicting``. A name that memory doesn't know keeps its first guess (refinement null); one that nothing scores
    is ``no-result``. Names are distinct in a document.
    """
    hints = suggestions.join(memory["names"].withColumnRenamed("name", "hint"), ["doc_id", "hint"], "left")
    hints = stored(hints)
    known = hints.where("entity is not null")
    scored = rank(staged(known, lexical.join(known.select("doc_id", "hint"), ["doc_id", "hint"], "left_semi"), closure, canon, memory))
    met = hints.join(scored, ["doc_id", "hint"], "left")
    found, asked = F.col("best").isNotNull(), F.col("entity").isNotNull()
    return met.select(
        *suggestions.columns, F.coalesce("best", "prior_concept").alias("likely_type"), F.coalesce("confidence", "prior_confidence").alias("type_confidence"), F.col("margin"),
        F.when(found, F.when(F.col("ambiguous"), "semantic-memory-ambiguous").otherwise("semantic-memory-refined")).alias("type_status"),
        F.when(found, F.when(F.col("ambiguous"), "ambiguous").otherwise("refined")).when(asked, "no-result").alias("refinement"),
        F.array_distinct(F.concat(F.coalesce("conflicting", F.array().cast("array<string>")), F.coalesce("alternatives", F.array().cast("array<string>")))).alias("conflicts"),
    )
