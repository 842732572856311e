"""Relations, names and types from spans: extraction, evidence and scores.

Spans carry ``kind`` (entity-type, role-signal, relation, event, field, modifier), which a
lexicon's ontology gives them. Clauses hold the text in its own case, with the same
offsets as the spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp01, saturate, weakest_link
from ..functions.text import trim_all
from .linking import name_similarity
from .spans import inside

_NAME = r"[A-Z][A-Za-z0-9'’-]*(?:\s+[A-Z][A-Za-z0-9'’-]*){0,2}"
#: Fixed: fields that say better than a relation what it says.
PREFERRED_FIELDS = {"relation.from": "field.hometown", "relation.origin": "field.hometown", "relation.member_of": "field.affiliation", "relation.works_for": "field.affiliation", "relation.affiliated_with": "field.affiliation", "relation.lives_in": "field.residence", "relation.resides_in": "field.residence"}
#: Fixed: auxiliaries that may stand between a subject and its trigger; pronouns that may be one.
AUXILIARIES = "is|was|are|were|has|have|had|uses|used|received|underwent|became|comes|came|lives|lived"
SUBJECT_PRONOUNS = "He|She|It|They|His|Her|Its|Their"
#: Fixed: words at which an object ends.
OBJECT_ENDS = "and|but|while|then|who|which|that"
#: Fixed: what a resolved pronoun says about its subject, and how surely.
PRONOUNS = {"he": ("male", 0.93), "him": ("male", 0.90), "his": ("male", 0.93), "himself": ("male", 0.93), "she": ("female", 0.93), "her": ("female", 0.90), "hers": ("female", 0.93), "herself": ("female", 0.93), "他": ("male", 0.93), "他的": ("male", 0.93), "她": ("female", 0.93), "她的": ("female", 0.93)}
#: Fixed: weights of type evidence: an expected type; lexical by strength; an earlier inference; memory by its sources; stored entities; fit and misfit with what is expected.
EXPECTED, LEXICAL, PRIOR, MEMORY, MEMORY_SOURCES, STORED, FITS, MISFIT = 0.72, {"suffix": 0.58, "weak": 0.18, "other": 0.38}, 0.24, 0.58, (0.55, 0.78, 1.0), 0.34, 0.12, -0.48


def subject_left(before: Column, structural_tail: Column) -> Column:
    """The subject left of a trigger: a name right after the nearest type or role word, a name before an auxiliary, a pronoun, the clause's first name."""
    get = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    verb = rf"(?i)^\s*((?-i:{_NAME}))\s+(?:{AUXILIARIES})\s+(?:a|an|the)?\s*$"
    return F.coalesce(get(structural_tail, rf"^\s*({_NAME})"), get(before, verb), get(before, rf"(?:^|\s)({SUBJECT_PRONOUNS})\b[^.!?;]*$"), get(before, rf"^\s*({_NAME})\b"))


def extract_relations(spans: DataFrame, clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, clause_idx, relation, subject, object, start, end, confidence): a relation word, its subject on the left, its object up to the next structural span or mark.

    Boundaries and subjects come from windows over the clause's spans.
    """
    met = inside(spans, clauses.drop("text"), doc).join(clauses.select(doc, "clause_idx", "text"), [doc, "clause_idx"])
    w = Window.partitionBy(doc, "clause_idx").orderBy("start", "seq")
    hard = F.col("kind").isin("relation", "event", "role-signal") | ((F.col("kind") == "entity-type") & (F.col("evidence_type") != "suffix"))
    nxt = F.min(F.when(hard, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    last_type = F.max(F.when(F.col("kind").isin("entity-type", "role-signal"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rel = met.withColumns({"__next": nxt, "__type": last_type}).where("kind = 'relation'")
    at = lambda a, b: F.substring(F.col("text"), a - F.col("clause_start") + 1, F.greatest(F.lit(0), b - a))
    limit = F.least(F.col("clause_end"), F.coalesce(F.when(F.col("__next") > F.col("end"), F.col("__next")), F.col("clause_end")))
    close = at(F.col("end"), limit)
    raw = F.when(trim_all(close) == "", at(F.col("end"), F.col("clause_end"))).otherwise(close)
    obj = trim_all(F.element_at(F.split(raw, rf"(?i)[,.;!?]|\s+(?:{OBJECT_ENDS})\s+"), 1))
    obj = F.nullif(F.regexp_replace(obj, r"(?i)^(?:(?:to|into|in|at|on|from|with|of)\s+)?(?:(?:a|an|the)\s+)?", ""), F.lit(""))
    tail = F.when((F.col("__type") <= F.col("start")), at(F.col("__type"), F.col("start"))).otherwise(F.lit(""))
    out = rel.withColumns({"subject": subject_left(at(F.col("clause_start"), F.col("start")), tail), "object": obj}).where("object is not null")
    return out.select(doc, "clause_idx", F.col("concept_id").alias("relation"), "subject", "object", "start", F.least("clause_end", F.col("end") + F.length("object")).cast("int").alias("end"), F.least(F.lit(0.98), F.col("confidence") + 0.06).alias("confidence"))


def preferred_fields(relations: DataFrame) -> DataFrame:
    """Relations whose two sides are known as the field that says it better; a little less sure."""
    table = F.create_map(*[F.lit(x) for kv in PREFERRED_FIELDS.items() for x in kv])
    out = relations.withColumn("field_concept", F.try_element_at(table, F.col("relation")))
    return out.where("field_concept is not null and subject is not null and object is not null").withColumns({"value": F.col("object"), "confidence": F.greatest(F.lit(0.0), F.col("confidence") - 0.02)})


def discover_names(spans: DataFrame, docs: DataFrame, stop: Sequence[str] = (), doc: str = "doc_id") -> DataFrame:
    """(doc, name, start, end, likely_type, role, confidence): capitalised words right before a type or role word, with it.

    At most six words; names of two words, and suffix evidence, are surer. Names that are
    stop terms, or shorter than two characters, aren't names.
    """
    token = r"(?:[A-Z][A-Za-z0-9'’-]*|(?i:[0-9]+(?:st|nd|rd|th)?))"
    met = spans.where("kind in ('entity-type', 'role-signal')").join(docs.select(doc, "text"), doc)
    left = F.regexp_extract(F.substring(F.col("text"), F.lit(1), F.col("start")), rf"((?:{token}\s+){{1,6}})$", 1)
    word = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    name = F.regexp_replace(F.concat(left, word), r"\s+", " ")
    sure = F.col("confidence") + F.when(F.size(F.split(F.col("name"), " ")) >= 2, 0.08).otherwise(0) + F.when(F.col("evidence_type") == "suffix", 0.05).otherwise(0)
    role = F.col("kind") == "role-signal"
    out = met.withColumns({"name": name, "__from": (F.col("start") - F.length(left)).cast("int")}).where((F.length("name") >= 2) & ~F.lower("name").isin(*stop, ""))
    return out.select(doc, "name", F.col("__from").alias("start"), "end", F.when(role, "entityType.character").otherwise(F.col("concept_id")).alias("likely_type"), F.when(role, F.col("concept_id")).alias("role"), F.least(F.lit(1.0), sure).alias("confidence"), "expression", "evidence_type")


def reject_terms(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Names that aren't generic or stop terms, by their form without case and spaces."""
    form = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return names.withColumn("__f", form(F.col("name"))).join(terms.select(form(F.col("term")).alias("__f")).distinct(), "__f", "left_anti").drop("__f")


def similar_names(hints: DataFrame, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Hints with the names of their document that are alike: (doc, hint, name, similarity), each pair once.

    One ends with the other, so the endings of either side meet the other side whole, in equi-joins.
    """
    ends = lambda df, c, least: df.select(doc, c, F.explode(F.sequence(F.least(F.lit(least), F.length(c)), F.length(c))).alias("__n")).select(doc, c, F.lower(F.expr(f"right({c}, __n)")).alias("__end"))
    whole = lambda df, c: df.select(doc, c, F.lower(c).alias("__end"))
    h, n = hints.select(doc, "hint").where("length(hint) > 0").distinct(), names.select(doc, "name").where("length(name) > 0").distinct()
    met = whole(h, "hint").join(ends(n, "name", 2), [doc, "__end"]).unionByName(ends(h, "hint", 3).join(whole(n, "name"), [doc, "__end"]).select(doc, "__end", "hint", "name")).select(doc, "hint", "name").distinct()
    return met.withColumn("similarity", name_similarity(F.lower("hint"), F.lower("name"))).where("similarity is not null")


def pronoun_genders(resolved: DataFrame) -> DataFrame:
    """(doc_id, subject, value, confidence) from pronouns (doc_id, pronoun, subject, status) that are surely resolved; each subject and value once, the surest."""
    table = F.create_map(*[x for p, (g, c) in PRONOUNS.items() for x in (F.lit(p), F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")))])
    got = resolved.where("subject is not null and coalesce(status, 'resolved') = 'resolved'").withColumn("__p", F.try_element_at(table, F.lower(F.trim("pronoun")))).where("__p is not null")
    return got.groupBy("doc_id", "subject", F.col("__p.g").alias("value")).agg(F.max("__p.c").alias("confidence"))


def lexical_evidence(names: DataFrame, similarity: str = "similarity") -> DataFrame:
    """(hint, concept, score) from discovered names: strength of the evidence, how sure, how alike the names are."""
    weight = F.when(F.col("evidence_type") == "suffix", LEXICAL["suffix"]).when(F.col("strength") == "weak", LEXICAL["weak"]).otherwise(LEXICAL["other"])
    return names.select("doc_id", "hint", F.col("likely_type").alias("concept"), (weight * F.col("confidence") * F.col(similarity)).alias("score"))


def expected_evidence(hints: DataFrame) -> DataFrame:
    """(hint, concept, score) of the types that a hint's role expects."""
    return hints.select("doc_id", "hint", F.explode("expected").alias("concept")).withColumn("score", F.lit(EXPECTED))


def prior_evidence(prior: DataFrame) -> DataFrame:
    """(hint, concept, score) of an earlier inference."""
    return prior.select("doc_id", "hint", "concept", (PRIOR * F.col("confidence")).alias("score"))


def memory_evidence(memory: DataFrame) -> DataFrame:
    """(hint, concept, score) of remembered types, by how many sources said so, and of how salient the entity is."""
    by_sources = F.when(F.col("n") <= 1, MEMORY_SOURCES[0]).when(F.col("n") == 2, MEMORY_SOURCES[1]).otherwise(MEMORY_SOURCES[2])
    lasting = F.least(F.lit(0.14), 0.035 * F.col("mentions")) + 0.10 * F.col("salience")
    return memory.select("doc_id", "hint", "concept", (MEMORY * F.col("confidence") * by_sources + lasting).alias("score"))


def with_expectation(evidence: DataFrame, hints: DataFrame, closure: DataFrame) -> DataFrame:
    """Evidence, and for every concept scored so far whether it fits what the hint expects; hints that expect nothing stay as they are."""
    scored = evidence.select("doc_id", "hint", "concept").distinct()
    up = closure.groupBy(F.col("concept")).agg(F.collect_set("ancestor").alias("__up"))
    met = scored.join(hints.select("doc_id", "hint", "expected"), ["doc_id", "hint"]).where(F.size("expected") > 0).join(up, "concept", "left")
    fits = F.arrays_overlap("expected", F.coalesce("__up", F.array("concept")))
    return evidence.unionByName(met.select("doc_id", "hint", "concept", F.when(fits, FITS).otherwise(MISFIT).alias("score")))


def relation_score(subject_fits: Column, object_fits: Column, subject_c: Column, object_c: Column, subject_s: Column, object_s: Column, known: Column) -> Column:
    """How plausible a relation is by its ends' types, their salience and memory; it annotates, it doesn't filter."""
    side = lambda fits, c, good, bad, memory: F.when(fits.isNull(), 0.0).when(fits, good * c + memory * c).otherwise(bad)
    total = side(subject_fits, subject_c, 0.46, -0.40, 0.24) + side(object_fits, object_c, 0.54, -0.48, 0.28) + 0.08 * F.coalesce(subject_s, F.lit(0.0)) + 0.06 * F.coalesce(object_s, F.lit(0.0)) + F.when(known, 0.18).otherwise(0.0)
    return saturate(total)


def event_score(confidence: Column, subject_quality: Column, object_quality: Column) -> Column:
    """An event is as sure as its weakest part."""
    return weakest_link(weakest_link(clamp01(confidence), F.coalesce(subject_quality, confidence)), F.coalesce(object_quality, confidence))


def mention_relations(mentions: DataFrame, sentences: DataFrame, rules: Sequence[tuple[str, str, float]], keys: Sequence[str] = ("doc_id", "sentence_idx")) -> DataFrame:
    """(keys, subject, object, relation, confidence): the first rule (relation, label, confidence) whose label stands between two mentions, each triple once a document."""
    a, b = mentions.alias("a"), mentions.alias("b")
    cond = (F.col("a.start") < F.col("b.start")) & (F.col("a.entity_id") != F.col("b.entity_id"))
    for k in keys:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    pairs = a.join(b, cond).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.entity_id").alias("subject"), F.col("b.entity_id").alias("object"), F.col("a.end").alias("__from"), F.col("b.start").alias("__to")).join(sentences, list(keys))
    between = F.lower(F.substring(F.col("text"), F.col("__from") + 1, F.greatest(F.lit(0), F.col("__to") - F.col("__from"))))
    hit = F.coalesce(*(F.when(F.contains(between, F.lit(label.lower())), F.struct(F.lit(k).alias("k"), F.lit(r).alias("relation"), F.lit(c).alias("confidence"))) for k, (r, label, c) in enumerate(rules)))
    found = pairs.withColumn("__h", hit).where("__h is not null")
    return found.groupBy(keys[0], "subject", "object", F.col("__h.relation").alias("relation")).agg(F.max("__h.confidence").alias("confidence"))


def materialize(pending: DataFrame, accepted: DataFrame, sides: Sequence[str] = ("subject", "object", "target")) -> DataFrame:
    """Pending suggestions whose drafts were accepted as entities (doc_id, draft_key, name, entity_id) get the stored id and lose the draft.

    A draft key decides; by name alone only if neither side has a key.
    """
    out = pending
    for side in sides:
        if f"{side}_draft_key" not in pending.columns:
            continue
        by_key = accepted.where("draft_key is not null").select("doc_id", F.col("draft_key").alias(f"{side}_draft_key"), F.col("entity_id").alias("__k"))
        by_name = accepted.where("draft_key is null").select("doc_id", F.col("name").alias(f"{side}_name"), F.col("entity_id").alias("__n"))
        out = out.join(by_key, ["doc_id", f"{side}_draft_key"], "left")
        out = out.join(by_name, ["doc_id", f"{side}_name"], "left") if f"{side}_name" in pending.columns else out.withColumn("__n", F.lit(None).cast("string"))
        new = F.coalesce(F.col("__k"), F.when(F.col(f"{side}_draft_key").isNull(), F.col("__n")))
        stored = F.coalesce(F.col(f"{side}_entity_id"), new)
        out = out.withColumns({f"{side}_entity_id": stored, f"{side}_draft_key": F.when(stored.isNull(), F.col(f"{side}_draft_key"))}).drop("__k", "__n")
    return out.select(*pending.columns)


def rename_drafts(pending: DataFrame, renames: DataFrame, side: str) -> DataFrame:
    """Pending suggestions after drafts (doc_id, draft_key, new_name) were renamed; the change joins their edit history."""
    met = pending.join(renames.select("doc_id", F.col("draft_key").alias(f"{side}_draft_key"), "new_name"), ["doc_id", f"{side}_draft_key"], "left")
    changed = F.col("new_name").isNotNull() & ~F.col("new_name").eqNullSafe(F.col(f"{side}_name"))
    entry = F.concat_ws(" -> ", F.col(f"{side}_name"), F.col("new_name"))
    return met.withColumn("edit_history", F.when(changed, F.array_append("edit_history", entry)).otherwise(F.col("edit_history"))).withColumn(f"{side}_name", F.when(changed, F.col("new_name")).otherwise(F.col(f"{side}_name"))).select(*pending.columns)
