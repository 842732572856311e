"""Event assembly from clauses and event spans: subjects, objects, modality, sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coordinated, trim_all
from .spans import gather, inside, is_near

#: Fixed: events that take no object; modifiers with their reach before an event (English).
OBJECTLESS = ("event.birth", "event.death", "event.resurrection", "event.awaken", "event.disappear")
MODIFIERS = {"negated": ("modifier.negation", 18), "intended": ("modifier.intention", 22), "uncertain": ("modifier.uncertainty", 20)}
#: Fixed: what may stand between a subject and its event, and after an event before its object's end.
_LEAD = r"(?i)^(?:then|later|afterward|afterwards|finally|eventually|subsequently|and)\s+"
_AUX = r"(?i)\b(?:did not|didn't|never|not|plans? to|planned to|intends? to|intended to|wants? to|wanted to|may|might|possibly|probably)\s*$"
_PRONOUN = r"(?i)^(?:then\s+|later\s+|finally\s+)?(he|she|it|they)\b"
_NAME = r"([A-Z][A-Za-z0-9'’-]*(?:\s+[A-Z][A-Za-z0-9'’-]*){0,3})\s*$"
_ARTICLE_NAME = r"(?:^|\s)(The\s+[A-Z][A-Za-z0-9'’-]*(?:\s+[A-Z][A-Za-z0-9'’-]*){0,3})\s*$"
_STOP = r"(?i)[,.;!?]|\s+(?:and|then|later|finally|but|while|afterward|afterwards)\s+"


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def subject_of(before: Column) -> Column:
    """struct<names,pronoun>: the explicit subjects at the end of the text before an event (several if coordinated), or its pronoun."""
    piece = trim_all(F.element_at(F.split(before, "[,;]"), -1))
    pronoun = _blank(F.regexp_extract(piece, _PRONOUN, 1))
    local = trim_all(F.regexp_replace(F.regexp_replace(piece, _LEAD, ""), _AUX, ""))
    whole = trim_all(F.regexp_replace(F.regexp_replace(trim_all(before), _LEAD, ""), _AUX, ""))
    several = coordinated(whole)
    one = F.coalesce(_blank(F.regexp_extract(local, _ARTICLE_NAME, 1)), _blank(F.regexp_extract(local, _NAME, 1)))
    names = F.when(F.size(several) > 1, several).when(pronoun.isNull() & one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.struct(names.alias("names"), F.when(F.size(several) <= 1, pronoun).alias("pronoun"))


def object_of(after: Column, concept: Column) -> Column:
    """The object in the text after an event, without preposition and article; null for events that take none."""
    bare = trim_all(F.element_at(F.split(after, _STOP), 1))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^(?:to|into|in|at|on|from|with|of)\s+", ""), r"(?i)^(?:a|an|the)\s+", "")
    return F.when(~concept.isin(*OBJECTLESS), _blank(trim_all(bare)))


def _marked(concept: str, reach: int) -> Column:
    """Whether a gathered mark of one concept is near the event."""
    return F.exists("__marks", lambda m: (m["concept_id"] == concept) & is_near(m, F.col("start"), F.col("end"), reach, 2))


def disambiguate(ev: DataFrame, types: DataFrame, doc: str = "doc_id", reach: int = 20) -> DataFrame:
    """Of spans that may be leaving a group or departing from a place, the one that the context means.

    A place and no group within ``reach`` characters to the right: depart. A group: leave.
    Else leave if the event before was a join, and depart if not. ``types`` holds spans
    with ``role``: place or group.
    """
    w = Window.partitionBy(doc, "start", "end")
    names = F.collect_set("concept_id").over(w)
    both = ev.withColumn("__both", F.array_contains(names, "event.leave") & F.array_contains(names, "event.depart"))
    # What stands before: an ambiguous span is never a join, so its outcome isn't needed.
    order = Window.partitionBy(doc).orderBy("start")
    both = both.withColumn("__joined", F.coalesce(F.last(F.when(F.col("concept_id") == "event.join", F.col("start"))).over(order.rangeBetween(Window.unboundedPreceding, -1)).isNotNull(), F.lit(False)))
    t = types.groupBy(doc).agg(F.collect_list(F.struct("start", "role")).alias("__types"))
    met = both.join(t, doc, "left")
    seen = lambda role: F.coalesce(F.exists("__types", lambda x: (x["role"] == role) & (x["start"] - F.col("end")).between(0, reach)), F.lit(False))
    wanted = F.when(seen("place") & ~seen("group"), "event.depart").when(seen("group"), "event.leave").when(F.col("__joined"), "event.leave").otherwise("event.depart")
    out = met.withColumn("__want", wanted).where(~F.col("__both") | ~F.col("concept_id").isin("event.leave", "event.depart") | (F.col("concept_id") == F.col("__want")))
    return out.select(*ev.columns)


def assemble(clauses: DataFrame, spans: DataFrame, concepts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Events (doc, sequence_index, event_concept, subject, object, negated, intended, uncertain, start, end, confidence, produces, ends).

    clauses hold the text in its own case; concepts is (concept_id, produces, ends). A
    pronoun or a missing subject takes the last explicit one of the document; a leave
    without object takes that of the event before it if the subject is the same. All of
    it is windows over a document's own events.
    """
    ev = inside(spans.where("category = 'events'"), clauses.drop("text"), doc).join(clauses.select(doc, "clause_idx", "text"), [doc, "clause_idx"])
    # One event a span: the surest, then the longest concept.
    span = Window.partitionBy(doc, "start").orderBy(F.desc("confidence"), F.desc("end"), "seq")
    ev = ev.withColumn("__k", F.row_number().over(span)).where("__k = 1").drop("__k")
    in_clause = Window.partitionBy(doc, "clause_idx").orderBy("start")
    ev = ev.withColumn("__next", F.coalesce(F.lead("start").over(in_clause), F.col("clause_end")))
    rel = F.col("start") - F.col("clause_start")
    ev = ev.withColumn("__who", subject_of(F.substring(F.col("text"), F.lit(1), rel)))
    after = F.substring(F.col("text"), F.col("end") - F.col("clause_start") + 1, F.greatest(F.lit(0), F.least("__next", "clause_end") - F.col("end")))
    ev = ev.withColumn("__object", object_of(after, F.col("concept_id")))
    in_doc = Window.partitionBy(doc).orderBy("start")
    last_named = F.last(F.when(F.size("__who.names") > 0, F.element_at("__who.names", -1)), ignorenulls=True).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    ev = ev.withColumn("__subjects", F.when(F.size("__who.names") > 0, F.col("__who.names")).otherwise(F.array(F.coalesce(last_named, F.col("__who.pronoun")))))
    ev = ev.withColumn("__last", F.element_at("__subjects", -1)).withColumn("__before", F.lag("__last").over(in_doc))
    inherits = F.col("__object").isNull() & (F.col("concept_id") == "event.leave") & (F.size("__subjects") == 1) & (F.col("__before") == F.col("__subjects")[0])
    ev = ev.withColumn("__inherits", F.coalesce(inherits, F.lit(False)))
    own = F.last(F.when(~F.col("__inherits"), F.struct("__object")), ignorenulls=True).over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    ev = ev.withColumn("object", own["__object"])
    marks = spans.where(F.col("concept_id").isin(*(c for c, _ in MODIFIERS.values())))
    ev = ev.join(gather(marks, doc, "concept_id"), doc, "left")
    for flag, (concept, reach) in MODIFIERS.items():
        ev = ev.withColumn(flag, F.coalesce(_marked(concept, reach), F.lit(False)))
    out = ev.withColumn("subject", F.explode("__subjects")).join(concepts, "concept_id", "left")
    modal = F.col("negated") | F.col("intended") | F.col("uncertain")
    sure = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("subject").isNotNull(), 0.05).otherwise(0) + F.when(F.col("object").isNotNull(), 0.05).otherwise(0) + F.when(modal, 0.02).otherwise(0))
    place = F.array_position("__subjects", F.col("subject"))
    numbered = out.withColumn("sequence_index", F.row_number().over(Window.partitionBy(doc).orderBy("start", place)) - 1)
    return numbered.select(doc, "sequence_index", F.col("concept_id").alias("event_concept"), "subject", "object", "negated", "intended", "uncertain", "start", "end", sure.alias("confidence"), "produces", "ends")


def relation_log(events: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Assembled events as the log that ``state.replay_state`` replays; the document is the world."""
    return events.select(F.col(doc).alias("world"), F.col("sequence_index").alias("seq"), F.when(F.col("produces").isNotNull(), "produce").when(F.col("ends").isNotNull(), "end").alias("action"), F.coalesce("produces", "ends").alias("relation"), "subject", "object", "negated", "intended", "uncertain", "confidence")
