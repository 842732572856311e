"""Working memory of a document: candidates in reading order, folded into entities with beliefs.

Who a mention means depends on all mentions before it: an entity is known by a stored id, a
draft or a name, whichever comes first in that order, and a name that was said before leads to
the entity that it last meant. That is a fold over a document. Only few mentions can change
its state or see it changed: those whose key last came with another name, or whose name
last came with another key. Two windows find these; the fold streams over them alone, and all
other mentions repeat the answer of their key and name. Everything else is grouped or windowed by
entity, so a document with many candidates isn't held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp01, salience
from ..sources.scratch import stored
from . import context

#: Fixed: confidence of a candidate that has none; fields that tell a character, and how sure they are of it at least.
UNSTATED = 0.7
CHARACTER = "entityType.character"
CHARACTER_FIELDS = ("field.age", "field.gender", "field.pronouns", "field.occupation")
LEAST_BY_FIELD = 0.7

_ORDER = ["start", "seq", "side"]
_COLUMNS = ("subject_id", "subject_draft", "subject", "object_id", "object_draft", "object", "subject_type", "object_type", "field_concept", "value", "relation_concept", "candidate_type", "extractor")


def _present(c: Column) -> Column:
    """Null for blank text."""
    return F.when(F.trim(c) != "", F.trim(c))


def complete(candidates: DataFrame) -> DataFrame:
    """``candidates`` with every optional column (null), a known confidence, and names in one form."""
    out = candidates.withColumns({c: F.lit(None).cast("string") for c in _COLUMNS if c not in candidates.columns})
    out = out.withColumn("confidence", clamp01(F.coalesce("confidence", F.lit(UNSTATED)) if "confidence" in candidates.columns else F.lit(UNSTATED)))
    return out.withColumns({c: _present(F.col(c)) for c in ("subject_id", "subject_draft", "subject", "object_id", "object_draft", "object", "subject_type", "object_type", "field_concept", "relation_concept")})


def mentions(candidates: DataFrame) -> DataFrame:
    """(doc_id, start, seq, side, key, name, entity_id, draft_key, placed) of both sides of each candidate that say whom they mean; ``start`` orders, ``placed`` is the start if known."""
    sides = [F.struct(F.lit(k).alias("side"), F.col(f"{s}_id").alias("entity_id"), F.col(f"{s}_draft").alias("draft_key"), F.col(s).alias("name")) for k, s in enumerate(("subject", "object"))]
    each = candidates.select("doc_id", F.coalesce("start", F.lit(0)).alias("start"), "seq", F.col("start").alias("placed"), "confidence", F.explode(F.array(*sides)).alias("m"))
    key = F.coalesce(F.concat(F.lit("entity:"), "m.entity_id"), F.concat(F.lit("draft:"), "m.draft_key"), F.concat(F.lit("name:"), "m.name"))
    return each.select("doc_id", "start", "seq", "m.side", key.alias("key"), "m.name", "m.entity_id", "m.draft_key", "placed", "confidence").where("key is not null")


def identities(said: DataFrame) -> DataFrame:
    """``mentions`` with the ``entity`` that each means, named by the key under which it was first met."""
    by_key, by_name = (Window.partitionBy("doc_id", c).orderBy(*_ORDER) for c in ("key", "name"))
    same_name = F.lag(F.lit(True)).over(by_key).isNotNull() & F.lag("name").over(by_key).eqNullSafe(F.col("name"))
    same_key = F.col("name").isNull() | F.lag("key").over(by_name).eqNullSafe(F.col("key"))
    marked = said.withColumn("__turn", ~(same_name & same_key))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, known, named = None, set(), {}
        for b in batches:
            out = []
            for d, key, name in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "name"))):
                if d != doc:
                    doc, known, named = d, set(), {}
                entity = key if key in known else named.get(name, key) if name is not None else key
                if entity == key:
                    known.add(key)
                if name is not None:
                    named[name] = entity
                out.append(entity)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *_ORDER)), pa.array(out, pa.string())], names=["doc_id", *_ORDER, "__entity"])

    turns = marked.where("__turn").select("doc_id", *_ORDER, "key", "name")
    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("doc_id", *_ORDER))
    met = turns.repartition("doc_id").sortWithinPartitions("doc_id", *_ORDER).mapInArrow(fold, f"{kinds}, __entity string")
    own = Window.partitionBy("doc_id", "key", "name").orderBy(*_ORDER)
    return said.join(met, ["doc_id", *_ORDER], "left").withColumn("entity", F.last("__entity", ignorenulls=True).over(own)).drop("__entity")


def _targets(relations: DataFrame) -> DataFrame:
    """Relations (doc_id, entity, relation_concept, target_id, target, order, confidence) without those whose target's id or name was there before."""
    keys = ["doc_id", "entity", "relation_concept"]
    bare = F.col("target_id").isNull() & F.col("target").isNull()
    place = F.struct("start", "seq")
    first = relations.groupBy(*keys, "target_id", "target", F.when(bare, place).alias("__own")).agg(F.min(F.struct("start", "seq", "confidence")).alias("f"))
    rows = first.select(*keys, "target_id", "target", "f.start", "f.seq", "f.confidence")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, names = None, set(), set()
        for b in batches:
            stay = []
            for *key, i, n in zip(*(b.column(c).to_pylist() for c in (*keys, "target_id", "target"))):
                if key != now:
                    now, ids, names = key, set(), set()
                new = not (i is not None and i in ids or n is not None and n in names)
                stay.append(new)
                if new:
                    ids.add(i)
                    names.add(n)
            yield b.filter(pa.array(stay, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "start", "seq").mapInArrow(fold, rows.schema)


def working_memory(candidates: DataFrame) -> dict[str, DataFrame]:
    """What is believed after reading candidates (doc_id, start, seq and what ``complete`` adds) in the order of start and seq.

    ``entities`` (doc_id, entity, name, entity_id, draft_key, mention_count, salience, last_mention,
    best_type, best_confidence), ``types`` (doc_id, entity, concept, confidence, n, sources, first),
    ``fields`` (doc_id, entity, field_concept, value, confidence), ``relations`` (doc_id, entity,
    relation_concept, target_id, target, start, seq, confidence) and ``names`` (doc_id, name, entity):
    whom each name means at the end. Identities and types are stored tables, as several of these read them.
    Rows that name nobody are ignored; an unknown start counts as 0.
    """
    rows = complete(candidates)
    known = stored(identities(mentions(rows)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*_ORDER)))
    counted = known.groupBy("doc_id", "entity").agg(last("name").alias("name"), last("entity_id").alias("entity_id"), last("draft_key").alias("draft_key"), F.count("*").alias("mention_count"), last("placed").alias("last_mention"))
    names = known.where("name is not null").groupBy("doc_id", "name").agg(F.max_by("entity", F.struct(*_ORDER)).alias("entity"))
    facts = rows.select("doc_id", F.coalesce("start", F.lit(0)).alias("start"), "seq", "confidence", "subject_type", "object_type", "field_concept", "value", "relation_concept", "object_id", "object")
    by_side = known.select("doc_id", "start", "seq", "side", "entity").join(facts, ["doc_id", "start", "seq"])
    subjects, objects = by_side.where("side = 0"), by_side.where("side = 1")
    told = lambda k, concept, c, source: F.struct(F.lit(k).alias("part"), concept.alias("concept"), c.alias("confidence"), source.alias("source"))
    field = F.col("field_concept")
    c = F.col("confidence")
    of_subject = F.array(told(0, F.col("subject_type"), c, F.lit("candidate-subject-type")), told(1, F.when(field.isin(*CHARACTER_FIELDS), CHARACTER), F.greatest(F.lit(LEAST_BY_FIELD), c), F.concat(F.lit("field:"), field)))
    of_object = F.array(told(2, F.col("object_type"), c, F.lit("candidate-object-type")))
    at = ["doc_id", "entity", "start", "seq"]
    typed = subjects.select(*at, F.explode(of_subject).alias("t")).unionByName(objects.select(*at, F.explode(of_object).alias("t"))).select(*at, "t.*").where("concept is not null")
    order = ["start", "seq", "part"]
    summed = context.remember(typed, ["doc_id", "entity"], "concept", "confidence", order)
    sources = typed.groupBy("doc_id", "entity", "concept").agg(F.count_distinct("source").alias("sources"), F.min(F.struct(*order)).alias("first"))
    types = stored(summed.join(sources, ["doc_id", "entity", "concept"]))
    best = types.groupBy("doc_id", "entity").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "first", "concept")).alias("b")).select("doc_id", "entity", F.col("b.concept").alias("best_type"), (-F.col("b.less")).alias("best_confidence"))
    fields = subjects.where("field_concept is not null").groupBy("doc_id", "entity", "field_concept").agg(F.max(F.struct("confidence", "start", "seq", "value")).alias("b")).select("doc_id", "entity", "field_concept", "b.value", "b.confidence")
    relations = _targets(subjects.where("relation_concept is not null").select("doc_id", "entity", "relation_concept", F.col("object_id").alias("target_id"), F.col("object").alias("target"), "start", "seq", "confidence"))
    entities = counted.withColumn("salience", salience(F.col("mention_count"))).join(best, ["doc_id", "entity"], "left")
    return {"entities": entities, "types": types, "fields": fields, "relations": relations, "names": names}
