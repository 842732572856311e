"""Working memory and type refinement against plain folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import context, memory, refine

SCHEMA = "doc_id long, start int, seq int, subject_id string, subject_draft string, subject string, object_id string, object_draft string, object string, subject_type string, object_type string, field_concept string, value string, relation_concept string, confidence double"


def candidates(n=900, seed=0):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for k in range(n):
        doc = 0 if rng.random() < 0.5 else rng.randrange(12)
        rows.append((
            doc, pick(None, rng.randrange(200)), k, pick(None, None, "1", "2", ""), pick(None, None, "d1", "d2"), pick(None, "Ann", "Bob ", "Cy", " "), pick(None, None, "1", "3"), pick(None, None, "d1"), pick(None, "Ann", "Dee", "Bob"),
            pick(None, "t.a", "t.b"), pick(None, "t.c"), pick(None, "field.age", "field.motto", "field.occupation"), pick("x", "y", None), pick(None, "r.knows", "r.owns"), pick(None, round(rng.random(), 2), 1.5, -1.0, 0.5),
        ))
    return rows


def plain(rows):
    out = {}
    for doc in {r[0] for r in rows}:
        entities, index, targets = {}, {}, {}
        clean = lambda x: (x or "").strip() or None

        def meet(i, d, n):
            i, d, n = map(clean, (i, d, n))
            key = f"entity:{i}" if i else f"draft:{d}" if d else f"name:{n}" if n else None
            if key is None:
                return None
            e = entities.get(key) or (entities.get(index[n]) if n in index else None)
            if e is None:
                e = entities[key] = {"key": key, "name": None, "id": None, "draft": None, "n": 0, "last": None, "types": {}, "sources": {}, "fields": {}}
            if n:
                e["name"] = n
                index[n] = e["key"]
            e["id"], e["draft"] = i or e["id"], d or e["draft"]
            return e

        def believe(e, concept, c, source):
            e["types"][concept] = 1 - (1 - 0.92 * e["types"].get(concept, 0.0)) * (1 - c)
            e["sources"].setdefault(concept, set()).add(source)

        def mention(e, start):
            e["n"] += 1
            e["last"] = start if start is not None else e["last"]

        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1] or 0, r[2])):
            _, start, _, si, sd, sn, oi, od, on, st, ot, field, value, relation, c = r
            c = min(1.0, max(0.0, 0.7 if c is None else c))
            s = meet(si, sd, sn)
            if s:
                mention(s, start)
                if st:
                    believe(s, st, c, "subject")
                if field:
                    if field not in s["fields"] or c >= s["fields"][field][1]:
                        s["fields"][field] = (value, c)
                    if field in ("field.age", "field.occupation"):
                        believe(s, "entityType.character", max(0.7, c), field)
                if relation:
                    own, name = targets.setdefault((s["key"], relation), []), clean(on)
                    if not any((oi and i == oi) or (name and n == name) for i, n in own):
                        own.append((oi, name))
            o = meet(oi, od, on)
            if o:
                mention(o, start)
                if ot:
                    believe(o, ot, c, "object")
        out[doc] = entities, index, targets
    return out


def test_working_memory_is_the_plain_fold(spark):
    rows = candidates()
    got = {k: df.collect() for k, df in memory.working_memory(spark.createDataFrame(rows, SCHEMA).repartition(5)).items()}
    want = plain(rows)
    ents = {(d, k): e for d, (es, _, _) in want.items() for k, e in es.items()}
    assert {(r.doc_id, r.entity): (r.name, r.entity_id, r.draft_key, r.mention_count, r.last_mention) for r in got["entities"]} == {k: (e["name"], e["id"], e["draft"], e["n"], e["last"]) for k, e in ents.items()}
    assert all(math.isclose(r.salience, min(1, 0.35 + 0.12 * r.mention_count)) for r in got["entities"])
    types = {(r.doc_id, r.entity, r.concept): (r.confidence, r.sources) for r in got["types"]}
    assert types.keys() == {(*k, t) for k, e in ents.items() for t in e["types"]}
    assert all(math.isclose(c, ents[d, k]["types"][t]) and s == len(ents[d, k]["sources"][t]) for (d, k, t), (c, s) in types.items())
    for r in got["entities"]:
        own = ents[r.doc_id, r.entity]["types"]
        assert r.best_type == (max(own, key=own.get) if own else None)
    assert {(r.doc_id, r.entity, r.field_concept): (r.value, r.confidence) for r in got["fields"]} == {(*k, f): v for k, e in ents.items() for f, v in e["fields"].items()}
    assert sorted((r.doc_id, r.entity, r.relation_concept, str(r.target_id), str(r.target)) for r in got["relations"]) == sorted((d, k, c, str(i), str(n)) for d, (_, _, ts) in want.items() for (k, c), own in ts.items() for i, n in own)
    assert {(r.doc_id, r.name): r.entity for r in got["names"]} == {(d, n): k for d, (_, index, _) in want.items() for n, k in index.items()}


def test_only_turning_points_are_folded(spark):
    """A hot entity in a hot document repeats the answer of its key and name."""
    rows = [(0, k, 0, None, None, "Ann", None, None, "Bob", None, None, None, None, None, 0.5) for k in range(3000)]
    said = memory.mentions(memory.complete(spark.createDataFrame(rows, SCHEMA)))
    assert {(r.name, r.entity) for r in memory.identities(said).select("name", "entity").distinct().collect()} == {("Ann", "name:Ann"), ("Bob", "name:Bob")}
    got = memory.working_memory(spark.createDataFrame(rows[:0], SCHEMA))
    assert all(df.isEmpty() for df in got.values())


def test_parted_fold_is_the_fold(spark):
    rng = random.Random(1)
    rows = [(k % 3, "c", k, rng.random() / 4) for k in range(500)]
    want = {}
    for e, _, _, c in rows:
        want[e] = 1 - (1 - 0.92 * want.get(e, 0.0)) * (1 - c)
    df = spark.createDataFrame(rows, "e int, concept string, k int, c double").repartition(4)
    for folded in (1, 7, 4096):
        got = {r.e: (r.confidence, r.n) for r in context.remember(df, ["e"], "concept", "c", ["k"], folded).collect()}
        assert all(math.isclose(got[e][0], want[e]) for e in want) and sum(n for _, n in got.values()) == 500


@pytest.mark.parametrize("scores, order", [
    ({"entityType.item": 0.60, "type.x": 0.61}, ["entityType.item", "type.x"]),
    ({"entityType.item": 0.58, "type.x": 0.61}, ["type.x", "entityType.item"]),
    ({"entityType.item": 0.60, "entityType.character": 0.59, "type.x": 0.61}, ["entityType.character", "entityType.item", "type.x"]),
    # Each is near the next, the last isn't near the first: the highest leads its group, the rest follows.
    ({"type.x": 0.66, "type.y": 0.64, "entityType.character": 0.62}, ["type.x", "type.y", "entityType.character"]),
    ({"type.y": 0.50, "type.x": 0.50}, ["type.y", "type.x"]),
])
def test_ranking_with_a_tolerance(spark, scores, order):
    rows = [(1, "h", c, "x", -math.log(1 - s), 0, k) for k, (c, s) in enumerate(scores.items())]
    r = refine.rank(spark.createDataFrame(rows, "doc_id long, hint string, concept string, source string, score double, stage int, place long")).first()
    assert [r.best, *r.alternatives] == order and math.isclose(r.margin, scores[order[0]] - scores[order[1]], abs_tol=1e-9) and r.ambiguous == (r.margin < 0.12)


def test_every_kind_of_evidence(spark):
    """One name with all nine kinds; the sums are written out by hand."""
    up = spark.createDataFrame([("type.guild", "entityType.organization")], "concept string, ancestor string")
    rows = [(1, k, 0, "Ann", t, f, 0.8) for k, (t, f) in enumerate([("entityType.character", "field.age"), ("entityType.character", None), (None, "field.birthplace")])]
    known = memory.working_memory(spark.createDataFrame(rows, "doc_id long, start int, seq int, subject string, subject_type string, field_concept string, confidence double"))
    hints = spark.createDataFrame([(1, "Ann", ["entityType.organization"], "type.guild", 0.5, ["old"]), (1, "Zed", [], "type.guild", 0.4, None), (1, "Bo", [], None, None, None)], "doc_id long, hint string, expected array<string>, prior_concept string, prior_confidence double, conflicting array<string>")
    lexical = spark.createDataFrame([(1, "Ann", 0, "type.guild", "suffix", None, 0.9), (1, "Ann", 1, "type.other", None, "weak", None)], "doc_id long, hint string, place int, concept string, evidence_type string, strength string, confidence double")
    owned = hints.join(known["names"].withColumnRenamed("name", "hint"), ["doc_id", "hint"], "left")
    sums = {(r.hint, r.concept): (round(r.s, 9), set(r.k)) for r in refine.staged(owned, lexical, up, ["type.guild"], known).groupBy("hint", "concept").agg(F.sum("score").alias("s"), F.collect_set("source").alias("k")).collect()}
    c = 0.0
    for e in (0.8, 0.8, 0.8):
        c = 1 - (1 - 0.92 * c) * (1 - e)
    lasting = min(0.14, 0.035 * 3) + 0.10 * (0.35 + 0.12 * 3)
    assert sums["Ann", "entityType.organization"] == (round(0.72 + 0.12 - 0.34, 9), {"semantic-expectation", "semantic-compatibility", "semantic-memory-conflict"})
    assert sums["Ann", "type.guild"][0] == round(0.58 * 0.9 + 0.24 * 0.5 + 0.34 + 0.12 - 0.34, 9)
    assert sums["Ann", "type.other"][0] == round(0.18 * 0.6 - 0.48 - 0.34, 9)
    assert sums["Ann", "entityType.character"] == (round(0.58 * c * 0.78 + 0.2 * 0.8 * 2 + lasting - 0.48, 9), {"semantic-memory", "semantic-memory-fields", "semantic-memory-salience", "semantic-compatibility"})
    got = {r.hint: r for r in refine.refine(hints, lexical, known, up, ["type.guild"]).collect()}
    assert got["Zed"].refinement is None and got["Zed"].likely_type == "type.guild" and got["Zed"].type_confidence == 0.4
    assert got["Ann"].refinement in ("refined", "ambiguous") and got["Ann"].conflicts[0] == "old" and got["Bo"].likely_type is None
