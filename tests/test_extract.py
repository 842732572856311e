"""The smaller extractors and the leave/depart rule."""

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import events, extract, matching
from factloom.sources import lexicons


def parts(spark, body, rows, locale="en"):
    docs = spark.createDataFrame([(1, body)], "doc_id int, text string")
    found = matching.match_lexicon(docs, lexicons.from_rows(spark, rows, locale), locale)
    return found, docs.select("doc_id", F.explode(text.clauses(F.col("text"), locale)).alias("c")).select("doc_id", "c.*")


def test_gravity_before_its_word(spark):
    found, clauses = parts(spark, "这里有1.2G 重力，很轻。重力很大", [("fields", "field.gravity", "alias", "strong", "重力")], "zh-CN")
    got = extract.extract_gravity_prefix(found, clauses).collect()
    assert [(r.value, r.measured.value, r.measured.unit, r.start) for r in got] == [("1.2G", 1.2, "g", 3)]


def test_roles_and_direct_values(spark):
    rows = [("titles", "role.captain", "alias", "strong", "captain"), ("fields", "field.mood", "alias", "strong", "happy"), ("fields", "field.mood", "alias", "strong", "very happy"), ("fields", "field.mood", "alias", "normal", "sad")]
    found, clauses = parts(spark, "The captain is very happy; she was sad, then happy.", rows)
    found = found.withColumn("kind", F.when(F.col("category") == "titles", "role-signal").otherwise("field"))
    roles = extract.extract_roles(found, clauses, spark.createDataFrame([("role.captain", "field.rank")], "concept_id string, field_concept string")).collect()
    assert [(r.field_concept, r.value) for r in roles] == [("field.rank", "captain")]
    values = spark.createDataFrame([("field.mood", "happy"), ("field.mood", "very happy")], "concept_id string, expression string")
    assert sorted((r.value, r.start) for r in extract.extract_direct(found, clauses, values).collect()) == [("happy", 45), ("very happy", 15)]


def test_species_and_cleanup(spark):
    found, clauses = parts(spark, "Luna is a wolf; the wolf saw a fox dragon.", [("entityTypes", "s.wolf", "alias", "strong", "wolf"), ("entityTypes", "s.dragon", "alias", "strong", "dragon")])
    compounds = spark.createDataFrame([(1, 31, 41)], "doc_id int, start int, end int")
    got = extract.extract_species(found, compounds, clauses).collect()
    assert sorted((r.start, r.extractor) for r in got) == [(10, "pattern.species"), (31, "pattern.compound-species")]
    c = spark.createDataFrame([(1, 0, "f", 0, 0, 5, "red", 0.9), (1, 0, "f", 1, 6, 20, "deep red", 0.8), (1, 0, "f", 2, 8, 10, "x", 1.0), (1, 0, "g", 3, 8, 10, "x", 0.5), (1, 0, "g", 4, 8, 10, "x", 0.5)], "doc_id int, clause_idx int, field_concept string, seq int, start int, end int, value string, confidence double")
    assert sorted(r.seq for r in extract.drop_contained_values(c).collect()) == [1, 3]


def test_leave_or_depart(spark):
    rows = [(1, 0, 4, "event.join"), (1, 10, 14, "event.leave"), (1, 10, 14, "event.depart"), (2, 3, 7, "event.leave"), (2, 3, 7, "event.depart"), (3, 3, 7, "event.leave"), (3, 3, 7, "event.depart"), (4, 1, 2, "event.leave")]
    ev = spark.createDataFrame(rows, "doc_id int, start int, end int, concept_id string")
    types = spark.createDataFrame([(1, 20, "place"), (2, 12, "group"), (2, 9, "place"), (3, 90, "group")], "doc_id int, start int, role string")
    got = sorted((r.doc_id, r.start, r.concept_id) for r in events.disambiguate(ev, types).collect())
    assert got == [(1, 0, "event.join"), (1, 10, "event.depart"), (2, 3, "event.leave"), (3, 3, "event.depart"), (4, 1, "event.leave")]


def test_spans_find_their_clause_in_one_pass(spark):
    """The matching pass places spans as the join of spans and clauses does."""
    import random

    from factloom.functions import text
    from factloom.operators import matching, spans
    from factloom.sources import lexicons

    rng = random.Random(2)
    pieces = ["of", "the", "with", " ", " ", "  ", ".", "!", ";", "\n", " ", "﻿", "x", "é", "of the", "日本"]
    docs = spark.createDataFrame([(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for k in range(80)] + [(90, None), (91, ""), (92, " . ; ")], "doc_id long, text string")
    lexicon = lexicons.from_rows(spark, (("relations", "r.of", "alias", "strong", "of"), ("relations", "r.two", "alias", "strong", "of the"), ("types", "t.the", "suffix", "normal", "the")))
    clean = docs.select("doc_id", text.normalize_text(docs.text, compose=False).alias("text"))
    joined = spans.inside(matching.match_lexicon(clean, lexicon), text.clause_rows(clean).drop("text"))
    placed = matching.match_lexicon(docs, lexicon, clauses=True).where("clause_idx is not null")
    rows = lambda df: sorted((r.doc_id, r.clause_idx, r.concept_id, r.start, r.end) for r in df.collect())
    assert rows(joined) == rows(placed) and len(rows(placed)) > 100
