"""Event assembly, the suggestion lifecycle and the streaming twins."""

import time

from pyspark.sql import functions as F

from factloom.operators import state, suggest
from factloom.plans.suggest_queries import story_events
from factloom.streaming import replay


def test_story_events(spark):
    docs = spark.createDataFrame([(1, "Alice and John joined the Guild. Later Alice left, and Bob joined Port Elm. She did not join the Crew. Bob left."), (2, "it rained."), (3, None)], "doc_id int, text string")
    got = [(r.sequence_index, r.event_concept, r.subject, r.object, r.negated) for r in story_events(spark, docs).orderBy("sequence_index").collect()]
    assert got == [
        (0, "event.join", "Alice", "Guild", False), (1, "event.join", "John", "Guild", False), (2, "event.leave", "Alice", None, False),
        (3, "event.join", "Bob", "Port Elm", False), (4, "event.join", "Bob", "Crew", True), (5, "event.leave", "Bob", "Crew", False),
    ]


def test_editing_and_applying(spark):
    row = spark.range(1).select(F.lit("create-entity").alias("kind"), F.create_map(F.lit("name"), F.lit("Oak"), F.lit("type"), F.lit("t")).alias("p"))
    edit = lambda **patch: row.select(suggest.edited_payload(F.col("kind"), F.col("p"), F.create_map(*[F.lit(x) for kv in patch.items() for x in kv])).alias("x")).first().x
    assert edit(name="Elm") == {"name": "Elm", "type": "t"} and edit(type="u") is None
    fields = spark.createDataFrame([("t", "f", ["Red"]), ("t", "g", None)], "type_id string, field_key string, options array<string>")
    accepted = spark.createDataFrame([("t", "f", "red"), ("t", "f", "Blue"), ("t", "g", "New")], "type_id string, field_key string, option string")
    once = suggest.apply_options(fields, accepted)
    twice = suggest.apply_options(once, accepted)
    assert {r.field_key: r.options for r in once.collect()} == {r.field_key: r.options for r in twice.collect()} == {"f": ["Red", "Blue"], "g": ["New"]}
    entities = spark.createDataFrame([("w", "1", "Oak")], "world string, entity_id string, name string")
    new = spark.createDataFrame([("w", "2", " oak"), ("w", "3", "Elm"), ("w", "4", "ELM")], "world string, entity_id string, name string")
    assert sorted(r.entity_id for r in suggest.apply_create_entities(entities, new).collect()) == ["1", "3"]
    cast = spark.createDataFrame([({"n": "1.5", "b": "TRUE", "z": "drop"},), ({"n": "x"},), ({"b": "no", "n": "2"},)], "values map<string,string>")
    got = [(r.clean, r.error) for r in suggest.cast_values(cast, {"n": ("number", True), "b": ("boolean", False)}).collect()]
    assert got == [({"n": "1.5", "b": "true"}, None), ({}, "n:number"), ({"n": "2.0"}, "b:boolean")]
    s = spark.createDataFrame([("a", 2, 0.5, ["x"]), ("a", 1, 0.9, ["y"]), ("b", 3, 0.1, None)], "suggestion_id string, seq int, confidence double, warnings array<string>")
    (one,) = suggest.deduplicate(s).collect()
    assert (one.suggestion_id, one.seq, one.confidence, one.warnings, one.tier) == ("a", 1, 0.9, ["x", "y"], "normal")


def test_streamed_state_is_the_batch_replay(spark, tmp_path):
    rows = [("w", k, ["produce", "end", "produce"][k % 3] if k % 5 else None, f"s{k % 4}", "o", "r", k % 7 == 0, 0.1 * (k % 9)) for k in range(60)]
    schema = "world string, seq long, action string, subject string, object string, relation string, negated boolean, confidence double"
    events = spark.createDataFrame(rows, schema).withColumns({"intended": F.lit(False), "uncertain": F.lit(False)})
    for k in range(3):
        events.where(F.col("seq").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.relation_state(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("live").groupBy("world", "subject", "relation", "object").agg(F.max(F.struct("last_changed_by", "state", "confidence")).alias("x")).select("subject", "x.*")
    batch = state.replay_state(events)
    newest = batch.groupBy("subject").agg(F.max(F.struct("last_changed_by", "state", F.col("confidence"))).alias("x")).select("subject", "x.*")
    assert sorted((r.subject, r.last_changed_by, r.state, round(r.confidence, 6)) for r in last.collect()) == sorted((r.subject, r.last_changed_by, r.state, round(r.confidence, 6)) for r in newest.collect())


def test_snapshots_of_documents(spark, tmp_path):
    changes = [[(1, "a", 1), (2, "b", 2)], [(1, "a", 3), (2, "c", 4), (3, "d", 5)]]
    for k, rows in enumerate(changes):
        spark.createDataFrame(rows, "doc_id long, text string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    empty = spark.createDataFrame([], "doc_id long, text string, content_version long")
    stream = spark.readStream.schema("doc_id long, text string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge = lambda old, batch: replay.upsert_documents(empty if old is None else old, batch)
    q = replay.write_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "c"), merge).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.doc_id: (r.text, r.content_version) for r in replay.newest_snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {1: ("a", 1), 2: ("c", 2), 3: ("d", 1)}
