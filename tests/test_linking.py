"""Linking of many hints that ask the same, and of odd ones."""

from factloom.operators import linking

NAMES = [(1, "Port Elm", ["Elm"], "place", 7), (2, "port  elm", [], "group", 7), (3, "The Port Elm", [], None, 8), (4, "Oak", ["Elm", "elm"], "place", 7), (5, "Oak", [], "city", 8)]
UP = [("city", "place", 1), ("city", "city", 0), ("place", "place", 0)]


def link(spark, hints, up=True, **options):
    entities = spark.createDataFrame(NAMES, "entity_id long, name string, aliases array<string>, type string, w long")
    asked = spark.createDataFrame(hints, "hint_id long, hint string, expected array<string>, w long")
    return linking.link(asked, entities, spark.createDataFrame(UP, "concept string, ancestor string, depth int") if up else None, **options)


def test_every_hint_has_its_answer(spark):
    hints = [(k, *h) for k, h in enumerate([("Port Elm", ["place"], 7), ("port elm", ["place"], 7), ("the PORT elm", [], 7), ("port elm", None, 7), ("Port Elm", ["place"], 8), ("elm", ["place"], 7), ("oak", ["place"], 8), ("oak", ["place"], None), (None, ["place"], 7), ("", [], 7)] * 3)]
    got = {r.hint_id: (r.status, r.strategy, r.entity_id, r.confidence, r.alternatives) for r in link(spark, hints, world="w").collect()}
    assert len(got) == len(hints)
    place = ("resolved", "exact-name", 1, 1.0, None)
    want = [place, place, ("ambiguous", None, None, None, [1, 2]), ("ambiguous", None, None, None, [1, 2]), ("resolved", "exact-name", 3, 1.0, None), ("ambiguous", None, None, None, [1, 4]), ("resolved", "exact-name", 5, 1.0, None), *[("missing", None, None, None, None)] * 3]
    assert [got[k] for k in range(len(hints))] == want * 3
    free = {r.hint_id: (r.status, r.entity_id, r.alternatives) for r in link(spark, hints, up=False).collect()}
    assert free[2] == ("ambiguous", None, [1, 2, 3]) and free[8][0] == "missing" and free[7] == ("resolved", 4, None)


def test_hints_that_ask_the_same_meet_the_entities_once(spark):
    """Rows made by joins grow with hints plus entities, not with their product."""
    names = spark.range(200).selectExpr("id as entity_id", "'Guild' as name", "cast(array() as array<string>) as aliases", "cast(null as string) as type")
    hints = spark.range(300).selectExpr("id as hint_id", "'guild' as hint", "cast(array() as array<string>) as expected")
    out = linking.link(hints, names)
    assert out.where("status = 'ambiguous' and size(alternatives) = 200").count() == 300
    frame = out.select("hint_id", "status")
    frame.collect()
    rows, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert rows and max(rows) <= 500
