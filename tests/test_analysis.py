"""The whole analysis on a small corpus."""

from factloom.plans.analysis import analyse
from factloom.sources import lexicons

LEXICON = (("relations", "relation.lives_in", "alias", "strong", "lives in"), ("relations", "relation.friend", "alias", "strong", "is a friend of"), ("events", "event.join", "alias", "strong", "joined"), ("events", "event.leave", "alias", "strong", "left"), ("modifiers", "modifier.negation", "alias", "strong", "never"))
CONCEPTS = [("relation.lives_in", "relation", None, None), ("relation.friend", "relation", None, None), ("event.join", "event", "member_of", None), ("event.leave", "event", None, "member_of"), ("modifier.negation", "modifier", None, None)]


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "Rin is 24 years old.  Rin lives in the Oak City. Rin is a friend of Bob."), (2, "Bob joined the Guild; Ann joined the Guild. Ann left. Bob never left."), (3, None), (4, "")], "doc_id long, text string")
    entities = spark.createDataFrame([("e1", "Rin", [], None), ("e2", "Bob", ["Bobby"], None)], "entity_id string, name string, aliases array<string>, type string")
    out = analyse(docs, lexicons.from_rows(spark, LEXICON), spark.createDataFrame(CONCEPTS, "concept_id string, kind string, produces string, ends string"), entities)
    assert sorted((r.world, r.subject, r.object, r.state) for r in out["state"].collect()) == [(2, "Ann", "Guild", "ended"), (2, "Bob", "Guild", "active")]
    got = {(r.doc_id, r.suggestion_id): (r.status, r.tier) for r in out["suggestions"].collect()}
    assert got[1, "field-update::e1::field.age::24"] == ("ready", "normal")
    assert got[1, "field-update::e1::field.residence::Oak City"] == ("ready", "normal")
    assert got[1, "relation-update::e1::relation.friend::e2"] == ("ready", "normal")
    assert got[2, "create-entity::ann"][0] == "needs-user-confirmation"
    assert got[2, "event-history::e2::event.join::guild"][0] == "needs-user-confirmation"
    assert {s for (d, k), (s, _) in got.items() if k.startswith("event-history::e2::event.leave")} == {"informational"}
    assert {d for d, _ in got} == {1, 2}
