"""Lexicon folders, packs and the small configuration source."""

import json

from factloom.sources import lexicons


def put(path, concept, *words):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"entries": [{"conceptId": concept, "aliases": {"strong": list(words)}}]}))


def test_packs_and_overlays(spark, tmp_path):
    for c in lexicons.MATCHABLE:
        put(tmp_path / "en" / f"{c}.json", f"{c}.base", f"{c} word")
    put(tmp_path / "packs/space/shared/fields.json", "field.x", "gravity")
    put(tmp_path / "packs/space/en/entityTypes.json", "type.ship", "ship", "vessel")
    put(tmp_path / "packs/space/nsfw/en/fields.json", "field.y", "secret")
    base = lexicons.build(spark, str(tmp_path), "en", ["nothing"])
    assert base.count() == len(lexicons.MATCHABLE)
    got = lexicons.build(spark, str(tmp_path), "en", ["space", "space"]).where("pack = 'space'").collect()
    assert sorted((r.overlay, r.expression) for r in got) == [(1, "gravity"), (2, "ship"), (2, "vessel")]
    full = lexicons.build(spark, str(tmp_path), "en", ["space"], nsfw=True)
    assert full.where("overlay = 4").first().expression == "secret" and lexicons.enabled(full, ["space"]).where("overlay = 4").isEmpty()
    assert lexicons.aliases(full, "type.ship") == ["ship", "vessel"]
    types = spark.createDataFrame([("t1", "Vessel", None), ("t2", "Vessel", "type.own"), ("t3", "House", None)], "type_id string, name string, concept string")
    assert {r.type_id: r.type_concept for r in lexicons.type_concepts(types, full).collect()} == {"t1": "type.ship", "t2": "type.own", "t3": None}


def test_codes(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"codes": [{"code": " a "}, {"code": "b", "enabled": false, "maxUses": 3}, {"code": "c", "maxUses": "many"}, {"code": ""}]}')
    assert [tuple(r) for r in lexicons.read_codes(spark, str(tmp_path / "c.json")).orderBy("code").collect()] == [("a", True, None), ("b", False, 3), ("c", True, None)]
