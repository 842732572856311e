"""The pipeline's stages against plain versions, stage by stage on its own input."""

import re

import pytest
from test_simhash_dedup import plain_components, plain_fingerprint

import corpus_pipeline
from factloom.llm import pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows of every stage's input and output."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, at = [docs.collect()], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if k < 4:
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        made.write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out


def test_quality_stage(spark, kept):
    model = quality.fit(spark.createDataFrame(kept[0]), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in kept[0] if model.scores(quality._stacked([r.text]))[0] >= 0.5}
    assert {r.doc_id for r in kept[1]} == good and len(kept[1]) < len(kept[0])


def test_near_duplicate_stage(kept):
    want = plain_components([r.doc_id for r in kept[1]], [plain_fingerprint(r.text) for r in kept[1]])
    assert sorted(r.doc_id for r in kept[2]) == sorted(set(want.values()))


def test_decontamination_stage(spark, kept):
    grams = lambda t: (lambda w: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)})(t.lower().split())
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in kept[2] if any(len(g & grams(r.text)) >= 0.8 * len(g) for g in items)}
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]} - leaky


def test_pii_stage(kept):
    after = {r.doc_id: r for r in kept[4]}
    assert len(after) == len(kept[3])
    for r in kept[3]:
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        for kind, a, b in pii.base_spans(r.text):
            assert r.text[a:b] not in after[r.doc_id].text
        if not pii.base_spans(r.text) and not pii.candidate_spans(r.text, []):
            assert after[r.doc_id].text == r.text
    assert any(re.search("<(EMAIL|CARD|IP|PHONE)>", r.text) for r in kept[4])


def test_packing_stage(kept):
    assert {r.doc_id for r in kept[5]} == {r.doc_id for r in kept[4]}


def test_run_is_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[5])


def test_odd_tables(spark, tmp_path):
    """Null, empty, very long and repeated texts, null ids, extra columns; then empty tables."""
    long = "The river rose again. " * 20_000
    rows = [(1, None, "en", "s", 0, 7), (2, "", "en", "s", 0, 7), (None, "Some words here.", "en", "s", 9, 7), (3, long, "en", "s", len(long), 7), (3, long, "en", "s", len(long), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark int")
    for k, part in enumerate((docs, docs.limit(0))):
        at = str(tmp_path / str(k))
        part.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        # Without labels all pass; null and empty texts are one group, and copies are one document.
        assert {r.doc_id for r in got} == (set() if k else {1, None, 3})
        assert sum(r.length for r in got if r.doc_id == 1) == len({1} if not k else ())
