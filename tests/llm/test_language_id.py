"""Language identification: subwords against a plain version, and held-out accuracy."""

import zlib

import numpy as np
from factloom.llm import language_id as L
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain_subwords(text):
    low, _ = L._letters()
    words = "".join(chr(low[min(ord(c), L._END)]) for c in text).split(" ")
    out = []
    for w in filter(None, words):
        padded = f" {w} "
        out += [padded[i : i + n] for n in L.SIZES for i in range(len(padded) - n + 1)]
    return sorted(out)


def found(texts):
    chars, starts, _ = L.characters(texts)
    got = [[] for _ in texts]
    reach = {}
    sizes = {}
    for k, (place, bucket) in enumerate(L.subwords(chars)):
        n = L.SIZES[k % len(L.SIZES)]
        for p, b in zip(place.tolist(), bucket.tolist()):
            word = "".join(map(chr, chars[p : p + n]))
            assert reach.setdefault((n, word), b) == b
            sizes[n] = sizes.get(n, 0) + 1
            got[np.searchsorted(starts, p, side="right") - 1].append(word)
    return [sorted(g) for g in got]


def test_subwords_of_texts():
    texts = ["Hello, World", "", None, "a", "  é1É  ", "日本語 text", "\n\n", "x" * 9, "1234", "𐐀b", "नमस्ते"]
    assert found(texts) == [plain_subwords(t or "") for t in texts]


def test_long_texts_over_slices(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 7)
    texts = ["the quick brown fox jumps over it", "and so on and on", "", "abcdefghijklmnopqrstuvwxyz"]
    chars, starts, _ = L.characters(texts)
    table = np.random.default_rng(0).normal(size=(L.BUCKETS, 3))
    total, count = L.sums(table, chars, starts)
    monkeypatch.setattr(L, "SLICE", 1 << 20)
    again, n = L.sums(table, chars, starts)
    assert np.allclose(total, again) and (count == n).all() and count.tolist() == [len(plain_subwords(t)) for t in texts]
    for slice_ in (1 << 20, 7):
        monkeypatch.setattr(L, "SLICE", slice_)
        for (b, w), t, c in zip(L.bags(texts), total, count):
            assert np.allclose((w[:, None] * table[b]).sum(0) * c, t, atol=1e-4)
    model = L.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(L.BUCKETS, 4)), np.eye(4)[:, :2], np.zeros(2), np.zeros(0), np.zeros(0))
    parted, letters = model.shares([*texts, None, "1 2 3 4 5 6 7 8 9"])
    monkeypatch.setattr(L, "SLICE", 1 << 20)
    again, same = model.shares([*texts, None, "1 2 3 4 5 6 7 8 9"])
    assert np.allclose(parted, again) and (letters == same).all() and letters.tolist() == [True, True, False, True, False, False]


def test_a_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    rows = [(k % 3, rng.choice(200, 20, False).astype(np.int32), np.full(20, 0.05, np.float32)) for k in range(12)]
    e, w, c = rng.normal(0, 0.3, (200, 4)), rng.normal(0, 0.1, (4, 3)), np.zeros(3)

    def loss():
        return -np.mean([np.log(L._softmax(s @ e[b] @ w + c)[y]) for y, b, s in rows])

    before = loss()
    for _ in range(200):
        L.descend(rows, e, w, c, 0.5)
    assert loss() < 0.5 * before


def test_held_out_accuracy_and_contract(spark):
    got = L.op12_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(judged) > 30 and np.mean(judged) > 0.9


def test_nulls_empty_tables_and_rejection(spark):
    rows = [(k, text, lang, 1, 2) for k, (text, lang) in enumerate([("the cat and the dog were there", "en"), ("der Hund und die Katze waren dort", "de"), ("le chat et le chien étaient là", "fr")] * 60)]
    rows += [(None, "the dog", "en", 1, 2), (1000, None, "de", 1, 2), (1001, "", None, 1, 2), (1002, "123 ... !", None, 1, 2), (1003, "the " * 200_000, None, 1, 2), (1004, "日本", None, 1, 2), (1004, "日本", None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, rejected int").repartition(3)
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, None, 1000, 1001, 1002, 1003)] == ["en", "de", "fr", "en", "und", "und", "und", "en"]
    assert all(got[k].rejected and got[k].score == 0 for k in (1000, 1001, 1002)) and not got[0].rejected
    assert got[1004].lang_pred in model.langs and L.identify(docs, model).count() == len(rows)
    assert all(r.rejected for r in L.identify(docs, model, reject=1.1).collect())
    empty = docs.limit(0)
    assert L.identify(empty, L.fit(empty)).count() == 0
    none = L.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score, r.rejected) for r in L.identify(docs, none).collect()} == {("und", 0.0, True)}
