"""SimHash operator against a plain word-by-word, pair-by-pair version."""

import random
import re

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash_dedup
from factloom.llm.simhash_dedup import close_pairs, fingerprint, keep_one, near_duplicates


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, radius=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "AÉ é x y\x1cz   b", "the " * 5000, "x" * 100_000, "w1 w2 w3 w4 w5 " * 3])
def test_fingerprint_is_exact(text):
    assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(text, chunk=3) == plain_fingerprint(text)


def test_close_pairs_skip_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 700, dtype=np.uint64)
    y = np.concatenate((x[:200] ^ np.uint64(0b1011), x[200:260] ^ np.uint64(0b11111), rng.integers(0, 2**63, 100, dtype=np.uint64)))
    found = {(int(i), int(j)) for p, q in close_pairs(x, y, 4, block=32) for i, j in zip(p, q)}
    assert found == {(i, j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= 4}


@pytest.mark.parametrize("hot_share", [simhash_dedup.HOT_SHARE, 30, 1])
def test_components_match_brute_force(spark, monkeypatch, hot_share):
    """All fingerprints hot, only those of several rows, and none."""
    monkeypatch.setattr(simhash_dedup, "HOT_SHARE", hot_share)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + texts[:10] + ["", None, " ", "A b", "a B"]
    rows = [(k * 3 + 1, t, "en") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs, tile=16).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = plain_components(list(fps), list(fps.values()))
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(set(want.values()))


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.text for r in keep_one(docs).collect()) == ["a b c d e", "zz"]
    assert keep_one(docs.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert keep_one(only_null).count() == 1


def test_rows_are_judged_by_doc_id_and_text(spark):
    rows = [(3, "a b c d e", "x"), (5, "a b c d e", "y"), (5, "quite another text than that one", "z"), (7, None, "n"), (8, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == [rows[0], rows[2], rows[3]]
