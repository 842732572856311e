"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np

from factloom.llm import collocations as C


def plain(rows, threshold=10, top=2000, held=50, max_words=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    most = Counter()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                most[lang, w[i : i + size]] = max(most[lang, w[i : i + size]], a)
    out = []
    for (lang, w), a in cand.items():
        if most[lang, w] and 100 * most[lang, w] >= held * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    got, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return got


def corpus(seed=0, docs=300):
    rng = random.Random(seed)
    vocab = [chr(97 + i % 26) * (1 + i // 26) for i in range(60)] + ["É", "é", "ÖL", "Zz", "日本"]
    rows = []
    for _ in range(docs):
        words = [rng.choice(vocab[: rng.choice((5, 20, 65))]) for _ in range(rng.randrange(80))]
        for _ in range(3):
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["New", "York", "City"][: rng.randrange(1, 4)]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " . "), ("fr", "..."), ("en", "x" * 100_000), rows[0], rows[0]]


def of(df):
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_matches_plain_counting(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, rank int").repartition(5)
    want = plain(rows)
    assert of(C.collocations(docs)) == want and len(want) > 50
    # Small buckets and flushes, another threshold, longer phrases, few ranks.
    assert of(C.collocations(docs, threshold=4, max_words=4, top=7, bucket_mass=50, flush=40)) == plain(rows, 4, 7, max_words=4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert of(C.collocations(docs)) == []
    assert of(C.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string"))) == []


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(1)
    for threshold in (3, 10, 40):
        keys = (rng.zipf(1.3, 20_000) % 3000).astype(np.uint64)
        true = Counter(keys.tolist())
        s = C.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            s.add(*np.unique(part, return_counts=True))
            s.settle()
        got = set(s.reaching(threshold).tolist())
        assert s.taken < threshold and len(s.keys) <= s.capacity
        assert {k for k, n in true.items() if n >= threshold} <= got
        assert all(c <= true[k] <= c + s.taken for k, c in zip(s.keys.tolist(), s.counts.tolist()))


def test_summaries_merge():
    rng = np.random.default_rng(2)
    keys = (rng.zipf(1.2, 30_000) % 5000).astype(np.uint64)
    parts = [C.Summary(3001) for _ in range(4)]
    for s, own in zip(parts, np.array_split(keys, 4)):
        s.add(*np.unique(own, return_counts=True))
        s.settle()
    whole = C.Summary(3001)
    for s in parts:
        whole.add(s.keys, s.counts)
        whole.taken += s.taken
    assert {k for k, n in Counter(keys.tolist()).items() if n >= 10} <= set(whole.reaching(10).tolist())


def test_long_stretches_are_counted_once(monkeypatch):
    """Stretches overlap by the words that a phrase may reach over."""
    import pyarrow as pa

    words, piece = C.words_of(pa.array(["a b c d. a b " * 50]))
    got = Counter()
    for distinct, found in C.ngrams(words, piece, 15):  # stretches of 16 words
        names = distinct.to_pylist()
        for places, counts in found[:3]:
            for k, n in enumerate(counts):
                got[tuple(names[p[k]] for p in places)] += int(n)
    want = Counter()
    for part in re.split("[.]", "a b c d. a b " * 50):
        w = [x.encode() for x in part.split()]
        for n in (1, 2, 3):
            want.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    assert got == want


def test_scores_are_exact_past_64_bits(spark):
    big = 3_000_000_019
    rows = [("en", 0, "", 10**13), ("en", 1, "a", 10**12 + 7), ("en", 1, "b", 4 * big + 1), ("en", 2, "a b", big)]
    got = C.scored_phrases(spark.createDataFrame(rows, "lang string, n_words int, phrase string, f long")).first()
    assert got.score == 1_000_000 * big * big // ((10**12 + 7) * (4 * big + 1))


def test_equal_scores_and_hot_language(spark):
    rows = [("en", " ".join(f"w{k} v{k}." for k in range(40)))] * 12 + [("de", "a b c. " * 30)] * 400
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert of(C.collocations(docs, top=25)) == plain(rows, top=25)
