"""Sentence-span deduplication against a plain version, and its edge cases."""

import random
import re
import sys

import xxhash

from factloom.llm.sentence_dedup import AMONG, LONG, MIN_WORDS, RUN, _pieces, _runs, remove_repeats, repeated_passages, sentences


def passage(rng, n):
    return " ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(n))


def plain(rows):
    """Kept text by (doc_id, text), judging every run of every document one by one."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for i, t in order:
        spans, hit = sentences(t), set()
        said = [" ".join(t[a:b].lower().split()) for a, b in spans]
        for k in range(len(spans)):
            for n in range(1, RUN + 1):
                run = tuple(said[k : k + n])
                enough = len(" ".join(run).split()) >= MIN_WORDS
                if len(run) == n and (n == RUN or enough and len(" ".join(run[:-1]).split()) < MIN_WORDS or k == 0 and n == len(spans)):
                    if seen.setdefault(run, (i, k)) != (i, k):
                        hit |= set(range(k, k + n))
        text, at, k = "", 0, 0
        while k < len(spans):
            e = k
            while k in hit and e + 1 in hit:
                e += 1
            if k in hit:
                text += t[at : spans[k][0]]
                at = spans[e + 1][0] if e + 1 < len(spans) else len(t)
            k = e + 1
        out[i, t] = text + t[at:] if t is not None else None
    return out


def test_sentences_keep_their_offsets():
    text = "One two. Three, four!\n\n  five Six  seven A eight 9.5 x?! y"
    assert [text[a:b] for a, b in sentences(text)] == ["One two.", "Three, four!", "five Six  seven A eight 9.5 x?!", "y"]
    assert sentences(None) == sentences("") == sentences(" \n ") == []


def test_matches_plain_version(spark):
    rng = random.Random(7)
    shared = [passage(rng, 6) for _ in range(4)]
    rows = [(k, " ".join([passage(rng, rng.randint(0, 5)), rng.choice(shared), passage(rng, 2)] if k % 3 else [passage(rng, 3)])) for k in range(40)]
    rows += [(50, rows[1][1]), (51, shared[0] + " " + shared[0]), (52, None), (53, ""), (54, "No. No. No. No. No."), (55, "a b. c. d e. f g!"), (56, "A  b. C. D e. F g! H"), (None, shared[1])]
    docs = spark.createDataFrame([(*r, "k") for r in rows] + [(*rows[1], "again")], "doc_id long, text string, key string").repartition(3)
    want = plain(rows)
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows) + 1 and docs.columns == ["doc_id", "text", "key"]
    texts = dict(rows)
    assert all(r.text == want[r.doc_id, texts[r.doc_id]] for r in got)
    changed = repeated_passages(docs).collect()
    assert {(r.doc_id, r.text) for r in changed} == {(i, w) for (i, t), w in want.items() if w != t}
    for r in changed:
        t = texts[r.doc_id]
        assert len(r.text) == len(t) - sum(s.end - s.start for s in r.removed) and r.first_doc_ids and r.n_sentences >= 1
    assert repeated_passages(docs.limit(0)).count() == remove_repeats(docs.limit(0)).count() == 0
    assert want[56, "A  b. C. D e. F g! H"] == "H"


def test_very_long_text_and_repeated_doc_ids(spark):
    rng = random.Random(9)
    long, other = passage(rng, 4000), passage(rng, 5)
    rows = [(1, long), (1, other), (2, long[: len(long) // 2]), (3, other), (4, passage(rng, 9))]
    left = sorted((r.doc_id, r.text) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = plain(rows)
    assert left == sorted((i, want[i, t]) for i, t in rows) and want[3, other] == "" and len(want[2, rows[2][1]]) < 100


def test_long_sentences_and_cjk_repeat_too(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    one, edge = [" ".join(word() for _ in range(60)) for _ in range(2)]
    han = "。".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(9)) for _ in range(6)) + "。"
    # A copy of a sentence without marks; 51 words between other words, never a whole sentence; Chinese without spaces.
    rows = [(1, one), (2, one), (3, "x " + edge + " y"), (4, " ".join([word() for _ in range(20)] + edge.split()[4:55] + [word() for _ in range(20)])), (5, han), (6, han + "新的句子。"), (7, "short copy"), (8, "short  Copy"), (9, "Not so. A short copy"), (10, "One. Two. Three."), (11, "One. Two. Three."), (12, "Zero. One. Two. Three.")]
    left = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == one and left[2] == "" and left[3] == rows[2][1] and left[5] == han and left[6] == "新的句子。"
    assert len(left[4].split()) <= 91 - MIN_WORDS and (left[7], left[8], left[9]) == ("short copy", "", "Not so. A short copy") and (left[10], left[11], left[12]) == ("One. Two. Three.", "", "Zero. One. Two. Three.")


def one_by_one(text):
    """The pieces of a text by regular expressions, and each long sentence word by word."""
    out, at = [], 0
    for start, end in [*(m.span() for m in re.finditer(r"(?<=[.!?…。！？])\s+|(?<=[。！？])(?=[^\s。！？])|\n\s*", text)), (len(text), len(text))]:
        if text[at:start].strip():
            places = [(at + a, at + b) for a, b in (m.span() for m in re.finditer(r"[一-鿿\U00020000-\U0003ffff]|[^\s一-鿿\U00020000-\U0003ffff]+", text[at:start]))]
            hashes, least, cuts = [xxhash.xxh64_intdigest(text[a:b].lower()) for a, b in places], -1, []
            for k in range(len(hashes) - AMONG + 1 if len(hashes) > LONG else 0):
                near = range(k, k + AMONG)
                low = min(hashes[j] for j in near)
                if least < k or hashes[least] > low:
                    least = max(j for j in near if hashes[j] == low)
                    cuts += [least] if least else []
            edges = [at, *(places[k][0] for k in cuts)], [*(places[k - 1][1] for k in cuts), start]
            out += zip(*edges)
        at = end
    return out


def test_texts_parted_together_part_as_alone():
    rng = random.Random(11)
    words = ["a", "B", "no", "no", "d.", "e!", "g…", "新", "日本", "。", "！", "x。y", ".", "İ", "ΑΣ", "　", "\x1c", " ", "\n", "\r\n", "\t", "𠮷", "é"]
    texts = [rng.choice(["", " "]).join(rng.choices(rng.sample(words, 9), k=rng.choice([0, 3, 20, 200]))) for _ in range(400)] + [passage(rng, 3).replace(".", "") for _ in range(50)]
    got = _pieces(texts, say=True)
    assert list(zip(got.of.tolist(), got.start.tolist(), got.end.tolist())) == [(k, *x) for k, t in enumerate(texts) for x in one_by_one(t)]
    assert got.said == [" ".join(texts[k][a:b].lower().split()) for k, a, b in zip(got.of, got.start, got.end)]
    alone = [(k, *r) for k, t in enumerate(texts) for r in zip(*(x.tolist() for x in _runs([t], RUN)[1:]))]
    assert sorted(zip(*(x.tolist() for x in _runs(texts, RUN)))) == sorted(alone)


def test_runs_take_few_calls_a_word():
    rng = random.Random(12)
    texts, calls = [passage(rng, 60) + " " + passage(rng, 20).replace(".", "") for _ in range(60)], [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        _runs(texts, RUN)
        _pieces(texts)
    finally:
        sys.setprofile(None)
    assert calls[0] < 0.5 * sum(len(t.split()) for t in texts)


def test_runs_said_once_are_not_shuffled_whole(spark):
    rng = random.Random(13)
    shared = passage(rng, 6)
    rows = [(k, passage(rng, 40) + (" " + shared if k % 50 == 0 else "")) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    assert docs.count() == 1500
    before = shuffled(spark)
    assert sorted(r.doc_id for r in repeated_passages(docs).collect()) == [k for k in range(1500) if k and k % 50 == 0]
    assert 0 < shuffled(spark) - before < 20 * sum(len(_runs([t], RUN)[0]) for _, t in rows)
    docs.unpersist()


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_tables_for_ranges_of_tags(spark, monkeypatch):
    rng = random.Random(14)
    shared = [passage(rng, 6) for _ in range(20)]
    rows = [(k, " ".join([passage(rng, 3), rng.choice(shared), passage(rng, 2)])) for k in range(60)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), plain(rows)
    # Tables for a quarter of the tags each, then tags of so few bits that different runs share them.
    for name, value in (("MOST_BITS", 1 << 14), ("TAG", 8)):
        monkeypatch.setattr(f"factloom.llm.sentence_dedup.{name}", value)
        assert {r.doc_id: r.text for r in repeated_passages(docs).collect()} == {i: w for (i, t), w in want.items() if w != t}
        assert {r.doc_id: r.text for r in remove_repeats(docs).collect()} == {i: w for (i, t), w in want.items()}
