"""Packing and token ids against the tokenizer library and round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from factloom.llm import tokens
from factloom.llm.packing import pack_bins, pack_documents, packed_sequences

TEXTS = [None, "", " ", "a", "One two three.", " lead  double\n\nlines \t end ", "é ñ x　中文。 emoji 😀 <|endoftext|>", "w" * 5000, "the cat " * 3000, "x\x1c y\x85 z", "it's we've 12,345.67 *** ###"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, spark):
    encoder = tokens.load(tokens.default_path())
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts + texts[::-1]:
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_bins_respect_every_capacity(by):
    rng = np.random.default_rng(3)
    lengths = np.concatenate((rng.integers(1, 2049, 600), rng.integers(1, 40, 900)))
    bins, offsets = pack_bins(lengths, max_docs=7, max_cost=2_500_000 + 2048**2 // 2, by=by)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert len(own) <= 7 and (lengths[own] ** 2).sum() <= 2_500_000 + 2048**2 // 2
        assert offsets[own].tolist() == np.concatenate(([0], np.cumsum(lengths[own])[:-1])).tolist()
        assert lengths[own].sum() <= 2048
    assert set(bins) == set(range(bins.max() + 1))


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_bins_equal_a_naive_best_fit(by):
    """Every piece against every open bin, in floating point as written in the docstring."""
    rng = np.random.default_rng(8)
    lengths, length, max_docs, max_cost, w = rng.integers(1, 65, 300), 64, 5, 64 * 64 * 3 // 4 + 64 * 16, (1.0, 0.3, 0.4)
    lengths = lengths[lengths**2 <= max_cost]
    wt, wd, wc = w[0] / length**2, w[1] / max_docs**2, w[2] / max_cost**2
    free, want = [], np.zeros(len(lengths), int)
    for k in np.argsort(-lengths, kind="stable"):
        n, scores = int(lengths[k]), []
        for b, (r, d, c) in enumerate(free):
            if r >= n and d >= 1 and c >= n * n:
                scores.append((wt * (r - n) ** 2 + wd * (d - 1) ** 2 + wc * (c - n * n) ** 2 if by == "norm" else -(wt * r * n + wd * d + wc * c * n * n), b))
        if scores:
            b = min(scores)[1]
        else:
            b = len(free)
            free.append((length, max_docs, max_cost))
        r, d, c = free[b]
        free[b], want[k] = (r - n, d - 1, c - n * n), b
    bins, _ = pack_bins(lengths, length, max_docs, max_cost, w, by)
    # Bins of equal residuals are interchangeable, so what every bin holds is compared, not its number.
    held = lambda of: sorted(sorted(lengths[of == b].tolist()) for b in np.unique(of))
    assert held(bins) == held(want)


def test_tiny_documents_fill_a_sequence():
    bins, _ = pack_bins(np.ones(5000, np.int64))
    assert bins.max() + 1 == 3


def test_tight_packing():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1200, 4000)
    bins, _ = pack_bins(lengths)
    assert bins.max() + 1 <= np.ceil(lengths.sum() / 2048) * 1.005 + 1


def test_round_trip(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, " ", "again"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = pack_documents(docs, group=8).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, t in [*enumerate(TEXTS), (None, "null id")]:
        ids, own = np.array([*library(t), 0], "<u4"), sorted(by_doc[k], key=lambda r: (r.piece, r.sequence_id))
        if k == 2:
            assert [(r.piece, r.start, r.length) for r in own] == [(0, 0, len(ids))] * 2
            continue
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and (len(own) > 1) == (len(ids) > 2048)
        assert [r.start for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist()
        assert sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist()
        assert sum(r.length for r in own) <= 2048
    assert pack_documents(docs.limit(0)).count() == 0
    whole = packed_sequences(docs, group=8).collect()
    assert sum(r.n_docs for r in whole) == len(got) and all(len(r.ids) == 4 * r.n_tokens and len(r.doc_ids) == r.n_docs for r in whole)
