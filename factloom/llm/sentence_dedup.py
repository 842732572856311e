"""Substring deduplication by sliding sentence spans (operator 9).

Every run of ``run`` consecutive sentences is hashed, and every shorter one that reaches
``min_words`` words; a text of fewer sentences is a run, too, however few words it has. Runs join globally by hash, and every sentence covered by a run that
is not the first of its kind goes, however few words it has. Sentences of over ``LONG``
words are parted where their own words say so, so 51 shared words hold ``MIN_WORDS``
words of whole pieces wherever they start. First only the runs' tags are shuffled, the
first ``TAG`` bits of a hash, to be counted. The tags that come twice become bit tables of
at most ``MOST_BITS`` bits, one for each range of tags that fills one, and keep most runs
that are said once out of all that follows; those they let in by chance are told apart by
their whole hashes. Only 12-byte hashes of the rest with their document's key
and the sentence's number are shuffled. The first of each repeated run comes from a
pre-aggregated minimum; the way back to a run's occurrences is an equi-join whose large
side adaptive execution can split, so a passage that a third of all documents share is
no single task's work. A last bit table keeps most texts that lose nothing where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, free_name, read_table, settled

#: Consecutive sentences to a span.
RUN = 4
#: Words from which on fewer sentences are a span too.
MIN_WORDS = 25
#: Words of a piece at most; the words among which the one with the least hash starts a new piece.
LONG, AMONG = 13, 12

#: Characters of texts that are parted together; a longer text is parted alone.
CHUNK = 1 << 18

#: First bits of a run's hash that are counted; equal ones of different runs only let these through.
TAG = 40
#: Bits of a broadcast table at most, 16 MB; 8 to 16 a tag or document.
MOST_BITS = 1 << 27

# A sentence is the stretch up to a mark (. ! ? …) and white space, a CJK full stop or the like, or a line break.
# Of scripts without spaces each character counts as a word.
_SPACE, _MARK, _WIDE, _CJK = 1, 2, 4, 8
_KIND = np.zeros(0x110000, np.uint8)
_KIND[[c for c in range(0x3001) if chr(c).isspace()]] = _SPACE
_KIND[[ord(c) for c in ".!?…"]] = _MARK
_KIND[[ord(c) for c in "。！？"]] = _WIDE
for _a, _b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
    _KIND[_a : _b + 1] = _CJK


def _slid(op: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """The least or largest of each ``size`` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x


def _least(hashes: list[int]) -> list[int]:
    """The place of the least of each ``AMONG`` neighbours; among equals one stays while it can, then the last comes."""
    least, picked = -1, []
    for k in range(len(hashes) - AMONG + 1):
        end = k + AMONG - 1
        if least >= k:
            if hashes[least] <= hashes[end]:
                continue
            least = end
        else:
            near = hashes[k : end + 1]
            least = end - near[::-1].index(min(near))
        picked.append(least)
    return picked


def _parting(words: list[str], opens: np.ndarray) -> np.ndarray:
    """Which words start a part of a sentence of over ``LONG`` words: those with the least hash of ``AMONG`` neighbours, so the same words part alike in any surroundings."""
    begin = np.flatnonzero(opens)
    sizes = np.diff(np.append(begin, len(opens)))
    if not (sizes > LONG).any():
        return np.zeros(len(opens), bool)
    of, long = np.repeat(np.arange(len(begin)), sizes), np.repeat(sizes > LONG, sizes)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    low = _slid(np.minimum, hashes, AMONG)
    low[(of[: len(low)] != of[AMONG - 1 :]) | ~long[: len(low)]] = 0
    # A word is picked if one of the windows that hold it has no smaller one.
    picked = long & (hashes == _slid(np.maximum, np.pad(low, AMONG - 1), AMONG))
    at = np.flatnonzero(picked)
    # Equal words that are least in the same window are chosen from in order.
    tied = (hashes[at[1:]] == hashes[at[:-1]]) & (of[at[1:]] == of[at[:-1]]) & (np.diff(at) < AMONG)
    for k in np.unique(of[at[1:][tied]]).tolist():
        a, b = begin[k], begin[k] + sizes[k]
        picked[a:b] = False
        picked[a + np.array(_least(hashes[a:b].tolist()))] = True
    return picked & ~opens


class _Pieces(NamedTuple):
    """Sentences, or parts of long ones, of several texts: the text's number, start and end in code points, words, and on demand what is said."""

    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    said: list[str] | None


def _places(joined: str) -> tuple[np.ndarray, ...]:
    """Start and end of each word, the kind of its last character, and where lines end; ``joined`` ends with a line break."""
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind, lines = _KIND[chars], np.flatnonzero(chars == 10)
    before = np.append(np.uint8(_SPACE), kind[:-1])
    blank = (kind & _SPACE) != 0
    new = ~blank & (((before & (_SPACE | _CJK)) | (kind & _CJK)) != 0)
    new |= ((before & _WIDE) != 0) & ((kind & (_SPACE | _WIDE)) == 0)
    first, ends = np.flatnonzero(new), np.flatnonzero(((before & _SPACE) == 0) & (blank | new))
    return first, ends, kind[ends - 1], lines


def _pieces(texts: list[str], say: bool = False) -> _Pieces:
    """The pieces of all texts, in order; blank ones are left out. said: without case and spacing."""
    joined = "\n".join([*texts, ""])
    first, ends, last, lines = _places(joined)
    if not len(first):
        none = np.zeros(0, np.int64)
        return _Pieces(none, none, none, none, [] if say else None)
    base = np.append(0, np.cumsum([len(t) + 1 for t in texts]))[:-1]
    of = np.searchsorted(base, first, "right") - 1
    line = lines[np.searchsorted(lines, ends)]  # where the line of a word ends
    glued = ends[:-1] == first[1:]
    opens = np.ones(len(first), bool)
    opens[1:] = ((last[:-1] & _WIDE) != 0) | ((last[:-1] & _MARK) != 0) & ~glued | (line[:-1] < first[1:])
    # Words are what white space parts, but in texts where some touch.
    touching = np.zeros(len(texts), bool)
    touching[of[1:][glued]] = True
    if touching.any():
        words, at = [], np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        for k, text in enumerate(texts):
            a, b = at[k], at[k + 1]
            words += [joined[x:y].lower() for x, y in zip(first[a:b].tolist(), ends[a:b].tolist())] if touching[k] else text.lower().split()
    else:
        words = joined.lower().split()
    parting = _parting(words, opens)
    begin = np.flatnonzero(opens | parting)
    stop = np.append(begin[1:], len(first))
    parted = np.append(parting[begin[1:]], False)
    start, of = first[begin], of[begin]
    end = np.where(parted | ((last[stop - 1] & (_MARK | _WIDE)) != 0), ends[stop - 1], line[stop - 1])
    # A text's first sentence starts with the text, but for blank lines.
    fresh = np.append(True, of[1:] != of[:-1])
    start = np.where(fresh & (lines[np.searchsorted(lines, base[of])] > start), base[of], start)
    said = None
    if say and touching.any():
        said = [" ".join(joined[x:y].lower().split() if t else words[a:b]) for a, b, x, y, t in zip(begin.tolist(), stop.tolist(), start.tolist(), end.tolist(), touching[of].tolist())]
    elif say:
        said = [" ".join(words[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
    return _Pieces(of, start - base[of], end - base[of], stop - begin, said)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence or part of a long one, in code points; blank ones are left out."""
    p = _pieces([text or ""])
    return list(zip(p.start.tolist(), p.end.tolist()))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of texts of about ``CHUNK`` characters together."""
    a = size = 0
    for k, text in enumerate(texts):
        if k > a and size + len(text) > CHUNK:
            yield a, k
            a, size = k, 0
        size += len(text)
    if texts:
        yield a, len(texts)


def _runs(texts: list[str], run: int, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Arrays by run: the text's number, first sentence, sentences, signed 64-bit hash, signed 32-bit hash; compared without case and spacing.

    Runs of ``run`` sentences, from each sentence the run up to ``min_words`` words if that is shorter, and all of a text of fewer sentences.
    """
    p = _pieces(texts, say=True)
    one = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, p.said)), np.uint64).reshape(-1, 2)
    # A polynomial over the sentences' two hashes, modulo 2^64 each.
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    sizes = np.bincount(p.of, minlength=len(texts))[p.of]
    number = np.arange(len(one)) - np.searchsorted(p.of, p.of)
    words, hashes, open_ = np.zeros(len(one), np.int64), np.zeros((len(one), 2), np.uint64), np.ones(len(one), bool)
    out = []
    for n in range(1, min(run, len(one)) + 1):
        last = len(one) - n + 1
        words[:last] += p.words[n - 1 :]
        hashes[:last] = hashes[:last] * mix + one[n - 1 :]
        full = number + n <= sizes
        if n < run:
            full &= open_ & (words >= min_words)
            open_ &= ~full
            full |= (number == 0) & (sizes == n)  # all of a text of few sentences
        at = np.flatnonzero(full)
        own = hashes[at] ^ (hashes[at] >> np.uint64(31))
        out.append((p.of[at], number[at], np.full(len(at), n), own[:, 0].view(np.int64), (own[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32))


def _key(docs: DataFrame):
    """Rows are one document if doc_id and this are equal."""
    return F.xxhash64("doc_id", "text")


def _bits(n: int) -> int:
    """Two to this many bits are 8 to 16 for each of ``n`` hashes."""
    return max(16, (8 * n - 1).bit_length())


def _bit_table(at: DataFrame, bits: int) -> np.ndarray:
    """64-bit words of a table of two to the ``bits`` bits that has the bits ``at``; built in Spark."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = at.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << max(bits - 6, 0), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def _met(df: DataFrame, at: Column, known: DataFrame, bits: int) -> tuple[DataFrame, Broadcast]:
    """The rows of ``df`` whose ``at`` is one of ``known``, of ``bits`` bits, and the broadcast table that says so."""
    sent = df.sparkSession.sparkContext.broadcast(_bit_table(known, bits))

    @F.pandas_udf("boolean")
    def is_set(at: pd.Series) -> pd.Series:
        place = at.to_numpy().astype(np.uint64)
        return pd.Series((sent.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool))

    return df.where(is_set(at)), sent


def _seen_again(runs: DataFrame) -> DataFrame:
    """A written table of all runs whose hash comes twice, and of some others; ``runs`` is deleted.

    A table's bits are for one range of tags, so however many repeat, no table fills up; each range takes a pass over ``runs``.
    """
    tags = cut(runs.groupBy(F.shiftrightunsigned("run", 64 - TAG).alias("tag")).agg(F.count("*").alias("times")).where("times > 1").select("tag"))
    bits = min(_bits(tags.count()), TAG)
    held = min(bits, MOST_BITS.bit_length() - 1)
    # The hash's first bits are the number of the table and the place inside it.
    of_tag, of_run = F.shiftrightunsigned("tag", TAG - bits), F.shiftrightunsigned("run", 64 - bits)
    inside, out = F.lit((1 << held) - 1), []
    for k in range(1 << (bits - held)):
        kept, sent = _met(runs.where(F.shiftright(of_run, held) == k), of_run.bitwiseAND(inside), tags.where(F.shiftright(of_tag, held) == k).select(of_tag.bitwiseAND(inside).alias("at")), held)
        out.append(cut(kept))
        sent.destroy()
    drop_cut(tags)
    drop_cut(runs)
    return reduce(DataFrame.unionByName, out)


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, doc_id, first_doc_id, sentence, n): the runs, by their first sentence's number and how many they are, that are not the first of their kind.

    First: smallest doc_id (null last), then the smaller text hash, then the earlier place.
    Runs are told apart by 96 bits.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text or "" for text in b.column("text").to_pylist()]
            for x, y in _chunks(texts):
                of, place, size, one, two = _runs(texts[x:y], run, min_words)
                at = pa.array(of + x, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("doc_id").take(at), pa.array(one), pa.array(two), pa.array(place, pa.int32()), pa.array(size, pa.int32())], names=["key", "doc_id", "run", "run2", "sentence", "n"])

    runs = cut(docs.select(_key(docs).alias("key"), "doc_id", "text").mapInArrow(hashes, f"key long, doc_id {kind}, run long, run2 int, sentence int, n int"))
    runs = _seen_again(runs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "sentence")
    # Written before the join, so that both its sides are plain shuffles and a run that very many documents share can be split.
    firsts = cut(runs.groupBy("run", "run2").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").select("run", "run2", "first"))
    return runs.join(firsts, ["run", "run2"]).where(order != F.col("first")).select("key", "doc_id", F.col("first.doc_id").alias("first_doc_id"), "sentence", "n")


def _drop(text: str, starts: list[int], first: list[int], sizes: list[int]) -> tuple[str, list[list[int]], int]:
    """The text without the sentences of those runs (first sentence, sentences), what went as [start, end], and how many sentences."""
    hit = sorted({k for s, n in zip(first, sizes) for k in range(s, s + n)})
    gone, out, at = [], [], 0
    for k in hit:
        # Up to the next sentence, so that no doubled gap is left.
        end = starts[k + 1] if k + 1 < len(starts) else len(text)
        if gone and gone[-1][1] == starts[k]:
            gone[-1][1] = end
        else:
            gone.append([starts[k], end])
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), gone, len(hit)


def _dropped(texts: list[str], first: list[list[int]], sizes: list[list[int]]) -> Iterator[tuple[str, list[list[int]], int]]:
    """``_drop`` of each text, parted together."""
    for x, y in _chunks(texts):
        p = _pieces(texts[x:y])
        at, starts = np.searchsorted(p.of, np.arange(y - x + 1)).tolist(), p.start.tolist()
        for k in range(x, y):
            yield _drop(texts[k], starts[at[k - x] : at[k - x + 1]], first[k], sizes[k])


def _hits(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """A written table (key, doc_id, runs, first_doc_ids) of the documents that hold repeated runs."""
    runs, firsts = F.array_sort(F.collect_set(F.struct("sentence", "n"))), F.array_sort(F.collect_set("first_doc_id"))
    return settled(docs.sparkSession, lambda: repeated_runs(docs, run, min_words).groupBy("key", "doc_id").agg(runs.alias("runs"), firsts.alias("first_doc_ids")))


def repeated_passages(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document that loses something: doc_id, first_doc_ids, n_sentences, removed, text.

    removed: array of (start, end) code points; first_doc_ids: documents that keep what
    goes here (its own doc_id if a passage repeats inside it); text: what is left.
    Rows equal in doc_id and text are one document, cleaned alike. Null and empty texts
    lose nothing; a copy of a text of fewer than ``run`` sentences loses all, and such a text inside a longer one counts where it has
    ``min_words`` words. Very long texts are cleaned like any. An empty table gives none.
    """
    hits = _hits(docs, run, min_words)
    bits = min(_bits(hits.count()), MOST_BITS.bit_length() - 1)
    place = F.shiftrightunsigned("key", 64 - bits)
    rows, _ = _met(docs.select(_key(docs).alias("key"), "doc_id", "text"), place, hits.select(place.alias("at")), bits)
    met = rows.alias("d").join(hits.alias("h"), (F.col("d.key") == F.col("h.key")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))).select("d.doc_id", "text", "runs", "first_doc_ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, gone, counts = [], [], [], []
            for k, (left, cut_out, n) in enumerate(_dropped(*(b.column(c).to_pylist() for c in ("text", "starts", "sizes")))):
                if cut_out:
                    rows.append(k)
                    texts.append(left)
                    gone.append([{"start": x, "end": y} for x, y in cut_out])
                    counts.append(n)
            at = pa.array(rows, pa.int32())
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("first_doc_ids").take(at), pa.array(counts, pa.int32()), pa.array(gone, spans), pa.array(texts, pa.string())], names=["doc_id", "first_doc_ids", "n_sentences", "removed", "text"])

    return met.select("doc_id", "text", F.col("runs.sentence").alias("starts"), F.col("runs.n").alias("sizes"), "first_doc_ids").mapInArrow(clean, f"doc_id {kind}, first_doc_ids array<{kind}>, n_sentences int, removed array<struct<start:bigint,end:bigint>>, text string")


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with repeated passages cut out of text. An empty table gives an empty one."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        out, hit = text.to_numpy(object, copy=True), [k for k, s in enumerate(starts) if s is not None]
        for k, got in zip(hit, _dropped(*([c.iat[k] for k in hit] for c in (text, starts, sizes)))):
            out[k] = got[0]
        return pd.Series(out, dtype=object)

    key = free_name(docs, "key")
    hits = _hits(docs, run, min_words).select(F.col("key").alias("hit_key"), F.col("doc_id").alias("hit_id"), F.col("runs.sentence").alias("starts"), F.col("runs.n").alias("sizes")).alias("h")
    met = docs.withColumn(key, _key(docs)).alias("d").join(hits, (F.col(f"d.{key}") == F.col("h.hit_key")) & F.col("d.doc_id").eqNullSafe(F.col("h.hit_id")), "left")
    return met.select(*(clean("d.text", "h.starts", "h.sizes").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that an earlier document (or place) holds, and their text without them."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
