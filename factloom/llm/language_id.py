"""Language of whole texts by averaged hashed subword embeddings and a linear softmax (operator 12).

A text becomes its letters in lower case, words set apart by single blanks. Every run of
two to four characters that has no blank inside (so it may start or end a word) is
a subword; its hash picks one of ``BUCKETS`` embeddings. The average of all embeddings of a
text goes through a linear softmax over the languages.

Embeddings and softmax are trained by stochastic gradient descent in numpy: in every epoch
each of ``FIT_PARTS`` partitions of the training rows starts from the common model, takes a
step for each few documents, and the partitions' models are averaged. Training sees at most
``MAX_ROWS`` labelled rows, dealt evenly to the languages (a documented bound; the sample is by a
hash of doc_id). A fifth of these is kept out to calibrate: isotonic regression
turns the softmax's largest share into the chance that the answer is right, and answers
below a wanted chance are marked rejected.

A fitted model is linear up to the softmax, so it is folded into one table of subword scores,
and scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, read_table
from .quality import isotonic

#: Labelled rows that a fit sees at most.
MAX_ROWS = 8_000
BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
EPOCHS, FIT_PARTS, RATE, GROUP = 6, 4, 4.0, 16
#: Documents that training looks at in all, at least: partitions of a small sample go over theirs several times in an epoch.
VISITS = 24_000
#: Answers that are less likely right than this are marked rejected.
REJECT = 0.5
#: Bins of the largest share in which calibration counts right answers.
BINS = 1000
#: Characters that are looked at together; a longer text is parted at blanks.
SLICE = 1 << 19
#: Code points from here on are no letters.
_END = 0x32400

_TABLE: list[np.ndarray] = []
_BLANK = re.compile(r"\s")


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower case or 32, whether a letter) of each code point; combining marks belong to words without being letters."""
    if not _TABLE:
        chars = [chr(c) for c in range(_END)]
        letter = np.array([c.isalpha() for c in chars] + [False])
        mark = np.array([unicodedata.category(c)[0] == "M" for c in chars] + [False])
        low = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars] + [32], np.uint32)
        _TABLE.extend((np.where(letter | mark, low, 32).astype(np.uint32), letter))
    return _TABLE[0], _TABLE[1]


def stretches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, texts or parts of them) of about ``SLICE`` characters together; no subword goes over a blank."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = len(text) if len(text) - at <= SLICE else next((m.start() for m in _BLANK.finditer(text, at + SLICE)), len(text))
            numbers.append(k)
            parts.append(text[at:end])
            size += end - at
            if size >= SLICE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if numbers:
        yield numbers, parts


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each with a blank before it and one at the very end; where each starts; which have a letter)."""
    low, letter = _letters()
    raw = ["" if t is None else t for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    points = np.minimum(np.frombuffer(" ".join(["", *raw, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), _END)
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    own = letter[points]
    any_letter = np.diff(np.concatenate(([0], np.cumsum(own)))[at]) > 0
    chars = low[points]
    keep = chars != 32
    keep[1:] |= (chars[1:] == 32) & (chars[:-1] != 32)
    keep[at] = True
    # A blank before a text's first blank is there already.
    place = np.concatenate(([0], np.cumsum(keep)))
    return chars[keep], place[at], any_letter


def subwords(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the first character, bucket) of every subword, by stretches and sizes."""
    blank = chars == 32
    reach = max(SIZES)
    for lo in range(0, len(chars), SLICE):
        own, gap = chars[lo : lo + SLICE + reach - 1], blank[lo : lo + SLICE + reach - 1]
        h = own * np.uint32(0x9E3779B1)
        inside = np.ones(len(own), bool)
        for n in range(2, reach + 1):
            m = min(SLICE, len(own) - n + 1)
            if m <= 0:
                break
            h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + own[n - 1 : n - 1 + m]
            if n > 2:
                inside = inside[:m] & ~gap[n - 2 : n - 2 + m]
            if n in SIZES:
                ok = np.flatnonzero(inside[:m] & ~(gap[:m] & gap[n - 1 : n - 1 + m]) if n == 2 else inside[:m])
                mixed = (h[ok] ^ (h[ok] >> np.uint32(13))) * np.uint32(0xC2B2AE35)
                yield ok + lo, (mixed >> np.uint32(16)) % np.uint32(BUCKETS)


def sums(table: np.ndarray, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its subwords' rows of ``table``, and how many it has."""
    n = len(starts) - 1
    total, count = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for place, bucket in subwords(chars):
        edges = np.searchsorted(place, starts)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            total[some] += np.add.reduceat(table[bucket], edges[some], axis=0)
            count[some] += (edges[1:] - edges[:-1])[some]
    return total, count


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    out = [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * len(texts)
    open_, counts = None, np.zeros(BUCKETS, np.int64)

    def close() -> None:
        buckets = np.flatnonzero(counts)
        out[open_] = (buckets.astype(np.int32), (counts[buckets] / max(1, counts.sum())).astype(np.float32))

    for numbers, parts in stretches(texts):
        chars, starts, _ = characters(parts)
        found = list(subwords(chars))
        for number, a, e in zip(numbers, starts, starts[1:]):
            if number != open_:
                if open_ is not None:
                    close()
                open_, counts = number, np.zeros(BUCKETS, np.int64)
            for place, bucket in found:
                counts += np.bincount(bucket[np.searchsorted(place, a) : np.searchsorted(place, e)], minlength=BUCKETS)
    if open_ is not None:
        close()
    return out


@dataclass
class LanguageModel:
    """A fitted model; small enough to travel in a task."""

    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    centres: np.ndarray
    means: np.ndarray

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(softmax over the languages, one row a text; which texts have a letter)."""
        fold = len(self.langs) <= self.embeddings.shape[1]
        table = (self.embeddings @ self.weights if fold else self.embeddings).astype(np.float32)
        total, count, letters = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for numbers, parts in stretches(texts):
            chars, starts, any_letter = characters(parts)
            for whole, part in zip((total, count), sums(table, chars, starts)):
                np.add.at(whole, numbers, part)
            np.logical_or.at(letters, numbers, any_letter)
        total = total / np.maximum(1, count)[:, None]
        return _softmax((total if fold else total @ self.weights) + self.bias), letters

    def chance(self, share: np.ndarray) -> np.ndarray:
        """Calibrated chance that an answer with this largest share is right."""
        return np.clip(np.interp(share, self.centres, np.maximum.accumulate(self.means)) if len(self.centres) else share, 0, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, rate: float) -> None:
    """One step of gradient descent on some documents (language, buckets, shares), in place."""
    mean = np.stack([w @ embeddings[b] for _, b, w in rows])
    error = _softmax(mean @ weights + bias)
    error[np.arange(len(rows)), [y for y, _, _ in rows]] -= 1
    back = error @ weights.T
    weights -= rate / len(rows) * (mean.T @ error)
    bias -= 0.1 * rate / len(rows) * error.sum(0)
    # A subword's share is small; its embedding takes a step as if it were in a fortieth of the text.
    for (_, b, w), g in zip(rows, back):
        embeddings[b] -= (rate / len(rows) * 40) * w[:, None] * g


def held_out(doc_id: Column) -> Column:
    """Rows whose languages a fit never sees: CRC-32 of doc_id as text leaves 2 modulo 4 (null doc_id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, parts: int = FIT_PARTS, rate: float = RATE, group: int = GROUP, dim: int = DIM, seed: int = 3) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows that have a text and a language and aren't held out.

    Without such rows the model knows no language and answers ``und``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)).alias("deal"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}
    langs = list(counts)
    weights = np.zeros((dim, len(langs)))
    model = LanguageModel(langs, np.random.default_rng(seed).normal(0, 0.3, (BUCKETS, dim)), weights, np.zeros(len(langs)), np.zeros(0), np.zeros(0))
    if not langs:
        return model
    # An even part for each language; the hash is spread evenly, so a twentieth less stays under it.
    quota = max_rows / len(langs)
    share = {k: 1_000_000 if n <= quota else int(950_000 * quota / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = bags(b.column("text").to_pylist())
            own = pa.array([number[x] for x in b.column("lang").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([own, b.column("deal"), pa.array([x for x, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float32()))], names=["y", "deal", "buckets", "shares"])

    bagged = cut(known.where(F.col("deal") < limit[F.col("lang")]).mapInArrow(run, "y int, deal long, buckets array<int>, shares array<float>"))
    train, rest = bagged.where("deal % 5 != 0 and size(buckets) > 0"), bagged.where("deal % 5 = 0")
    dealt = cut(train.repartition(parts, "deal").sortWithinPartitions("deal", "y"))
    passes = max(1, -(-VISITS // (epochs * max(1, min(max_rows, sum(counts.values()))))))
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        sent = spark.sparkContext.broadcast((model.embeddings, model.weights, model.bias))

        def learn(batches: Iterator[pa.RecordBatch], now: float = now, sent=sent) -> Iterator[pa.RecordBatch]:
            e, w, c = (x.copy() for x in sent.value)
            seen = 0
            for b in list(batches) * passes if passes > 1 else batches:
                rows = list(zip(b.column("y").to_pylist(), map(lambda x: x.values.to_numpy(), b.column("buckets")), map(lambda x: x.values.to_numpy(), b.column("shares"))))
                for k in range(0, len(rows), group):
                    descend(rows[k : k + group], e, w, c, now)
                seen += len(rows)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (e, w, c))], names=["n", "e", "w", "c"])

        made = dealt.mapInArrow(learn, "n long, e binary, w binary, c binary").toArrow().to_pylist()
        sent.destroy()
        total = sum(r["n"] for r in made)
        for name, key in (("embeddings", "e"), ("weights", "w"), ("bias", "c")):
            like = getattr(model, name)
            if total:
                setattr(model, name, sum(np.frombuffer(r[key], np.float32).astype(float) * (r["n"] / total) for r in made).reshape(like.shape))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = np.array([s @ model.embeddings[k] if len(k) else np.zeros(dim) for k, s in zip(b["buckets"], b["shares"])]) @ model.weights + model.bias
            p = _softmax(z)
            yield pd.DataFrame({"bin": np.minimum(np.floor(p.max(1) * BINS), BINS - 1).astype(np.int64), "right": (p.argmax(1) == b["y"].to_numpy()).astype(np.int64)})

    table = rest.mapInPandas(judged, "bin long, right long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("right").alias("ones")).orderBy("bin").collect()
    if table:
        model.centres, model.means = isotonic(np.array([(r.bin + 0.5) / BINS for r in table]), np.array([float(r.n) for r in table]), np.array([float(r.ones) for r in table]))
    return model


def identify(docs: DataFrame, model: LanguageModel, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    Null texts, texts without a letter, and all texts of a model without languages are ``und`` with score 0
    and rejected. Otherwise ``lang_pred`` is the likeliest language and score its
    calibrated chance; below ``reject`` the answer is marked rejected. Repeated rows stay; other columns are
    ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.langs, "und"], object)
        for b in batches:
            if own.langs:
                p, letters = own.shares(b.column(2).to_pylist())
                best, score = np.where(letters, p.argmax(1), len(own.langs)), np.where(letters, own.chance(p.max(1)), 0.0)
            else:
                best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            und = names[best] == "und" if not own.langs else best == len(own.langs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(und | (score < reject))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
