"""Document quality by random Fourier features, ridge scores and isotonic calibration (operator 5).

Statistics of the whole text (never labels, language, source or id) are standardised and
mapped to random Fourier features of a Gaussian kernel; partitions sum the normal
equations, the driver solves one small system, and isotonic regression on labelled rows
kept out of the fit turns ridge scores into probabilities.

The fit sees at most ``MAX_ROWS`` labelled rows (a documented bound; the sample is by a
hash of doc_id). Their ids are therefore few enough to broadcast, so texts are never
shuffled: one pass over the labelled documents, then one narrow pass that scores all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, read_table

#: Labelled rows that a fit sees at most.
MAX_ROWS = 200_000
#: Random Fourier features, ridge penalty for each row, partitions of the training table at most.
N_FEATURES, PENALTY, FIT_PARTS = 256, 1e-4, 32
#: Bins of ridge scores in which calibration counts labels.
BINS = 2000

_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000 (others count as letters): 0 letter, 1 capital, 2 digit, 3 space, 4 line break, 5 sentence mark, 6 other."""
    if not _CLASS:
        chars = [chr(c) for c in range(0x3000)]
        _CLASS.append(np.array([4 if c == "\n" else 3 if c.isspace() else 1 if c.isupper() else 2 if c.isdigit() else 0 if c.isalnum() else 5 if c in ".,;:?'\"-" else 6 for c in chars] + [0], np.uint8))
    return _CLASS[0]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; all zero for null or blank texts."""
    words = (text or "").split()
    if not words:
        return np.zeros(18)
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x3000)
    kinds = np.bincount(_classes()[points], minlength=7)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    chars = n_chars = kinds.sum() - kinds[3] - kinds[4]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = kinds[0] + kinds[1]
    # Repetition in the neighbourhood doesn't depend on the length of the text, as the share of distinct words does.
    again = sum(map(str.__eq__, words, words[1:])) / n
    back = sum(w in seen for w, seen in zip(words[8:], zip(*(words[k:] for k in range(8))))) / n
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n
    marks = sum(w[-1] in ".?" for w in words)
    return np.array([
        np.log1p(n), np.log1p(chars), lengths.mean(), lengths.std(), kinds[1] / max(1, letters), kinds[2] / n_chars, kinds[5] / n_chars, kinds[6] / n_chars,
        len(counts) / n, np.log(len(counts)) / np.log(n + 1), counts.most_common(1)[0][1] / n, again, back, ends,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (marks + 1)), letters / n_chars,
    ])


def _stacked(texts: Iterator) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows) if rows else np.zeros((0, 18))


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: non-decreasing (centre, mean) of blocks of sorted x with ``ones`` of ``total`` labels."""
    blocks: list[list[float]] = []
    for c, t, o in zip(x, total, ones):
        blocks.append([c * t, t, o])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # One label is added to each block's halves: no score is exactly 0 or 1.
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


@dataclass
class QualityModel:
    """A fitted classifier; small enough to travel in a task."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    means: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant, one row a text."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases), np.ones((len(x), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; between blocks' centres in a straight line."""
        if not len(self.centres):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.ridge(stats), self.centres, np.maximum.accumulate(self.means)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels a fit never sees: CRC-32 of doc_id as text leaves 1 modulo 3 (null doc_id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, n_features: int = N_FEATURES, penalty: float = PENALTY, seed: int = 7) -> QualityModel:
    """Fit on the labelled documents that aren't held out.

    Several labels of one doc_id are averaged; null labels and ids are left out. Without
    any labelled document every score is 0.5; with one kind only it is near that kind's.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(label).alias("y")).withColumn("deal", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)))
    n = known.count()
    if n > max_rows:
        known = known.where(F.col("deal") < int(950_000 * max_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = _stacked(t.as_py() for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("deal"), pa.array(list(stats), pa.list_(pa.float64()))], names=["y", "deal", "stats"])

    rows = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", "deal").mapInArrow(run, "y double, deal long, stats array<double>"))
    # A fifth is kept for calibration.
    train, rest = rows.where("deal % 5 != 0").coalesce(FIT_PARTS), rows.where("deal % 5 = 0")
    d, rng = 18, np.random.default_rng(seed)
    moments = train.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(d), np.ones(d)
    for r in moments:
        mean[r.k], scale[r.k] = r.m, max(r.s or 0.0, 1e-6)
    model = QualityModel(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(0), np.zeros(0))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_features + 1, n_features + 2))
        count = 0
        for b in batches:
            z = model.features(np.stack(b["stats"].to_list()))
            total += z.T @ np.hstack([z, b["y"].to_numpy()[:, None]])
            count += len(b)
        if count:
            yield pd.DataFrame({"k": np.arange(n_features + 1), "part": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "part": [np.sum(pdf["part"].to_list(), axis=0)]})

    schema = "k int, part array<double>"
    equations = train.select("y", "stats").mapInPandas(sums, schema).groupBy("k").applyInPandas(add, schema).collect()
    if not equations:
        return model
    system = np.zeros((n_features + 1, n_features + 2))
    for r in equations:
        system[r.k] = r.part
    a, c = system[:, :-1], system[:, -1]
    model.weights = np.linalg.solve(a + penalty * max(1.0, a[-1, -1]) * np.eye(len(a)), c)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bin": np.floor(np.clip(model.ridge(np.stack(b["stats"].to_list())), -1, 2) * BINS / 3).astype(np.int64), "y": b["y"]})

    table = rest.select("y", "stats").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    if table:
        model.centres, model.means = isotonic(np.array([(r.bin + 0.5) * 3 / BINS for r in table]), np.array([float(r.n) for r in table]), np.array([r.ones for r in table]))
    return model


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, null and empty texts too; repeated rows stay, an empty table gives none."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.scores(_stacked(t.as_py() for t in b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are; one narrow pass. Null texts are judged as empty ones; an empty table stays empty."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_stacked(text)) >= threshold)

    return docs.where(good("text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
