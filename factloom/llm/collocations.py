"""Phrase collocations mined with mergeable Misra-Gries summaries (operator 11).

Texts are cut into pieces and words; every run of one to ``max_words`` words inside a
piece is an n-gram of its language. The first pass counts n-grams by hash inside each
task (exactly, so nothing is lost there) and sends (hash, count) to hash partitions, called
buckets here. A bucket first learns its mass m (the sum of all counts) and then keeps a
Misra-Gries summary of m // threshold + 1 counters: when more are needed, the largest
count that doesn't fit is taken from all. All that is ever taken is under the threshold
(each unit taken costs the summary one more unit of mass than it has counters), so
every n-gram that occurs ``threshold`` times has a counter at the end, and its count plus
what was taken reaches the threshold. Counters below that are dropped, too.

The survivors' hashes become a bit table of at most ``MOST_BITS`` bits, a constant. The
second pass counts, as text, what the table lets through; that count is exact, and
what the table lets through by chance falls to the threshold then. Scores use exact decimals.
Ranks come from one range sort and the counts of its partitions, so that no language has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, cut, drop_cut, free_name, read_table

THRESHOLD, MAX_WORDS, TOP = 10, 3, 2000
#: A candidate goes if a longer one that holds it has this many hundredths of its count.
HELD = 50
#: Bits of the survivors' table at most (16 MB), whatever the input.
MOST_BITS = 1 << 27
#: Mass that a bucket should have at most (a tenth of it is the summary's size), and n-grams that a task counts before it sends them.
BUCKET_MASS, FLUSH = 8_000_000, 2_000_000
#: Bits of a hash inside its bucket; equal ones are counted together, so counts are never too low.
_BITS = 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes: 0 word, 1 blank, 2 end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in order, as bytes, and the number of each word's piece (equal only inside one piece)."""
    texts = texts.drop_null().cast(pa.large_binary())
    if not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[at - at[0]] = True
    inside = np.concatenate(([False], kind == 0, [False]))
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    piece = np.cumsum((kind == 2) | first[:-1])[starts]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))]), piece


def ngrams(words: pa.Array, piece: np.ndarray, max_words: int) -> Iterator[tuple[pa.Array, list[tuple[list[np.ndarray], np.ndarray]]]]:
    """For each stretch of words: its distinct words, and for n = 1, 2, ... the n-grams as word numbers (one array a place) with their counts.

    A stretch is short enough that n word numbers fit 62 bits, so n-grams are told apart exactly.
    """
    if max_words > 15:
        raise ValueError("phrases of at most 15 words")
    most = 1 << (62 // max(3, max_words))
    for lo in range(0, len(words), most - max_words):
        own = words.slice(lo, most)
        n_own = min(most - max_words, len(words) - lo)
        coded = own.dictionary_encode()
        ids, size, part = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), piece[lo : lo + most]
        out, key = [], ids
        for n in range(1, max_words + 1):
            if n > 1:
                key = key[:-1] * size + ids[n - 1 :]
            here = key[:n_own][(part[n - 1 :] == part[: max(0, len(part) - n + 1)])[:n_own]]
            rest, counts = np.unique(here, return_counts=True)
            places = []
            for _ in range(n):
                places.append(rest % size)
                rest = rest // size
            out.append((places[::-1], counts))
        yield coded.dictionary, out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hashes(lang: str, own: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, from the hashes ``own`` of the distinct words."""
    h = np.full(len(places[0]), xxhash.xxh3_64_intdigest(lang.encode(), len(places)), np.uint64)
    for p in places:
        h = _mixed(h ^ own[p]) + own[p]
    return _mixed(h)


def _of_batches(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[str, int, pa.Array, list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]]]:
    """(language, words, distinct words, n-grams by n as hashes, word numbers and counts) of every stretch."""
    for b in batches:
        lang, text = b.column(0), b.column(1)
        for own_lang in pc.unique(lang).to_pylist():
            words, piece = words_of(text.filter(pc.equal(lang, own_lang)))
            for distinct, found in ngrams(words, piece, max_words):
                own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
                yield own_lang, int(found[0][1].sum()), distinct, [(_hashes(own_lang, own, places), places, counts) for places, counts in found]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[order], starts)


class Summary:
    """A mergeable Misra-Gries summary of at most ``capacity`` counters; ``taken`` is the most that a key's count may be too low."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Further counts; another summary's counters are merged in the same way (its ``taken`` is to be added)."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.n_waiting = [], 0
        self.keys, self.counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        if len(self.keys) > self.capacity:
            least = len(self.keys) - self.capacity - 1
            out = int(np.partition(self.counts, least)[least])
            stay = self.counts > out
            self.keys, self.counts, self.taken = self.keys[stay], self.counts[stay] - out, self.taken + out

    def reaching(self, threshold: int) -> np.ndarray:
        """Every key whose true count is ``threshold`` or more, and maybe others."""
        self.settle()
        return self.keys[self.counts + self.taken >= threshold]


def _placed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, hash inside it) of 64-bit hashes."""
    return (h % np.uint64(buckets)).astype(np.int32), (h // np.uint64(buckets)) & np.uint64((1 << _BITS) - 1)


def _spread(bucket: np.ndarray | int, inner: np.ndarray, buckets: int) -> np.ndarray:
    """64 bits that stand for (bucket, hash inside it) in the bit table."""
    return _mixed(_mixed(inner * np.uint64(buckets) + np.asarray(bucket).astype(np.uint64)))


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys in five bytes each; counts in one byte each, 0 for those that follow in eight."""
    small = counts < 256
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]).tobytes(), np.where(small, counts, 0).astype(np.uint8).tobytes(), counts[~small].astype(np.int64).tobytes()


def _unpacked(keys: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    wide = np.zeros((len(n), 8), np.uint8)
    wide[:, : _BITS // 8] = np.frombuffer(keys, np.uint8).reshape(len(n), -1)
    n[n == 0] = np.frombuffer(large, np.int64)
    return wide.view(np.uint64)[:, 0], n


def survivors(docs: DataFrame, threshold: int, max_words: int, buckets: int, flush: int = FLUSH) -> DataFrame:
    """(at) of every n-gram that may reach ``threshold`` in (lang, text) rows: 64 bits by ``_spread``; each that reaches it is there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            bucket, inner = _placed(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, inner, own = bucket[order], inner[order], counts[order]
            edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            cells = [_packed(inner[a:e], own[a:e]) for a, e in zip(edges, edges[1:])]
            there, mass = pa.array(bucket[edges[:-1]]), pa.array(np.add.reduceat(own, edges[:-1]))
            nothing = pa.nulls(len(cells), pa.binary())
            yield pa.RecordBatch.from_arrays([there, mass, nothing, nothing, nothing], names=["bucket", "mass", "keys", "counts", "large"])
            yield pa.RecordBatch.from_arrays([there, pa.nulls(len(cells), pa.int64()), *(pa.array([c[k] for c in cells], pa.binary()) for k in range(3))], names=["bucket", "mass", "keys", "counts", "large"])

        for _, _, _, found in _of_batches(batches, max_words):
            waiting += [(h, n) for h, _, n in found]
            size += sum(len(h) for h, _, _ in found)
            if size > flush:
                keys, counts = _summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
                waiting, size = [], 0
                if len(keys) > flush:
                    yield from rows()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = _summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
        if len(keys):
            yield from rows()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket's masses come before its counts.
        bucket, mass, held = None, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(_spread(bucket, held.reaching(threshold), buckets).view(np.int64))], names=["at"])

        for b in batches:
            there, masses = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (own, m) in enumerate(zip(there, masses)):
                if own != bucket:
                    yield from done()
                    bucket, mass, held = own, 0, None
                if m is not None:
                    mass += m
                    continue
                held = held or Summary(mass // threshold + 1)
                held.add(*_unpacked(*(b.column(c)[k].as_py() for c in (2, 3, 4))))
        yield from done()

    sent = docs.mapInArrow(send, "bucket int, mass long, keys binary, counts binary, large binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket", F.col("mass").isNull()).mapInArrow(summarise, "at long")


def _bit_table(at: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(shift, 64-bit words) of the table of the survivors' first bits; built in Spark, at most ``MOST_BITS`` bits arrive here."""
    bits = min(max(16, (16 * n - 1).bit_length()), MOST_BITS.bit_length() - 1)
    place = F.shiftrightunsigned("at", 64 - bits)
    words = at.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return 64 - bits, table.view(np.uint64)


def frequent_ngrams(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS, bucket_mass: int = BUCKET_MASS, flush: int = FLUSH) -> DataFrame:
    """(lang, n_words, phrase, f) of every n-gram that occurs ``threshold`` times or more in its language, counted exactly; n_words 0 has the language's words in f.

    ``docs`` needs lang and text; null texts are empty, a null lang is ``und``. A written table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its mark take about six bytes; smaller buckets than needed only even out the tasks.
    buckets = max(volume * max_words // (6 * bucket_mass), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    known = cut(survivors(rows, threshold, max_words, buckets, flush))
    shift, table = _bit_table(known, known.count())
    drop_cut(known)
    sent = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift_ = sent.value, np.uint64(shift)
        for lang, n_words, distinct, found in _of_batches(batches, max_words):
            phrases, sizes, counts = [pa.array([b""], pa.large_binary())], [np.zeros(1, np.int32)], [np.array([n_words], np.int64)]
            for h, places, n in found:
                place = _spread(*_placed(h, buckets), buckets) >> shift_
                stay = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                parts = [distinct.take(pa.array(p[stay])) for p in places]
                phrases.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())))
                sizes.append(np.full(len(stay), len(places), np.int32))
                counts.append(n[stay])
            phrase = pa.concat_arrays(phrases).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(np.concatenate(sizes)), phrase, pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "n_words", "phrase", "f"])

    counted = rows.mapInArrow(count, "lang string, n_words int, phrase string, f long").groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    return cut(counted.where((F.col("f") >= threshold) | (F.col("n_words") == 0)))


def scored_phrases(frequent: DataFrame, max_words: int = MAX_WORDS, held: int = HELD) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates in the table of ``frequent_ngrams`` that no longer one makes redundant.

    Parts of a frequent phrase are as frequent, so both sides of a cut are in the table. The arithmetic
    is in decimals of 38 digits: exact for up to 10^15 occurrences.
    """
    of = lambda name: frequent.where("n_words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f"f_{name}"))
    words = F.split("phrase", " ")
    phrases = frequent.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k")).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    sides = cuts.join(of("first"), ["lang", "first"]).join(of("rest"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = sides.select("lang", "phrase", "a", "k", F.col("f_first").alias("l"), F.col("f_rest").alias("r"), wide("a").alias("wa"), wide("f_first").alias("wl"), wide("f_rest").alias("wr")).withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * (wa * wa)) div (wl * wr)"))
    best = ranked.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    # What every longer candidate holds, however many words less it has.
    inner = phrases.where("n_words > 2").select("lang", "words", "n_words", "a", F.explode(F.expr("sequence(2, n_words - 1)")).alias("size"))
    inner = inner.select("lang", "words", "a", "size", F.explode(F.expr("sequence(1, n_words - size + 1)")).alias("start")).select("lang", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    totals = frequent.where("n_words = 0").select("lang", F.col("f").alias("n"))
    return best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < held * F.col("a"))).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked_within(df: DataFrame, group: str, order: list, top: int) -> DataFrame:
    """``df`` with ``rank`` (from 1) by ``order`` within ``group``, up to ``top``; rows must differ in their order.

    One range sort; a partition's rows are numbered as they are written, and the counts of the
    partitions before it (one row a partition and group) are added.
    """
    place, part = free_name(df, "place"), free_name(df, "part")
    table = cut(df)
    numbered = table.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(place, F.monotonically_increasing_id())
    numbered = cut(numbered).withColumn(part, F.shiftright(place, 33))
    counts = numbered.groupBy(group, part).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, part, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < top)
    return numbered.join(offsets, [group, part]).withColumn("rank", F.col("_before") + F.col(place) - F.col("_first") + 1).where(F.col("rank") <= top).drop(place, part, "_before", "_first")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS, top: int = TOP, held: int = HELD, bucket_mass: int = BUCKET_MASS, flush: int = FLUSH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_words`` words.

    ``docs`` needs lang and text; other columns are ignored, whatever their names. Null
    and empty texts have no words, a null lang counts as ``und``; repeated rows count again; ties are
    broken by count, then by the phrase's bytes. An empty table gives an empty result.
    """
    kept = scored_phrases(frequent_ngrams(docs, threshold, max_words, bucket_mass, flush), max_words, held)
    out = ranked_within(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
runs as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as words from pieces),
grams as (
    select lang, n, array_to_string(words[i : i + n - 1], ' ') as phrase
    from (select lang, words, n, unnest(range(1, len(words) - n + 2)) as i
          from runs, (select unnest([1, 2, 3]) as n) where len(words) >= n)),
counted as (select lang, n, phrase, count(*) as f from grams group by all),
totals as (select lang, cast(sum(f) as bigint) as n from counted where n = 1 group by lang),
cand as (select lang, n, phrase, f as a, string_split(phrase, ' ') as words from counted where n > 1 and f >= 10),
cuts as (
    select lang, phrase, a, words, k, array_to_string(words[1 : k], ' ') as first, array_to_string(words[k + 1 :], ' ') as rest
    from (select *, unnest(range(1, n)) as k from cand)),
scores as (
    select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, cast((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as bigint) as score
    from cuts c join counted x on x.lang = c.lang and x.phrase = c.first join counted y on y.lang = c.lang and y.phrase = c.rest),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
    select lang, phrase, max(a) as most from (
        select lang, a, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) as phrase from cand where n = 3)
    group by all),
kept as (
    select b.lang, b.phrase, b.a, b.l, b.r, t.n, b.score
    from best b join totals t using (lang) left join held h on h.lang = b.lang and h.phrase = b.phrase
    where h.most is null or 100 * h.most < 50 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""
