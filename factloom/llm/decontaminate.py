"""Benchmark decontamination by template canonicalisation (operator 8).

Texts become sequences of words in which numbers, names and units are typed
placeholders. The hashes of windows of five such words of all benchmark items are a
table that the windows of the documents meet in an equi-join. Before that join one
narrow pass drops, by a bit table of at most ``MOST_BITS`` bits (a constant, whatever the
benchmark's size), the windows that no item has; what is shuffled is the hashes of the
others. A (text, item) pair that holds at least ``CONTAINMENT`` of the item's windows is
a candidate; its text is then read again and its hits are chained along the item. A
chain is a leak if it holds that share of the item's own words as well (a copy, whatever
was edited in it), or if its placeholders were filled consistently (the same question
with other parameters): a name or unit of the item has one value in the document, and
so has a number before the same word.

Texts are known by 128 bits, so copies are one text in the join and each its own row in
the result. A passage that many documents share is a hot window hash; both sides of the
join are written before, so adaptive execution can split it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, read_table

WINDOW = 5
CONTAINMENT = 0.8
#: Bits of the broadcast table at most, 16 MB; 16 a window up to that, then it fills up and lets more windows into the join.
MOST_BITS = 1 << 27
#: An item of fewer canonical words is a leak where a whole document says it; from this length on an item shorter than a window is one window.
LEAST_WORDS = 3
#: Items that one row of the second reading is compared with.
ITEMS_A_ROW = 256
#: Words that a worker remembers before it forgets all.
KEPT_WORDS = 200_000

#: Fixed lists: unit words and number words.
UNITS = frozenset("% $ € £ mm cm m km in ft yd mi mg g kg lb oz ml l s sec ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion half third quarter dozen".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
_EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”‘’«»"
#: Hashes of the placeholders.
NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<num>", "<name>", "<unit>"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to its number; by number: its hash, whether it may be a name (1) or a unit (2), whether a sentence ends with it."""

    def __init__(self):
        super().__init__()
        self.codes, self.kinds, self.ends = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int8), np.zeros(1 << 14, bool)

    def __missing__(self, word: str) -> int:
        bare = word.strip(_MARKS)
        if not bare.isalpha():
            bare = _EDGES.sub("", word)
        low = bare.lower()
        if not bare:
            code = 0
        elif bare.isalpha() and low not in NUMBERS:
            code = xxhash.xxh64_intdigest(low) or 1
        elif _NUMBER.fullmatch(bare) or low in NUMBERS:
            code = int(NUM)
        else:
            code = xxhash.xxh64_intdigest(low) or 1
        at = len(self)
        if at == len(self.codes):
            self.codes, self.kinds, self.ends = (np.concatenate((x, np.zeros_like(x))) for x in (self.codes, self.kinds, self.ends))
        self.codes[at] = code
        self.kinds[at] = 2 if low in UNITS else 1 if bare[:1].isupper() and bare[1:2].islower() and code != int(NUM) else 0
        self.ends[at] = word[-1:] in ".!?:…。！？" or word[-2:-1] in ".!?"
        self[word] = at
        return at


_WORDS: list[_Words] = []


# Scripts without spaces: each character counts as a word.
_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ONE_CJK, _WORD = re.compile(f"[{_CJK}]"), re.compile(f"[{_CJK}]|[^\\s{_CJK}]+")


def _split(text: str) -> list[str]:
    return text.split() if text.isascii() or not _ONE_CJK.search(text) else _WORD.findall(text)


def canonical(text: str | None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, words, place) of a whole text: the hash of each canonical word and the number of its word in ``words`` (the last of a name).

    Case and outer punctuation are dropped, and tokens without letters or digits.
    A capitalised word inside a sentence is a name, and neighbouring names are one; a
    unit word is a placeholder after a number only.
    """
    words = _split(text or "")
    if not _WORDS or len(_WORDS[0]) > KEPT_WORDS:
        _WORDS[:] = [_Words()]
    known = _WORDS[0]
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    if not len(ids):
        return np.zeros(0, np.uint64), words, ids
    codes, kind, ends = known.codes[ids], known.kinds[ids], known.ends[ids]
    place = np.flatnonzero(codes)
    codes, kind, starts = codes[place], kind[place], np.concatenate(([True], ends[:-1]))[place]
    codes = np.where((kind == 1) & ~starts, NAME, codes)
    after_number = np.concatenate(([False], codes[:-1] == NUM))
    codes = np.where((kind == 2) & after_number, UNIT, codes)
    goes_on = np.concatenate(((codes[1:] == NAME) & (codes[:-1] == NAME), [False]))
    return codes[~goes_on], words, place[~goes_on]


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ codes[k : len(codes) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _whole(words: list[str]) -> tuple[str, ...]:
    """The plain words of a text."""
    return tuple(w for w in map(_bare, words) if w)


def _postings(codes: np.ndarray, words: list[str], place: np.ndarray, window: int) -> tuple[int, list[tuple[int, int]]]:
    """(window length, [(place, hash)]) of an item's windows; the last is the other reading of the first one."""
    n = min(window, len(codes))
    # In running text the item's first word is no sentence start: its other reading counts as the same window.
    other = codes[:n].copy()
    other[0] = NAME if other[0] != NAME else np.uint64(xxhash.xxh64_intdigest(_bare(words[place[0]])))
    return n, [*enumerate(window_hashes(codes, n).tolist()), (0, int(window_hashes(other, n)[0]))]


class TemplateIndex:
    """Template windows of some benchmark items: window hash to (item, place)."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window, self.items, self.postings, self.lengths, self.whole = window, [], defaultdict(list), set(), defaultdict(list)
        for item_id, text in items:
            codes, words, place = canonical(text)
            if len(codes) < min(LEAST_WORDS, window):
                # Too little to tell a leak from any other text, but for a text that says nothing else.
                if len(codes):
                    self.whole[_whole(words)].append(item_id)
                continue
            at = len(self.items)
            n, postings = _postings(codes, words, place, window)
            self.items.append((item_id, codes, words, place, len(postings) - 1, n))
            self.lengths.add(n)
            for k, h in postings:
                self.postings[h].append((at, k))
        self.postings = dict(self.postings)
        # Most windows of a document are in no item: a bit table says so before any lookup.
        self.shift = np.uint64(64 - max(12, (16 * len(self.postings)).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[np.fromiter(self.postings, np.uint64, len(self.postings)) >> self.shift] = True

    def leaks(self, text: str | None, containment: float = CONTAINMENT) -> list[tuple[int, float, int, int, int]]:
        """(item_id, contained share, first word, last word, slots) of each item that leaks into a text, its best chain."""
        if not text:
            return []
        codes, words, place = canonical(text)
        hits, out = defaultdict(list), []
        if 0 < len(codes) < LEAST_WORDS and self.whole:
            out = [(item_id, 1.0, int(place[0]), int(place[-1]), 0) for item_id in self.whole.get(_whole(words), ())]

        for n in self.lengths:
            h = window_hashes(codes, n)
            if not len(h):
                continue
            for p in np.flatnonzero(self.maybe[h >> self.shift]).tolist():
                for item, q in self.postings.get(int(h[p]), ()):
                    if self.items[item][5] == n:
                        hits[item].append((p, q))
        for item, found in hits.items():
            item_id, own, own_words, own_place, total, n = self.items[item]
            if len({q for _, q in found}) < containment * total:
                continue
            best = None
            for chain in _chains(sorted(found), 2 * len(own)):
                share = len({q for _, q in chain}) / total
                if share >= containment and (best is None or share > best[1]):
                    slots, agree = _slots(chain, n, codes, words, place, own, own_words, own_place)
                    if agree or _literal(own_words, words[place[chain[0][0]] - n if place[chain[0][0]] > n else 0 : place[min(chain[-1][0] + n, len(place) - 1)] + n], self.window) >= containment:
                        best = (item_id, share, int(place[chain[0][0]]), int(place[min(chain[-1][0] + n, len(place)) - 1]), slots)
            if best:
                out.append(best)
        return out


def _chains(found: list[tuple[int, int]], reach: int) -> Iterator[list[tuple[int, int]]]:
    """Hits in document order, parted where the item starts over or the next hit is out of reach.

    The item's first window may recur in it: the item starts over only where no hit at the
    same word goes on along the chain's diagonals (document's word less item's word).
    """
    chain: list[tuple[int, int]] = []
    weights: Counter = Counter()
    diagonal = last = main = 0
    for p, group in groupby(found, key=lambda hit: hit[0]):
        places = [q for _, q in group]
        if chain:
            nearest = min(places, key=lambda q: (abs(p - q - diagonal), q))
            ahead = [q for q in places if q > last and p - q - diagonal <= reach]
            goes_on = bool(ahead) or any(q and p - q in (diagonal, main) for q in places)
            if p - chain[-1][0] > reach or p - nearest - (chain[0][0] - chain[0][1]) > reach or (places[0] == 0 and last > 0 and not goes_on):
                yield chain
                chain, weights = [], Counter()
            elif p - nearest == diagonal:
                last = nearest
            elif ahead:
                last = min(ahead, key=lambda q: (abs(p - q - diagonal), q))
                diagonal = p - last
        if not chain:
            last = places[0]
            main = diagonal = p - last
        for q in places:
            chain.append((p, q))
            weights[p - q] += 1
            if weights[p - q] > weights[main]:
                main = p - q
    if chain:
        yield chain


def _slots(chain, n, codes, words, place, own, own_words, own_place) -> tuple[int, bool]:
    """How many placeholders the chain aligns, and whether their values agree.

    A name has one value, both ways. A unit has one value, singular or plural. A number
    has one value before the same word ("3 apples" twice), but may have two before
    different ones; two numbers may get the same value, except in runs of placeholders,
    where nothing else tells a list from any other.
    """
    there, back, pairs = {}, {}, set()
    main = Counter(p - q for p, q in chain).most_common(1)[0][0]
    for p, q in chain:
        if abs(p - q - main) > 2:
            continue  # a window that occurs elsewhere in the item as well
        pairs.update((p + k, q + k) for k in range(n) if own[q + k] in (NUM, NAME, UNIT) and codes[p + k] == own[q + k])
    agree = True
    for p, q in sorted(pairs):
        x, y = _bare(own_words[own_place[q]]), _bare(words[place[p]])
        if own[q] == UNIT:
            x, y = (u.removesuffix("s") or u for u in (x, y))
        after = None
        if own[q] == NUM:
            after = _bare(own_words[own_place[q + 1]]) if q + 1 < len(own) and own[q + 1] not in (NUM, NAME) else ""
        one = there.setdefault((own[q], x, after), y) == y
        if not after and own[q] != UNIT:
            one &= back.setdefault((own[q], y), x) == x
        agree &= one
    return len(pairs), agree


def _bare(word: str) -> str:
    return _EDGES.sub("", word).lower()


def _literal(own_words: list[str], words: list[str], window: int) -> float:
    """Share of the item's windows of plain words that a stretch of a text holds."""

    def grams(source: list[str]) -> set:
        bare = [w for w in map(_bare, source) if w]
        n = min(window, len(own))
        return {tuple(bare[k : k + n]) for k in range(len(bare) - n + 1)}

    own = [w for w in map(_bare, own_words) if w]
    mine = grams(own_words)
    return len(mine & grams(words)) / len(mine) if mine else 0.0


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Window hashes that tell windows of another length apart, signed."""
    return (hashes * np.uint64(2 * n + 1) ^ (hashes >> np.uint64(32))).view(np.int64)


def _whole_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(("whole", *_whole(words)))) - (1 << 63)


def _items(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """((item, item_id, text) and (item, total, place, n, hash) of the benchmark's windows), written."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + b.num_rows), pa.int64()), *b.columns], names=["item", "item_id", "text"])
            row += b.num_rows

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, words, place = canonical(text)
                if 0 < len(codes) < min(LEAST_WORDS, window):
                    rows.append((item, 1, 0, 0, _whole_hash(words)))
                elif len(codes):
                    n, postings = _postings(codes, words, place, window)
                    own = _windows(np.array([h for _, h in postings], np.uint64), n).tolist()
                    rows += [(item, len(own) - 1, k, n, h) for (k, _), h in zip(postings, own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["item", "total", "place", "n", "hash"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = cut(benchmark.select("item_id", "text").where("text is not null").mapInArrow(number, f"item long, item_id {kind}, text string"))
    return items, cut(items.select("item", "text").mapInArrow(cut_windows, "item long, total int, place int, n int, hash long"))


def _bit_table(windows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(shift, 64-bit words) of the table of all window hashes' first bits."""
    bits = min(max(16, (16 * n - 1).bit_length()), MOST_BITS.bit_length() - 1)
    at = F.shiftrightunsigned("hash", 64 - bits)
    words = windows.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return 64 - bits, table.view(np.uint64)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("again"), text).alias("k2")]


def leaking_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT) -> DataFrame:
    """(k1, k2, item_id, containment, first_word, last_word, n_slots) of each leak of an item into a text; k1 and k2 are the text's 128 bits."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items, windows = _items(benchmark, window)
    schema = f"k1 long, k2 long, item_id {items.schema['item_id'].dataType.simpleString()}, containment double, first_word int, last_word int, n_slots int"
    by_length = {r.n: r["count"] for r in windows.groupBy("n").count().collect()}
    if not by_length:
        return spark.createDataFrame([], schema)
    shift, table = _bit_table(windows, sum(by_length.values()))
    sent, lengths = spark.sparkContext.broadcast(table), sorted(by_length)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            rows, found = [], []
            for k, text in enumerate(b.column(2)):
                codes, words, _ = canonical(text.as_py())
                own = [_windows(window_hashes(codes, n), n) for n in lengths if n]
                if 0 in lengths and 0 < len(codes) < LEAST_WORDS:
                    own.append(np.array([_whole_hash(words)], np.int64))
                own = np.concatenate(own) if own else np.zeros(0, np.int64)
                at = own.view(np.uint64) >> np.uint64(shift)
                own = np.unique(own[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)])
                if len(own):
                    rows.append(np.full(len(own), k, np.int32))
                    found.append(own)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(found))], names=["k1", "k2", "hash"])

    texts = docs.where("text is not null")
    # Written before the join, so that both its sides are plain shuffles and a window that very many documents share can be split.
    hits = cut(texts.select(*_text_key(F.col("text")), "text").mapInArrow(probe, "k1 long, k2 long, hash long"))
    held = hits.join(windows, "hash").groupBy("k1", "k2", "item", "total").agg(F.count_distinct("place").alias("places")).where(F.col("places") >= containment * F.col("total")).select("k1", "k2", "item")
    asked = cut(held.join(items, "item").withColumn("deal", F.floor(F.rank().over(Window.partitionBy("k1", "k2").orderBy("item")) / ITEMS_A_ROW)).groupBy("k1", "k2", "deal").agg(F.sort_array(F.collect_list(F.struct("item", "item_id", "text"))).alias("items")))
    first = texts.select(*_text_key(F.col("text")), "text").join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lru_cache(maxsize=64)(lambda own: TemplateIndex([*own], window))
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                own = tuple((x["item_id"], x["text"]) for x in b.column("items")[k].as_py())
                rows += [(k, *leak) for leak in index(own).leaks(b.column("text")[k].as_py(), containment)]
            take = pa.array([r[0] for r in rows], pa.int32())
            item_ids = pa.array([r[1] for r in rows], b.column("items").type.value_type.field("item_id").type)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), item_ids, pa.array([r[2] for r in rows], pa.float64()), *(pa.array([r[j] for r in rows], pa.int32()) for j in (3, 4, 5))], names=["k1", "k2", "item_id", "containment", "first_word", "last_word", "n_slots"])

    return cut(first.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "items").mapInArrow(verify, schema))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment, first_word, last_word, n_slots) of every leak of a benchmark item into a document.

    The words are numbers in the text split at white space. Null and empty texts leak
    nothing; nor do null items and items without a word. Items of one or two words leak
    into documents that say nothing else. Repeated rows and items of equal text each give
    their own rows; of equal chains the first in the text is reported. Other columns are
    ignored. Empty tables give an empty result.
    """
    leaks = leaking_texts(docs, benchmark, window, containment)
    return docs.select("doc_id", *_text_key(F.col("text"))).join(leaks, ["k1", "k2"]).drop("k1", "k2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, all columns as they are."""
    found = cut(leaking_texts(docs, benchmark, window, containment).select("k1", "k2").distinct())
    k1, k2 = _text_key(docs["text"])
    return docs.join(found, (k1 == found["k1"]) & (k2 == found["k2"]), "left_anti")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
