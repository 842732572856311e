"""Personal data by bootstrapped contextual extraction (operator 7).

Base patterns (e-mail, IP address, card, telephone) give seed entities. The words around
seeds induce lexical patterns: (kind, the word before; the two words before; the word
after). Strings that look like an identifier of a kind but fail its base rule are
candidates. Spark scores the bipartite graph of patterns and instances round by round:
a pattern is as good as the share of its distinct instances that are identifiers, damped
by how many there are; a candidate is as good as the noisy-or of its patterns. What
patterns of high confidence vouch for is an identifier too, and seeds further patterns
in the next round, until a round discovers nothing.

Texts are read once. What is shuffled is hashes of contexts and instances of found
strings only; sums are pre-aggregated and go back in equi-joins that adaptive execution
can split, so a word that stands before a third of all identifiers is no single task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, cut, drop_cut, read_table

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Scoring rounds at most; share of identifiers among a pattern's instances and its distinct seeds at least; a candidate's score at least.
ROUNDS, PATTERN_SHARE, PATTERN_SEEDS, ACCEPT = 10, 0.8, 5, 0.8

# Fixed: the base forms. Possessive runs and the look-behind change no match; they keep long digit strings linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Looser forms: what an identifier that fails its base rule may look like.
_LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64} ?(?:@|\[at\]|\(at\)|\{at\}) ?[\w-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[\w-]{2,63}){1,5}"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w.]*[0-9])"),
    "card": re.compile(r"(?<![\w.])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])(?:00|\(?0?)[0-9]{1,4}\)?[\x20./-]?\(?[0-9]{2,4}\)?(?:[\x20./-]?[0-9]{2,4}){1,3}(?![\w-])"),
}
_WORD = re.compile(r"\w+|[^\w\s]+")


def luhn(digits: str) -> bool:
    """The card checksum."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in a whole text, by kind, then start; code points, end exclusive."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings of the looser forms that touch no base span and no candidate of an earlier kind; linear in the text."""
    if "@" not in text and "at" not in text and not _DIGIT.search(text):
        return []
    taken, out = sorted((a, b) for _, a, b in base), []
    for kind in KINDS:
        if kind == "email" and not any(x in text for x in ("@", "[at]", "(at)", "{at}")):
            continue
        at, reach, fresh = 0, 0, []
        for m in _LOOSE[kind].finditer(text):
            a, b = m.span()
            if kind == "phone" and not 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            # Matches and taken spans both go forward: ``reach`` is how far those that start before b get.
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= a:
                fresh.append((a, b))
        out += [(kind, a, b) for a, b in fresh]
        taken = sorted(taken + fresh)
    return out


def _near(text: str, at: int, before: bool, n: int) -> list[str]:
    """The n words before or after a place, whole however long they are."""
    size = 64
    while True:
        a, b = (max(0, at - size), at) if before else (at, min(len(text), at + size))
        words = _WORD.findall(text[a:b].lower())
        # The word at the window's edge may be cut off.
        if len(words) > n or (a == 0 if before else b == len(text)):
            return words[-n:] if before else words[:n]
        size *= 4


def contexts(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span."""
    before, after = _near(text, start, True, 2), _near(text, end, False, 1)
    found = [("l", before[-1:]), ("r", after)] + ([("l2", before)] if len(before) == 2 else [])
    return [xxhash.xxh64_intdigest("\0".join([kind, where, *words])) >> 1 for where, words in found if words]


def _instance(kind: str, surface: str) -> int:
    return xxhash.xxh64_intdigest(kind + "\0" + re.sub(r"[\W_]+", "", surface.lower())) >> 1


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


_SPAN = "struct<kind:string,start:bigint,end:bigint,instance:bigint,contexts:array<bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns but these) with __row, __base and __loose: spans with their instance and context hashes. A written table: __row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))]))
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, found = range(row, row + b.num_rows), ([], [])
            row += b.num_rows
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                loose = candidate_spans(text, base) if text else []
                for to, spans in zip(found, (base, loose)):
                    to.append([{"kind": k, "start": a, "end": e, "instance": _instance(k, text[a:e]), "contexts": contexts(text, k, a, e)} for k, a, e in spans])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64()), *(pa.array(x, kind_of) for x in found)], names=[*b.schema.names, "__row", "__base", "__loose"])

    bounded_batches(docs.sparkSession)
    added = StructType.fromDDL(f"__row long, __base array<{_SPAN}>, __loose array<{_SPAN}>")
    return cut(docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields])))


def score_graph(found: DataFrame, rounds: int = ROUNDS, share: float = PATTERN_SHARE, seeds: int = PATTERN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """(instance) of candidates that patterns of high confidence vouch for.

    Round by round: a pattern's confidence is the mean score of its distinct instances,
    and it counts from ``share`` and ``seeds`` distinct identifiers on, base ones and
    those discovered in an earlier round; a candidate's score is the noisy-or over its
    counting patterns, each damped by n / (n + 1). Candidates of equal scores are judged
    alike. Rounds end when one discovers nothing.
    """
    sides = [found.select(F.explode(c).alias("s")).select(F.col("s.instance").alias("instance"), F.explode("s.contexts").alias("pattern"), F.lit(float(seed)).alias("seed")) for c, seed in (("__base", 1), ("__loose", 0))]
    edges = cut(sides[0].unionByName(sides[1]).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    # An instance that is a seed anywhere is one everywhere.
    scores = cut(edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed")))
    known = 0
    for _ in range(rounds):
        patterns = (
            edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern")
            .agg(F.avg("score").alias("share"), F.count("*").alias("n"), F.count_if(F.col("score") >= accept).alias("seeds"))
            .where((F.col("share") >= share) & (F.col("seeds") >= seeds))
            .select("pattern", (F.col("share") * F.col("n") / (F.col("n") + 1)).alias("trust"))
        )
        vouched = edges.where("seed = 0").select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("trust"))
        now = cut(scores.join(vouched, "instance", "left").select("instance", "seed", F.greatest("seed", F.coalesce("trust", F.lit(0.0))).alias("score")))
        drop_cut(scores)
        scores = now
        found_now = scores.where((F.col("seed") == 0) & (F.col("score") >= accept)).count()
        if found_now == known:
            break
        known = found_now
    return scores.where((F.col("seed") == 0) & (F.col("score") >= accept)).select("instance")


def added_spans(found: DataFrame, **options) -> DataFrame:
    """(__row, __added) of rows in which the graph discovers identifiers."""
    loose = found.select("__row", F.explode("__loose").alias("s")).select("__row", "s.kind", "s.start", "s.end", "s.instance")
    return loose.join(score_graph(found, **options), "instance").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("__added"))


def detect(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and base_sha256 are of the base spans; spans are all. Null and empty texts have
    none. Repeated rows stay and are judged alike. An empty table gives an empty result.
    """
    found = find(docs.select("doc_id", "text"))
    met = found.drop("text").join(added_spans(found, **options), "__row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, more = [[] for _ in KINDS], [], [], []
            for base, added in zip(b.column("__base").to_pylist(), b.column("__added").to_pylist()):
                own = [(s["kind"], s["start"], s["end"]) for s in base]
                new = [(s["kind"], s["start"], s["end"]) for s in added or ()]
                for to, k in zip(counts, KINDS):
                    to.append(sum(s[0] == k for s in own))
                digests.append(hashlib.sha256(_written(own).encode()).hexdigest())
                spans.append(_written(own + new))
                more.append(len(new))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return met.select("doc_id", "__base", "__added").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with every span of text replaced by its kind, like ``<EMAIL>``; of overlapping spans the outermost.

    Null texts stay null, empty ones empty; an empty table gives an empty result.
    """
    # Columns go by their place while spans stand beside them.
    found = find(docs.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns))))

    @F.pandas_udf("string")
    def masked(text: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        return pd.Series([_mask(t, [*(b if b is not None else ()), *(a if a is not None else ())]) for t, b, a in zip(text, base, added)], dtype=object)

    plain = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    met = found.join(added_spans(found, **options), "__row", "left")
    touched = (F.size("__base") > 0) | F.col("__added").isNotNull()
    return met.withColumn("text", F.when(touched, masked("text", plain, "__added")).otherwise(F.col("text"))).select(*("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns))).toDF(*docs.columns)


def _mask(text: str | None, spans: list) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return detect(read_table(spark, sf_dir, "documents"))
