"""Dictionary matching: all expressions of a lexicon in one pass over each text."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLAUSE_BREAKS, is_zh, normalize_text
from .spans import suppress_covered

#: Expressions in a broadcast automaton, some 200 bytes each; a larger lexicon is an error, not a slower plan.
MAX_EXPRESSIONS = 1_000_000
#: Fixed: which evidence goes first among equals.
EVIDENCE_PRIORITY = {"exact": 4, "alias": 3, "suffix": 2}


#: White space that is trimmed from clauses: what ``text.SPACE`` matches.
_SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
#: The last automaton of this worker, by the call that it was made for.
_MACHINE: dict[str, object] = {}


def _machine(call: str, words: Iterable[str]):
    """The automaton of all words, made once a worker."""
    import ahocorasick

    if call not in _MACHINE:
        _MACHINE.clear()
        machine = ahocorasick.Automaton()
        for word in words:
            machine.add_word(word, word)
        machine.make_automaton()
        _MACHINE[call] = machine
    return _MACHINE[call]


def _clauses(source: str, breaks: re.Pattern) -> tuple[list[int], list[int]]:
    """(starts, ends) of the trimmed clauses of a text that aren't blank."""
    starts, ends, at = [], [], 0
    for end in [*(m.start() for m in breaks.finditer(source)), len(source)]:
        raw = source[at:end]
        bare = raw.lstrip(_SPACES)
        start, bare = at + len(raw) - len(bare), bare.rstrip(_SPACES)
        if bare:
            starts.append(start)
            ends.append(start + len(bare))
        at = end + 1
    return starts, ends


def match_lexicon(docs: DataFrame, lexicon: DataFrame, locale: str = "en", doc: str = "doc_id", text: str = "text", compose: bool = False, clauses: bool = False) -> DataFrame:
    """(doc, seq, concept_id, category, evidence_type, strength, expression, confidence, start, end) of every occurrence.

    Texts are normalised first and offsets are of that form. Occurrences of one
    expression don't overlap; outside Chinese they must be bounded by something that is
    no letter, digit or underscore. The automaton's words are broadcast; texts aren't shuffled.
    With ``clauses`` each has the ``clause_idx`` of the clause that holds all of it, or null: found in the same
    pass, so neither spans nor clauses are shuffled to meet.
    """
    rows = lexicon.select("concept_id", "category", "evidence_type", "strength", "expression", "score").limit(MAX_EXPRESSIONS + 1).collect()
    if len(rows) > MAX_EXPRESSIONS:
        raise ValueError("the lexicon is too large to broadcast")
    by: dict[str, list] = {}
    for r in rows:
        word = " ".join(r.expression.split())
        by.setdefault(word if is_zh(locale) else word.lower(), []).append(tuple(r))
    sent = docs.sparkSession.sparkContext.broadcast(by)
    call, breaks = uuid.uuid4().hex, re.compile(f"[{CLAUSE_BREAKS['zh' if is_zh(locale) else 'en']}]")
    bounded, kind = not is_zh(locale), docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(call, sent.value) if sent.value else None
        for b in batches:
            out: list[list] = [[] for _ in range(11)]
            for k, source in enumerate(b.column(1).to_pylist()):
                if not source or not sent.value:
                    continue
                last: dict[str, int] = {}
                found = []
                for end, word in machine.iter(source):
                    start, end = end - len(word) + 1, end + 1
                    if start < last.get(word, 0) or bounded and (start and _WORDY(source[start - 1]) or end < len(source) and _WORDY(source[end])):
                        continue
                    last[word] = end
                    found.append((start, end, word))
                found.sort(key=lambda f: (f[0], -f[1]))
                starts, ends = _clauses(source, breaks) if clauses and found else ((), ())
                for seq, (start, end, entry) in enumerate((s, e, x) for s, e, w in found for x in sent.value[w]):
                    at = bisect_right(starts, start) - 1
                    for to, v in zip(out, (k, seq, *entry[:5], entry[5], start, end, at if at >= 0 and end <= ends[at] else None)):
                        to.append(v)
            names = [doc, "seq", "concept_id", "category", "evidence_type", "strength", "expression", "confidence", "start", "end"]
            arrays = [b.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.string()) for x in out[2:7]), pa.array(out[7], pa.float64()), pa.array(out[8], pa.int32()), pa.array(out[9], pa.int32())]
            if clauses:
                names.append("clause_idx")
                arrays.append(pa.array(out[10], pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{doc}` {kind}, seq int, concept_id string, category string, evidence_type string, strength string, expression string, confidence double, start int, end int" + (", clause_idx int" if clauses else "")
    return docs.select(doc, normalize_text(F.col(text), locale, compose).alias("t")).mapInArrow(run, schema)


def _WORDY(c: str) -> bool:
    return c == "_" or c.isalnum()


def collapse_evidence(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Of a concept's spans in a document, those that no surer, longer or better kind of evidence covers."""
    rank = F.when(F.col("evidence_type") == "exact", 4).when(F.col("evidence_type") == "alias", 3).when(F.col("evidence_type") == "suffix", 2).otherwise(0)
    order = [F.desc("confidence"), F.desc(F.col("end") - F.col("start")), F.desc(rank), F.col("seq")]
    return suppress_covered(spans, [doc, "concept_id", "category"], order)


def plural_spans(tokens: DataFrame, species: DataFrame, singular, doc: str = "doc_id", cost: float = 0.05) -> DataFrame:
    """Tokens whose singular, not themselves, is a dictionary word: confidence is the word's less ``cost``."""
    word = F.lower(F.col("token"))
    base = tokens.withColumn("__one", singular(F.col("token"))).where(F.col("__one") != word)
    return base.join(species.select(F.lower("expression").alias("__one"), "concept_id", "confidence"), "__one").select(doc, "token", "start", "end", "concept_id", (F.col("confidence") - cost).alias("confidence"))


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, token, start, end) of words, with their offsets; in the JVM."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))
    found = F.aggregate(
        runs, seed,
        lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.when(x.rlike(r"^[\p{L}\p{N}_]"), F.array_append(a["out"], F.struct(x.alias("token"), a["at"].alias("start"), (a["at"] + F.length(x)).alias("end")))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    return docs.select(doc, F.explode(found).alias("x")).select(doc, "x.*")
