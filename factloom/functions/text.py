"""Text column functions: normal forms, segmentation, small grammars.

All are built-in expressions (whole-stage code generation), but for ``nfkc``, which Spark
doesn't have. Offsets count code points, half-open. ``locale`` is a literal; locales that
start with zh follow the Chinese rules.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed: characters that end a clause, by locale.
CLAUSE_BREAKS = {"zh": "。！？；\n", "en": ".!?;\n"}
#: Fixed: plurals that follow no rule.
IRREGULAR_PLURALS = {"wolves": "wolf", "foxes": "fox", "elves": "elf", "dwarves": "dwarf", "mice": "mouse", "geese": "goose", "deer": "deer", "sheep": "sheep", "species": "species"}
#: Fixed: lower-case words that may stand inside a name.
NAME_CONNECTORS = ("of", "the", "de", "da", "del", "la", "le", "van", "von", "di")
#: Fixed: words that open a sentence without being part of a name.
DISCOURSE_WORDS = "then|later|afterward|afterwards|finally|eventually|subsequently|initially|first|firstly|meanwhile|previously|but|however|therefore|thus|so|yet"
#: White space as JavaScript and Python see it; Java's own class is narrower.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def is_zh(locale: str | None) -> bool:
    return (locale or "").lower().startswith("zh")


def _composed(text: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text], dtype=object)


def nfkc(c: Column) -> Column:
    """Unicode NFKC; an Arrow UDF, for names and keys rather than whole corpora."""
    return F.pandas_udf(_composed, StringType())(c)


def trim_all(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column, locale: str = "en", compose: bool = True) -> Column:
    """Normal form for matching: NFKC, tabs and carriage returns to spaces, runs of spaces to one, trimmed, lower case unless Chinese. Line breaks stay."""
    out = nfkc(c) if compose else c
    out = F.regexp_replace(F.regexp_replace(F.coalesce(out, F.lit("")), "[\\u3000\t\r\f\\x0B]", " "), " {2,}", " ")
    out = trim_all(out)
    return out if is_zh(locale) else F.lower(out)


def comparison_form(c: Column, locale: str = "en", compose: bool = True) -> Column:
    """The normal form without white space and quotation marks; as all white space goes, none is made one space before."""
    out = F.coalesce(nfkc(c) if compose else c, F.lit(""))
    return F.regexp_replace(out if is_zh(locale) else F.lower(out), f"{SPACE}|[\"'`“”‘’「」『』《》]", "")


def collapse_space(c: Column) -> Column:
    """Runs of any white space to one space, trimmed; null is empty. Most names have none, which one look tells."""
    out = F.coalesce(c, F.lit(""))
    return F.when(out.rlike(SPACE), trim_all(F.regexp_replace(out, f"{SPACE}+", " "))).otherwise(out)


def strip_article(c: Column) -> Column:
    """Without a leading the, a or an."""
    return F.regexp_replace(trim_all(F.coalesce(c, F.lit(""))), f"(?i)^(?:the|a|an){SPACE}+", "")


def entity_name_form(c: Column, compose: bool = True) -> Column:
    """Form in which entity names are equal: no leading article, NFKC, single spaces, lower case."""
    out = strip_article(c)
    return F.lower(collapse_space(nfkc(out) if compose else out))


def label_form(c: Column, compose: bool = True) -> Column:
    """Form in which schema labels are equal: NFKC, trimmed, lower case, spaces, hyphens and underscores dropped."""
    out = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(trim_all(nfkc(out) if compose else out)), f"(?:{SPACE}|[-_])+", "")


def draft_key(c: Column, compose: bool = True) -> Column:
    """Key of an entity that isn't stored yet."""
    return entity_name_form(c, compose)


def clauses(c: Column, locale: str = "en") -> Column:
    """array<struct<clause_idx,start,end,text>>: trimmed clauses of a text with their true offsets.

    Pieces and their lengths give the offsets by a running sum, so the text is scanned
    once and nothing leaves the JVM.
    """
    marks = CLAUSE_BREAKS["zh" if is_zh(locale) else "en"].replace("\n", "\\n")
    pieces = F.split(c, f"[{marks}]")
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        left = F.regexp_replace(raw, f"^{SPACE}+", "")
        bare = F.regexp_replace(left, f"{SPACE}+$", "")
        start = acc["at"] + F.length(raw) - F.length(left)
        found = F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("text"))
        return F.struct((acc["at"] + F.length(raw) + 1).alias("at"), F.when(bare == "", acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

    made = F.aggregate(pieces, seed, step, lambda acc: acc["out"])
    return F.transform(made, lambda x, i: F.struct(i.alias("clause_idx"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def clause_rows(docs: DataFrame, doc: str = "doc_id", column: str = "text", locale: str = "en") -> DataFrame:
    """(doc, clause_idx, start, end, text): the clauses of every document, as ``clauses`` gives them for one text.

    A running sum over a document's pieces gives the offsets, so the work is linear in a
    text however many clauses it has, and its partitioning by document serves the joins
    that follow. ``doc`` tells documents apart.
    """
    marks = CLAUSE_BREAKS["zh" if is_zh(locale) else "en"].replace("\n", "\\n")
    order = Window.partitionBy(doc).orderBy("k")
    raw = docs.select(doc, F.posexplode(F.split(column, f"[{marks}]")).alias("k", "raw"))
    placed = raw.withColumn("at", F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = placed.withColumn("left", F.regexp_replace("raw", f"^{SPACE}+", "")).withColumn("text", F.regexp_replace("left", f"{SPACE}+$", "")).where("text != ''")
    start = (F.col("at") + F.length("raw") - F.length("left")).cast("int")
    return left.select(doc, (F.row_number().over(order) - 1).alias("clause_idx"), start.alias("start"), (start + F.length("text")).alias("end"), "text")


def sentences(c: Column) -> Column:
    """Sentences with their closing mark; a full stop is no boundary, line breaks are."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "(?<=[。！？!?；;])|\\n+"), trim_all), lambda x: x != "")


def detect_locale(c: Column) -> Column:
    """zh-CN if Han characters outweigh 0.15 of the Latin letters, else en."""
    han = F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[\\u3400-\\u4DBF\\u4E00-\\u9FFF]"))
    latin = F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]"))
    return F.when((han == 0) & (latin > 0), "en").when((latin == 0) & (han > 0), "zh-CN").when(han > latin * 0.15, "zh-CN").otherwise("en")


def singular(c: Column) -> Column:
    """English singular of one word, lower case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR_PLURALS.items() for x in pair])
    rule = (
        F.when(low.endswith("ies") & (F.length(low) > 4), F.concat(F.substring(low, 1, F.length(low) - 3), F.lit("y")))
        .when(low.rlike("(?:s|x|z|ch|sh)es$"), F.substring(low, 1, F.length(low) - 2))
        .when(low.endswith("s") & ~low.endswith("ss") & (F.length(low) > 3), F.substring(low, 1, F.length(low) - 1))
        .otherwise(low)
    )
    return F.coalesce(F.try_element_at(known, low), rule)


def strip_marks(c: Column) -> Column:
    """A value without leading assignment marks and trailing punctuation."""
    out = F.regexp_replace(trim_all(F.coalesce(c, F.lit(""))), f"^(?:[：:=—-]|{SPACE})+", "")
    return trim_all(F.regexp_replace(out, "[，。！？；,.!?;]+$", ""))


def first_number(c: Column) -> Column:
    """The first number in a value, as double; null without one."""
    return F.nullif(F.regexp_extract(strip_marks(c), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def age_value(c: Column) -> Column:
    """The first number if it is an age from 0 to 10000."""
    n = first_number(c)
    return F.when(n.between(0, 10000), n)


def gravity_value(c: Column) -> Column:
    """struct<value,unit>: a number with unit g, or a bare number; null without one."""
    bare = strip_marks(c)
    with_unit = F.nullif(F.regexp_extract(bare, r"(-?\d+(?:\.\d+)?)\s*[gG]\b", 1), F.lit("")).try_cast("double")
    n = first_number(c)
    return F.when(with_unit.isNotNull(), F.struct(with_unit.alias("value"), F.lit("g").alias("unit"))).when(n.isNotNull(), F.struct(n.alias("value"), F.lit(None).cast("string").alias("unit")))


def named_phrase(c: Column) -> Column:
    """Whether a phrase of at most eight words is a name: capitalised words and lower-case connectors, one capitalised at least."""
    words = F.split(strip_outer(c), f"{SPACE}+")
    capital = lambda w: w.rlike(r"^[A-Z][A-Za-z0-9'’-]*$")
    return (strip_outer(c) != "") & (F.size(words) <= 8) & F.forall(words, lambda w: capital(w) | F.lower(w).isin(*NAME_CONNECTORS)) & F.exists(words, capital)


def strip_outer(c: Column) -> Column:
    """Single spaces, no outer commas, semicolons and colons."""
    return trim_all(F.regexp_replace(F.regexp_replace(collapse_space(c), "^[,;:]+", ""), "[,;:]+$", ""))


def strip_discourse_prefix(c: Column) -> Column:
    """Without leading discourse words such as later, finally, but."""
    return trim_all(F.regexp_replace(collapse_space(c), rf"(?i)^(?:(?:{DISCOURSE_WORDS})\s*,?\s+)+", ""))


def coordinated(c: Column) -> Column:
    """Names of an explicit coordination (A, B and C); empty unless there is an and or & and every part is a named phrase."""
    text = strip_discourse_prefix(c)
    parts = F.regexp_replace(F.regexp_replace(text, r"(?i),\s*(?:and|&)\s+", ", "), r"(?i)\s+(?:and|&)\s+", ", ")
    names = F.filter(F.transform(F.split(parts, r"\s*,\s*"), strip_outer), lambda x: x != "")
    ok = text.rlike(r"(?i)(?:^|\s)(?:and|&)\s") & (F.size(names) >= 2) & F.forall(names, named_phrase)
    return F.when(ok, F.array_distinct(names)).otherwise(F.array().cast("array<string>"))


def select_options(c: Column) -> Column:
    """Options trimmed, blanks dropped, distinct without case keeping the first spelling and the order."""
    bare = F.filter(F.transform(c, lambda x: trim_all(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.aggregate(bare, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def prefixed(c: Column, prefix: str) -> Column:
    """``member_of`` to ``relation.member_of``; a value that has the prefix stays, blank is null."""
    bare = trim_all(F.coalesce(c, F.lit("")))
    return F.when(bare == "", None).when(bare.startswith(prefix), bare).otherwise(F.concat(F.lit(prefix), bare))


def unprefixed(c: Column, prefix: str) -> Column:
    """``relation.member_of`` to ``member_of``; blank is null."""
    bare = trim_all(F.coalesce(c, F.lit("")))
    return F.nullif(F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 20)).otherwise(bare), F.lit(""))


def joined_key(*parts: Column) -> Column:
    """Parts joined by ``::``, null and empty ones left out."""
    return F.concat_ws("::", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def promotable(c: Column) -> Column:
    """A value that may become an entity of its own: at most 80 characters, no sentence punctuation; else null."""
    bare = collapse_space(c)
    return F.when((bare != "") & (F.length(bare) <= 80) & ~bare.rlike("[。！？!?；;\\n]"), bare)


def valid_email(c: Column) -> Column:
    """Trimmed, lower case, at most 254 characters and of the form x@y.z; else null."""
    bare = F.lower(trim_all(F.coalesce(c, F.lit(""))))
    return F.when(bare.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(bare) <= 254), bare)


def first_set(*alternatives: Column) -> Column:
    """The first of alternative fields that is neither null nor blank."""
    return F.coalesce(*(F.when(trim_all(c) != "", c) for c in alternatives))


def boundary_before(text: Column, start: Column) -> Column:
    """Whether no letter, digit or underscore stands right before ``start``."""
    return (start == 0) | ~F.substring(text, start, F.lit(1)).rlike(r"^[\p{L}\p{N}_]$")


def boundary_after(text: Column, end: Column) -> Column:
    """Whether no letter, digit or underscore stands at ``end``."""
    return ~F.substring(text, end + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}_]$")
