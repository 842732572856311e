"""Compound chains and the quality of spans over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compounds as chains
from ..operators import names, span_quality
from .registry import query

#: Fixed: the locale names of Chinese.
_ZH = "zh-CN"


def _spans_sql(name: str, pattern: str, source: str = "documents") -> str:
    """CTEs <name>_p, <name>_x and <name> (doc_id, k, gap, found, s, e): occurrences of a pattern from left to right."""
    return rf"""{name}_p AS (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS f FROM {source}), {name}_x AS (SELECT doc_id, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, unnest(range(len(f))) AS k FROM {name}_p),
{name} AS (SELECT *, e - length(found) AS s FROM (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM {name}_x))"""


#: Components and markers of the two rules; parts of words, so that they touch, are joined by single letters, or stand a word apart.
_PARTS = {"en": ("the|of|and|eau|en|ch", "was|tion"), _ZH: ("th|er|in|an|en|ch|be", "ou|un")}


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _chain_sql(v: str, locale: str) -> str:
    rule, (parts, marks) = chains.RULES["zh" if locale == _ZH else "en"], _PARTS[locale]
    bare, weak = ("trim(gap)", "lower(trim(gap))") if rule.trimmed else ("gap", "gap")
    joined = "touching" if locale == _ZH else rf"regexp_matches(between_, '{chains.CONNECTOR}')"
    go = f"(x.free OR coalesce(p.mark <= x.ne + {rule.marker_distance}, false))"
    return rf"""{_spans_sql(v, parts)}, {_spans_sql(v + 'm', marks)},
{v}_n AS (SELECT doc_id, s, e, found AS own, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(gap) OVER w AS gap, lead(found) OVER w AS nf FROM {v} WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
{v}_e AS (SELECT *, {bare} IN {_list(rule.connectors)} AS free FROM {v}_n WHERE length(gap) <= {rule.longest} AND ({bare} IN {_list(rule.connectors)} OR {weak} IN {_list(rule.weak)})),
{v}_path AS (SELECT doc_id, s AS start, (SELECT min(m.s) FROM {v}m m WHERE m.doc_id = {v}_e.doc_id AND m.e >= {v}_e.s - {rule.marker_distance}) AS mark, s AS last, e AS end_, 1 AS n, own AS text, '' AS between_, '' AS tail, true AS touching FROM {v}_e
  UNION ALL SELECT p.doc_id, p.start, p.mark, x.ns, x.ne, p.n + 1, p.text || x.gap || x.nf, p.between_ || p.tail || x.gap, x.nf, p.touching AND x.gap = '' FROM {v}_path p JOIN {v}_e x ON x.doc_id = p.doc_id AND x.s = p.last WHERE p.n < 5 AND {go}),
{v}_made AS (SELECT doc_id, start, end_, n, text, coalesce(mark <= end_ + {rule.marker_distance}, false) AS marked, {joined} AS joined FROM {v}_path WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY n DESC) = 1),
{v}_out AS (SELECT doc_id, '{locale}' AS locale, CAST(start AS INTEGER) AS start, CAST(end_ AS INTEGER) AS "end", text, n, round(least(1.0, {rule.base} + CASE WHEN joined THEN {rule.plain_bonus} ELSE 0 END + CASE WHEN marked THEN {rule.marker_bonus} ELSE 0 END)::DOUBLE, 6) AS confidence FROM {v}_made a WHERE NOT EXISTS (SELECT 1 FROM {v}_made b WHERE b.doc_id = a.doc_id AND b.start < a.start AND b.end_ >= a.end_ AND b.n > a.n))"""


@query(f"WITH RECURSIVE {_chain_sql('en', 'en')}, {_chain_sql('zh', _ZH)} FROM en_out UNION ALL FROM zh_out")
def compound_chains(spark, t):
    """Chains of components under both locales' gap rules, with connectors and markers of hybrids."""
    docs = t("documents").select("doc_id", "text")
    out = None
    for locale, (parts, marks) in _PARTS.items():
        one = chains.compounds_found(docs, parts, marks, locale)
        one = one.select("doc_id", F.lit(locale).alias("locale"), "start", "end", "text", "n", F.round("confidence", 6).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


#: Names, and what may stand in them: a kind for each pattern.
_NAMES, _KINDS = "[A-Z][a-z]+", {"entity-type": "the", "relation": "is|of", "event": "ing", "field": "er|ch", "role-signal": "and"}
_BASE = f"""{_spans_sql('names', _NAMES)}, {', '.join(_spans_sql('m' + str(k), p) for k, p in enumerate(_KINDS.values()))},
cand AS (SELECT n.doc_id, n.k AS cand_id, n.found AS name, n.s, n.e, CASE WHEN d.lang = 'fr' THEN '{_ZH}' WHEN d.lang = 'en' THEN 'en' END AS locale, lower(n.found) AS form, CASE WHEN d.lang = 'fr' THEN true ELSE false END AS zh, length(n.found) % 4 IN (0, 1) AS held, length(n.found) AS len, CASE WHEN n.s > 0 THEN substr(d.text, CAST(n.s AS BIGINT), 1) END AS before, CASE WHEN n.e < length(d.text) THEN substr(d.text, CAST(n.e AS BIGINT) + 1, 1) END AS after_ FROM names n JOIN documents d USING (doc_id)),
found_ AS (SELECT doc_id, s, e, 1 AS p, 0 AS f FROM m1 UNION ALL SELECT doc_id, s, e, 1, 0 FROM m2 UNION ALL SELECT doc_id, s, e, 0, 1 FROM m3 UNION ALL SELECT doc_id, s, e, 0, 1 FROM m4),
cuts AS (SELECT c.doc_id, c.cand_id, sum(f.p) AS p, sum(f.f) AS f FROM cand c JOIN found_ f ON f.doc_id = c.doc_id AND f.s < c.e AND f.e > c.s GROUP BY 1, 2),
parts AS (SELECT c.*, CASE len % 4 WHEN 0 THEN 0.16 WHEN 1 THEN 0.08 WHEN 2 THEN 0 ELSE 0 END AS lexical,
  CASE WHEN zh THEN CASE WHEN len BETWEEN 2 AND 8 THEN 0.08 ELSE 0 END + CASE WHEN len > 12 THEN -0.22 ELSE 0 END ELSE CASE WHEN form IN {_list(span_quality.ALONE_EN.split('|'))} THEN -0.62 ELSE 0 END + 0.07 END AS shape,
  -0.48 * coalesce(u.p, 0) - 0.16 * coalesce(u.f, 0) AS contamination, CASE WHEN before IS NULL OR regexp_matches(before, '[\\s.,;:!?()"]') OR (zh AND before = '''') THEN 0.04 ELSE 0 END + CASE WHEN after_ IS NULL OR regexp_matches(after_, '[\\s.,;:!?()"]') THEN 0.04 ELSE 0 END AS edges FROM cand c LEFT JOIN cuts u USING (doc_id, cand_id)),
judged AS (SELECT *, CAST(greatest(0, least(1, round(0.48 + lexical + shape + contamination + edges, 12))) AS DOUBLE) AS span_confidence FROM parts)""".replace("\\\\s", "\\s")


def _quality(t):
    docs = t("documents").select("doc_id", "text", "lang")
    names = chains.literal_spans(docs, _NAMES)
    n = F.length("found")
    said = lambda *xs: F.array(*(F.struct(F.lit(e).cast("string").alias("evidence_type"), F.lit(s).cast("string").alias("strength")) for e, s in xs))
    evidence = F.when(n % 4 == 0, said(("exact", "strong"), ("exact", None))).when(n % 4 == 1, said(("suffix", "weak"), ("alias", None))).when(n % 4 == 2, said(("alias", "weak"))).otherwise(said())
    cands = names.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "start", "end", F.col("found").alias("name"), F.when(F.col("lang") == "fr", _ZH).when(F.col("lang") == "en", "en").alias("locale"), evidence.alias("evidence"), F.col("start").alias("cand_id"))
    matches = None
    for kind, pattern in _KINDS.items():
        own = chains.literal_spans(docs, pattern).select("doc_id", "start", "end", F.lit(kind).alias("kind"))
        matches = own if matches is None else matches.unionByName(own)
    return span_quality.candidate_quality(cands, matches, docs, compose=False)


@query(f"WITH {_BASE} SELECT doc_id, CAST(s AS INTEGER) AS start, name, round(lexical, 6)::DOUBLE AS lexical, round(shape, 6)::DOUBLE AS shape, round(contamination, 6)::DOUBLE AS contamination, round(edges, 6)::DOUBLE AS edges, span_confidence, CASE WHEN span_confidence >= 0.72 THEN 'normal' WHEN span_confidence >= 0.45 THEN 'low-confidence' ELSE 'suppressed' END AS quality FROM judged")
def mention_quality(spark, t):
    """how likely each capitalised word is a mention, by its evidence, form, the spans it cuts, and its ends."""
    return _quality(t).select("doc_id", "start", "name", *(F.round(c, 6).alias(c) for c in ("lexical", "shape", "contamination", "edges")), "span_confidence", "quality")


@query(f"""WITH {_BASE}, best AS (SELECT doc_id, form, max(span_confidence) AS support FROM judged WHERE span_confidence >= 0.6 GROUP BY 1, 2), hints AS (SELECT DISTINCT doc_id, name AS hint, form, CASE len % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'object' WHEN 2 THEN 'field-value' END AS role, len % 2 = 0 AS anchored FROM judged)
SELECT h.doc_id, h.hint, b.support, CAST(greatest(0, least(1, round(0.48 + CASE WHEN role IS NOT NULL THEN 0.12 ELSE 0 END + CASE WHEN anchored THEN 0.04 ELSE 0 END + coalesce(0.34 * b.support, 0) + CASE WHEN h.form IN {_list(span_quality.ALONE_EN.split('|'))} THEN -0.62 ELSE 0 END + 0.07, 12))) AS DOUBLE) AS span_confidence FROM hints h LEFT JOIN best b USING (doc_id, form)""")
def hint_support(spark, t):
    """proposed names, and whether an independent mention supports them."""
    judged = _quality(t)
    n = F.length("name")
    hints = judged.select("doc_id", F.col("name").alias("hint"), F.when(n % 4 == 0, "subject").when(n % 4 == 1, "object").when(n % 4 == 2, "field-value").alias("role"), (n % 2 == 0).alias("anchored"), F.lit("en").alias("locale")).distinct()
    return span_quality.hint_quality(hints, judged.where("span_confidence >= 0.6"), compose=False).select("doc_id", "hint", "support", "span_confidence")


#: Letters that stand for particles, so that a text is read as Chinese; type words (pattern, type, evidence, strength, confidence); events; generic terms.
_AS_PARTICLES = ("wvyz", "的在从了")
_TYPE_WORDS = (("ung|ing|tion|ment|heit", "type.place", "suffix", "strong", 0.75), ("g|t|n", "type.group", "exact", "weak", 0.9))
_EVENTS, _GENERIC = "ch|be", ("ung", "the", "and")
_INNER = f"[^{names.BOUNDS}{names.PARTICLES}]*".replace("'", "''")
_GROWN = " UNION ALL ".join(rf"""SELECT doc_id, 2 * s + {k} AS seq, s, e, found, '{t}' AS type, {sure} AS sure, '{kind}' AS kind, {0.12 if k == 0 else 0.09} AS worth FROM w{k}""" for k, (_, t, kind, _, sure) in enumerate(_TYPE_WORDS))


@query(rf"""WITH t AS (SELECT doc_id, translate(text, '{_AS_PARTICLES[0]}', '{_AS_PARTICLES[1]}') AS text FROM documents), {_spans_sql('w0', _TYPE_WORDS[0][0], 't')}, {_spans_sql('w1', _TYPE_WORDS[1][0], 't')}, {_spans_sql('ev', _EVENTS, 't')}, words AS ({_GROWN}),
grown AS (SELECT w.*, regexp_extract(substr(text, CAST(greatest(0, s - 12) AS BIGINT) + 1, CAST(s - greatest(0, s - 12) AS BIGINT)), '{_INNER}$') AS l, regexp_extract(substr(text, CAST(e AS BIGINT) + 1, 4), '^{_INNER}') AS r FROM words w JOIN t USING (doc_id)),
named AS (SELECT doc_id, seq, CAST(s - length(l) AS INTEGER) AS start, CAST(e + length(r) AS INTEGER) AS end_, l || found || r AS name, type, found, worth, least(1.0, sure + CASE WHEN length(l || found || r) >= 3 THEN 0.08 ELSE 0 END + CASE WHEN kind = 'suffix' THEN 0.05 ELSE 0 END)::DOUBLE AS c FROM grown WHERE ends_with(l || found || r, found) AND length(l || found || r) >= 2 AND l || found || r NOT IN {_list(_GENERIC)}),
merged AS (SELECT doc_id, start, end_, name, list(type ORDER BY c DESC, seq) AS types, max(c) AS c FROM named GROUP BY 1, 2, 3, 4),
worth AS (SELECT doc_id, start, end_, name, least(0.16, sum(worth)) AS lexical FROM (SELECT DISTINCT doc_id, start, end_, name, type, found, worth FROM named) GROUP BY 1, 2, 3, 4),
cuts AS (SELECT m.doc_id, m.start, m.end_, count(*) AS p FROM (SELECT DISTINCT doc_id, start, end_ FROM merged) m JOIN ev ON ev.doc_id = m.doc_id AND ev.s < m.end_ AND ev.e > m.start GROUP BY 1, 2, 3),
judged AS (SELECT m.*, CAST(greatest(0, least(1, round(0.48 + w.lexical + CASE WHEN length(name) <= 8 THEN 0.08 ELSE 0 END + CASE WHEN length(name) > 12 THEN -0.22 ELSE 0 END - 0.48 * coalesce(c.p, 0)
  + CASE WHEN start = 0 OR regexp_matches(substr(text, start, 1), '[\s，。！？；：、,.!?;:"“”''‘’（）()]') THEN 0.04 ELSE 0 END + CASE WHEN end_ = length(text) OR regexp_matches(substr(text, end_ + 1, 1), '[\s，。！？；：、,.!?;:"“”''‘’（）()]') THEN 0.04 ELSE 0 END, 12))) AS DOUBLE) AS q
  FROM merged m JOIN worth w USING (doc_id, start, end_, name) LEFT JOIN cuts c USING (doc_id, start, end_) JOIN t USING (doc_id)),
linked AS (SELECT *, least(c, q) + (greatest(c, q) - least(c, q)) * CAST(0.2 AS DOUBLE) AS sure FROM judged)
SELECT doc_id, start, name, types[1] AS likely_type, list_filter(types, lambda x: x <> types[1])[1] AS alternative, round(sure, 6) AS confidence, CASE WHEN sure >= 0.72 THEN 'normal' WHEN sure >= 0.45 THEN 'low-confidence' ELSE 'suppressed' END AS disposition FROM linked""")
def grown_names(spark, t):
    """Names grown from type words to both sides, up to boundaries and particles; several types of one name merged, and judged as spans."""
    docs = t("documents").select("doc_id", F.translate("text", *_AS_PARTICLES).alias("text"))
    events = chains.literal_spans(docs, _EVENTS).select("doc_id", F.lit("event").alias("kind"), "start", "end")
    generic = spark.createDataFrame([(x,) for x in _GENERIC], "term string")
    out = names.judged(names.grow_found(docs, _TYPE_WORDS, events, generic), events, docs, "zh")
    return out.select("doc_id", "start", "name", "likely_type", F.try_element_at("alternatives", F.lit(1)).alias("alternative"), F.round("confidence", 6).alias("confidence"), "disposition")
