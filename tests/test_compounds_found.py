"""Compounds found where the text is, against those of given spans and of a plain walk."""

import random
import re

import pytest

from factloom.operators import compounds

PARTS = {"en": ("wolf|fox|cat|wolf fox", "hybrid|hy"), "zh-CN": ("狼|龙|狐狸|狐", "混种|混")}


def texts(locale):
    rng = random.Random(5)
    pieces = {"en": ["wolf", "fox", "cat", " ", "  ", "-", " and ", " AND ", "with", "x", "hybrid", ",", "far away from it", "\n"], "zh-CN": ["狼", "龙", "狐狸", "狐", "和", "与", "×", "/", "混种", "混", "。", "远处的东西", "𠀀", "\n"]}[locale]
    return [(k, t) for k, t in enumerate([*("".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(150)), "", None])]


def plain(text, parts, marks, rule, zh, most=5):
    spans, markers = ([m.span() for m in re.finditer(p, text)] for p in (parts, marks))
    made = []
    for s, e in spans:
        mark = min((a for a, b in markers if b >= s - rule.marker_distance), default=10**9)
        path = [(s, e)]
        while len(path) < most:
            on = next((x for x in spans if x[0] >= path[-1][1]), None)
            gap = None if on is None else text[path[-1][1] : on[0]]
            if gap is None or len(gap) > rule.longest:
                break
            bare = gap.strip(" ") if rule.trimmed else gap
            if not (bare in rule.connectors or (bare.lower() if rule.trimmed else bare) in rule.weak and mark <= on[1] + rule.marker_distance):
                break
            path.append(on)
        if len(path) > 1:
            between = text[e : path[-1][0]]
            joined = all(a[1] == b[0] for a, b in zip(path, path[1:])) if zh else re.search(compounds.CONNECTOR, between) is not None
            made.append((s, path[-1][1], text[s : path[-1][1]], len(path), mark <= path[-1][1] + rule.marker_distance, joined, [x[0] for x in path]))
    return [m for m in made if not any(o[0] < m[0] and o[1] >= m[1] and o[3] > m[3] for o in made)]


@pytest.mark.parametrize("locale", list(PARTS))
def test_found_given_and_plain_compounds_agree(spark, locale):
    parts, marks = PARTS[locale]
    rule = compounds.RULES["zh" if locale == "zh-CN" else "en"]
    rows = texts(locale)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((k, *m) for k, t in rows for m in plain(t or "", parts, marks, rule, locale == "zh-CN"))
    got = lambda df: sorted((r.doc_id, r.start, r.end, r.text, r.n, r.marked, r.joined, r.starts) for r in df.collect())
    assert got(compounds.compounds_found(docs, parts, marks, locale)) == want
    assert got(compounds.compounds(compounds.literal_spans(docs, parts), compounds.literal_spans(docs, marks), docs, locale)) == want
    assert len(want) > 50


def test_only_compounds_are_dealt_anew(spark):
    """No join, and one sort by document: components and gaps aren't shuffled."""
    docs = spark.createDataFrame(texts("en"), "doc_id long, text string")
    plan = compounds.compounds_found(docs, *PARTS["en"], "en")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
