"""Personal data against the contract's regular expressions, and the graph's discoveries."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm.pii import _instance, base_spans, candidate_spans, contexts, detect, find, luhn, redact, score_graph

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("text", [None, "", "a@b", "a@b.c@d.e", "x.y+z@a-b.co.uk.", "@@a@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.2.3.4", "4111 1111-1111 1111", "4111111111111112", "+1 (171) 555-2028.", "+1+12345678+", "é 😀 a@b.cd 10.0.0.1", "0" * 20_000, "a@" * 500 + "b.c"])
def test_base_spans(text):
    assert base_spans(text) == plain(text)


def test_base_spans_of_random_strings():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789.+-() @ab") for _ in range(rng.randint(0, 60)))
        assert base_spans(text) == plain(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_candidates_touch_no_base_span():
    text = "mail a [at] b.org or a@b.org, card 4111 1111 1111 1112, ip 300.1.1.1"
    assert [(k, text[a:b]) for k, a, b in candidate_spans(text, base_spans(text))] == [("email", "a [at] b.org"), ("ip", "300.1.1.1"), ("card", "4111 1111 1111 1112")]


def rows():
    rng = random.Random(1)
    out = [(k, f"Some words here. Contact server at {rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{k} please now.") for k in range(40)]
    out += [(100, "Contact server at 300.20.7.1 please now."), (101, "The release is 300.20.9.1 of course."), (102, None), (103, ""), (104, "Nothing at all.")]
    return out + [(100, "Contact server at 300.20.7.1 please now."), (None, "me@x.org")]


def test_discovery_counts_and_hashes(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows()], "doc_id long, text string, spans string").repartition(3)
    got = detect(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for i, t in rows():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t))
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [by[i][f"n_{k}"] for k in RULES] == [sum(s[0] == k for s in plain(t)) for k in RULES]
        assert by[i].spans == ("ip:18:28" if i == 100 else base)
    assert detect(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows()], "doc_id long, text string, kind string")
    got = redact(docs)
    assert got.columns == docs.columns
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[0].endswith("at <IP> please now.") and by[100] == "Contact server at <IP> please now." and by[101] == "The release is 300.20.9.1 of course."
    assert by[None] == "<EMAIL>" and by[102] is None and by[103] == ""
    named = docs.withColumn("__row", F.lit("x")).withColumn("__base", F.lit(1)).withColumn("c1", F.lit(2))
    assert sorted(r.text or "" for r in redact(named).collect()) == sorted(r.text or "" for r in got.collect())
    assert redact(named).columns == named.columns and redact(docs.limit(0)).count() == 0


def chained_rows():
    """Identifiers teach "server at"; what that discovers teaches "backup host", which discovers more."""
    out = [(k, f"Ask server at 10.0.0.{k} now.") for k in range(120)]
    out += [(200 + k, f"Ask server at 300.1.1.{k} now.") for k in range(24)]
    out += [(300 + k, f"Use backup host 300.1.1.{k} then.") for k in range(24)]
    out += [(400 + k, f"Use backup host 400.2.2.{k} then.") for k in range(3)]
    return out + [(500 + k, f"Version number 500.{k}.2.3 works.") for k in range(9)]


def plain_graph(found, rounds=10, share=0.8, seeds=5, accept=0.8):
    edges, seed = defaultdict(set), {}
    for r in found:
        for spans, is_seed in ((r["__base"], 1.0), (r["__loose"], 0.0)):
            for s in spans:
                seed[s.instance] = max(seed.get(s.instance, 0.0), is_seed)
                for c in s.contexts:
                    edges[c].add(s.instance)
    score = dict(seed)
    for _ in range(rounds):
        miss = {i: 1.0 for i in seed}
        for own in edges.values():
            mean = sum(score[i] for i in own) / len(own)
            if mean >= share and sum(score[i] >= accept for i in own) >= seeds:
                for i in own:
                    miss[i] *= 1 - mean * len(own) / (len(own) + 1)
        score = {i: max(seed[i], 1 - miss[i]) for i in seed}
    return {i for i in seed if not seed[i] and score[i] >= accept}


def test_graph_equals_a_plain_version_and_goes_on_from_discoveries(spark):
    docs = spark.createDataFrame(chained_rows(), "doc_id long, text string").repartition(3)
    found = find(docs)
    got = {r.instance for r in score_graph(found).collect()}
    assert got == plain_graph(found.collect()) and got
    assert got == {_instance("ip", t.split()[3]) for i, t in chained_rows() if 200 <= i < 500}
    one_round = {r.instance for r in score_graph(found, rounds=1).collect()}
    assert one_round == plain_graph(found.collect(), rounds=1) and one_round < got


def test_contexts_hold_whole_words():
    word = "w" * 500
    assert contexts(f"{word} 1.2.3.4 {word}", "ip", 501, 508) == contexts(f"a, {word} 1.2.3.4 {word}", "ip", 504, 511)[:2]
    assert contexts(f"x{word} 1.2.3.4", "ip", 502, 509) != contexts(f"{word} 1.2.3.4", "ip", 501, 508)
    assert contexts(" " * 3000 + "1.2.3.4", "ip", 3000, 3007) == []


def test_many_candidates_take_linear_time():
    text = "tel 030 1234567 or +49 171 5552028 " * 40_000
    began = time.time()
    base = base_spans(text)
    assert len(candidate_spans(text, base)) == 40_000 and time.time() - began < 10
