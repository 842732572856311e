"""URL filters by a trie over reversed host labels and path segments (operator 4).

The rules are compiled on the driver into a trie that is broadcast: com -> example ->
(path) en -> 7. A node of the path trie holds rules that end inside a segment, so a
rule's path is a plain prefix of the URL's path. Lookup walks the URL's own labels and
segments, whatever the number of rules; the longest match decides between allow and
block. The broadcast is bounded by ``MAX_RULES``, checked; more rules are met by an
equi-join on host suffixes instead, with the same answers and no broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

#: (host, path, verdict); the rules of the registered query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Rules in a broadcast trie; about 1 kB each in a worker.
MAX_RULES = 200_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``. Null or without ``://``: both empty."""
    rest = (url or "").partition("://")[2]
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(_UPPER), path


class RuleTrie:
    """Host labels from the top-level domain down, then path segments; the longest match wins.

    Longest: most host labels, then most characters of path. Of rules equal in both,
    block stands before allow.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {"hosts": {}, "paths": None}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")) if host else ():
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            here = node["paths"] = node["paths"] or {"next": {}, "ends": {}}
            *whole, tail = path.split("/")
            for segment in whole:
                here = here["next"].setdefault(segment, {"next": {}, "ends": {}})
            if (tail not in here["ends"]) or verdict == "block":
                here["ends"][tail] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        for label in [None, *reversed(host.split("."))] if host else [None]:
            if label is not None:
                node = node["hosts"].get(label)
                if node is None:
                    break
            if node["paths"] is not None:
                best = self._longest(node["paths"], path) or best
        return best

    @staticmethod
    def _longest(here: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            fits = [tail for tail in here["ends"] if segment.startswith(tail)] if len(here["ends"]) <= len(segment) else [segment[:k] for k in range(len(segment) + 1) if segment[:k] in here["ends"]]
            if fits:
                best = here["ends"][max(fits, key=len)]
            here = here["next"].get(segment)
            if here is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    rule is the host and path of the longest rule that fits (else null); verdict is
    its own, else ``default``. Null and malformed URLs have an empty host and path and
    fit no rule with a host. Rules that hold a null are refused. A long URL is walked once
    along its labels and segments. Other columns are ignored, repeated rows stay; an empty
    table gives an empty result.
    """
    if any(part is None for rule in rules for part in rule):
        raise ValueError("a rule holds a null")
    if len(rules) > max_rules:
        return _judge_by_join(pages, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            found = [trie.value.find(h, p) for h, p in split]
            columns = [[h for h, _ in split], [p for _, p in split], [f and f[0] for f in found], [f[1] if f else default for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    """The same rows for rule lists that are too large to broadcast: each URL's host suffixes meet the rules in an equi-join."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(h.translate(_UPPER), p, h + p, v) for h, p, v in rules], "suffix string, prefix string, rule string, verdict string").hint("shuffle_merge")
    rest = F.regexp_extract("url", r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1), F.lit("")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    parts = cut(parts)  # so that a retry can't number the rows anew
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct((F.size(labels) - k + 1).alias("depth"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("suffix")))
    fits = (
        parts.select("row", "path", F.explode(F.array_append(suffixes, F.struct(F.lit(0).alias("depth"), F.lit("").alias("suffix")))).alias("s")).select("row", "path", "s.*")
        .join(table, "suffix").where(F.col("path").startswith(F.col("prefix")))
        .groupBy("row").agg(F.max(F.struct("depth", F.length("prefix").alias("n"), "verdict", "rule")).alias("best"))
    )
    return parts.join(fits, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the allow and block rules."""
    return judge_urls(read_table(spark, sf_dir, "pages"))


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1), '')"
OP4_SQL = f"""
WITH parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(suffix, prefix, verdict) AS (VALUES {', '.join(str(r) for r in RULES)}),
fits AS (
  SELECT p.page_id, r.suffix || r.prefix AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.suffix) DESC, length(r.prefix) DESC, r.verdict DESC) AS k
  FROM parts p JOIN rules r ON starts_with(p.path, r.prefix) AND (p.host = r.suffix OR ends_with(p.host, '.' || r.suffix))
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
