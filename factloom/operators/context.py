"""Ordered context: fill-forward subjects, mention memory, antecedents, working memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import DECAY, noisy_or, salience, saturate

#: Fixed: mentions that stay in memory; an antecedent's least score and lead.
MEMORY, LEAST, MARGIN = 24, 0.30, 0.12


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null up to and including each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def antecedent_score(clauses_back: Column, distance: Column, last_subject: Column, last_object: Column, discourse: Column, repeats: Column) -> Column:
    """How likely a mention is what a pronoun means: nearness, role and repetition, saturated."""
    near = F.when(clauses_back == 0, 0.42).when(clauses_back == 1, 0.32).otherwise(-0.10 * (clauses_back - 1))
    gap = F.when(distance <= 80, 0.26).otherwise(-0.0008 * F.least(distance - 80, F.lit(500)))
    role = F.when(last_subject, 0.34).otherwise(0) + F.when(last_object, 0.15).otherwise(0) + F.when(discourse, 0.26).otherwise(0)
    return saturate(near + gap + role + F.least(F.lit(0.18), 0.06 * (repeats - 1)))


def recent_mentions(mentions: DataFrame, doc: str, order: str, name: str, memory: int = MEMORY) -> DataFrame:
    """Mentions with the ``memory`` names before them, and how often each row's own name came before."""
    w = Window.partitionBy(doc).orderBy(order)
    own = Window.partitionBy(doc, name).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumns({"recent": F.collect_list(name).over(w.rowsBetween(-memory, -1)), "seen": F.count("*").over(own)})


def choose(ranked: DataFrame, keys: Sequence[str], score: str, ident: str, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """(keys, best, best_score, status): resolved if the best reaches ``least`` and leads by ``margin``, else ambiguous or unresolved.

    Only the two best of each key are kept before they are gathered (a rank limit that
    Spark applies before the shuffle).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    top = ranked.withColumn("__k", F.row_number().over(w)).where("__k <= 2").groupBy(*keys).agg(F.max_by(ident, -F.col("__k")).alias("best"), F.max(score).alias("best_score"), F.min(F.when(F.col("__k") == 2, F.col(score))).alias("__second"))
    status = F.when(F.col("best_score") < least, "unresolved").when(F.col("best_score") - F.col("__second") < margin, "ambiguous").otherwise("resolved")
    return top.select(*keys, "best", "best_score", status.alias("status"))


#: Evidence of one key that is folded in one array.
FOLDED = 4096


def remember(evidence: DataFrame, entity: Sequence[str], concept: str, confidence: str, order: Sequence[str], folded: int = FOLDED) -> DataFrame:
    """(entity, concept, confidence, n): evidence of each concept joined in order by a decayed noisy-or.

    One step is affine in what was believed before, so a key's evidence is parted by its order into
    stretches of ``folded``; each becomes a factor and a remainder, and these are joined in order.
    """
    keys = [*entity, concept]
    placed = evidence.withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / folded))
    seen = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(confidence).alias("__c")))), lambda x: x["__c"])
    parts = placed.groupBy(*keys, "__part").agg(seen.alias("__seen"), F.count("*").alias("__n"))
    factor = F.aggregate("__seen", F.lit(1.0), lambda f, c: f * DECAY * (1 - c))
    steps = F.array_sort(F.collect_list(F.struct("__part", noisy_or(F.col("__seen")).alias("b"), factor.alias("f"))))
    return parts.groupBy(*keys).agg(F.aggregate(steps, F.lit(0.0), lambda s, x: x["b"] + x["f"] * s).alias("confidence"), F.sum("__n").alias("n"))


def mentions_summary(mentions: DataFrame, entity: Sequence[str], order: str) -> DataFrame:
    """(entity, mention_count, salience, last_mention)."""
    return mentions.groupBy(*entity).agg(F.count("*").alias("mention_count"), F.max(order).alias("last_mention")).withColumn("salience", salience(F.col("mention_count")))


def latest_best(evidence: DataFrame, keys: Sequence[str], value: str, confidence: str, order: str) -> DataFrame:
    """(keys, value, confidence): the surest value, the latest of equals."""
    return evidence.groupBy(*keys).agg(F.max(F.struct(F.col(confidence), F.col(order), F.col(value))).alias("__b")).select(*keys, F.col(f"__b.{value}").alias(value), F.col(f"__b.{confidence}").alias(confidence))


#: Fixed: decimal places to which evidence is summed; evidence beyond the bound is summed as it is.
PLACES, BOUND = 15, 1e15


def exact_sum(score: str) -> Column:
    """Sum in decimals: what adds up to the same is the same, however the rows are dealt and ordered."""
    exact = F.try_sum(F.col(score).try_cast(f"decimal(38,{PLACES})")).cast("double")
    return F.coalesce(F.when(F.max(F.abs(score)) < BOUND, exact), F.sum(score))


def rank_types(evidence: DataFrame, entity: Sequence[str], concept: str, score: str, margin: float = 0.12, keep: int = 4) -> DataFrame:
    """(entity, best, score, alternatives, status): evidence summed by concept and saturated; ambiguous if the lead is under ``margin``.

    Equal scores go by concept name.
    """
    sums = evidence.groupBy(*entity, concept).agg(saturate(exact_sum(score)).alias("__s"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("__s")).alias("n"), F.col(concept).alias("c")))), 1, keep)
    out = sums.groupBy(*entity).agg(ranked.alias("r"))
    best, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    return out.select(*entity, best["c"].alias("best"), (-best["n"]).alias("score"), F.transform(F.slice("r", 2, keep), lambda x: x["c"]).alias("alternatives"), F.when(second.isNotNull() & (second["n"] - best["n"] < margin), "ambiguous-scored").otherwise("semantic-scored").alias("status"))
