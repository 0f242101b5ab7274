"""Question-answering metrics as array expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, normalize_answer, tokens

# Answers that count only when equal.
WHOLE = ("yes", "no", "noanswer")


def common_tokens(a: Column, b: Column) -> Column:
    """The size of two bags' intersection."""
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def answer_scores(prediction: Column, gold: Column) -> Column:
    """struct(em, f1, prec, recall) of one gold answer."""
    p, g = normalize_answer(prediction), normalize_answer(gold)
    a, b = tokens(p), tokens(g)
    n = common_tokens(a, b).cast("double")
    apart = (p.isin(*WHOLE) | g.isin(*WHOLE)) & (p != g)
    none = apart | (n == 0)
    prec, recall = n / F.size(a), n / F.size(b)
    zero = F.lit(0.0)
    return F.struct(
        (p == g).cast("double").alias("em"), F.when(none, zero).otherwise(2 * prec * recall / (prec + recall)).alias("f1"), F.when(none, zero).otherwise(prec).alias("prec"), F.when(none, zero).otherwise(recall).alias("recall"),
    )


def best_scores(prediction: Column, golds: Column) -> Column:
    """Each metric's best over the gold answers."""
    all_ = F.transform(golds, lambda g: answer_scores(prediction, g))

    def best(metric: str) -> Column:
        return F.coalesce(F.array_max(F.transform(all_, lambda s: s[metric])), F.lit(0.0)).alias(metric)

    return F.struct(*map(best, ("em", "f1", "prec", "recall")))


def set_scores(prediction: Column, gold: Column) -> Column:
    """struct(em, f1, prec, recall) of two sets."""
    p, g = F.array_distinct(prediction), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g)).cast("double")
    prec = F.when(F.size(p) > 0, tp / F.size(p)).otherwise(0.0)
    recall = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(0.0)
    same = (tp == F.size(p)) & (tp == F.size(g))
    return F.struct(same.cast("double").alias("em"), F.when(prec + recall > 0, 2 * prec * recall / (prec + recall)).otherwise(0.0).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def joint_scores(*parts: Column) -> Column:
    """Joint metrics: products of precisions and recalls, null if a part is missing."""
    prec, recall, em = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for part in parts:
        prec, recall, em = prec * part["prec"], recall * part["recall"], em * part["em"]
    return F.struct(em.alias("em"), F.when(prec + recall > 0, 2 * prec * recall / (prec + recall)).otherwise(0.0).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def with_aliases(golds: DataFrame, aliases: DataFrame) -> DataFrame:
    """(answer_id, golds): the gold answers and their aliases, once each."""
    more = aliases.groupBy("answer_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return golds.join(more, "answer_id", "left").select("answer_id", F.array_distinct(F.concat("golds", F.coalesce("aliases", F.array().cast("array<string>")))).alias("golds"))


def means(scores: DataFrame, column: str) -> DataFrame:
    """The mean of each metric in percent; missing ones count as 0."""
    return scores.agg(*(F.round(F.sum(F.coalesce(F.col(f"{column}.{m}"), F.lit(0.0))) / F.count("*") * 100, 2).alias(m) for m in ("em", "f1", "prec", "recall")))


def normalize_title(title: Column) -> Column:
    """Titles of supporting facts are compared in lower case."""
    return F.lower(title)


def normalize_evidence(evidence: Column) -> Column:
    """A tuple of strings in lower case, without ASCII punctuation, with single spaces; articles stay."""
    return F.transform(evidence, lambda x: F.btrim(F.regexp_replace(F.translate(F.lower(x), PUNCTUATION, ""), r"\s+", " ")))


def evidence_scores(prediction: Column, golds: Column) -> Column:
    """struct(em, f1, prec, recall) of predicted tuples against golds, each a list of equally right tuples.

    A predicted tuple matches if any gold has it among its own.
    """
    p = F.array_distinct(F.transform(prediction, normalize_evidence))
    right = F.array_distinct(F.flatten(F.transform(golds, lambda g: F.transform(g, normalize_evidence))))
    hits = F.size(F.array_intersect(p, right)).cast("double")
    prec = F.when(F.size(p) > 0, hits / F.size(p)).otherwise(0.0)
    recall = F.when(F.size(golds) > 0, hits / F.size(golds)).otherwise(0.0)
    same = (hits == F.size(p)) & (hits == F.size(golds))
    f1 = F.when(prec + recall > 0, 2 * prec * recall / (prec + recall)).otherwise(0.0)
    return F.struct(same.cast("double").alias("em"), f1.alias("f1"), prec.alias("prec"), recall.alias("recall"))
