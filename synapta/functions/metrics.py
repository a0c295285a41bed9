"""Answer metrics as Column builders: multiset overlap by counting in arrays, no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dropped articles, and what counts as a refusal.
ARTICLES = r"\b(a|an|the|and)\b"
REFUSALS = r"no information|not mentioned"


def normalize(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, ARTICLES, " "), r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda x: x != "")


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def f1(prediction: Column, gold: Column) -> Column:
    p, g = answer_tokens(prediction), answer_tokens(gold)
    same = common(p, g).cast("double")
    precision, recall = same / F.size(p), same / F.size(g)
    return F.when(same == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def f1_multi(prediction: Column, gold: Column) -> Column:
    """Mean over the gold parts of the best F1 of a predicted part."""
    golds, predictions = F.array_distinct(F.split(gold, ",")), F.split(prediction, ",")
    best = F.transform(golds, lambda g: F.array_max(F.transform(predictions, lambda p: f1(p, g))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(golds)


def exact_match(prediction: Column, gold: Column) -> Column:
    return F.array_sort(F.array_distinct(answer_tokens(prediction))) == F.array_sort(F.array_distinct(answer_tokens(gold)))


def bleu1(prediction: Column, gold: Column) -> Column:
    p, g = answer_tokens(prediction), answer_tokens(gold)
    short = F.when(F.size(p) < F.size(g), F.exp(1 - F.size(g) / F.nullif(F.size(p), F.lit(0)))).otherwise(1.0)
    return F.when(F.size(p) == 0, 0.0).otherwise(short * common(p, g) / F.nullif(F.size(p), F.lit(0)))


def category_f1(prediction: Column, gold: Column, category: Column) -> Column:
    """Several answers for category 1, refusals for 5, the first reading for 3, else token F1."""
    first = F.when(category == 3, F.trim(F.split(gold, ";")[0])).otherwise(gold)
    refused = F.when(F.lower(prediction).rlike(REFUSALS), 1.0).otherwise(0.0)
    return F.when(category == 1, f1_multi(prediction, first)).when(category == 5, refused).otherwise(f1(prediction, first))
