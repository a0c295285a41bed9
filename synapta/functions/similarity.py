"""Set, map and vector similarities as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from synapta.functions.text import word_set


def jaccard_sets(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_sets(word_set(a), word_set(b))


def jaccard_ci(a: Column, b: Column) -> Column:
    return jaccard(F.lower(a), F.lower(b))


def containment(a: Column, b: Column) -> Column:
    """Share of a's words that b has; 0 if a is empty."""
    x, y = word_set(a), word_set(b)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def attribute_similarity(a: Column, b: Column) -> Column:
    """Equal values among shared keys of two maps; 0 without a shared key."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    equal = F.filter(shared, lambda k: a[k] == b[k])
    return F.when(F.size(shared) == 0, 0.0).otherwise(F.size(equal) / F.size(shared))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 for different lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm, F.lit(0.0))))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), value).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a zero vector, infinite for different lengths."""
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(1 - cosine(a, b))
