"""Vector and score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What equal metadata adds to a score.
SAME_URL, SAME_HOST, SAME_METHOD = 0.7, 0.03, 0.01


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths, without components or without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """a at length 1; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def squash(x: Column) -> Column:
    """A score as a probability: as it is from 0 to 1, else by the logistic function."""
    return F.when(x.between(0, 1), x).otherwise(1 / (1 + F.exp(-x)))


def metadata_boost(query: Column, entry: Column) -> Column:
    """What equal url, host and method of two structs add; a value that is missing or empty is equal to none."""
    same = lambda f: F.coalesce((query[f] == entry[f]) & (query[f] != ""), F.lit(False))
    add = lambda f, x: F.when(same(f), x).otherwise(0.0)
    return add("url", SAME_URL) + add("host", SAME_HOST) + add("method", SAME_METHOD)


def hybrid(dense: Column, lexical: Column, boost: Column, dense_weight: float = 0.8, lexical_weight: float = 0.2) -> Column:
    """The weighted mean of the clamped dense score and the lexical score, plus boost, 1 at most."""
    mean = (F.lit(float(dense_weight)) * clamp(dense) + F.lit(float(lexical_weight)) * lexical) / F.lit(float(dense_weight + lexical_weight))
    return F.least(F.lit(1.0), mean + boost)
