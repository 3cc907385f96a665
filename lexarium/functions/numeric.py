"""Vectors, decay functions, sizing of Bloom filters; columns and driver-side arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import AUTHORITY_WEIGHTS, looked_up
from .text import c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; 0 for vectors of different length."""
    total = F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(c(a)) == F.size(c(b)), total).otherwise(F.lit(0.0))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance; infinite for vectors of different length."""
    squares = F.aggregate(F.zip_with(c(a), c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(c(a)) == F.size(c(b)), F.sqrt(squares)).otherwise(F.lit(float("inf")))


def age_decay(day: Column | str, as_of: Column, citations: Column | str, rate: float = 0.1) -> Column:
    """exp(-rate * years), half as much again for more than 50 citations."""
    years = F.datediff(as_of, c(day)) / F.lit(365.25)
    return F.exp(-rate * years) * F.when(c(citations) > 50, 1.5).otherwise(1.0)


def half_life(day: Column | str, as_of: Column, days: float = 365) -> Column:
    return F.exp(F.lit(-math.log(2) / days) * F.greatest(F.lit(0), F.datediff(as_of, c(day))))


def decay(day: Column | str, as_of: Column, kind: str = "exponential", scale: float = 365.0) -> Column:
    """Exponential (half-life), linear (to 0 after scale days) or logarithmic decay; 1 for the day itself and later."""
    d = F.datediff(as_of, c(day)).cast("double")
    forms = {"linear": F.greatest(F.lit(0.0), 1 - d / scale), "logarithmic": 1 / (1 + F.log1p(d / scale))}
    return F.when(d <= 0, F.lit(1.0)).otherwise(forms.get(kind, F.exp(-math.log(2) / scale * d)))


def authority(court: Column | str, citations: Column | str) -> Column:
    return looked_up(court, AUTHORITY_WEIGHTS, 1.0) * (1 + 0.1 * F.log1p(c(citations).cast("double")))


def bloom_size(capacity: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a capacity and a false-positive rate."""
    bits = int(-capacity * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, int(bits / capacity * math.log(2)))


def bloom_rate(bits: int, hashes: int, items: int) -> float:
    """The false-positive rate that a filter with so many items has."""
    return (1 - math.exp(-hashes * items / bits)) ** hashes if items else 0.0
