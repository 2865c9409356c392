"""Vectors as arrays, with higher-order functions: no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.config import DEFAULTS, Settings


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda p: p["x"] / F.greatest(p["n"], F.lit(1e-12)))


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms of equal length."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(1 - both / F.sqrt(total(a) * total(b)), F.lit(0.0)))


def tag_blend(confidence: Column, rank: Column, s: Settings = DEFAULTS) -> Column:
    return F.round(s.tag_weight * confidence + (1 - s.tag_weight) * rank, 3)


def search_score(similarity: Column, overlap: Column, s: Settings = DEFAULTS) -> Column:
    return F.round(similarity + s.keyword_bonus * overlap, 3)
