"""A deterministic stand-in for a sentence encoder: hashed word counts, L2-normalised. No measure of quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

DIMENSIONS = 384


def embed(c: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<double> of unit length; all zeros for a text without words."""
    places = F.transform(T.tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    start = F.array_repeat(F.lit(0.0), dimensions)
    counts = F.aggregate(places, start, lambda v, p: F.transform(v, lambda x, i: F.when(i == p, x + 1).otherwise(x)))
    # Arrays of one element bind a value, so that counts and norm are made once and not for every element.
    bound = F.transform(
        F.array(counts), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    )
    unit = F.transform(bound, lambda b: F.transform(b["v"], lambda x: F.when(b["n"] > 0, x / b["n"]).otherwise(0.0)))
    return F.get(unit, F.lit(0))
