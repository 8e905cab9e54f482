"""Text as column expressions: normalisation, tokens, token sets, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to a blank, blanks collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def tokens(c: Column) -> Column:
    """Lower-cased ASCII word tokens, in order."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def raw_tokens(c: Column) -> Column:
    r"""Tokens between runs of \W (ASCII), case kept: the second analyser."""
    return F.array_remove(F.split(c, "[^A-Za-z0-9_]+"), "")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalise(c), " "), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(part: Column, whole: Column) -> Column:
    """The share of ``part``'s distinct tokens that ``whole`` has; 0 where it has none."""
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def unit(v: Column) -> Column:
    """A vector of length 1 in the same direction; null where the norm is zero. Arrays of one element bind the norm, so that it is made once."""
    bound = F.transform(F.array(v), lambda x: F.struct(x.alias("x"), F.sqrt(dot(x, x)).alias("n")))
    made = F.transform(bound, lambda b: F.when(b["n"] > 0, F.transform(b["x"], lambda y: y.cast("double") / b["n"])))
    return F.get(made, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """Indel-like similarity from 0 to 100 by Levenshtein distance over the longer string."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def token_sort(c: Column) -> Column:
    """The tokens in alphabetical order, joined by blanks."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def estimated_tokens(c: Column) -> Column:
    """A model-free token count: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def scrub_binds(c: Column) -> Column:
    """Prose without mentions of bind parameters (:name, but not ::type): each becomes "a literal value". Applying it twice changes nothing more."""
    return F.regexp_replace(c, r"(?<![:\w]):[a-zA-Z_][a-zA-Z0-9_]*\b", "a literal value")
