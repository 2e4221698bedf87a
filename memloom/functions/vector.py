"""Vector expressions in double precision, and embedders."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Similarity with a small constant in the denominator; pass norms that are already columns."""
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + F.lit(EPSILON))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Embedder(Protocol):
    """Text column to array<double> column."""

    def __call__(self, text: Column) -> Column: ...


class HashedTrigrams:
    """Deterministic embedder: counts of hashed character trigrams of the lower-cased text, length 1. Native expressions only."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
        bucket = lambda p, i: F.conv(F.substring(F.md5(F.substring(p, i, F.lit(3))), 1, 4), 16, 10).cast("int") % self.dim
        buckets = let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: bucket(p, i)))
        every = F.sequence(F.lit(0), F.lit(self.dim - 1))
        counts = let(buckets, lambda found: F.transform(every, lambda k: F.size(F.filter(found, lambda b: b == k)).cast("double")))
        return let(counts, lambda c: let(F.greatest(norm(c), F.lit(EPSILON)), lambda n: F.transform(c, lambda x: x / n)))


def entity_text(name: Column, aliases: Column) -> Column:
    """What retrieval embeds for an entity."""
    return F.concat_ws(" ", name, F.array_join(aliases, " "))


def claim_text(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, relation, object_)


def search_text(name: Column, type_: Column) -> Column:
    """What the mixed search embeds for an entity."""
    return F.concat(name, F.lit(" ("), type_, F.lit(")"))
