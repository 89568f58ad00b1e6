"""Scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-life in hours; default weights of vector, recency, importance, authority, confidence.
HALF_LIFE_HOURS = 72
WEIGHTS = {"vector": 0.45, "recency": 0.20, "importance": 0.15, "authority": 0.10, "confidence": 0.10}
MAX_AUTHORITY = 4


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def age_hours(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 3.6e9


def recency(then: Column, now: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    """1 for now, half after half_life hours; the future counts as now."""
    return F.exp(F.lit(-math.log(2)) * F.greatest(age_hours(then, now), F.lit(0.0)) / half_life)


def authority(level: Column) -> Column:
    return F.least(F.greatest(level, F.lit(1)), F.lit(MAX_AUTHORITY)) / MAX_AUTHORITY


def final_score(vector: Column, recency_: Column, importance: Column, authority_: Column, confidence: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum; without a vector score its weight goes to the others in proportion.  Not
    rounded: round where it is shown, once."""
    rest = sum(w for k, w in weights.items() if k != "vector")
    others = recency_ * weights["recency"] + importance * weights["importance"] + authority_ * weights["authority"] + confidence * weights["confidence"]
    scale = (weights["vector"] + rest) / rest if rest else 0.0
    return F.when(vector.isNull(), others * scale).otherwise(F.least(F.greatest(vector, F.lit(0.0)), F.lit(1.0)) * weights["vector"] + others)


def dot(a: Column, b: Column) -> Column:
    """The scalar product in double; null if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if a norm is 0; null for a null vector or unequal lengths."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def boost(count: Column, factor: float = 0.05) -> Column:
    return F.log1p(count) * factor


def keyword_ratio(content: Column, query: Column) -> Column:
    """The share of the query's words that are part of the content, both lower-cased."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.lower(content).contains(w)))
    return hits / F.greatest(F.size(words), F.lit(1))


def tag(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), " ", "_"), 1, 20)


def path_label(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """A deterministic unit vector of a text: hashes of (text, place) as numbers in [-1, 1)."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64(text, i) / F.lit(float(2**63)))
    return F.transform(raw, lambda x: (x / norm(raw)).cast("float"))
