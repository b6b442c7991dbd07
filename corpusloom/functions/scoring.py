"""Ranking signals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import glob_regex


def recency(mtime: Column, now: int, half_life_days: float) -> Column:
    """0.5 ** (age / half life), age in days and not negative; 1 without a half life or time."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (F.lit(now) - mtime) / 86400.0) / half_life_days), F.lit(1.0))


def feedback_boost(good: Column, bad: Column) -> Column:
    g, b = F.coalesce(good, F.lit(0)), F.coalesce(bad, F.lit(0))
    return F.when(g + b == 0, 1.0).otherwise(0.7 + 0.6 * (g + 1) / (g + b + 2))


def backlink_boost(n: Column, weight: float) -> Column:
    return 1.0 + weight * F.log2(1.0 + F.coalesce(n, F.lit(0)))


def read_boost(n: Column, weight: float) -> Column:
    return 1.0 + weight * F.sqrt(F.coalesce(n, F.lit(0)).cast("double"))


def final_score(base: Column, recent: Column, weight: float, feedback: Column) -> Column:
    return base * (1.0 + recent * weight) * feedback


def path_boost(path: Column, rules: list[tuple[str, float]]) -> Column:
    """Factor of the first rule (glob, factor) that matches; 1 if none does."""
    out = F.when(F.lit(False), 1.0)
    for glob, factor in rules:
        out = out.when(path.rlike(glob_regex(glob, False)), factor)
    return out.otherwise(1.0)


def bm25_term(tf: Column, dl: Column, df: Column, n_docs: float, avg_dl: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """Okapi weight of one term in one text."""
    idf = F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 for vectors of different or no length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if a norm is 0 or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def sign_bits(v: Column) -> Column:
    """Signs of a vector as packed longs, 32 a word."""
    n = F.ceil(F.size(v) / 32).cast("int")
    bit = lambda w: F.aggregate(F.slice(v, w * 32 + 1, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), bit)


def hamming_similarity(a: Column, b: Column, bits: Column) -> Column:
    """1 - share of differing bits of packed words; 0 for different lengths."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), 1.0 - differing / bits).otherwise(0.0)
