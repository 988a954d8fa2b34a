"""Score expressions: BM25, fusion, boosts, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import fixed


#: Fixed: saturation and length normalisation of BM25.
K1, B = 1.5, 0.75


def bm25_weight(tf, length, average):
    """Saturated term frequency with length normalisation, of columns or arrays; average: 1 at least."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log((n - df + 0.5) / (df + 0.5) + 1.0)).otherwise(0.0)


def rrf_part(rank: Column, weight: Column) -> Column:
    return F.when(rank.isNotNull(), weight / (fixed.RRF_K + rank)).otherwise(0.0)


def tier_boost(tier: Column) -> Column:
    out = F
    for name, boost in fixed.TIER_BOOST.items():
        out = out.when(tier == name, boost)
    return out.otherwise(fixed.NO_TIER_BOOST)


def unit_score(score: Column, clamp: bool = False) -> Column:
    """Per cent scores to a share: over 1 means per cent."""
    share = F.when(score > 1, score / 100).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) if clamp else share


def verdict(score: Column, passes: float = 80.0, soft: float = 60.0) -> Column:
    """PASS, SOFT_FLAG or BLOCK by two thresholds."""
    return F.when(score >= passes, "PASS").when(score >= soft, "SOFT_FLAG").otherwise("BLOCK")


def parsed_score(text: Column) -> Column:
    """'85%' is 85; what is no number is 0."""
    return F.coalesce(F.trim(F.regexp_replace(text, "%", "")).try_cast("double"), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(d(a), d(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(d(a), lambda v: v * v))) * F.sqrt(total(F.transform(d(b), lambda v: v * v)))
    return F.when(norm > 0, dot / norm)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v))


def time_ago(then: Column, now: Column) -> Column:
    """Age in words: just now, minutes, hours, days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))
