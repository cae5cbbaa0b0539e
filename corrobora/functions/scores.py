"""Scoring expressions of the evidence model as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff(attempts: Column, base: int, cap: int) -> Column:
    """Seconds to rest: the base doubles with each attempt, sixteenfold at most, up to the cap."""
    doubled = F.least(F.lit(16.0), F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    return F.least(F.lit(cap), (doubled * base).cast("int"))


def corroborated(reliabilities: Column) -> Column:
    """The best reliability, raised by each further one with halving weight; at most 99.

    Takes the reliabilities of independent groups in any order.
    """
    falling = F.reverse(F.array_sort(reliabilities))
    start = F.struct(F.element_at(falling, 1).cast("double").alias("s"), F.lit(0.35).alias("w"))
    folded = F.aggregate(
        F.slice(falling, 2, F.greatest(F.size(falling), F.lit(1))),
        start,
        lambda a, r: F.struct((a["s"] + (100.0 - a["s"]) * a["w"] * r / 100.0).alias("s"), (a["w"] / 2).alias("w")),
    )
    return F.least(F.lit(99), F.round(folded["s"]).cast("int"))


def prior(tier: Column, kind: Column, rank: Column, override: Column | None = None) -> Column:
    """A source's prior reliability: by tier and class, less for low priority (25 if it is not listed)."""
    base = F.when(tier == 1, 80).when(tier == 2, 68).otherwise(55)
    extra = F.when(kind == "official", 6).when(kind == "database", 2).when(kind == "wiki", 0).otherwise(-6)
    score = F.coalesce(override, base + extra) if override is not None else base + extra
    return F.greatest(F.lit(0), F.least(F.lit(99), score - F.when(rank.isNull(), 25).otherwise(F.least(F.lit(18), 4 * rank))))


def shrunk(prior_: Column, agreements: Column, samples: Column, failures: Column) -> Column:
    """Prior and observed agreement, by sample size; the prior alone below three samples."""
    fail_rate = F.coalesce(F.try_divide(failures, samples + failures), F.lit(0.0))
    observed = 100.0 * F.try_divide(agreements, samples) * (1 - F.least(F.lit(0.5), fail_rate))
    w = F.least(F.lit(0.65), samples / 60)
    return F.round(F.when(samples < 3, prior_).otherwise(prior_ * (1 - w) + observed * w)).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def decision_score(reliability: Column, independent: Column, rivals: Column) -> Column:
    """The winner's score: less 6 if alone, less a share of each rival (struct: reliability, independent)."""
    top = F.greatest(independent, F.lit(1))
    loss = F.aggregate(
        rivals,
        F.lit(0),
        lambda a, r: a + F.round(r["reliability"] * F.least(F.lit(1.0), r["independent"] / top) * 0.35).cast("int"),
    )
    return F.greatest(F.lit(0), F.least(F.lit(99), reliability - F.when(independent < 2, 6).otherwise(0) - loss))


def image_score(source: Column, width: Column, height: Column, relevant: Column, duplicate: Column) -> Column:
    resolution = F.least(F.lit(1.0), width * height / (1280.0 * 720.0))
    aspect = F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide(width * 1.0, height) - 16.0 / 9) / 2)
    raw = 0.35 * source + 0.30 * resolution + 0.15 * aspect + 0.20 * relevant
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * F.when(duplicate, 0.85).otherwise(1.0))), 2)


def confidence_ladder(authority: Column, witness: Column, others: Column) -> Column:
    """How far one source is believed: it leads for the field, others give the same, or it is known for the field at all."""
    return (
        F.when(authority & (others > 0), 0.95)
        .when(authority, 0.80)
        .when(others > 0, 0.70)
        .when(witness, 0.55)
        .otherwise(0.40)
    )
