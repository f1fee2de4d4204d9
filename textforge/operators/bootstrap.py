"""Intervals of mean scores by the Poisson bootstrap.

A replicate draws a weight for every sample from a Poisson distribution of mean 1, which is what drawing with
replacement comes to on large tables, and needs no knowledge of the other rows. The weights are fixed by a hash of
seed, key and replicate: they do not depend on the partitioning, a task that runs again draws the same,
and two models scored on the same samples get the same weights, so their difference has a paired interval.
Weighted sums are added up inside tasks; what is shuffled is one row per task, group and replicate.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200
_HEX = 4  # digits of the hash for one weight; a hash of 32 digits serves 8 replicates
_PER_HASH = 32 // _HEX


def poisson_steps(digits: int = _HEX) -> list[str]:
    """Least hash digits for weights of 1, 2, ...: the distribution function of Poisson(1) in steps of 16 ** -digits."""
    steps, total, term, k = [], 0.0, math.exp(-1), 0
    while True:
        total += term
        step = round(total * 16**digits)
        if step >= 16**digits:
            return steps
        steps.append(f"{step:0{digits}x}")
        k += 1
        term /= k


def replicate_weights(df: DataFrame, keys: Sequence[str], replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Rows of ``df`` once per replicate that draws them, with ``replicate`` and ``weight``; nothing is shuffled."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys]
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts, F.col("_block").cast("string")))
    digits = F.array(*[F.substring(F.col("_hash"), 1 + i * _HEX, _HEX) for i in range(_PER_HASH)])
    weight = sum((F.col("_digits") >= step).cast("int") for step in poisson_steps())
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // _PER_HASH)))).withColumn("_hash", hashed)
    each = blocks.select(*df.columns, "_block", F.posexplode(digits).alias("_place", "_digits"))
    drawn = each.select(*df.columns, (F.col("_block") * _PER_HASH + F.col("_place")).alias("replicate"), weight.alias("weight"))
    return drawn.where((F.col("weight") > 0) & (F.col("replicate") < replicates))


def replicate_means(
    scores: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    group: Sequence[str] = (),
    replicates: int = REPLICATES,
    seed: int = 42,
) -> DataFrame:
    """Weighted mean of every metric per group and replicate; null scores are left out of theirs.

    Rows that repeat a key are drawn together: give the key of the sampled unit. A replicate that draws no row of a
    group (likely in groups of a few rows only) is missing.
    """
    drawn = replicate_weights(scores.select(*dict.fromkeys([*keys, *group, *metrics])), keys, replicates, seed)

    def mean(metric: str) -> Column:
        used = F.sum(F.when(F.col(metric).isNotNull(), F.col("weight")))
        return (F.sum(F.col("weight") * F.col(metric)) / used).alias(metric)

    return drawn.groupBy(*group, "replicate").agg(*[mean(m) for m in metrics])


def _bounds(means: DataFrame, group: Sequence[str], metrics: Sequence[str], level: float) -> DataFrame:
    """Median and both ends of the interval of every metric, in long form."""
    tail = (1 - level) / 2
    long = means.unpivot([*group, "replicate"], list(metrics), "metric", "value")
    at = lambda q: F.percentile("value", F.lit(q))
    return long.groupBy(*group, "metric").agg(
        at(0.5).alias("median"), at(tail).alias("low"), at(1 - tail).alias("high"), F.count("value").alias("replicates")
    )


def score_intervals(
    scores: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    group: Sequence[str] = ("model",),
    replicates: int = REPLICATES,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """``(group, metric, median, low, high, replicates)`` of mean scores, in one pass over ``scores``."""
    return _bounds(replicate_means(scores, keys, metrics, group, replicates, seed), list(group), metrics, level)


def change_intervals(
    scores: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    base: str,
    model: str = "model",
    replicates: int = REPLICATES,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Relative change in percent of every other model against ``base``, paired: both have the weights of the same samples.

    A replicate in which the base's mean is 0 has no relative change.
    """
    means = replicate_means(scores, keys, metrics, [model], replicates, seed)
    others = means.where(F.col(model) != base)
    against = means.where(F.col(model) == base).select("replicate", *[F.col(m).alias(f"_{m}") for m in metrics])
    both = others.join(against, "replicate")  # one row per model and replicate
    changes = [F.when(F.col(f"_{m}") != 0, (F.col(m) - F.col(f"_{m}")) / F.col(f"_{m}") * 100).alias(m) for m in metrics]
    return _bounds(both.select(model, "replicate", *changes), [model], metrics, level)
