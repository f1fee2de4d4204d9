"""Multiple-choice accuracy from scored choices."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice_score(normalise: bool = False) -> Column:
    """Log-likelihood of a choice, divided by its text length for the normalised variant."""
    if normalise:
        return F.col("loglik") / F.greatest(F.length("choice_text"), F.lit(1))
    return F.col("loglik")


def pick_choices(choices: DataFrame, item: Sequence[str], normalise: bool = False) -> DataFrame:
    """The best-scored choice per item; the lowest index wins ties.

    The running best is one struct per item, kept per task before the shuffle.
    """
    best = F.max(
        F.struct(choice_score(normalise).alias("s"), (-F.col("choice_index")).alias("c"))
    )
    return choices.groupBy(*item).agg(best.alias("b")).select(*item, (-F.col("b.c")).alias("pick"))


def accuracy(picks: DataFrame, group: Sequence[str], gold: str = "gold_index") -> DataFrame:
    hit = (F.col("pick") == F.col(gold)).cast("int")
    return picks.groupBy(*group).agg(
        F.avg(F.coalesce(hit, F.lit(0))).alias("accuracy"), F.count(F.lit(1)).alias("samples")
    )


def macro_average(accuracies: DataFrame, subject: str, configured: int | None = None) -> DataFrame:
    """Unweighted mean over subjects, with observed and configured item counts.

    One row per subject goes in. No subjects give no row.
    """
    return (
        accuracies.agg(
            F.avg("accuracy").alias("accuracy"),
            F.sum("samples").alias("samples"),
            F.count_distinct(subject).alias("n_subjects"),
        )
        .where(F.col("accuracy").isNotNull())
        .withColumn("configured_samples", F.lit(configured).cast("bigint"))
    )
