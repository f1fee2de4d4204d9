"""Operational checks of generated texts: format, length, emptiness."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions.text import is_blank

# Section heads of an answer, in their order.
SECTION_MARKERS = ("Certainly!", "[ INGREDIENTS ]", "[ DIRECTIONS ]")


def sections_in_order(text: Column, markers: Sequence[str] = SECTION_MARKERS) -> Column:
    """All section heads are there, each after the one before: one ordered pattern over the text."""
    pattern = "(?s)" + ".*?".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in m) for m in markers)
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def output_report(
    df: DataFrame,
    group: Sequence[str],
    text: str = "prediction",
    markers: Sequence[str] = SECTION_MARKERS,
    exact_quantiles: bool = False,
) -> DataFrame:
    """Format compliance, empty outputs and length distribution per group.

    Quantiles are sketches by default, so no group's lengths are gathered in one task.
    """
    measured = df.select(
        *group,
        sections_in_order(F.col(text), markers).cast("int").alias("ok"),
        F.coalesce(is_blank(F.col(text)), F.lit(True)).cast("int").alias("empty"),
        F.length(F.coalesce(text, F.lit(""))).alias("chars"),
        F.coalesce(F.regexp_count(F.lower(F.col(text)), F.lit("[a-z0-9]+")), F.lit(0)).alias("n_words"),
    )
    quantile = F.percentile if exact_quantiles else (lambda c, p: F.percentile_approx(c, p, 10_000))
    return measured.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.avg("ok").alias("format_rate"),
        F.avg("empty").alias("empty_rate"),
        F.avg("chars").alias("mean_chars"),
        F.avg("n_words").alias("mean_words"),
        F.min("chars").alias("min_chars"),
        quantile("chars", 0.5).cast("double").alias("median_chars"),
        F.max("chars").alias("max_chars"),
    )
