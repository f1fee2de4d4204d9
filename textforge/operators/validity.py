"""Row validity and its audit."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.text import is_blank
from textforge.options import FieldMap

# Required columns and the instruction markers.
REQUIRED = ("title", "ingredients", "directions", "prompt")
MARKER_COLUMN = "prompt"
MARKERS = ("[INST]", "[/INST]")


def required_columns(fields: FieldMap) -> tuple[str, ...]:
    """The required columns under a field map."""
    roles = {"title": fields.title, "ingredients": fields.ingredients, "directions": fields.output}
    return tuple(roles.get(c, c) for c in REQUIRED)


def valid(
    df: DataFrame,
    required: Sequence[str] = REQUIRED,
    marker_column: str | None = MARKER_COLUMN,
    markers: Sequence[str] = MARKERS,
) -> Column:
    """True for rows whose required columns hold text and whose prompt holds both markers.

    An absent required column makes every row invalid. Array columns count as blank when empty.
    """

    def filled(name: str) -> Column:
        if name not in df.columns:
            return F.lit(False)
        if isinstance(df.schema[name].dataType, T.ArrayType):
            return F.col(name).isNotNull() & (F.size(name) > 0)
        return F.col(name).isNotNull() & ~is_blank(F.col(name).cast("string"))

    tests = [filled(name) for name in required]
    if marker_column is not None:
        if marker_column in df.columns:
            tests += [F.col(marker_column).contains(m) for m in markers]
        else:
            tests.append(F.lit(False))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def filter_valid(df: DataFrame, enabled: bool = True, **rules) -> DataFrame:
    return df.where(valid(df, **rules)) if enabled else df


def filter_audit(df: DataFrame, split: str = "split", **rules) -> DataFrame:
    """Rows before, kept and removed per split, in one pass with map-side partial counts."""
    flagged = df.select(split, valid(df, **rules).cast("bigint").alias("_ok"))
    return flagged.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.sum("_ok").alias("n_after"),
        (F.count(F.lit(1)) - F.sum("_ok")).alias("n_removed"),
    )
