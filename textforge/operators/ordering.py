"""Global row numbers in a named order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.session import materialise

_PLACE_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in its low bits


def number_rows(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in this order. Nulls come first, as Spark sorts them.

    A range sort deals the rows out, and the numbered table is written once: ties fall in any order, but
    stay as they fell. Of all ranges together only one row each reaches the driver, to add up their sizes. Name a
    last column that tells rows apart if one key may hold much of the table, since equal rows share a range.
    """
    at, part = f"_{name}_at", f"_{name}_part"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialise(placed, "numbered")
    ranges = placed.groupBy(F.shiftright(at, _PLACE_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, starts = 0, []
    for row in sorted(ranges):
        starts.append((row["p"], total))
        total += row["n"]
    table = df.sparkSession.createDataFrame(starts, f"`{part}` long, `{name}` long")
    inside = F.col(at).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = placed.join(F.broadcast(table), F.shiftright(at, _PLACE_BITS) == F.col(part))
    return joined.withColumn(name, F.col(name) + inside).drop(at, part)
