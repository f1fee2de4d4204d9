"""Latest numbered snapshot from a listing of names."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: snapshot names end in a step number.
SNAPSHOT_NAME = r"^checkpoint-(\d+)$"


def snapshot_step(name: Column) -> Column:
    """Step number of a snapshot name, null for other names."""
    digits = F.regexp_extract(name, SNAPSHOT_NAME, 1)
    return F.when(digits != "", digits.cast("long"))


def latest_snapshot(names: DataFrame, name: str, group: Sequence[str] = ()) -> DataFrame:
    """The snapshot with the highest step, by number and not by text; no row if there is none.

    Only the numbers are aggregated, so groups of any size combine inside the tasks first.
    """
    steps = names.select(*group, snapshot_step(F.col(name)).alias("step")).where("step IS NOT NULL")
    latest = steps.groupBy(*group).agg(F.max("step").alias("step")).where("step IS NOT NULL")
    return latest.withColumn("latest", F.concat(F.lit("checkpoint-"), F.col("step").cast("string")))
