"""Mergeable sketches as columns: distinct values and quantiles of data that arrives in parts.

A sketch is made inside tasks and merged between them, so no group is gathered and its size does not grow with the
data: at most some 16 KB for distinct values, some 10 KB for quantiles. Each part is stored once, under its name;
the report merges what is stored and reads no row again.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.sources.publish import publish_folder

LOG_BUCKETS = 14
WIDTH = 400


def distinct_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative standard error of a merged estimate of distinct values."""
    return 1.04 / 2 ** (log_buckets / 2)


def rank_error(width: int = WIDTH) -> float:
    """Error of a quantile's rank, as a share of the rows, that 99 of 100 estimates keep (the library's published fit)."""
    return 2.296 / width**0.9723


def value_sketches(df: DataFrame, group: Sequence[str], distinct: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n_rows``, a distinct sketch of each column of ``distinct``, and exact sum, count, least and
    largest value and a quantile sketch of each whole-numbered column of ``numeric``.

    Nulls take no part but count as rows; null groups are groups. Without ``group`` there is one row, for an empty table too.
    """
    made = [F.count(F.lit(1)).alias("n_rows")]
    for name in distinct:
        made.append(F.hll_sketch_agg(name, LOG_BUCKETS).alias(f"{name}_distinct"))
    for name in numeric:
        value = F.col(name).cast("long")
        made += [
            F.sum(value).alias(f"{name}_sum"),
            F.count(value).alias(f"{name}_count"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
            F.kll_sketch_agg_bigint(value, WIDTH).alias(f"{name}_quantiles"),
        ]
    return df.groupBy(*group).agg(*made)


def merge_sketches(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of ``value_sketches`` of several parts, or of finer groups, as one row per group."""
    merged = []
    for name in parts.columns:
        if name in group:
            continue
        if name.endswith("_distinct"):
            merged.append(F.hll_union_agg(name).alias(name))
        elif name.endswith("_quantiles"):
            merged.append(F.kll_merge_agg_bigint(name, WIDTH).alias(name))
        elif name.endswith("_min"):
            merged.append(F.min(name).alias(name))
        elif name.endswith("_max"):
            merged.append(F.max(name).alias(name))
        elif name == "n_rows" or name.endswith(("_sum", "_count")):
            merged.append(F.sum(name).alias(name))
    return parts.groupBy(*group).agg(*merged)


def quantile(name: str, share: float) -> Column:
    """Estimated value at ``share`` of the rows; null for a group without values."""
    sketch = F.col(f"{name}_quantiles")
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(share)))


def n_distinct(name: str) -> Column:
    return F.hll_sketch_estimate(f"{name}_distinct")


def mean(name: str) -> Column:
    """Exact mean."""
    return F.when(F.col(f"{name}_count") > 0, F.col(f"{name}_sum") / F.col(f"{name}_count"))


def store_part(sketches: DataFrame, path: str, part: str) -> bool:
    """Store the sketches of one arrival of data under its name; False, and nothing changed, if that is stored already."""
    return publish_folder(sketches.sparkSession, f"{path.rstrip('/')}/part={part}", lambda p: sketches.write.parquet(p))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All stored parts, not merged yet, with the name of each in ``part``."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/part=*")
