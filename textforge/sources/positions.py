"""Rows of text files by their position: files that carry no key are matched line by line.

A prediction file has one line per sample, in the order of the samples, and nothing else says which
is whose. Positions come from the data alone: files in the order of their names, and lines in the order
of a file, however Spark splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.session import materialise


def read_lines(spark: SparkSession, path: str | list[str], name: str = "position") -> DataFrame:
    """``(position, value)`` of every line that is not blank, over all files of ``path``.

    A split of a file is read by one task, in order, so a number that grows along a task tells a line's place in its
    split. Lines are written once with it; the position is the place plus the lines of all splits before.
    Lines are not shuffled to be numbered: only the counts, one row per split (about 8,000 for a terabyte), are put in order.
    """
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    lines = text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    numbered = materialise(lines, "lines")
    splits = numbered.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return numbered.join(starts, ["_file", "_block"]).select((F.col("_at") + F.col("_shift")).cast("long").alias(name), "value")


def read_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType, name: str = "position") -> DataFrame:
    """``position`` and the fields of every JSON line. A line that is no JSON object is an error, not a gap."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = read_lines(spark, path, name)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(name, parsed.alias("_r")).select(name, "_r.*")


def align_by_position(samples: DataFrame, records: DataFrame, name: str = "position") -> DataFrame:
    """Samples and records of the same position side by side. Different lengths are an error, before anything is joined.

    Both must be numbered 0, 1, 2, ...; a column of the same name is taken from the samples.
    """
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.max(name).alias("last"), F.count_distinct(name).alias("d")).first() for df in (samples, records)]
    if sizes[0]["n"] != sizes[1]["n"]:
        raise ValueError(f"{sizes[0]['n']} samples, but {sizes[1]['n']} records")
    for what, size in zip(("samples", "records"), sizes):
        if size["n"] and (size["last"] != size["n"] - 1 or size["d"] != size["n"]):
            raise ValueError(f"the {what} are not numbered 0 to {size['n'] - 1}")
    return samples.join(records.drop(*[c for c in records.columns if c != name and c in samples.columns]), name)
