"""Spark helpers of the operators in this package."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from textforge.llm import bytes as tb
from textforge.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    """Words of a text, counted natively; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no lineage to run again."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_slices(
    df: DataFrame,
    each: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict | None],
    schema: str | StructType,
    text: str = "text",
    limit: int = tb.SLICE_BYTES,
) -> DataFrame:
    """Run ``each(rows, data, offsets)`` over slices of whole texts; it returns columns by name.

    Memory in a task is one Arrow batch and the working arrays of one slice. ``each`` returns
    None for no rows.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, text, limit):
            out = each(rows, data, offsets)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], t) if isinstance(out[n], (list, np.ndarray)) else out[n].cast(t) for n, t in fields],
                    names=[n for n, _ in fields],
                )

    return df.mapInArrow(run, schema)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Null-safe join with a table that is usually small: broadcast if its counted size allows."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])


def is_temporary(name: str) -> bool:
    """Names that operators join under the columns of a table."""
    return name.startswith("_tf_")


def aside(docs: DataFrame, clashes: Callable[[str], bool] = is_temporary) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its clashing columns under names that nothing uses, and the name of each column in it.

    Spark tells names apart without their case, so ``clashes`` is asked for the name in lower case.
    """
    taken = {c.lower() for c in docs.columns}
    names = {}
    for column in docs.columns:
        name = column
        while clashes(name.lower()) or (name != column and name.lower() in taken):
            name = f"in_{name}"
        taken.add(name.lower())
        names[column] = name
    renamed = {c: n for c, n in names.items() if c != n}
    return docs.withColumnsRenamed(renamed) if renamed else docs, names


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, _h, text)``: one id and text, told apart by the hash where an id is repeated or null.

    Rows with the same id and the same text are one document.
    """
    return docs.select(
        F.col(key).alias("doc_id"),
        F.xxhash64(F.col(key), F.col(text)).alias("_h"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def join_identified(docs: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Join on the identity of :func:`identified`, null ids included."""
    other = other.withColumnRenamed("doc_id", "_o_id").withColumnRenamed("_h", "_o_h")
    same = (docs["_h"] == F.col("_o_h")) & docs["doc_id"].eqNullSafe(F.col("_o_id"))
    return docs.join(other, same, how).drop("_o_id", "_o_h")


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest ``n`` such that at most ``most`` rows have it or a higher one.

    Counts fall into bins of one up to 1,024 and of doubling width above, so the histogram is bounded.
    """
    wide = F.lit(1024) + F.floor(F.log2(F.col("n") / 1024)) + 1
    bins = counts.groupBy(F.when(F.col("n") <= 1024, F.col("n")).otherwise(wide).cast("long").alias("bin"))
    sizes = sorted(((r["bin"], r["rows"], r["low"]) for r in bins.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, size, low in sizes:
        if total + size > most:
            break
        total, least = total + size, low
    return least
