"""Fixed-size batches padded to their longest member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textforge.operators.ordering import number_rows
from textforge.operators.sampling import row_hash
from textforge.operators.tokens import IGNORED, PAD_ID
from textforge.session import materialise


def pad_right(values: Column, length: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(length - F.size(values), F.lit(0))))


def assign_batches(
    df: DataFrame, key: str, batch_size: int = 4, seed: int = 42, drop_last: bool = False, row: str | None = None
) -> DataFrame:
    """``(key, batch_id, batch_length)``: a narrow table, so no token array is shuffled here.

    Needs ``n_tokens``. Batches are consecutive in seeded hash order of the key, null keys and repeated ones included;
    with ``drop_last`` the one incomplete batch at the end goes, as a training loop over equal batches wants it.
    ``row`` names a column that tells rows with one key apart; it orders them and comes along.
    """
    named = [key, *([row] if row else [])]
    hashed = df.select(*named, "n_tokens", row_hash(F.col(key), seed).alias("_h"))
    numbered = number_rows(hashed, "_h", F.col(key).cast("string"), *named[1:], name="ordinal")
    placed = numbered.withColumn("batch_id", F.expr(f"ordinal div {int(batch_size)}"))
    # A batch holds batch_size rows at most, so this window cannot grow with the table.
    batch = W.partitionBy("batch_id")
    sized = placed.withColumn("batch_length", F.max("n_tokens").over(batch))
    if drop_last:
        sized = sized.withColumn("_n", F.count(F.lit(1)).over(batch)).where(F.col("_n") == batch_size)
    return sized.select(*named, "batch_id", "batch_length")


def pad_batches(
    df: DataFrame,
    key: str,
    batch_size: int = 4,
    pad_id: int = PAD_ID,
    seed: int = 42,
    drop_last: bool = False,
) -> DataFrame:
    """Batch id and right-padded arrays for every row; keys may be null or repeat.

    The arrays are written once, with a number per row that is no more than a name. Lengths are ranked apart from them,
    and the arrays are shuffled once, by that number, to meet their batch.
    """
    row = "_row"
    arrays = ("input_ids", "attention_mask", "labels")
    rows = materialise(df.select(key, *arrays).withColumn(row, F.monotonically_increasing_id()), "batch-rows")
    lengths = rows.select(key, row, F.size("input_ids").alias("n_tokens"))
    batches = assign_batches(lengths, key, batch_size, seed, drop_last, row).drop(key)
    length = F.col("batch_length")
    fillers = dict(zip(arrays, (pad_id, 0, IGNORED)))
    return rows.join(batches, row).select(key, "batch_id", *[pad_right(F.col(a), length, fillers[a]).alias(a) for a in arrays])
