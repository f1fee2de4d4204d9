"""Seeded subsets, exact splits, ranks and reports.

The order is the seeded hash of the row key, then the key, then the hash of the whole row; a null key is a
key. Picking the k smallest never sorts the table: counts per hash prefix narrow the k-th position down to
one hash, for every k in the same way, and the table is then filtered by comparing with it. Rows that
are equal in all of this are interchangeable, so of those only as many are taken as are wanted.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textforge.functions.hashing import HEX_DIGITS, bucket_of, seeded_hash
from textforge.operators.ordering import number_rows
from textforge.options import SampleCount

CUT_DIGITS = 3  # at most 4,096 counts reach the driver per narrowing step
RANK_DIGITS = 4  # 65,536 buckets to rank in


@dataclass(frozen=True)
class Cut:
    """The k-th smallest hash: how many rows lie below it, and how many of those with it are wanted."""

    total: int
    hashed: str = ""
    tied: int = 0
    wanted: int = 0
    everything: bool = False
    nothing: bool = False

    @property
    def whole(self) -> bool:
        """All rows with the cut's hash are wanted, so comparing hashes is enough."""
        return self.everything or self.nothing or self.tied == self.wanted

    def keeps(self, hashed: Column) -> Column:
        """Rows up to the cut; those with its hash are included."""
        return F.lit(self.everything) if self.everything or self.nothing else hashed <= self.hashed


def row_hash(key: Column, seed: int) -> Column:
    """The seeded hash of a key that may be null."""
    return F.coalesce(seeded_hash(key, seed), seeded_hash(F.lit("\0null"), seed))


def find_cut(df: DataFrame, key: str, seed: int, k: int | None = None, fraction: float | None = None) -> Cut:
    """Locate the k-th smallest hash; ``fraction`` asks for ``ceil(fraction * rows)``.

    Every step counts rows per next digits of the hash below the prefix found so far, until one hash
    is left: three steps for any table whose hashes differ in their first nine digits.
    """
    hashed = df.select(row_hash(F.col(key), seed).alias("h"))
    prefix, total, want = "", None, k
    while len(prefix) < HEX_DIGITS:
        inside = hashed.where(F.col("h").startswith(prefix)) if prefix else hashed
        counted = (
            inside.groupBy(bucket_of(F.col("h"), CUT_DIGITS, len(prefix)).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
            .collect()
        )
        counts = sorted((r["b"], r["n"], r["low"], r["high"]) for r in counted)
        if total is None:
            total = sum(n for _, n, _, _ in counts)
            want = math.ceil(fraction * total) if fraction is not None else k
            if want >= total:
                return Cut(total, everything=True)
            if want <= 0:
                return Cut(total, nothing=True)
        for bucket, n, low, high in counts:
            if want <= n:
                prefix += bucket
                break
            want -= n
        if low == high:
            return Cut(total, low, n, want)
    return Cut(total, prefix, n, want)


def select_subset(df: DataFrame, n: SampleCount, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all of them if there are fewer), the same for every partitioning.

    Keys may repeat or be null. Asking for more rows than there are gives a warning.
    """
    cut = subset_cut(df, n, key, seed)
    return df if cut is None else take_cut(df, cut, key, seed)


def subset_cut(df: DataFrame, n: SampleCount, key: str, seed: int = 42) -> Cut | None:
    """Where ``n`` rows end; None if all are wanted."""
    if n is None or n == "all":
        return None
    cut = find_cut(df, key, seed, k=int(n))
    if int(n) > cut.total:
        warnings.warn(f"{n} samples requested, {cut.total} available; using all of them")
    return cut


def take_cut(df: DataFrame, cut: Cut, key: str, seed: int) -> DataFrame:
    """The rows up to the cut, exactly as many as it wants of those that tie with it."""
    hashed = row_hash(F.col(key), seed)
    if cut.whole:
        return df.where(cut.keeps(hashed))
    # Rows of one key tie, and may be much of the table: they are numbered by ranges of their own hash, not sorted in one task.
    # Equal rows are interchangeable; the last column only keeps them from sharing a range.
    tied = df.where(hashed == cut.hashed).withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_any", F.monotonically_increasing_id())
    ties = number_rows(tied, "_tie", "_any", name="_place").where(F.col("_place") < cut.wanted)
    return df.where(hashed < cut.hashed).unionByName(ties.select(*df.columns))


def present_splits(df: DataFrame, names: Sequence[str], split: str = "split") -> set[str]:
    """Which of these splits have rows, in one pass that returns one row."""
    flags = df.agg(*[F.max((F.col(split) == n).cast("int")).alias(n) for n in names]).first()
    return {n for n in names if flags[n]}


def split_validation(
    df: DataFrame,
    key: str,
    val_size: float = 0.05,
    seed: int = 42,
    split: str = "split",
    always: bool = False,
) -> DataFrame:
    """Move ``ceil(val_size * n)`` train rows to ``validation``, unless such a split exists.

    A split called ``val`` is renamed. The result is a row-local projection: no shuffle.
    With ``always`` the train rows are split even if a validation split exists already,
    which then gives way to the new one.
    """
    if always:
        df = df.where(~F.col(split).isin("validation", "val"))
    else:
        present = present_splits(df, ["validation", "val"], split)
        if "validation" in present:
            return df
        if "val" in present:
            renamed = F.when(F.col(split) == "val", F.lit("validation")).otherwise(F.col(split))
            return df.withColumn(split, renamed)
    is_train = F.col(split) == "train"
    cut = find_cut(df.where(is_train), key, seed, fraction=val_size)
    if not cut.whole:
        raise ValueError(f"{key} must be unique: {cut.tied} rows share the key at the border of the validation split")
    chosen = is_train & cut.keeps(row_hash(F.col(key), seed))
    return df.withColumn(split, F.when(chosen, F.lit("validation")).otherwise(F.col(split)))


def split_report(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and percentage of all rows per split."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    # One row per split is left here, so the total may be a plain window.
    share = F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()) * 100
    return counts.withColumn("pct", share)


def first_n(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a named order; 0 or None means no limit."""
    return df.orderBy(*order).limit(n) if n else df


def first_n_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group; rows with equal ``order`` follow by the hash of the row.

    Groups are cut within salted parts first, so a group holding much of the table is sorted by many
    tasks. The second step sees at most ``salts * n`` rows of a group.
    """
    rank, hashed, salt = "_rank", "_hash", "_salt"
    total = [*order, hashed]
    salted = W.partitionBy(*groups, salt).orderBy(*total)
    whole = W.partitionBy(*groups).orderBy(*total)
    # The row is hashed once; its hash deals it to a salt, breaks ties, and goes along to the second step.
    rows = df.withColumn(hashed, F.xxhash64(*df.columns)).withColumn(salt, F.pmod(F.col(hashed), F.lit(salts)))
    parts = rows.withColumn(rank, F.row_number().over(salted)).where(F.col(rank) <= n).drop(salt, rank)
    return parts.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n).drop(rank, hashed)


def with_ordinal(df: DataFrame, key: str, seed: int = 42, name: str = "ordinal") -> DataFrame:
    """Number all rows 0, 1, 2, ... in seeded hash order without a single-task window.

    Rows are ranked inside 65,536 hash buckets, which stay even because keys are unique; the
    number of rows in lower buckets is added from a table with one row per bucket, small enough
    to broadcast at any scale.
    """
    tagged = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn(
        "_b", bucket_of(F.col("_h"), RANK_DIGITS)
    )
    below = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        df.select(bucket_of(seeded_hash(F.col(key), seed), RANK_DIGITS).alias("_b"))
        .groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_b", F.coalesce(below, F.lit(0)).alias("_below"))
    )
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", F.col(key).cast("string")))
    return (
        tagged.withColumn("_r", inside)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col("_below") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_below")
    )


def extremes(df: DataFrame, label: str, value: str) -> DataFrame:
    """Largest and smallest value with their labels, and the mean; the first label wins ties."""
    top = F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))
    bottom = F.min(F.struct(F.col(value).alias("v"), F.col(label).alias("l")))
    return df.agg(
        top.alias("t"), bottom.alias("b"), F.avg(value).alias("mean_value")
    ).select(
        F.col("t.l").alias("largest"),
        (-F.col("t.v")).alias("largest_value"),
        F.col("b.l").alias("smallest"),
        F.col("b.v").alias("smallest_value"),
        "mean_value",
        (-F.col("t.v") - F.col("b.v")).alias("value_range"),
    )
