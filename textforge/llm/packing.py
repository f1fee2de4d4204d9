"""Packing into optimal length buckets (operator 1).

A text is a sequence of its words and one end token. The lengths of all texts are counted in a
histogram; dynamic programming over it chooses the bucket boundaries with the least padding, where
each sequence is padded to the boundary above it. Inside a bucket, batches hold as many sequences as
fit ``budget`` tokens. Sequences longer than ``budget`` are batches of their own, without padding.

The histogram has one row per length up to ``budget``, so it is bounded by a parameter and not by the
table; only it reaches the driver. Lengths are written once and read for the histogram and for the
batches. Sequences get their number in a bucket from ranks inside hash slots plus the sizes of the
slots before (4,096 rows per bucket at most, broadcast), so a bucket that holds most of the table
is numbered by many tasks, and only ids and lengths move.

Null and empty texts are sequences of one end token. Null ids and repeated rows are sequences like
any other; rows that are equal in all columns get the numbers of their group in any order. An
empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textforge.functions.hashing import bucket_of, seeded_hash
from textforge.llm.common import materialise, n_words

BUDGET = 8_192
BUCKETS = 16
SLOT_DIGITS = 3  # 16**3 hash slots


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the longest length) with the least total padding.

    ``cost(i, j)`` of putting the lengths i+1 .. j in one bucket is their number times the longest;
    the total of all real tokens is fixed, so the least padded total is the least padding. Among equal
    totals the last cut is the smallest one, and fewer buckets win.
    """
    n = len(lengths)
    if not n:
        return []
    length = np.asarray(lengths, np.int64)
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    best = length * upto[1:]
    total, cuts = [best[-1]], [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = np.empty(n, np.int64), np.zeros(n, np.int64)
        new[0] = best[0]
        for j in range(1, n):
            # the last bucket holds lengths i .. j, i >= 1
            costs = best[:j] + length[j] * (upto[j + 1] - upto[1 : j + 1])
            i = int(np.argmin(costs))
            if costs[i] < best[j]:
                new[j], cut[j] = costs[i], i + 1
            else:
                new[j], cut[j] = best[j], -1  # no better with one more bucket
        best = new
        total.append(best[-1])
        cuts.append(cut)
    out, j, k = [], n - 1, len(cuts) - 1
    while True:
        while k and cuts[k][j] == -1:
            k -= 1
        out.append(int(length[j]))
        if not k or cuts[k][j] == 0:
            break
        j, k = int(cuts[k][j]) - 1, k - 1
    return out[::-1]


def sequence_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), (n_words(F.col(text)) + 1).alias("n_tokens"))


def boundaries(lengths: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> list[int]:
    histogram = lengths.where(F.col("n_tokens") <= budget).groupBy("n_tokens").count().collect()
    histogram = sorted((r["n_tokens"], r["count"]) for r in histogram)
    return optimal_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row per sequence: ``doc_id, n_tokens, bucket, padded_tokens, batch, place``.

    ``padded_tokens`` is the boundary of the bucket, ``batch`` counts inside the bucket, ``place``
    inside the batch; a bucket's batches are full but for the last. The number of a sequence follows
    its hash slot and id. Sequences over ``budget`` have the bucket after the last.
    """
    lengths = materialise(sequence_lengths(docs, key, text), "lengths")
    bounds = boundaries(lengths, budget, buckets)
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    own = F.col("n_tokens") > budget
    placed = lengths.select(
        "doc_id",
        "n_tokens",
        F.when(own, F.lit(len(bounds))).otherwise(bucket).cast("int").alias("bucket"),
        F.when(own, F.col("n_tokens")).otherwise(F.get(edges, bucket)).alias("padded_tokens"),
        F.coalesce(bucket_of(seeded_hash(F.col("doc_id"), 0), SLOT_DIGITS), F.lit("")).alias("_slot"),
    )
    sizes = placed.groupBy("bucket", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("bucket").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
    # One row per bucket and slot: bounded by the parameters.
    offsets = sizes.select(F.col("bucket").alias("_b"), F.col("_slot").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("bucket", "_slot").orderBy("doc_id", "n_tokens"))
    numbered = placed.withColumn("_r", inside).join(
        F.broadcast(offsets), (F.col("bucket") == F.col("_b")) & (F.col("_slot") == F.col("_s"))
    )
    number = F.col("_before") + F.col("_r") - 1
    capacity = F.greatest(F.lit(budget) / F.col("padded_tokens"), F.lit(1)).cast("long")
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_tokens",
        F.floor(number / capacity).cast("long").alias("batch"),
        F.pmod(number, capacity).cast("long").alias("place"),
    )
