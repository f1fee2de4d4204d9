"""Word-overlap and subsequence scores of predictions against references."""

from __future__ import annotations

from collections import Counter
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.lcs import lcs_length, union_hits
from textforge.functions.ngrams import WORD_BREAK, f_measure, spaced_lines, spaced_words, word_sequences, words


def _safe_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _run_counts(tokens: Sequence[str], n: int) -> Counter:
    return Counter(tokens if n == 1 else zip(*(tokens[i:] for i in range(n))))


def _common(left: Counter, right: Counter) -> int:
    if len(left) > len(right):
        left, right = right, left
    return sum(min(count, right[run]) for run, count in left.items() if run in right)


def _pair_counts(sizes: Sequence[int], subsequence: bool):
    """Arrow function from two columns of blank-separated words to the counts scores are made of."""
    names = ["n_pred", "n_ref", *[f"_o{n}" for n in sizes], *(["_lcs"] if subsequence else [])]

    def one(prediction: str, reference: str) -> list[int]:
        p, r = ([w for w in text.split(" ") if w] for text in (prediction, reference))
        common = [_common(_run_counts(p, n), _run_counts(r, n)) for n in sizes]
        return [len(p), len(r), *common, *([lcs_length(p, r)] if subsequence else [])]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            rows = [one(a, b) for a, b in zip(left, right)]
            yield pd.DataFrame(rows, columns=names, dtype="int32")

    return F.pandas_udf(run, T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


def clipped_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two string arrays.

    Both arrays are sorted together, copies from the left (side -1) before equal ones from the
    right (side 1). One pass keeps a balance of left copies not yet matched; each right copy that
    meets a positive balance is a hit. The state is three values, so the cost is that of the
    sort, and nothing is exploded or shuffled.
    """

    def tagged(values: Column, side: int) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(side).alias("s")))

    def state(value: Column, balance: Column, hits: Column) -> Column:
        return F.struct(value.alias("v"), balance.alias("b"), hits.alias("h"))

    def step(acc: Column, x: Column) -> Column:
        matched = F.when((x["s"] > 0) & (acc["b"] > 0), acc["h"] + 1).otherwise(acc["h"])
        again = state(x["v"], acc["b"] - x["s"], matched)
        return F.when(x["v"] == acc["v"], again).otherwise(state(x["v"], -x["s"], acc["h"]))

    both = F.sort_array(F.concat(tagged(left, -1), tagged(right, 1)))
    return F.aggregate(both, state(F.lit(""), F.lit(0), F.lit(0)), step, lambda acc: acc["h"])


def rouge_scores(
    df: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    reference: str = "reference",
    sizes: Sequence[int] = (1, 2),
    subsequence: bool = True,
    pattern: str = WORD_BREAK,
    native: bool = False,
) -> DataFrame:
    """Precision, recall and F per sample for word runs of the given sizes, and optionally for the
    longest common subsequence.

    Both texts of a sample sit in one row, so this is a projection: no shuffle, no key that
    could be hot, and memory for one row at a time. The subsequence needs Python; the texts,
    cleaned in the JVM, go there once per Arrow batch and come back as a few integers, with the
    overlaps counted on the way - several times cheaper than array lambdas, which Spark
    interprets. ``native`` keeps the overlaps in the JVM all the same (no subsequence then).
    """
    if native:
        if subsequence:
            raise ValueError("the subsequence length has no native form")
        split = df.select(
            *keys, words(F.col(prediction), pattern).alias("_p"), words(F.col(reference), pattern).alias("_r")
        )
        overlaps = [
            clipped_overlap(word_sequences(F.col("_p"), n), word_sequences(F.col("_r"), n)).alias(f"_o{n}")
            for n in sizes
        ]
        counted = split.select(*keys, F.size("_p").alias("n_pred"), F.size("_r").alias("n_ref"), *overlaps)
    else:
        count = _pair_counts(tuple(sizes), subsequence)
        counts = count(spaced_words(F.col(prediction), pattern), spaced_words(F.col(reference), pattern))
        counted = df.select(*keys, counts.alias("_c")).select(*keys, "_c.*")

    def runs(total: str, n: int) -> Column:
        return F.greatest(F.col(total) - (n - 1), F.lit(0))

    scored = []

    def add(name: str, hits: Column, n: int) -> None:
        precision = _safe_ratio(hits, runs("n_pred", n))
        recall = _safe_ratio(hits, runs("n_ref", n))
        scored.extend(
            [
                precision.alias(f"{name}_p"),
                recall.alias(f"{name}_r"),
                f_measure(precision, recall).alias(name),
            ]
        )

    for n in sizes:
        add(f"rouge{n}", F.col(f"_o{n}"), n)
    if subsequence:
        add("rougeL", F.col("_lcs"), 1)
    return counted.select(*keys, "n_pred", "n_ref", *scored)


def rouge_lsum(
    df: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    reference: str = "reference",
    pattern: str = WORD_BREAK,
) -> DataFrame:
    """Sentence-wise subsequence score: texts are cut at line breaks, and for every reference
    sentence the subsequences with all predicted sentences are united."""

    @F.pandas_udf("hits int, n_pred int, n_ref int")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            rows = []
            for prediction, reference in zip(left, right):
                p, r = ([[w for w in line.split(" ") if w] for line in text.split("\n")] for text in (prediction, reference))
                rows.append((union_hits(r, p), sum(map(len, p)), sum(map(len, r))))
            yield pd.DataFrame(rows, columns=["hits", "n_pred", "n_ref"], dtype="int32")

    # Cleaned lines travel as one string a text: nested arrays would cost several times the bytes and a list per word.
    counts = count(spaced_lines(F.col(prediction), pattern), spaced_lines(F.col(reference), pattern))
    counted = df.select(*keys, counts.alias("_c")).select(
        *keys, F.col("_c.hits").alias("_hits"), F.col("_c.n_pred").alias("_np"), F.col("_c.n_ref").alias("_nr")
    )
    precision = _safe_ratio(F.col("_hits"), F.col("_np"))
    recall = _safe_ratio(F.col("_hits"), F.col("_nr"))
    return counted.select(
        *keys,
        precision.alias("rougeLsum_p"),
        recall.alias("rougeLsum_r"),
        f_measure(precision, recall).alias("rougeLsum"),
    )


def corpus_scores(scores: DataFrame, metrics: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean of per-sample scores and the number of samples."""
    return scores.groupBy(*group).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("num_samples")
    )
