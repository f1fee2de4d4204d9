"""Greedy cosine matching of token embeddings."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 2048  # reference tokens compared at a time; bounds the memory of very long texts


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def best_matches(candidate, reference) -> tuple[float, float, float]:
    """Mean best similarity per candidate token, per reference token, and their harmonic mean."""
    if candidate is None or reference is None or len(candidate) == 0 or len(reference) == 0:
        return 0.0, 0.0, 0.0
    left, right = _unit(candidate), _unit(reference)
    row_best = np.full(len(left), -np.inf)
    column_best = np.full(len(right), -np.inf)
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            similar = left[i : i + TILE] @ right[j : j + TILE].T
            np.maximum(row_best[i : i + TILE], similar.max(axis=1), out=row_best[i : i + TILE])
            np.maximum(column_best[j : j + TILE], similar.max(axis=0), out=column_best[j : j + TILE])
    precision, recall = float(row_best.mean()), float(column_best.mean())
    total = precision + recall
    return precision, recall, 2 * precision * recall / total if total else 0.0


SCORE_FIELDS = [T.StructField(n, T.DoubleType()) for n in ("bert_precision", "bert_recall", "bert_f1")]


@F.pandas_udf(T.StructType(SCORE_FIELDS))
def _match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in batches:
        rows = [best_matches(a, b) for a, b in zip(left, right)]
        yield pd.DataFrame(rows, columns=["bert_precision", "bert_recall", "bert_f1"], dtype="float64")


def greedy_match(
    df: DataFrame, keys: Sequence[str], candidate: str = "candidate", reference: str = "reference"
) -> DataFrame:
    """Precision, recall and F1 per pair of ``ARRAY<ARRAY<FLOAT>>`` token embeddings.

    Both matrices sit in one row, as an embedder returns them, so pairs of tokens are never
    rows: a pair is one tiled matrix product inside its task.
    """
    return df.select(*keys, _match(candidate, reference).alias("s")).select(*keys, "s.*")


def match_corpus(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Means of the per-pair scores; the mean F1 is a mean of F1 values."""
    return scores.groupBy(*group).agg(
        F.avg("bert_precision").alias("bert_precision"),
        F.avg("bert_recall").alias("bert_recall"),
        F.avg("bert_f1").alias("bert_f1"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def embed_and_match(
    df: DataFrame,
    keys: Sequence[str],
    make_embedder,
    prediction: str = "prediction",
    reference: str = "reference",
    batch_size: int = 32,
) -> DataFrame:
    """Embed both texts with a user function (list of texts to list of matrices) and match them.

    The embedder gets ``batch_size`` texts of each side at a time, and their matrices are released
    before the next ones; just three numbers per pair leave the task.
    """
    keys = list(keys)
    source = df.select(*keys, F.col(prediction).alias("_p"), F.col(reference).alias("_r"))
    fields = [df.schema[k] for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        for batch in batches:
            texts = batch["_p"].fillna("").tolist(), batch["_r"].fillna("").tolist()
            rows = []
            for at in range(0, len(batch), batch_size):
                left, right = (embed(side[at : at + batch_size]) for side in texts)
                rows += [best_matches(a, b) for a, b in zip(left, right)]
            scores = pd.DataFrame(rows, columns=["bert_precision", "bert_recall", "bert_f1"], dtype="float64")
            yield pd.concat([batch[keys].reset_index(drop=True), scores], axis=1)

    return source.mapInPandas(run, T.StructType(fields + SCORE_FIELDS))
