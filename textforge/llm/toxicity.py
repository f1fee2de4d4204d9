"""Toxicity by cumulative-link ordinal regression (operator 4).

``P(grade <= k) = 1 / (1 + exp(-(cut[k] - w . x)))``: one weight per feature, shared by all grades,
and ascending cuts. Features are words and the first 4 to 7 bytes of longer ones; a word is a run of
letters (ASCII letters and all bytes of other scripts) in lower case, so ``Idiot###`` is ``idiot``.
With n words in a text, a feature that occurs t times counts ``t / sqrt(n)``, and ``sqrt(n)`` is one
more feature, so that the same few hits weigh less in a longer text.

Features are those that occur in significantly more or fewer toxic texts than others (chi-square); they
are counted and picked on Spark. ``labels`` say only toxic or not: grade 0 is not toxic, and toxic
texts get grade 1, 2 or 3 by terciles of the log odds of their features.

The model is fitted on at most ``MAX_TRAIN`` labelled texts (those with the smallest hashes of their
ids) and ``MAX_FEATURES`` features, so what the driver holds is bounded. Scoring is one pass over all
whole texts without a shuffle. ``expected_severity`` is the sum of grade times probability; a text is
``toxic`` if it is ``TOXIC_FROM`` or more.

Null and empty texts have no features and get the severity of the cuts alone. Repeated rows are scored
one by one; repeated labels of one id count as one, the higher one. Without labels, or with labels of
one kind only, there are no features and the model gives the share of toxic labels (none: 1/1000).
Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from textforge.llm import bytes as tb
from textforge.llm.common import map_slices

MAX_TRAIN = 20_000
MAX_FEATURES = 5_000
SIGNIFICANT = 25.0  # chi-square: p < 1e-6, for many words looked at together
PREFIXES = (4, 5, 6, 7)
GRADES = 4
TOXIC_FROM = 0.1  # expected severity; low, as a missed toxic text costs more than a second look
STEPS = 800
RATE = 0.2
SHRINK = 1e-5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NO_LETTER = ~_LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def letter_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features of all words and the text of each, and the number of words per text."""
    starts, ends, of_text = tb.words(data, offsets, _NO_LETTER)
    text, low = tb.owner(of_text), LOWER[data]
    hashes, texts = [tb.span_hashes(low, starts, ends)], [text]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(tb.span_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size))
        texts.append(text[longer])
    return np.concatenate(hashes), np.concatenate(texts), np.diff(of_text)


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # ascending word hashes
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-(self.cuts[None, :] - score[:, None])))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)

    def inputs(self, hashes: np.ndarray, text: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse x: rows, columns, values. The last column is the length of the text."""
        root = np.sqrt(np.maximum(n_words, 1))
        known = np.zeros(0, np.int64)
        if len(self.features) and len(hashes):
            at = np.searchsorted(self.features, hashes)
            at[at == len(self.features)] = 0
            known = np.flatnonzero(self.features[at] == hashes)
        n = len(self.features) + 1
        cells, times = np.unique(text[known] * n + at[known] if len(known) else known, return_counts=True)
        rows = np.concatenate([cells // n, np.arange(len(n_words))])
        columns = np.concatenate([cells % n, np.full(len(n_words), n - 1)])
        return rows, columns, np.concatenate([times / root[cells // n], np.where(n_words, root / 10, 0)])

    def scores(self, hashes: np.ndarray, text: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """w . x of every text."""
        rows, columns, values = self.inputs(hashes, text, n_words)
        return np.bincount(rows, self.weights[columns] * values, minlength=len(n_words))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by gradient ascent on the penalised likelihood; x is ``values`` at (rows, columns).

    Cuts are a first one and the logarithms of the gaps after it, which keeps them in order.
    """
    n, top = len(grades), GRADES - 1
    weights = np.zeros(n_features)
    share = np.clip(np.array([(grades <= k).mean() for k in range(top)]), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    base, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    means = [np.zeros(n_features), np.zeros(1), np.zeros(top - 1)]
    squares = [np.zeros_like(m) for m in means]
    for turn in range(1, STEPS + 1):
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, weights[columns] * values, minlength=n)
        upto = 1 / (1 + np.exp(-(cuts[None, :] - score[:, None])))
        edge = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        chance = np.maximum(edge[np.arange(n), grades + 1] - edge[np.arange(n), grades], 1e-12)
        up, down = slope[np.arange(n), grades + 1] / chance, slope[np.arange(n), grades] / chance
        by_score = down - up
        by_cut = np.array([(up * (grades == k)).sum() - (down * (grades == k + 1)).sum() for k in range(top)]) / n
        moves = (
            np.bincount(columns, by_score[rows] * values, minlength=n_features) / n - SHRINK * weights,
            np.array([by_cut.sum()]),
            np.array([by_cut[k + 1 :].sum() for k in range(top - 1)]) * np.exp(gaps),
        )
        # Steps by running means of gradients and their squares (Adam), falling to zero at the end.
        rate, steps = RATE * (1 - turn / (STEPS + 1)), []
        for mean, square, move in zip(means, squares, moves):
            mean += 0.1 * (move - mean)
            square += 0.01 * (move * move - square)
            steps.append(rate * mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-10))
        weights, base, gaps = weights + steps[0], base + steps[1][0], gaps + steps[2]
    return weights, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _presence(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
    """Features of a slice with the toxic and other texts they occur in."""
    toxic = rows.column(rows.schema.get_field_index("toxic")).to_numpy()
    hashes, text, _ = letter_features(data, offsets)
    order = np.lexsort((text, hashes))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    features, index = np.unique(hashes[new], return_inverse=True)
    in1 = np.bincount(index, toxic[text[new]], minlength=len(features)).astype(np.int64)
    return {"feature": features.view(np.int64), "in1": in1, "in0": np.bincount(index, minlength=len(features)) - in1}


def training_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``(toxic, text)`` of at most ``most`` labelled documents."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # At most `most` rows of two numbers, by the limit above.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def select_features(texts: DataFrame, n1: int, n0: int, most: int = MAX_FEATURES) -> list:
    """At most ``most`` rows ``(feature, in1, in0)`` with the largest significant chi-square."""
    schema = StructType().add("feature", "long").add("in1", "long").add("in0", "long")
    counts = map_slices(texts, _presence, schema).groupBy("feature").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    total = (F.col("in1") + F.col("in0")).cast("double")
    gap = F.col("in1") * (n0 - F.col("in0")) - F.col("in0") * (n1 - F.col("in1"))
    chi = (n1 + n0) * gap.cast("double") * gap / F.greatest(total * ((n1 + n0) - total) * (float(n1) * n0), F.lit(1.0))
    return counts.withColumn("chi", chi).where(F.col("chi") >= SIGNIFICANT).orderBy(F.desc("chi"), "feature").limit(most).collect()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> OrdinalModel:
    texts = training_texts(docs, labels, most)
    n, n1 = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n0 = n - n1
    if not n1 or not n0:
        share = min(max(n1 / max(n, 1), 1e-3), 1 - 1e-3)
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(1), np.log((1 - share) / share) + np.arange(GRADES - 1.0))
    picked = sorted((np.uint64(r["feature"] & (2**64 - 1)), r["in1"], r["in0"]) for r in select_features(texts, n1, n0))
    features = np.array([f for f, _, _ in picked], np.uint64)
    in1, in0 = (np.array([p[k] for p in picked], float) for k in (1, 2))
    empty = OrdinalModel(features, np.zeros(len(features) + 1), np.zeros(GRADES - 1))

    def inputs(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
        cells, columns, values = empty.inputs(*letter_features(data, offsets))
        order = np.argsort(cells, kind="stable")
        ends = np.searchsorted(cells[order], np.arange(len(offsets))).astype(np.int32)
        return {
            "toxic": rows.column(rows.schema.get_field_index("toxic")),
            "columns": pa.ListArray.from_arrays(pa.array(ends), pa.array(columns[order], pa.int32())),
            "values": pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order], pa.float64())),
        }

    schema = StructType().add("toxic", "integer").add("columns", ArrayType(IntegerType())).add("values", ArrayType(DoubleType()))
    table = map_slices(texts, inputs, schema).toArrow()
    toxic = np.asarray(table["toxic"].combine_chunks(), np.int64)
    lists = table["columns"].combine_chunks()
    rows = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    columns = lists.flatten().to_numpy()
    values = table["values"].combine_chunks().flatten().to_numpy()

    odds = np.append(np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1)), 0.0)
    evidence = np.bincount(rows, odds[columns] * values, minlength=len(toxic))
    grades = np.zeros(len(toxic), np.int64)
    bounds = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
    grades[toxic == 1] = 1 + np.searchsorted(bounds, evidence[toxic == 1])
    weights, cuts = fit_ordinal(rows, columns, values, grades, len(features) + 1)
    return OrdinalModel(features, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, severity, expected_severity, toxic`` of every whole text."""

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
        chance = model.probabilities(model.scores(*letter_features(data, offsets)))
        return {
            "doc_id": rows.column(rows.schema.get_field_index(key)),
            "severity": chance.argmax(1).astype(np.int32),
            "expected_severity": chance @ np.arange(GRADES),
            "toxic": chance @ np.arange(GRADES) >= TOXIC_FROM,
        }

    schema = StructType().add("doc_id", docs.schema[key].dataType).add("severity", "integer")
    return map_slices(docs.select(key, text), each, schema.add("expected_severity", "double").add("toxic", "boolean"), text)
