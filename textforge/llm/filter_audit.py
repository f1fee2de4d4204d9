"""What each filter of a chain removes, in every order of the chain (operator 12).

Five filters judge every whole text; a bit mask says which ones it fails. Texts of one part (a
language) with the same mask are alike for every chain, so a part is its 32 mask cells, counted inside
tasks before anything is shuffled. A walk along the Gray code then visits all 32 sets of filters, one
filter switched on or off at a time: every cell keeps the number of active filters that it fails, and a
cell joins or leaves the running survivors when that counter reaches or leaves zero. The survivors of
the 32 states are stored; each step of each of the 120 orders is a difference of two of them.

The copy filter needs the smallest id of every text. Texts are compared by SHA-256. The smallest id of
a text is a grouped minimum, and it is joined back by text and id together, so neither a text that a
third of the rows share nor an id that many rows repeat gathers in a task.

Null texts are empty: they fail only the word count and, unless theirs is the smallest id, the copy
filter. A row without an id is nobody's copy and nobody's original. Rows that repeat an id are counted
each, and are no copies of each other. Null parts are the part ''. Labels that repeat an id count if any
of them says so; documents without a label are neither good nor toxic. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.llm.common import WORD, materialise

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
MEASURES = ("n", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """What a text fails by itself: too short, too uniform, too many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals.cast("long") > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(doc_id, part, digest, mask)``: one narrow row per document, without the copy filter."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_failures(whole))]
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        sum(bits, F.lit(0)).cast("int").alias("mask"),
    )


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each mask, copies included in the mask."""
    rows = materialise(judged(docs, key, text, part), "audit-rows")
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counted = known.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << COPY)).otherwise(F.lit(0))
    cells = joined.select("part", (F.col("mask") + copy).alias("mask"), "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES[1:]])
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return cells.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def gray_walk(masks: np.ndarray, counts: np.ndarray, n_filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors of every set of filters, indexed by the set's bits: one row of ``counts`` sums each.

    ``masks`` has the failed filters of each cell, ``counts`` what is summed. Set i of the walk is
    i ^ (i >> 1), which differs from the one before in one filter.
    """
    states = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)  # active filters that each cell fails
    survivors = counts.sum(axis=0)
    states[0] = survivors
    active = 0
    for i in range(1, 1 << n_filters):
        flipped = (i & -i).bit_length() - 1
        active ^= 1 << flipped
        hit = np.flatnonzero(masks >> flipped & 1)
        if active >> flipped & 1:
            survivors = survivors - counts[hit[failing[hit] == 0]].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            survivors = survivors + counts[hit[failing[hit] == 0]].sum(axis=0)
        states[active] = survivors
    return states


def chain_report(part: str, states: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """Every step of every order as differences of the stored states."""
    n, full = len(filters), (1 << len(filters)) - 1
    rows, shapley = [], np.zeros(n, np.int64)
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            lost = states[before] - states[after]
            failing = states[0, 0] - states[1 << f, 0]
            alone = states[full ^ 1 << f, 0] - states[full, 0]
            shapley[f] += lost[0]
            rows.append((part, "".join(filters[g] for g in order), step, states[after, 0], lost[0], failing - lost[0], alone, lost[1], lost[2], f))
            before = after
    assert len(rows) == factorial(n) * n
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame([(*r[:-1], shapley[r[-1]]) for r in rows], columns=names)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, as in ``SCHEMA``. A part is 32 rows at most when it is walked."""

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        states = gray_walk(cells["mask"].to_numpy(np.int64), cells[list(MEASURES)].to_numpy(np.int64))
        return chain_report(cells["part"].iloc[0], states)

    return mask_cells(docs, labels, key, text, part).groupBy("part").applyInPandas(walk, SCHEMA)
