"""A vocabulary of dense ids: 0 to V - 1 by frequency, built, stored and looked up on Spark.

Tokens are the native ones, which cover every character, so that decoding gives the text back. The commonest tokens
have the lowest ids. The first ``HEAD`` of them, most of all occurrences whatever the size of the table, go to the tasks
as a dictionary of that bound. Rarer ones are looked up by a join, once for each block of rows that has them, so a token
of every row comes to one task once a block only, and a row moves once, to meet the answers of its block.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textforge.operators.ordering import number_rows
from textforge.operators.tokens import TOKEN_PATTERN, split_tokens
from textforge.session import materialise

HEAD = 1 << 16
BLOCK = 1 << 25  # bytes of text or of ids whose rarer tokens are looked up together; a longer row is a block of its own
_PLACE_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in its low bits
_MOST_TASKS = 1 << 12  # that compose; below it there are four times as many as blocks, so that few blocks share one

#: Lists of values, and what was found for each value of them all in turn (null if nothing), to the values made of them.
Compose = Callable[[pa.Array, pa.Array], pa.Array]


def build_vocabulary(df: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN, min_count: int = 1) -> DataFrame:
    """``(token, n, token_id)``, stored: most frequent first, equal counts by the token's bytes; no gaps.

    Occurrences are counted inside tasks before they are shuffled. Null texts have no tokens.
    """
    tokens = df.select(F.explode(split_tokens(F.col(text), pattern)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return number_rows(counts, F.desc("n"), "token", name="token_id")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return [*zip(edges[:-1], edges[1:])] if len(keys) else []


def _offsets(lists: pa.Array) -> pa.Array:
    """Where each list begins in all values in turn, and their end; null as an empty list."""
    return pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]), pa.int32())


def _in_blocks(rows: DataFrame, size: Column) -> tuple[DataFrame, int]:
    """``rows`` with ``_block``, from 0, in place of ``_row``, and the number of blocks: neighbours of one partition, about ``BLOCK`` bytes by ``size``.

    Only a number and a size of each row are shuffled, and one row of each block reaches the driver.
    """
    part = F.shiftright("_row", _PLACE_BITS)
    before = F.sum("size").over(Window.partitionBy("part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    sized = rows.select("_row", part.alias("part"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    placed = sized.select("part", "_row", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).alias("block"))
    parts: dict[int, list[int]] = {}
    for row in placed.groupBy("part", "block").agg(F.min("_row").alias("begin")).collect():
        parts.setdefault(row["part"], []).append(row["begin"])
    table, total = [], 0
    for key in sorted(parts):
        table.append((key, total - 1, parts[key]))
        total += len(parts[key])
    begins = rows.sparkSession.createDataFrame(table, "_part long, _before long, _begins array<long>")
    joined = rows.join(F.broadcast(begins), part == F.col("_part"))
    passed = F.size(F.filter("_begins", lambda b: b <= F.col("_row")))
    return joined.withColumn("_block", F.col("_before") + passed).drop("_row", "_part", "_before", "_begins"), total


def _asked(lists: DataFrame, value_type: T.DataType, known: pa.Array) -> DataFrame:
    """``(_block, value)``: the distinct values in all lists ``_values`` of a block that are not ``known``.

    A block that two tasks read asks in each of them.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, end in _runs(keys):
                new = batch.column(1).slice(begin, end - begin).flatten().unique().drop_null()
                new = new.filter(pc.invert(pc.is_in(new, value_set=known.cast(new.type))))
                if keys[begin] == at:
                    asked = pa.concat_arrays([asked, new]).unique()
                    continue
                if asked is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), at)), asked], names=["_block", "value"])
                at, asked = keys[begin], new
        if asked is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), at)), asked], names=["_block", "value"])

    return lists.mapInArrow(ask, T.StructType([T.StructField("_block", T.LongType()), T.StructField("value", value_type)]))


def _looked_up(
    df: DataFrame, values: Column, size: Column, value_type: T.DataType, table: DataFrame, head: tuple[list, list], made: T.StructField, compose: Compose
) -> DataFrame:
    """``df`` with ``made``, composed of the lists ``values`` and what ``head`` (values, found) or ``table (value, found)`` has for what is in them.

    The values are made of the row wherever they are needed, not written or shuffled with it, and each block of rows asks
    once for a value that is not in ``head``. Its answers and its rows meet in the task that composes them.
    """
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "looked-up", compression="zstd")
    found_type = table.schema["found"].dataType
    known, held = (pa.array(x, to_arrow_type(t)) for x, t in zip(head, (value_type, found_type)))
    made_type = to_arrow_type(made.dataType)
    columns = df.columns
    blocks, n_blocks = _in_blocks(rows, size)

    def answer(waiting: pa.Table, answers: pa.Table) -> pa.Table:
        own = [x.flatten() for x in answers.column("_own").chunks if len(x)]
        value_set, found = (pa.concat_arrays([first, *(x.field(k).cast(first.type) for x in own)]) for k, first in enumerate((known, held)))
        schema, out = waiting.select(columns).schema.append(pa.field(made.name, made_type)), []
        for batch in waiting.to_batches():
            lists = batch.column("_values")
            flat = lists.flatten()
            composed = compose(lists, found.take(pc.index_in(flat, value_set=value_set.cast(flat.type))))
            out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), composed.cast(made_type)], schema=schema))
        return pa.Table.from_batches(out, schema)

    # Dealt out by block before lists are made and answers are put together, so that neither is shuffled.
    n = min(4 * max(n_blocks, 1), _MOST_TASKS)
    waiting = blocks.repartition(n, "_block").sortWithinPartitions("_block").select("_block", values.alias("_values"), *columns)
    asked = _asked(blocks.select("_block", values.alias("_values")), value_type, known).join(table, "value")
    answers = asked.repartition(n, "_block").groupBy("_block").agg(F.collect_list(F.struct("value", "found")).alias("_own"))
    return waiting.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(answer, T.StructType([rows.schema[c] for c in columns] + [made]))


def encode_vocabulary(
    df: DataFrame, vocabulary: DataFrame, text: str = "text", name: str = "ids", pattern: str = TOKEN_PATTERN, unknown: int | None = None, head: int = HEAD
) -> DataFrame:
    """``df`` with the ids of its text's tokens. A token that is not in the vocabulary gets ``unknown``, or is an error without it."""
    common = vocabulary.where(F.col("token_id") < head).select("token", "token_id").collect()
    table = vocabulary.where(F.col("token_id") >= head).select(F.col("token").alias("value"), F.col("token_id").cast("long").alias("found"))

    def compose(lists: pa.Array, ids: pa.Array) -> pa.Array:
        if unknown is not None:
            ids = pc.fill_null(ids, unknown)
        elif ids.null_count:
            raise ValueError(f"not in the vocabulary: {lists.flatten()[pc.index(pc.is_null(ids), True).as_py()].as_py()!r}")
        return pa.ListArray.from_arrays(_offsets(lists), ids)

    columns = [c for c in df.columns if c != name]
    known = [r["token"] for r in common], [r["token_id"] for r in common]
    made = T.StructField(name, T.ArrayType(T.LongType()))
    return _looked_up(df.select(*columns), split_tokens(F.col(text), pattern), F.octet_length(text), T.StringType(), table, known, made, compose)


def decode_vocabulary(df: DataFrame, vocabulary: DataFrame, ids: str = "ids", name: str = "decoded", head: int = HEAD) -> DataFrame:
    """``df`` with the tokens of its ids put together. An id that is not in the vocabulary is an error; null gives null."""
    common = vocabulary.where(F.col("token_id") < head).select("token", "token_id").collect()
    table = vocabulary.where(F.col("token_id") >= head).select(F.col("token_id").cast("long").alias("value"), F.col("token").alias("found"))

    def compose(lists: pa.Array, parts: pa.Array) -> pa.Array:
        if parts.null_count:
            raise ValueError(f"no token has the id {lists.flatten()[pc.index(pc.is_null(parts), True).as_py()].as_py()}")
        texts = pc.binary_join(pa.ListArray.from_arrays(_offsets(lists), parts), "")
        return pc.if_else(pc.is_valid(lists), texts, pa.scalar(None, texts.type))

    columns = [c for c in df.columns if c != name]
    known = [r["token_id"] for r in common], [r["token"] for r in common]
    made = T.StructField(name, T.StringType())
    return _looked_up(df.select(*columns), F.col(ids).cast("array<bigint>"), F.size(ids) * 8, T.LongType(), table, known, made, compose)
