"""The row-local part of data preparation on a stream of arriving samples.

Validity, messages, rendering and tokenising keep no state, so the same functions run on a
streaming DataFrame; a new file becomes tokens without reading the older ones again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textforge.operators.validity import filter_valid, required_columns
from textforge.options import PrepOptions
from textforge.plans.prepare import training_tokens


def token_stream(samples: DataFrame, options: PrepOptions, key: str = "sample_id") -> DataFrame:
    kept = filter_valid(samples, options.filter_invalid, required=required_columns(options.fields))
    return training_tokens(kept, options, key)


def append_tokens(tokens: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append tokens to a Parquet table, exactly once per input file, until the source is drained."""
    return (
        tokens.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
