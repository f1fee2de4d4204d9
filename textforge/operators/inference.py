"""Text generation through user-supplied functions, in Arrow batches.

``make_predict`` is called once per task and returns a function from a list of prompts (or
message lists) to texts. It is shipped to the executors, so it should load its model itself.
"""

from __future__ import annotations

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.operators.batched import MapBatch, map_batches
from textforge.session import materialise
from textforge.sources.datasets import mark_complete, path_exists

PredictBatch = Callable[[list[Any]], Sequence[str]]
CallEndpoint = Callable[[Any], str]

_PREDICTION = [T.StructField("prediction", T.StringType()), T.StructField("error", T.StringType())]


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    """Carried columns first, then what the model gives."""
    return T.StructType([df.schema[k] for k in keys] + _PREDICTION)


def batch_predict(
    df: DataFrame,
    keys: Sequence[str],
    prompt: str,
    make_predict: Callable[[], PredictBatch],
    batch_size: int = 8,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One prediction per row, stripped; prompts reach the function ``batch_size`` at a time.

    ``carry`` names further columns that travel with the row, so nothing has to be joined afterwards.
    """
    keys = [*keys, *carry]

    def make() -> MapBatch:
        predict = make_predict()

        def run(columns: dict[str, list]) -> dict[str, list]:
            prompts, texts = columns[prompt], []
            for begin in range(0, len(prompts), batch_size):
                texts.extend(predict(prompts[begin : begin + batch_size]))
            if len(texts) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts gave {len(texts)} predictions")
            return {"prediction": [t.strip() for t in texts], "error": [None] * len(texts)}

        return run

    return map_batches(df, make, [prompt], T.StructType(_PREDICTION), list(dict.fromkeys(keys)))


class _Pace:
    """At most ``rate`` starts a second, over all threads of a task."""

    def __init__(self, rate: float | None) -> None:
        self.gap, self.due, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(time.monotonic(), self.due)
                self.due = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


def endpoint_predict(
    df: DataFrame,
    keys: Sequence[str],
    prompt: str,
    make_client: Callable[[], CallEndpoint],
    max_workers: int = 10,
    pause: float = 0.25,
    carry: Sequence[str] = (),
    in_flight: int = 1,
    retries: int = 0,
    backoff: float = 1.0,
    calls_per_second: float | None = None,
) -> DataFrame:
    """Call a remote endpoint for every row, with at most ``max_workers`` calls in flight over all tasks.

    A task keeps up to ``in_flight`` calls open at a time, each on a thread with a client of its own, and gives its
    rows back in order; there are ``max_workers / in_flight`` tasks, rounded down. A failing call is repeated
    up to ``retries`` times after ``backoff``, twice ``backoff``, and so on; if all fail, the row has an empty prediction
    and the last error's text, and the job goes on. ``calls_per_second`` is shared out evenly among the
    tasks, and each call is followed by ``pause``. A retried task repeats its calls, so write the result once (see
    ``predict_once``) before using it.
    """
    dealt_by, keys = list(keys), [*keys, *carry]
    in_flight = max(1, min(in_flight, max_workers))
    tasks = max(1, max_workers // in_flight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, pace = threading.local(), _Pace(calls_per_second / tasks if calls_per_second else None)

        def ask(item: Any) -> tuple[str, str | None]:
            if not hasattr(own, "call"):
                own.call = make_client()
            for attempt in range(retries + 1):
                pace.wait()
                try:
                    return own.call(item).strip(), None
                except Exception as problem:
                    error = str(problem) or type(problem).__name__
                finally:
                    if pause:
                        time.sleep(pause)
                if attempt < retries:
                    time.sleep(backoff * 2**attempt)
            return "", error

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                answers = list(pool.map(ask, batch[prompt]))
                yield batch[keys].assign(
                    prediction=[text for text, _ in answers], error=pd.Series([error for _, error in answers], dtype=object).values
                )

    spread = df.select(*dict.fromkeys([*keys, prompt])).repartition(tasks, *dealt_by)
    return spread.mapInPandas(run, _schema(df, keys))


def predict_once(predictions: DataFrame, name: str = "predictions") -> DataFrame:
    """Write predictions to the shared folder and read them back: models run exactly once."""
    return materialise(predictions, name)


def predict_in_waves(
    df: DataFrame,
    keys: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    path: str,
    waves: int = 16,
) -> DataFrame:
    """Predict the rows in ``waves`` parts by key hash, storing each part as soon as it is done.

    For long runs of costly calls: losing executors or the whole job costs one part at most, as a
    later call with the same ``path`` skips the parts that are complete. Pass everything the
    model sees in ``df``, from a stored table, since each wave reads it.
    """
    spark = df.sparkSession
    for wave in range(waves):
        part = f"{path}/wave={wave}"
        if not path_exists(spark, part):
            rows = df.where(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
            predict(rows).write.mode("overwrite").parquet(part)
            mark_complete(spark, part)
    return spark.read.parquet(path).drop("wave")


def align(samples: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach predictions to their samples by key, which may be null.

    Every sample stays, with a null prediction if it has none. Two predictions for one key are an error.
    """
    keys = list(keys)
    values = [c for c in predictions.columns if c not in keys]
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two predictions for one key")).cast("boolean"))
    unique = predictions.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(one.alias("_two"), *[F.first(c).alias(c) for c in values])
    same = reduce(lambda a, b: a & b, [samples[k].eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = samples.join(unique, same, "left").where(F.col("_two").isNull())
    return joined.select(*[samples[c] for c in samples.columns], *values)


def failure_report(predictions: DataFrame, group: str) -> DataFrame:
    return predictions.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.col("error").isNotNull().cast("bigint")).alias("n_failed"),
    )
