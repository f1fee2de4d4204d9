"""Mean scores per model over a stream of predictions.

Scoring one sample needs no state, so the batch scores run on the stream as they are. The state is the set of keys that
were counted: a sample delivered again, at once or much later, counts once, and one that comes late counts as any other,
since the means belong to no window of time. It grows with the samples (a key each), split by key over all executors;
``spark.sql.streaming.stateStore.providerClass`` may keep it in RocksDB.

Each micro-batch adds its sums to the totals of the one before and publishes them under its own number. A batch
that is run again after a failure finds its totals stored and adds nothing. Totals hold a row per model and are
all a reader needs; those of older batches go.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textforge.session import remove
from textforge.sources.publish import publish_folder


def _batches(spark: SparkSession, path: str) -> list[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _sums(metrics: Sequence[str]) -> list:
    made = [F.sum(F.coalesce(F.col(m), F.lit(0.0)).cast("double")).alias(f"{m}_sum") for m in metrics]
    return made + [F.count(m).alias(f"{m}_count") for m in metrics] + [F.count(F.lit(1)).alias("num_samples")]


def add_batch(batch: DataFrame, number: int, path: str, metrics: Sequence[str], group: Sequence[str]) -> bool:
    """Totals after this batch; False if they are stored already."""
    spark = batch.sparkSession
    stored = _batches(spark, path)
    if number in stored:
        return False
    totals = batch.groupBy(*group).agg(*_sums(metrics))
    before = [b for b in stored if b < number]
    if before:
        joined = totals.unionByName(spark.read.parquet(f"{path}/batch={before[-1]}"))
        totals = joined.groupBy(*group).agg(*[F.sum(c).alias(c) for c in totals.columns if c not in group])
    done = publish_folder(spark, f"{path}/batch={number}", lambda p: totals.coalesce(1).write.parquet(p))
    for old in before[:-1]:  # the one just read stays for a reader that has opened it
        remove(spark, f"{path}/batch={old}")
    return done


def stream_means(
    scores: DataFrame, path: str, checkpoint: str, metrics: Sequence[str], keys: Sequence[str], group: Sequence[str]
) -> StreamingQuery:
    """Keep the totals under ``path`` up to date until the source is drained; ``checkpoint`` holds source position and keys.

    ``scores`` is a streaming table, such as ``rouge_scores`` of a stream, with ``keys`` naming a sample of a model. Of rows that
    share their keys the first to arrive counts. Null keys and null groups are values; a null score is left out of its mean.
    """
    root = path.rstrip("/")
    once = scores.dropDuplicates(list(keys))

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, root, metrics, group)

    return (
        once.writeStream.foreachBatch(add)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_means(spark: SparkSession, path: str, metrics: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Mean scores and sample counts of everything counted so far."""
    root = path.rstrip("/")
    stored = _batches(spark, root)
    if not stored:
        raise FileNotFoundError(f"no totals under {path}")
    totals = spark.read.parquet(f"{root}/batch={stored[-1]}")
    means = [F.when(F.col(f"{m}_count") > 0, F.col(f"{m}_sum") / F.col(f"{m}_count")).alias(m) for m in metrics]
    return totals.select(*group, *means, "num_samples")
