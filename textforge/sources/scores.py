"""Score files of several producers, brought to one long form."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.operators.compare import to_long

# Metric and identity keys used by the different producers.
METRICS = ("rouge1", "rouge2", "rougeL", "bert_precision", "bert_recall", "bert_f1", "mmlu", "hellaswag")
IDENTITY_KEYS = (
    "model_name",
    "finetuned_model_id",
    "adapter_source",
    "adapter_id",
    "adapter_dir",
    "model_path",
    "base_model",
)
TUNED_KEYS = ("finetuned_model_id", "adapter_source", "adapter_id", "adapter_dir")

_BENCHMARKS = T.StructType(
    [
        T.StructField(
            "mmlu",
            T.StructType(
                [
                    T.StructField("accuracy", T.DoubleType()),
                    T.StructField("samples", T.LongType()),
                    T.StructField("subjects", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "hellaswag",
            T.StructType(
                [
                    T.StructField("accuracy_norm", T.DoubleType()),
                    T.StructField("samples", T.LongType()),
                ]
            ),
        ),
    ]
)
SCORE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in IDENTITY_KEYS]
    + [T.StructField("dataset", T.StringType()), T.StructField("model_type", T.StringType())]
    + [T.StructField("timestamp", T.StringType()), T.StructField("num_samples", T.LongType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS if m not in ("mmlu", "hellaswag")]
    + [T.StructField("benchmarks", _BENCHMARKS)]
)

# Fields of the training log entries.
_LOG_ENTRY = T.StructType(
    [T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "loss",
            "grad_norm",
            "learning_rate",
            "eval_loss",
            "eval_runtime",
            "eval_samples_per_second",
            "eval_steps_per_second",
        )
    ]
)
TRAINING_LOG_SCHEMA = T.StructType(
    [
        T.StructField("epoch", T.DoubleType()),
        T.StructField("global_step", T.LongType()),
        T.StructField("log_history", T.ArrayType(_LOG_ENTRY)),
    ]
)


def read_score_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every score file as one row with the union of all fields and its source file."""
    return (
        spark.read.schema(SCORE_SCHEMA)
        .json(list(paths), multiLine=True)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def with_benchmark_columns(records: DataFrame) -> DataFrame:
    return records.withColumn("mmlu", F.col("benchmarks.mmlu.accuracy")).withColumn(
        "hellaswag", F.col("benchmarks.hellaswag.accuracy_norm")
    )


def is_tuned(records: DataFrame) -> Column:
    tests = [F.col(k).isNotNull() for k in TUNED_KEYS if k in records.columns]
    tuned = F.lit(False)
    for test in tests:
        tuned = tuned | test
    return tuned


def normalise_scores(records: DataFrame, bases: Mapping[str, str] | None = None, variant: Column | None = None) -> DataFrame:
    """``model, variant, base_model, metric, value, num_samples``.

    ``bases`` maps tuned models to their base models. It decides for the records of these models, which
    need not name a base themselves (benchmark records do not); others follow their identity keys.
    """
    records = with_benchmark_columns(records)
    model = F.coalesce(*[F.col(k) for k in IDENTITY_KEYS if k in records.columns])
    given = F.element_at(F.create_map(*[F.lit(x) for pair in bases.items() for x in pair]), model) if bases else F.lit(None).cast("string")
    tuned = is_tuned(records) | given.isNotNull()
    if variant is None:
        variant = F.when(tuned, F.lit("finetuned")).otherwise(F.lit("base"))
    own = F.when(tuned, F.coalesce(given, F.col("base_model") if "base_model" in records.columns else F.lit(None)))
    wide = records.select(
        model.alias("model"), variant.alias("variant"), own.cast("string").alias("base_model"), "num_samples", *[F.col(m) for m in METRICS]
    )
    return to_long(wide, ["model", "variant", "base_model", "num_samples"], METRICS)


def read_training_log(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per log entry."""
    return (
        spark.read.schema(TRAINING_LOG_SCHEMA)
        .json(list(paths), multiLine=True)
        .select("global_step", F.inline("log_history"))
    )
