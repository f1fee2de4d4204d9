"""Prediction records and result objects as JSON, one folder per run."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.operators.chat import reference_column
from textforge.options import FieldMap, safe_name
from textforge.sources.publish import publish_json

# Record fields, in order.
SAMPLE_FIELDS = ("title", "NER", "ingredients", "directions")
MATCH_FIELDS = ("bert_precision", "bert_recall", "bert_f1")
PHASES = ("benchmarks", "domain", "operational", "final")
PHASE_SCHEMA = (
    "timestamp string, model_path string, model_type string, base_model string, duration_minutes double, "
    "section string, metric string, value double, run_id string, phase string"
)


def prediction_records(
    aligned: DataFrame, fields: FieldMap = FieldMap(), with_match_scores: bool = False
) -> DataFrame:
    """Sample fields, full reference and prediction; absent sample fields become empty text."""
    sample = [
        (F.col(c) if c in aligned.columns else F.lit("")).alias(c) for c in SAMPLE_FIELDS
    ]
    scores = [F.col(c) for c in MATCH_FIELDS] if with_match_scores else []
    return aligned.select(
        *sample, reference_column(aligned, fields).alias("reference_full"), F.col("prediction"), *scores
    )


def dialogue_records(aligned: DataFrame, dialogue: str, reference: str) -> DataFrame:
    """The three-field record of the summarisation variant."""
    return aligned.select(
        F.col(dialogue).alias("dialogue"), F.col(reference).alias("reference"), F.col("prediction")
    )


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, one file per partition; null fields keep their key."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def append_result(scores: DataFrame, path: str, identity: Mapping[str, str | None], run_id: str | None = None) -> bool:
    """Add one run's aggregated scores and its identity to a results folder.

    With a ``run_id`` the result is one file of that name: it is stored once, however often the run is repeated and
    whoever does it at the same time. False means that it was there already; the stored one stays.
    """
    columns = [F.lit(v).cast("string").alias(k) for k, v in identity.items()]
    named = scores.select("*", *columns)
    if run_id is not None:
        return publish_json(named, path, safe_name(run_id))
    named.coalesce(1).write.mode("append").json(path, ignoreNullFields=False)
    return True


def append_phase(
    spark: SparkSession,
    path: str,
    run_id: str,
    phase: str,
    metadata: Mapping[str, Any],
    results: DataFrame,
) -> None:
    """Store everything known after one evaluation phase under its run and phase.

    ``results`` has columns ``section, metric, value``. The base model is recorded for adapter
    runs only. Storing a phase again replaces exactly that phase of that run.
    """
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}")
    base = metadata.get("base_model") if metadata.get("model_type") == "lora" else None
    results.select(
        F.lit(run_id).alias("run_id"),
        F.lit(phase).alias("phase"),
        F.lit(metadata.get("timestamp")).cast("string").alias("timestamp"),
        F.lit(metadata.get("model_path")).cast("string").alias("model_path"),
        F.lit(metadata.get("model_type")).cast("string").alias("model_type"),
        F.lit(base).cast("string").alias("base_model"),
        F.lit(metadata.get("duration_minutes")).cast("double").alias("duration_minutes"),
        "section",
        "metric",
        "value",
    ).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "phase").parquet(path)


def read_phases(spark: SparkSession, path: str, phases: Sequence[str] = PHASES) -> DataFrame:
    return spark.read.schema(PHASE_SCHEMA).parquet(path).where(F.col("phase").isin(*phases))
