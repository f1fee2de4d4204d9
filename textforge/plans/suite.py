"""Evaluation phases in sequence, each stored when it is done."""

from __future__ import annotations

import time
import uuid
from datetime import datetime
from typing import Any, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators.choice import accuracy, macro_average, pick_choices
from textforge.operators.output_checks import output_report
from textforge.operators.sampling import first_n_per_group
from textforge.options import SuiteOptions
from textforge.plans.evaluate import Evaluation
from textforge.sources.records import append_phase, read_phases


def benchmark_results(
    choices: DataFrame, options: SuiteOptions, completion_choices: DataFrame | None = None
) -> DataFrame:
    """``section, metric, value`` of the multiple-choice tasks that are switched on.

    ``choices``: ``subject, item_id, choice_index, choice_text, loglik, gold_index``.
    """

    def answered(table: DataFrame, per_subject: int, normalise: bool) -> DataFrame:
        # Items are limited, not choices: pick per item first, which leaves one small row each.
        picks = pick_choices(table, ["subject", "item_id", "gold_index"], normalise)
        limited = first_n_per_group(picks, ["subject"], ["item_id"], per_subject)
        return accuracy(limited, ["subject"])

    parts = []
    if options.per_subject > 0:
        wanted = choices.where(F.col("subject").isin(*options.subjects))
        macro = macro_average(
            answered(wanted, options.per_subject, False), "subject", options.configured_items
        )
        parts.append(
            macro.select(
                F.lit("mmlu").alias("section"),
                F.explode(
                    F.create_map(
                        F.lit("accuracy"),
                        F.col("accuracy"),
                        F.lit("samples"),
                        F.col("configured_samples").cast("double"),
                        F.lit("observed"),
                        F.col("samples").cast("double"),
                    )
                ).alias("metric", "value"),
            )
        )
    if options.completion_items > 0 and completion_choices is not None:
        # One section whatever subjects the items have.
        whole = completion_choices.withColumn("subject", F.lit("completion"))
        scored = answered(whole, options.completion_items, True)
        parts.append(
            scored.select(
                F.lit("hellaswag").alias("section"),
                F.explode(
                    F.create_map(
                        F.lit("accuracy_norm"),
                        F.col("accuracy"),
                        F.lit("samples"),
                        F.lit(float(options.completion_items)),
                        F.lit("observed"),
                        F.col("samples").cast("double"),
                    )
                ).alias("metric", "value"),
            )
        )
    whole = parts[0] if parts else choices.sparkSession.createDataFrame(
        [], "section string, metric string, value double"
    )
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _long(table: DataFrame, section: str) -> DataFrame:
    numeric = [c for c, t in table.dtypes if t in ("double", "bigint", "int")]
    doubles = table.select([F.col(c).cast("double").alias(c) for c in numeric])
    return doubles.unpivot([], numeric, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "value"
    )


def run_suite(
    options: SuiteOptions,
    path: str,
    metadata: Mapping[str, Any],
    choices: DataFrame | None = None,
    completion_choices: DataFrame | None = None,
    evaluate_domain=None,
    run_id: str | None = None,
) -> str:
    """Run the phases that are switched on and store all results so far after each one.

    ``evaluate_domain`` returns an :class:`Evaluation`; its predictions also feed the operational
    checks, and are made for them alone when the domain phase is off.
    """
    run_id = run_id or uuid.uuid4().hex
    started = time.time()
    info = {"timestamp": datetime.now().isoformat(), **metadata}
    done: DataFrame | None = None
    domain: Evaluation | None = None

    def store(phase: str, part: DataFrame | None, **extra: Any) -> None:
        nonlocal done
        if part is not None:
            done = part if done is None else done.unionByName(part)
        if done is None:
            return
        spark = done.sparkSession
        append_phase(spark, path, run_id, phase, {**info, **extra}, done)
        # Later phases repeat the stored numbers instead of computing them again.
        stored = read_phases(spark, path, [phase]).where(F.col("run_id") == run_id)
        done = stored.select("section", "metric", "value")

    if options.enable_benchmarks and choices is not None:
        store("benchmarks", benchmark_results(choices, options, completion_choices))
    if options.enable_domain and evaluate_domain is not None:
        domain = evaluate_domain()
        store("domain", _long(domain.scores, "domain"))
    if options.enable_operational and evaluate_domain is not None:
        domain = domain or evaluate_domain()
        store("operational", _long(output_report(domain.predictions, []), "operational"))
    store("final", None, duration_minutes=(time.time() - started) / 60)
    return run_id
