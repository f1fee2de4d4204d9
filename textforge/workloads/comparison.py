"""Registered queries: score tables, change, ranking, result storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.operators.bootstrap import change_intervals, poisson_steps, score_intervals
from textforge.operators.compare import best_model, change, rank_models, stack_scores, summary, to_long
from textforge.operators.rouge import corpus_scores, rouge_scores
from textforge.session import fresh_path
from textforge.sources.records import append_phase, append_result, read_phases
from textforge.sources.scores import normalise_scores, read_score_files
from textforge.workloads.relations import PREDICTIONS, model_predictions, rouge_sql
from textforge.workloads.scoring import CORPUS_CTES

METRICS = ["rouge1", "rouge2", "rougeL"]


def _model_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = rouge_scores(model_predictions(spark, folder), ["conv_id", "turn", "model", "variant"])
    return corpus_scores(scores, METRICS, ["model", "variant"])


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return to_long(_model_scores(spark, folder), ["model", "variant"], METRICS)


def _families(spark: SparkSession, folder: str) -> DataFrame:
    """Two base models and a tuned one of each; the second one scores below its base."""
    scores = _long(spark, folder)
    row = lambda model, name, variant, base: F.when(F.col("model") == model, F.struct(F.lit(name).alias("model"), F.lit(variant).alias("variant"), F.lit(base).cast("string").alias("base_model")))
    roles = F.array(
        row("org/Qwen-echo", "org/Qwen-echo", "base", None),
        row("org/gemma-tail", "org/gemma-tail", "base", None),
        row("org/Llama-lead", "org/Qwen-tuned", "finetuned", "org/Qwen-echo"),
        row("org/Qwen-echo", "org/gemma-tuned", "finetuned", "org/gemma-tail"),
    )
    return scores.select(F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"), "metric", "value").select("r.*", "metric", "value")


def score_union(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap scores and length figures, from tables with different columns, in one long table."""
    overlap = _model_scores(spark, folder).select("model", *METRICS)
    lengths = model_predictions(spark, folder).groupBy("model").agg(
        F.avg(F.length("prediction")).alias("mean_chars")
    )
    stacked = to_long(stack_scores([overlap, lengths]), ["model"], [*METRICS, "mean_chars"])
    return stacked.withColumn("value", F.round("value", 6))


def relative_change(spark: SparkSession, folder: str) -> DataFrame:
    changed = change(_families(spark, folder))
    numbers = ("base", "finetuned", "relative_pct", "points", "retention")
    return changed.select(*[F.round(c, 5).alias(c) if c in numbers else F.col(c) for c in changed.columns])


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(_families(spark, folder))


def model_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_models(_model_scores(spark, folder), "model", "rouge1", path="model")
    return ranked.withColumn("rouge1", F.round("rouge1", 6))


def best_system_model(spark: SparkSession, folder: str) -> DataFrame:
    best = best_model(_model_scores(spark, folder), "model", "rouge1", path="model")
    return best.withColumn("rouge1", F.round("rouge1", 6))


def stored_results(spark: SparkSession, folder: str) -> DataFrame:
    """One result file per model, written with its identity, read back and normalised.

    The third model's record names no base; the caller's map does.
    """
    path = fresh_path(spark, "results")
    scores = _model_scores(spark, folder)
    identities = {
        "org/Qwen-echo": {"model_name": "org/Qwen-echo"},
        "org/Llama-lead": {"base_model": "org/Qwen-echo", "adapter_id": "org/Llama-lead"},
        "org/gemma-tail": {"model_path": "org/gemma-tail", "model_type": "full"},
    }
    for model, identity in identities.items():
        own = scores.where(F.col("model") == model).drop("model", "variant")
        if model == "org/gemma-tail":
            accuracy = F.struct(F.col("rouge1").alias("accuracy"), F.col("num_samples").alias("samples"))
            own = own.withColumn("benchmarks", F.struct(accuracy.alias("mmlu")))
        append_result(own, path, identity)
    stored = normalise_scores(read_score_files(spark, [path]), {"org/gemma-tail": "org/Qwen-echo"})
    return stored.withColumn("value", F.round("value", 6))


def stored_once(spark: SparkSession, folder: str) -> DataFrame:
    """Results under their run's name, each stored twice: the second attempt changes nothing."""
    path = fresh_path(spark, "results")
    scores = _model_scores(spark, folder)
    for attempt in (1, 2):
        for model in ("org/Qwen-echo", "org/gemma-tail"):
            own = scores.where(F.col("model") == model).drop("model", "variant").withColumn("num_samples", F.col("num_samples") * attempt)
            append_result(own, path, {"model_name": model}, run_id=f"{model}:1")
    stored = normalise_scores(read_score_files(spark, [path]))
    return stored.select("model", "metric", "num_samples", F.round("value", 6).alias("value"))


def stored_phases(spark: SparkSession, folder: str) -> DataFrame:
    """Results of two phases, the later one holding the earlier one's too."""
    path = fresh_path(spark, "phases")
    long_scores = _long(spark, folder).select(F.col("model").alias("section"), "metric", "value")
    info = {"model_path": "org/Qwen-echo", "model_type": "lora", "base_model": "org/Qwen"}
    append_phase(spark, path, "run-1", "domain", info, long_scores.where("metric = 'rouge1'"))
    append_phase(spark, path, "run-1", "final", {**info, "duration_minutes": 1.5}, long_scores)
    stored = read_phases(spark, path)
    return stored.select(
        F.col("run_id").cast("string").alias("run_id"),
        "phase",
        "base_model",
        "duration_minutes",
        "section",
        "metric",
        F.round("value", 6).alias("value"),
    )


def _pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rouge_scores(model_predictions(spark, folder), ["conv_id", "turn", "model"], subsequence=False)


def score_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95 % bounds of each model's mean overlap, by 200 Poisson bootstrap replicates."""
    found = score_intervals(_pair_scores(spark, folder), ["conv_id", "turn"], ["rouge1", "rouge2"])
    return found.select("model", "metric", *[F.round(c, 6).alias(c) for c in ("median", "low", "high")], "replicates")


def change_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Median and bounds of the relative change against the echoing model, on the same replicates."""
    found = change_intervals(_pair_scores(spark, folder), ["conv_id", "turn"], ["rouge1", "rouge2"], "org/Qwen-echo", level=0.9)
    return found.select("model", "metric", *[F.round(c, 5).alias(c) for c in ("median", "low", "high")], "replicates")


QUERIES = {
    "score_intervals": score_bounds,
    "change_intervals": change_bounds,
    "score_union": score_union,
    "relative_change": relative_change,
    "score_summary": score_summary,
    "model_ranking": model_ranking,
    "best_model": best_system_model,
    "stored_results": stored_results,
    "stored_once": stored_once,
    "stored_phases": stored_phases,
}

_LONG = f"""{CORPUS_CTES},
long_scores AS (
  SELECT model, metric, value, CASE model WHEN 'org/Qwen-echo' THEN 'base' WHEN 'org/Llama-lead' THEN 'finetuned'
    ELSE 'other' END AS variant
  FROM (SELECT model, unnest(['rouge1', 'rouge2', 'rougeL']) AS metric, unnest([rouge1, rouge2, rougeL]) AS value
    FROM per_model)),
families AS (
  SELECT f.model, f.base_model, t.metric, b.value AS b, t.value AS t
  FROM (VALUES ('org/Qwen-tuned', 'org/Qwen-echo', 'org/Llama-lead'), ('org/gemma-tuned', 'org/gemma-tail', 'org/Qwen-echo'))
    AS f(model, base_model, source)
  JOIN long_scores t ON t.model = f.source JOIN long_scores b ON b.model = f.base_model AND b.metric = t.metric)"""

_STEPS = " + ".join(f"(digits >= '{step}')::INTEGER" for step in poisson_steps())
_REPLICATES = f"""{PREDICTIONS}, {rouge_sql('predictions', 'conv_id, turn, model', 1, 'r1')}, {rouge_sql('predictions', 'conv_id, turn, model', 2, 'r2')},
hashed AS (
  SELECT conv_id, turn, block, md5('42:' || conv_id || ':' || turn || ':' || block) AS h FROM pairs CROSS JOIN range(25) AS b(block)),
drawn AS (
  SELECT conv_id, turn, 8 * block + place AS replicate, {_STEPS} AS weight
  FROM (SELECT conv_id, turn, block, place, substr(h, (4 * place + 1)::INTEGER, 4) AS digits FROM hashed CROSS JOIN range(8) AS p(place))),
means AS (
  SELECT model, replicate, sum(weight * r1.f) / sum(weight) AS rouge1, sum(weight * r2.f) / sum(weight) AS rouge2
  FROM drawn JOIN r1 USING (conv_id, turn) JOIN r2 USING (conv_id, turn, model) WHERE weight > 0 GROUP BY model, replicate)"""


def _bounds_sql(source: str, tail: float, decimals: int) -> str:
    ends = ", ".join(f"round(quantile_cont(value, {q}), {decimals}) AS {name}" for q, name in ((0.5, "median"), (tail, "low"), (1 - tail, "high")))
    return f"""SELECT model, metric, {ends}, count(*) AS replicates FROM (
      SELECT model, unnest(['rouge1', 'rouge2']) AS metric, unnest([rouge1, rouge2]) AS value FROM {source}) GROUP BY model, metric"""


ORACLES = {
    "score_intervals": f"WITH {_REPLICATES} {_bounds_sql('means', 0.025, 6)}",
    "change_intervals": f"""WITH {_REPLICATES}, changes AS (
      SELECT a.model, (a.rouge1 - b.rouge1) / b.rouge1 * 100 AS rouge1, (a.rouge2 - b.rouge2) / b.rouge2 * 100 AS rouge2
      FROM means a JOIN means b USING (replicate) WHERE a.model <> 'org/Qwen-echo' AND b.model = 'org/Qwen-echo')
      {_bounds_sql('changes', 0.05, 5)}""",
    "score_union": f"""WITH {_LONG} SELECT model, metric, round(value, 6) AS value FROM long_scores
      UNION ALL SELECT model, 'mean_chars', round(avg(length(prediction)), 6) FROM predictions GROUP BY model""",
    "relative_change": f"""WITH {_LONG} SELECT model, base_model, metric, round(b, 5) AS base, round(t, 5) AS finetuned,
      round((t - b) / b * 100, 5) AS relative_pct, round((t - b) * 100, 5) AS points, round(t / b, 5) AS retention,
      CASE WHEN t >= b THEN 'positive' ELSE 'negative' END AS direction FROM families""",
    "score_summary": f"""WITH {_LONG} SELECT model,
      (list_position(['rouge1', 'rouge2', 'rougeL'], metric) - 1)::INTEGER AS position,
      CASE metric WHEN 'rouge1' THEN 'ROUGE-1' WHEN 'rouge2' THEN 'ROUGE-2' ELSE 'ROUGE-L' END AS metric,
      printf('%.1f%%', b * 100) AS base_model, printf('%.1f%%', t * 100) AS fine_tuned,
      CASE WHEN t >= b THEN '+' ELSE '' END || printf('%.0f%%', (t - b) / b * 100) AS change,
      CASE WHEN (t - b) / b * 100 >= 1 THEN 'better than its base' WHEN (t - b) / b * 100 <= -1 THEN 'worse than its base'
        ELSE 'about the same' END AS interpretation
      FROM families""",
    "model_ranking": f"""WITH {_LONG} SELECT model, round(rouge1, 6) AS rouge1,
      (rank() OVER (ORDER BY rouge1 DESC))::INTEGER AS rank, model IN ('org/Qwen-echo', 'org/Llama-lead') AS supports_system
      FROM per_model""",
    "best_model": f"""WITH {_LONG} SELECT model, round(rouge1, 6) AS rouge1 FROM per_model
      WHERE model IN ('org/Qwen-echo', 'org/Llama-lead') ORDER BY rouge1 DESC, model LIMIT 1""",
    "stored_results": f"""WITH {_LONG}, sized AS (
        SELECT model, num_samples, metric, value FROM long_scores JOIN (SELECT model, num_samples FROM per_model) USING (model)
        UNION ALL SELECT model, num_samples, 'mmlu', rouge1 FROM per_model WHERE model = 'org/gemma-tail')
      SELECT model, CASE model WHEN 'org/Qwen-echo' THEN 'base' ELSE 'finetuned' END AS variant,
        CASE model WHEN 'org/Qwen-echo' THEN NULL ELSE 'org/Qwen-echo' END AS base_model, num_samples, metric, round(value, 6) AS value
      FROM sized""",
    "stored_once": f"""WITH {_LONG} SELECT model, metric, num_samples, round(value, 6) AS value
      FROM long_scores JOIN (SELECT model, num_samples FROM per_model) USING (model) WHERE model <> 'org/Llama-lead'""",
    "stored_phases": f"""WITH {_LONG} SELECT 'run-1' AS run_id, phase, 'org/Qwen' AS base_model,
      CASE phase WHEN 'final' THEN 1.5::DOUBLE END AS duration_minutes, model AS section, metric, round(value, 6) AS value
      FROM long_scores JOIN (SELECT unnest(['domain', 'final']) AS phase) ON phase = 'final' OR metric = 'rouge1'""",
}
