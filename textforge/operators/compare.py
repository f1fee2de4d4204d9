"""Model comparison over score tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textforge.functions.text import percent, signed_percent
from textforge.registry import DEFAULT_REGISTRY, ModelConfig, config_for_path


@dataclass(frozen=True)
class SummaryRule:
    """How one metric appears in the summary table; changes below ``level`` (as printed) are no change."""

    metric: str
    label: str
    relative: bool
    decimals: int
    level: float = 1.0


# The summary's metrics, in order.
SUMMARY_RULES: tuple[SummaryRule, ...] = (
    SummaryRule("rouge1", "ROUGE-1", True, 0),
    SummaryRule("rouge2", "ROUGE-2", True, 0),
    SummaryRule("rougeL", "ROUGE-L", True, 0),
    SummaryRule("bert_f1", "BERT F1", True, 1),
    SummaryRule("mmlu", "MMLU", False, 1),
    SummaryRule("hellaswag", "HellaSwag", False, 1),
)


def stack_scores(tables: Sequence[DataFrame]) -> DataFrame:
    """One table from score tables with differing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_long(scores: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (model, metric); metrics a table does not have are left out."""
    return scores.unpivot(list(ids), list(metrics), "metric", "value").where("value IS NOT NULL")


def _sides(long_scores: DataFrame, base: str, tuned: str, variant: str, group: Sequence[str]) -> DataFrame:
    """Every tuned score beside that of its own base model.

    A tuned row names its base in ``base_model``. Without that column all rows are one family. Two values
    for one model and metric are an error; a tuned model without its base gives no row.
    """
    families = "base_model" in long_scores.columns
    model = F.col("model") if "model" in long_scores.columns else F.lit("")

    def side(name: str, family: Column, value: str) -> DataFrame:
        rows = long_scores.where(F.col(variant) == name).select(*group, family.alias("_family"), model.alias("_model"), "value")
        each = ["_family", *(["_model"] if families else []), *group]
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"more than one {name} score for a model and metric")).cast("double"))
        return rows.groupBy(*each).agg(F.coalesce(one, F.max("value")).alias(value), F.max("_model").alias(f"_{value}_model"))

    left = side(base, model if families else F.lit(""), "base").drop("_model")
    right = side(tuned, F.col("base_model") if families else F.lit(""), "finetuned").drop("_model")
    return left.join(right, ["_family", *group])


def change(
    long_scores: DataFrame,
    base: str = "base",
    tuned: str = "finetuned",
    variant: str = "variant",
    group: Sequence[str] = ("metric",),
) -> DataFrame:
    """Tuned models against their own base per metric: relative change in percent, points, retention, direction."""
    both = _sides(long_scores, base, tuned, variant, group).where("base IS NOT NULL AND finetuned IS NOT NULL")
    delta = F.col("finetuned") - F.col("base")
    nonzero = F.col("base") != 0
    names = [F.col("_finetuned_model").alias("model"), F.col("_family").alias("base_model")] if "base_model" in long_scores.columns else []
    return both.select(
        *names,
        *group,
        "base",
        "finetuned",
        F.when(nonzero, delta / F.col("base") * 100).alias("relative_pct"),
        (delta * 100).alias("points"),
        F.when(nonzero, F.col("finetuned") / F.col("base")).alias("retention"),
        F.when(delta >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
    )


def summary(
    long_scores: DataFrame,
    rules: Sequence[SummaryRule] = SUMMARY_RULES,
    base: str = "base",
    tuned: str = "finetuned",
) -> DataFrame:
    """Formatted table of metric, base, tuned, change and what the change says."""
    changed = change(long_scores, base, tuned)

    def amount(rule: SummaryRule) -> Column:
        return F.col("relative_pct" if rule.relative else "points")

    def wording(rule: SummaryRule) -> Column:
        return (
            F.when(amount(rule) >= rule.level, F.lit("better than its base"))
            .when(amount(rule) <= -rule.level, F.lit("worse than its base"))
            .when(amount(rule).isNotNull(), F.lit("about the same"))
        )

    def by_rule(pick) -> Column:
        return F.coalesce(*[F.when(F.col("metric") == r.metric, pick(r)) for r in rules])

    models = ["model"] if "model" in changed.columns else []
    return changed.where(F.col("metric").isin([r.metric for r in rules])).select(
        *models,
        by_rule(lambda r: F.lit(rules.index(r))).alias("position"),
        by_rule(lambda r: F.lit(r.label)).alias("metric"),
        percent(F.col("base")).alias("base_model"),
        percent(F.col("finetuned")).alias("fine_tuned"),
        by_rule(lambda r: signed_percent(amount(r), r.decimals)).alias("change"),
        by_rule(wording).alias("interpretation"),
    )


def rank_models(
    scores: DataFrame,
    model: str,
    metric: str,
    path: str | None = None,
    registry: Sequence[ModelConfig] = DEFAULT_REGISTRY,
) -> DataFrame:
    """Models by score, ties sharing a rank; the table has one row per model."""
    ranked = scores.withColumn("rank", F.rank().over(W.orderBy(F.desc(metric))))
    if path is None:
        return ranked.select(model, metric, "rank")
    return ranked.withColumn(
        "supports_system", config_for_path(F.col(path), registry)["supports_system"]
    ).select(model, metric, "rank", "supports_system")


def best_model(
    scores: DataFrame,
    model: str,
    metric: str,
    path: str,
    open_weights: str | None = None,
    registry: Sequence[ModelConfig] = DEFAULT_REGISTRY,
) -> DataFrame:
    """Best score among models that take system messages (and have open weights, if known)."""
    eligible = scores.where(config_for_path(F.col(path), registry)["supports_system"])
    if open_weights is not None:
        eligible = eligible.where(F.col(open_weights))
    best = F.min(F.struct((-F.col(metric)).alias("s"), F.col(model).alias("m")))
    return (
        eligible.agg(best.alias("x"))
        .where("x IS NOT NULL")
        .select(F.col("x.m").alias(model), (-F.col("x.s")).alias(metric))
    )


def headline_metrics(scores: DataFrame, per_sample_suffix: str = "_per_sample") -> DataFrame:
    """A result record without its per-sample lists."""
    return scores.select(*[c for c in scores.columns if not c.endswith(per_sample_suffix)])
