"""Registered queries: sketches and scores of data that arrives in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions.ngrams import words
from textforge.operators.output_checks import output_report
from textforge.operators.rouge import rouge_scores
from textforge.operators.sketches import (
    distinct_error,
    mean,
    merge_sketches,
    n_distinct,
    quantile,
    rank_error,
    read_parts,
    store_part,
    value_sketches,
)
from textforge.session import fresh_path
from textforge.streaming.scores import read_means, stream_means
from textforge.workloads.relations import documents, model_predictions, words_sql
from textforge.workloads.scoring import CORPUS_CTES

PARTS = 3


def _near(estimate: str, share: float, error: float) -> Column:
    """The rank of an estimated quantile among the real values is right up to ``error``."""
    rows = F.count("chars")
    below = F.sum((F.col("chars") < F.col(estimate)).cast("long")) / rows
    upto = F.sum((F.col("chars") <= F.col(estimate)).cast("long")) / rows
    return (below - error <= share) & (upto + error >= share)


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arriving in three parts, the sketches of each stored twice; merged figures against exact ones."""
    docs = documents(spark, folder).select("doc_id", "lang", "text", F.length("text").alias("chars"))
    path = fresh_path(spark, "sketches")
    for part in range(PARTS):
        here = docs.where(F.pmod("doc_id", F.lit(PARTS)) == part)
        for _ in range(2):
            store_part(value_sketches(here, ["lang"], [], ["chars"]), f"{path}/lengths", str(part))
            store_part(value_sketches(here.select("lang", F.explode(words(F.col("text"))).alias("word")), ["lang"], ["word"]), f"{path}/words", str(part))
    lengths = merge_sketches(read_parts(spark, f"{path}/lengths"), ["lang"]).select(
        "lang", "n_rows", F.round(mean("chars"), 6).alias("mean_chars"), F.col("chars_min").alias("min_chars"),
        F.col("chars_max").alias("max_chars"), quantile("chars", 0.5).alias("p50"), quantile("chars", 0.9).alias("p90"),
    )
    estimated = merge_sketches(read_parts(spark, f"{path}/words"), ["lang"]).select("lang", n_distinct("word").alias("estimate"))
    exact = docs.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang").agg(F.countDistinct("word").alias("distinct_words"))
    figures = ["lang", "n_rows", "mean_chars", "min_chars", "max_chars"]
    ranked = docs.select("lang", "chars").join(lengths, "lang").groupBy(*figures).agg(
        _near("p50", 0.5, 2 * rank_error()).alias("p50_in_bound"), _near("p90", 0.9, 2 * rank_error()).alias("p90_in_bound")
    )
    near = F.abs(F.col("estimate") - F.col("distinct_words")) <= F.greatest(4 * distinct_error() * F.col("distinct_words"), F.lit(1.0))
    return ranked.join(estimated, "lang").join(exact, "lang").select(
        *figures, "distinct_words", near.alias("words_in_bound"), "p50_in_bound", "p90_in_bound"
    )


def output_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The default report, whose median is a sketch, over whole documents."""
    docs = documents(spark, folder).select("lang", F.col("text").alias("prediction"))
    report = output_report(docs, ["lang"])
    kept = ["lang", "n_outputs", "empty_rate", "mean_chars", "min_chars", "max_chars"]
    ranked = docs.select("lang", F.length("prediction").alias("chars")).join(report, "lang").groupBy(*kept)
    checked = ranked.agg(_near("median_chars", 0.5, 1e-3).alias("median_in_bound"))
    return checked.select(*[F.round(c, 6).alias(c) if c in ("empty_rate", "mean_chars") else F.col(c) for c in checked.columns])


def streamed_means(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions arriving as files, one model's delivered twice; means equal those of the batch."""
    source, totals, checkpoint = (fresh_path(spark, name) for name in ("arriving", "totals", "positions"))
    arriving = model_predictions(spark, folder).select("conv_id", "turn", "model", "prediction", "reference")
    arriving.repartition(4, "conv_id", "turn").write.parquet(source)
    arriving.where(F.col("model") == "org/Qwen-echo").write.mode("append").parquet(source)
    metrics, keys = ["rouge1", "rouge2", "rougeL"], ["conv_id", "turn", "model"]
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 4).parquet(source)
    query = stream_means(rouge_scores(stream, keys), totals, checkpoint, metrics, keys, ["model"])
    query.awaitTermination()
    means = read_means(spark, totals, metrics, ["model"])
    return means.select("model", *[F.round(m, 6).alias(m) for m in metrics], "num_samples")


QUERIES = {"stored_sketches": stored_sketches, "output_format_sketched": output_sketched, "streamed_means": streamed_means}

ORACLES = {
    "stored_sketches": f"""WITH vocab AS (
        SELECT lang, count(DISTINCT word) AS distinct_words
        FROM (SELECT lang, unnest({words_sql('text')}) AS word FROM documents) GROUP BY lang)
      SELECT lang, count(*) AS n_rows, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars,
        max(length(text)) AS max_chars, any_value(distinct_words) AS distinct_words, TRUE AS words_in_bound,
        TRUE AS p50_in_bound, TRUE AS p90_in_bound
      FROM documents JOIN vocab USING (lang) GROUP BY lang""",
    "output_format_sketched": r"""SELECT lang, count(*) AS n_outputs,
        round(avg(regexp_full_match(text, '\s*')::INTEGER), 6) AS empty_rate, round(avg(length(text)), 6) AS mean_chars,
        min(length(text))::INTEGER AS min_chars, max(length(text))::INTEGER AS max_chars, TRUE AS median_in_bound
      FROM documents GROUP BY lang""",
    "streamed_means": f"""WITH {CORPUS_CTES} SELECT model, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2,
      round(rougeL, 6) AS "rougeL", num_samples FROM per_model""",
}
