"""Registered queries: inference through user functions, records, full evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions.templates import ANSWER_TEMPLATE, MESSAGE_TYPE, message
from textforge.operators.batched import map_batches
from textforge.operators.inference import (
    align,
    batch_predict,
    endpoint_predict,
    failure_report,
    predict_in_waves,
    predict_once,
)
from textforge.operators.matching import embed_and_match
from textforge.operators.output_checks import output_report
from textforge.operators.chat import reference_column
from textforge.options import SuiteOptions
from textforge.plans.evaluate import evaluate_model, score_prediction_file
from textforge.plans.suite import run_suite
from textforge.session import fresh_path
from textforge.sources.records import dialogue_records, prediction_records, read_phases, write_json_lines
from textforge.workloads.relations import (
    ANSWER,
    MERGED,
    PAIR_SAMPLES,
    PAIRS,
    PREDICTIONS,
    RAW,
    lcs_sql,
    model_predictions,
    pairs,
    raw_samples,
    rouge_sql,
    sample_pairs,
    table,
)


def make_reversed_words():
    """A stand-in model: the blank-separated words of the whole prompt in reverse order."""

    def predict(prompts):
        return [" ".join(p.split(" ")[::-1]) + " " for p in prompts]

    return predict


def make_answering_endpoint():
    """A stand-in endpoint: the user turn with underscores for blanks; it refuses some lengths."""

    def call(messages):
        text = messages[-1]["content"]
        if len(text) % 7 == 0:
            raise RuntimeError("refused")
        return f"\n{text.replace(' ', '_')} "

    return call


def make_prompt_tail():
    """A stand-in model: what the user asked for, cut out of the rendered prompt."""

    def predict(prompts):
        return [p.rsplit("Include ingredients: ", 1)[-1].split("<|im_end|>")[0] for p in prompts]

    return predict


def make_literal_client():
    """A stand-in endpoint that repeats the last message and refuses some lengths."""

    def call(messages):
        text = messages[-1]["content"]
        if len(text) % 5 == 0:
            raise RuntimeError("refused")
        return text

    return call


def make_word_shapes():
    """A stand-in batch function: for every text the lengths and the first letters of its words."""

    def shapes(columns):
        words = [text.split(" ") for text in columns["request"]]
        return {"lengths": [[len(w) for w in ws] for ws in words], "initials": [[w[:1] for w in ws] for ws in words]}

    return shapes


def make_word_embedder():
    """A stand-in embedder: a word is its length, its number of e's and a one."""

    def embed(texts):
        return [[[float(len(w)), float(w.count("e")), 1.0] for w in t.split(" ")] for t in texts]

    return embed


def batched(spark: SparkSession, folder: str) -> DataFrame:
    asked = pairs(spark, folder).select("conv_id", "turn", "request")
    return batch_predict(asked, ["conv_id", "turn"], "request", make_reversed_words).drop("error")


def _endpoint(spark: SparkSession, folder: str) -> DataFrame:
    asked = pairs(spark, folder).select(
        "conv_id", "turn", F.array(message("user", F.col("request"))).cast(MESSAGE_TYPE).alias("messages")
    )
    return endpoint_predict(asked, ["conv_id", "turn"], "messages", make_answering_endpoint, 4, pause=0)


def endpoint(spark: SparkSession, folder: str) -> DataFrame:
    return _endpoint(spark, folder)


def endpoint_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    """The same calls from two tasks with four of them open in each, and a failed one made once more."""
    asked = pairs(spark, folder).select(
        "conv_id", "turn", F.array(message("user", F.col("request"))).cast(MESSAGE_TYPE).alias("messages")
    )
    return endpoint_predict(asked, ["conv_id", "turn"], "messages", make_answering_endpoint, 8, pause=0, in_flight=4, retries=1, backoff=0.001)


def endpoint_failures(spark: SparkSession, folder: str) -> DataFrame:
    return failure_report(predict_once(_endpoint(spark, folder)), "turn")


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    samples = sample_pairs(spark, folder)
    asked = samples.select("sample_id", F.col("NER").alias("request"))
    made = batch_predict(asked, ["sample_id"], "request", make_reversed_words)
    return align(samples, made, ["sample_id"])


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction records written as JSON Lines and read back."""
    path = fresh_path(spark, "records")
    rows = prediction_records(_aligned(spark, folder))
    write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue_records(_aligned(spark, folder), "NER", "directions")


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt, predict, align and score all pairs for one model."""
    done = evaluate_model(
        sample_pairs(spark, folder), "Qwen/Qwen2.5-1.5B-Instruct", make_predict=make_prompt_tail
    )
    return done.scores.select(
        *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")], "num_samples"
    )


def endpoint_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The same through an endpoint whose failures count as empty answers."""
    done = evaluate_model(
        sample_pairs(spark, folder), "google/gemma-2-9b-it", make_client=make_literal_client, max_workers=4, pause=0
    )
    failed = done.predictions.agg(F.count("error").alias("n_failed"))
    scores = done.scores.select(*[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2")], "num_samples")
    return scores.select(F.lit(1).alias("k"), "*").join(failed.select(F.lit(1).alias("k"), "*"), "k").drop("k")


def waves(spark: SparkSession, folder: str) -> DataFrame:
    asked = pairs(spark, folder).select("conv_id", "turn", "request")
    keys = ["conv_id", "turn"]
    made = predict_in_waves(
        asked, keys, lambda rows: batch_predict(rows, keys, "request", make_reversed_words), fresh_path(spark, "waves"), 3
    )
    return made.drop("error")


def mapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two array columns per conversation pair, made in batches; the texts are dropped."""
    asked = pairs(spark, folder)
    return map_batches(asked, make_word_shapes, ["request"], "lengths array<int>, initials array<string>", ["conv_id", "turn"], 64)


def stored_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions stored without a key in several files, scored against the samples by position."""
    samples = sample_pairs(spark, folder)
    made = samples.select("sample_id", F.concat_ws(" ", F.reverse(F.split("NER", " ")), F.lit("and so on")).alias("prediction"))
    path = fresh_path(spark, "no-key")
    in_order = made.repartitionByRange(7, "sample_id").sortWithinPartitions("sample_id")
    write_json_lines(in_order.select("prediction"), path)
    done = score_prediction_file(samples, path)
    scores = [F.round(c, 6).alias(c) for c in ("rouge1", "rouge2")]
    return done.predictions.join(done.per_sample, ["sample_id", "position"]).select("sample_id", "position", "prediction", *scores)


def match_records(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction records with embedding scores of the reply against the request."""
    samples = sample_pairs(spark, folder)
    texts = samples.select("sample_id", F.col("directions").alias("prediction"), F.col("NER").alias("reference"))
    scored = predict_once(embed_and_match(texts, ["sample_id"], make_word_embedder), "match-scores")
    rows = align(samples.withColumn("prediction", F.col("directions")), scored, ["sample_id"])
    records = prediction_records(rows, with_match_scores=True)
    return records.select(
        "title", "prediction", *[F.round(c, 6).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1")]
    )


def suite(spark: SparkSession, folder: str) -> DataFrame:
    """All four phases: line items as choices of two tasks, and a model over all conversation pairs."""
    items = table(spark, folder, "lineitem").select(
        F.concat(F.lit("subject"), (F.col("l_orderkey") % 4).cast("string")).alias("subject"),
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("choice_index"),
        F.col("l_partkey").cast("string").alias("choice_text"),
        (-F.col("l_extendedprice")).alias("loglik"),
        (F.col("l_orderkey") % 7 + 1).cast("int").alias("gold_index"),
    )
    options = SuiteOptions(
        enable_benchmarks=True,
        enable_domain=True,
        enable_operational=True,
        per_subject=33,
        subjects=("subject0", "subject1", "subject2"),
        completion_items=100,
    )
    path = fresh_path(spark, "suite")
    info = {"model_path": "org/Qwen", "model_type": "full"}
    domain = lambda: evaluate_model(sample_pairs(spark, folder), "Qwen/x", make_predict=make_prompt_tail)
    run_suite(options, path, info, items, items.where("subject = 'subject3'"), domain, run_id="run-1")
    stored = read_phases(spark, path).where("metric <> 'median_chars'")  # a sketch
    return stored.select("phase", "section", "metric", F.round("value", 6).alias("value"))


def output_format(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of documents checked as if they were outputs; some lack their list or title."""
    samples = raw_samples(spark, folder)
    answers = samples.select(
        "split",
        F.when(F.trim("ingredients") != "", reference_column(samples, template=ANSWER_TEMPLATE))
        .when(F.col("title").isNotNull(), F.lit("Certainly! Here's nothing"))
        .otherwise(F.lit(" "))
        .alias("prediction"),
    )
    report = output_report(answers, ["split"], exact_quantiles=True)
    rounded = ("format_rate", "empty_rate", "mean_chars", "mean_words", "median_chars")
    return report.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in report.columns])


def output_format_by_model(spark: SparkSession, folder: str) -> DataFrame:
    report = output_report(model_predictions(spark, folder), ["model"], exact_quantiles=True)
    return report.select("model", "n_outputs", "min_chars", "max_chars", F.round("empty_rate", 6).alias("empty_rate"))


QUERIES = {
    "batch_predict": batched,
    "endpoint_predict": endpoint,
    "endpoint_in_flight": endpoint_in_flight,
    "endpoint_failures": endpoint_failures,
    "prediction_records": records,
    "dialogue_records": dialogue,
    "evaluate_model": evaluation,
    "evaluate_endpoint": endpoint_evaluation,
    "predict_in_waves": waves,
    "match_records": match_records,
    "map_batches": mapped_columns,
    "positional_scores": stored_in_order,
    "suite_phases": suite,
    "output_format_report": output_format,
    "output_lengths_by_model": output_format_by_model,
}

_LEAD = "trim(array_to_string(list_reverse(string_split({0}, ' ')), ' '))"
_PREDICTED = f"{PAIR_SAMPLES}, made AS (SELECT *, {_LEAD.format('NER')} AS prediction FROM samples)"
_ENDPOINT = f"""{PAIRS}, made AS (
  SELECT conv_id, turn, CASE WHEN length(request) % 7 = 0 THEN '' ELSE replace(request, ' ', '_') END AS prediction,
    CASE WHEN length(request) % 7 = 0 THEN 'refused' END AS error FROM pairs)"""
_EVALUATED = f"{PAIR_SAMPLES}, texts AS (SELECT sample_id, NER AS prediction, {ANSWER} AS reference FROM samples)"
_WORDS = "len(list_filter(string_split(regexp_replace(lower(prediction), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"

_IN_ORDER = r"regexp_matches(prediction, '(?s)Certainly!.*\[ INGREDIENTS \].*\[ DIRECTIONS \]')"

_CALLED = f"""{PAIR_SAMPLES}, asked AS (SELECT *, {MERGED} AS content FROM samples),
  texts AS (SELECT sample_id, CASE WHEN length(content) % 5 = 0 THEN '' ELSE trim(content, chr(10) || ' ') END AS prediction,
    {ANSWER} AS reference, length(content) % 5 = 0 AS failed FROM asked)"""
_WORD_MATCH = f"""{PAIRS}, vectors AS (
  SELECT conv_id, turn, side, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM (
    SELECT conv_id, turn, 'p' AS side, string_split(reply, ' ') AS w FROM pairs
    UNION ALL SELECT conv_id, turn, 'r', string_split(request, ' ') FROM pairs)),
placed AS (
  SELECT *, [length(word), length(word) - length(replace(word, 'e', '')), 1]::DOUBLE[] AS v FROM vectors),
close_by AS (
  SELECT p.conv_id, p.turn, p.place AS i, r.place AS j, list_cosine_similarity(p.v, r.v) AS c
  FROM placed p JOIN placed r ON p.conv_id = r.conv_id AND p.turn = r.turn AND p.side = 'p' AND r.side = 'r'),
sides AS (
  SELECT conv_id, turn, p, r FROM
    (SELECT conv_id, turn, avg(c) AS p FROM (SELECT conv_id, turn, i, max(c) AS c FROM close_by GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT conv_id, turn, avg(c) AS r FROM (SELECT conv_id, turn, j, max(c) AS c FROM close_by GROUP BY ALL) GROUP BY ALL)
    USING (conv_id, turn))"""


def _subjects_sql(name: str, score: str, limit: int) -> str:
    """CTE ``name``: the best choice of the first items of every subject."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT 'subject' || l_orderkey % 4 AS subject, l_orderkey AS item_id, l_linenumber = l_orderkey % 7 + 1 AS hit
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {score} DESC, l_linenumber) = 1)
  QUALIFY row_number() OVER (PARTITION BY subject ORDER BY item_id) <= {limit})"""


_SUITE = f"""{_subjects_sql('plain', '-l_extendedprice', 33)},
{_subjects_sql('normalised', '-l_extendedprice / length(l_partkey::VARCHAR)::DOUBLE', 100)},
results AS (
  SELECT 'mmlu' AS section, 'accuracy' AS metric, avg(a) AS value FROM (
    SELECT avg(hit::INTEGER) AS a FROM plain WHERE subject <> 'subject3' GROUP BY subject)
  UNION ALL SELECT 'mmlu', 'samples', 99
  UNION ALL SELECT 'mmlu', 'observed', count(*) FROM plain WHERE subject <> 'subject3'
  UNION ALL SELECT 'hellaswag', 'observed', count(*) FROM normalised WHERE subject = 'subject3'
  UNION ALL SELECT 'hellaswag', 'accuracy_norm', avg(hit::INTEGER) FROM normalised WHERE subject = 'subject3'
  UNION ALL SELECT 'hellaswag', 'samples', 100)"""

ORACLES = {
    "evaluate_endpoint": f"""WITH {_CALLED}, {rouge_sql('texts', 'sample_id', 1, 'r1')}, {rouge_sql('texts', 'sample_id', 2, 'r2')}
      SELECT round(avg(r1.f), 6) AS rouge1, round(avg(r2.f), 6) AS rouge2, count(*) AS num_samples,
        (SELECT count(*) FROM texts WHERE failed) AS n_failed FROM r1 JOIN r2 USING (sample_id)""",
    "map_batches": f"""WITH {PAIRS} SELECT conv_id, turn, list_transform(string_split(request, ' '), lambda w: length(w)::INTEGER) AS lengths,
      list_transform(string_split(request, ' '), lambda w: w[1:1]) AS initials FROM pairs""",
    "positional_scores": f"""WITH {PAIR_SAMPLES}, texts AS (
        SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position, {ANSWER} AS reference,
          array_to_string(list_reverse(string_split(NER, ' ')), ' ') || ' and so on' AS prediction FROM samples),
      {rouge_sql('texts', 'sample_id', 1, 'r1')}, {rouge_sql('texts', 'sample_id', 2, 'r2')}
      SELECT sample_id, position, prediction, round(r1.f, 6) AS rouge1, round(r2.f, 6) AS rouge2
      FROM texts JOIN r1 USING (sample_id) JOIN r2 USING (sample_id)""",
    "predict_in_waves": f"WITH {PAIRS} SELECT conv_id, turn, {_LEAD.format('request')} AS prediction FROM pairs",
    "match_records": f"""WITH {_WORD_MATCH} SELECT 'Conversation ' || conv_id AS title, reply AS prediction,
      round(p, 6) AS bert_precision, round(r, 6) AS bert_recall, round(2 * p * r / (p + r), 6) AS bert_f1
      FROM pairs JOIN sides USING (conv_id, turn)""",
    "suite_phases": f"""WITH {_EVALUATED}, {rouge_sql('texts', 'sample_id', 1, 'r1')},
      {rouge_sql('texts', 'sample_id', 2, 'r2')}, {lcs_sql('texts', 'sample_id', 'rl')}, {_SUITE},
      overlap AS (SELECT avg(r1.f) AS a, avg(r2.f) AS b, avg(rl.f) AS c, count(*) AS n
        FROM r1 JOIN r2 USING (sample_id) JOIN rl USING (sample_id)),
      lengths AS (SELECT count(*) AS n, avg({_IN_ORDER}::INTEGER) AS ok, avg((trim(prediction) = '')::INTEGER) AS empty,
        avg(length(prediction)) AS chars, avg({_WORDS}) AS words, min(length(prediction)) AS low, max(length(prediction)) AS high FROM texts),
      stored AS (
        SELECT 1 AS since, section, metric, value::DOUBLE AS value FROM results
        UNION ALL SELECT 2, 'domain', unnest(['rouge1', 'rouge2', 'rougeL', 'num_samples']), unnest([a, b, c, n]::DOUBLE[]) FROM overlap
        UNION ALL SELECT 3, 'operational',
          unnest(['n_outputs', 'format_rate', 'empty_rate', 'mean_chars', 'mean_words', 'min_chars', 'max_chars']),
          unnest([n, ok, empty, chars, words, low, high]::DOUBLE[]) FROM lengths)
      SELECT phase, section, metric, round(value, 6) AS value FROM stored
      JOIN (VALUES ('benchmarks', 1), ('domain', 2), ('operational', 3), ('final', 4)) AS p(phase, upto) ON since <= upto""",
    "batch_predict": f"WITH {PAIRS} SELECT conv_id, turn, {_LEAD.format('request')} AS prediction FROM pairs",
    "endpoint_predict": f"WITH {_ENDPOINT} SELECT conv_id, turn, prediction, error FROM made",
    "endpoint_in_flight": f"WITH {_ENDPOINT} SELECT conv_id, turn, prediction, error FROM made",
    "endpoint_failures": f"""WITH {_ENDPOINT} SELECT turn, count(*) AS n_calls, count(error) AS n_failed
      FROM made GROUP BY turn""",
    "prediction_records": f"""WITH {_PREDICTED} SELECT title, NER, ingredients, directions, {ANSWER} AS reference_full,
      prediction FROM made""",
    "dialogue_records": f"WITH {_PREDICTED} SELECT NER AS dialogue, directions AS reference, prediction FROM made",
    "evaluate_model": f"""WITH {_EVALUATED}, {rouge_sql('texts', 'sample_id', 1, 'r1')},
      {rouge_sql('texts', 'sample_id', 2, 'r2')}, {lcs_sql('texts', 'sample_id', 'rl')}
      SELECT round(avg(r1.f), 6) AS rouge1, round(avg(r2.f), 6) AS rouge2, round(avg(rl.f), 6) AS "rougeL",
        count(*) AS num_samples FROM r1 JOIN r2 USING (sample_id) JOIN rl USING (sample_id)""",
    "output_lengths_by_model": f"""WITH {PREDICTIONS} SELECT model, count(*) AS n_outputs,
      min(length(prediction))::INTEGER AS min_chars, max(length(prediction))::INTEGER AS max_chars,
      round(avg((trim(prediction) = '')::INTEGER), 6) AS empty_rate FROM predictions GROUP BY model""",
    "output_format_report": f"""WITH {RAW}, outputs AS (
        SELECT split, CASE WHEN trim(ingredients) <> '' THEN {ANSWER} WHEN title IS NOT NULL
          THEN 'Certainly! Here''s nothing' ELSE ' ' END AS prediction FROM raw)
      SELECT split, count(*) AS n_outputs,
        round(avg({_IN_ORDER}::INTEGER), 6) AS format_rate,
        round(avg((trim(prediction) = '')::INTEGER), 6) AS empty_rate, round(avg(length(prediction)), 6) AS mean_chars,
        round(avg({_WORDS}), 6) AS mean_words, min(length(prediction))::INTEGER AS min_chars,
        round(quantile_cont(length(prediction), 0.5)::DOUBLE, 6) AS median_chars, max(length(prediction))::INTEGER AS max_chars
      FROM outputs GROUP BY split""",
}
