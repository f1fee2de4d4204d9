"""Generate, align, score and store."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions.templates import render_messages
from textforge.operators.chat import build_messages, reference_column
from textforge.operators.inference import batch_predict, endpoint_predict, predict_in_waves, predict_once
from textforge.operators.matching import embed_and_match, match_corpus
from textforge.operators.ordering import number_rows
from textforge.operators.rouge import corpus_scores, rouge_scores
from textforge.operators.sampling import first_n
from textforge.options import FieldMap
from textforge.registry import get_model_for_path
from textforge.sources.positions import align_by_position, read_records
from textforge.sources.records import MATCH_FIELDS, append_result, prediction_records, write_json_lines


@dataclass
class Evaluation:
    """Corpus scores (one row), per-sample scores and the predictions they come from."""

    scores: DataFrame
    per_sample: DataFrame
    predictions: DataFrame


def prompts(samples: DataFrame, model_path: str, fields: FieldMap = FieldMap()) -> DataFrame:
    """Messages and rendered generation prompt for every sample."""
    model = get_model_for_path(model_path)
    return samples.withColumn("messages", build_messages(samples, model, fields=fields)).withColumn(
        "text_prompt", render_messages(F.col("messages"), add_generation_prompt=True)
    )


def evaluate_model(
    samples: DataFrame,
    model_path: str,
    make_predict: Callable | None = None,
    make_client: Callable | None = None,
    make_embedder: Callable | None = None,
    key: str = "sample_id",
    fields: FieldMap = FieldMap(),
    batch_size: int = 8,
    max_workers: int = 5,
    pause: float = 0.1,
    results_path: str | None = None,
    records_path: str | None = None,
    num_samples: int | None = None,
    base_model: str | None = None,
    adapter_id: str | None = None,
    answers_path: str | None = None,
    run_id: str | None = None,
) -> Evaluation:
    """Score one model on samples (the first ``num_samples`` by key, if given).

    Give ``make_predict`` for a batched model or ``make_client`` for a remote endpoint; an
    embedder adds embedding-match scores. The columns of a sample travel with it through the model,
    and answers and scores are written once each and read from there. With ``answers_path`` the answers
    are stored there in waves, and a later call goes on after the last complete one. For a tuned model
    give its base and its adapter: they are stored as its identity. With ``run_id`` a result is stored once per run.
    """
    if (make_predict is None) == (make_client is None):
        raise ValueError("give either make_predict or make_client")
    samples = first_n(samples, num_samples, [key])
    asked = prompts(samples, model_path, fields).withColumn("reference", reference_column(samples, fields))
    carry = [c for c in (*samples.columns, "reference") if c != key]

    def ask(rows: DataFrame) -> DataFrame:
        if make_predict is not None:
            return batch_predict(rows, [key], "text_prompt", make_predict, batch_size, carry)
        return endpoint_predict(rows, [key], "messages", make_client, max_workers, pause, carry)

    answered = predict_in_waves(predict_once(asked, "asked"), [key], ask, answers_path) if answers_path else predict_once(ask(asked))
    # Records with embedding scores need the whole sample beside them, so it comes along; nothing is joined.
    carried = answered.columns if records_path and make_embedder is not None else [key, "prediction", "reference"]
    scored = rouge_scores(answered, carried)
    figures = [c for c in scored.columns if c not in carried]
    if make_embedder is None:
        kept = predict_once(scored.select(key, *figures), "scores")
        metrics = corpus_scores(kept, ["rouge1", "rouge2", "rougeL"])
    else:
        kept = predict_once(embed_and_match(scored, list(dict.fromkeys([key, *(carried if records_path else []), *figures])), make_embedder), "scores")
        figures += MATCH_FIELDS
        metrics = kept.agg(*[F.avg(m).alias(m) for m in ("rouge1", "rouge2", "rougeL", *MATCH_FIELDS)], F.count(F.lit(1)).alias("num_samples"))
    per_sample = kept.select(key, *figures)
    if results_path:
        tuned = {"base_model": base_model, "adapter_id": adapter_id or model_path}
        append_result(metrics, results_path, tuned if base_model else {"model_name": model_path}, run_id)
    if records_path:
        rows = answered if make_embedder is None else kept
        write_json_lines(prediction_records(rows, fields, make_embedder is not None), records_path)
    return Evaluation(metrics, per_sample, answered.select(key, "prediction", "error"))


def score_prediction_file(
    samples: DataFrame,
    path: str | list[str],
    key: str = "sample_id",
    order: tuple[str, ...] = (),
    prediction: str = "prediction",
    fields: FieldMap = FieldMap(),
) -> Evaluation:
    """Score stored predictions that carry no key: JSON Lines whose n-th line answers the n-th sample.

    Samples are in the order of ``order``, of ``key`` if it is not given, and the lines in that of the files' names. A
    file with more or fewer lines than there are samples is an error.
    """
    numbered = number_rows(samples, *(order or (key,)))
    read = read_records(samples.sparkSession, path, f"`{prediction}` string")
    answers = read.select("position", F.coalesce(F.col(prediction), F.lit("")).alias("prediction"))
    aligned = align_by_position(numbered.withColumn("reference", reference_column(samples, fields)).drop("prediction"), answers)
    predictions = predict_once(aligned, "aligned")
    per_sample = predict_once(rouge_scores(predictions, [key, "position"]), "scores")
    return Evaluation(corpus_scores(per_sample, ["rouge1", "rouge2", "rougeL"]), per_sample, predictions.select(key, "position", "prediction"))


__all__ = ["Evaluation", "evaluate_model", "match_corpus", "prompts", "score_prediction_file"]
