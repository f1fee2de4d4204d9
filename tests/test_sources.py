import json

import pytest
from pyspark.sql import functions as F

from textforge.operators.compare import best_model, change, headline_metrics, rank_models, stack_scores, summary
from textforge.sources.datasets import from_columns, load_or_materialise, path_exists, read_splits
from textforge.sources.records import (
    append_phase,
    append_result,
    dialogue_records,
    prediction_records,
    read_phases,
    write_json_lines,
)
from textforge.sources.scores import normalise_scores, read_score_files, read_training_log
from textforge.sources.snapshots import latest_snapshot

# Published scores and record keys, as stored by their producers.
SCORE_FILES = {
    "rouge_llama": {"model_name": "meta-llama/Llama-3.2-1B-Instruct", "num_samples": 200,
                    "rouge1": 0.27199354931101266, "rouge2": 0.08040581104495602, "rougeL": 0.17256304164527156},
    "rouge_gemma": {"model_name": "google/gemma-2-2b-it", "num_samples": 200,
                    "rouge1": 0.30076379344762494, "rouge2": 0.07994510400561679, "rougeL": 0.17247927495754717},
    "rouge_qwen": {"model_name": "Qwen/Qwen2.5-1.5B-Instruct", "num_samples": 200,
                   "rouge1": 0.3052601650183084, "rouge2": 0.07062790287388587, "rougeL": 0.16772462973488583},
    "rouge_tuned": {"rouge1": 0.4848035751135884, "rouge2": 0.2830489346672995, "rougeL": 0.39176641182249644,
                    "num_samples": 200, "base_model": "Qwen/Qwen2.5-1.5B-Instruct", "adapter_id": "org/adapter"},
    "bert_base": {"model_name": "Qwen/Qwen2.5-1.5B-Instruct", "num_samples": 200,
                  "bert_precision": 0.8169527649879456, "bert_recall": 0.8568416833877563, "bert_f1": 0.8363305926322937},
    "bert_tuned": {"finetuned_model_id": "org/tuned", "base_model": "Qwen/Qwen2.5-1.5B-Instruct", "num_samples": 200,
                   "bert_precision": 0.8152858018875122, "bert_recall": 0.8560771346092224, "bert_f1": 0.8350949287414551},
    "bench_base": {"timestamp": "2025-11-30T17:43:56", "model_path": "Qwen/Qwen2.5-1.5B-Instruct", "model_type": "full",
                   "base_model": None, "benchmarks": {
                       "mmlu": {"accuracy": 0.7070707070707071, "samples": 99, "subjects": ["a", "b", "c"]},
                       "hellaswag": {"accuracy_norm": 0.66, "samples": 100}}},
    "bench_tuned": {"timestamp": "2025-11-30T17:46:02", "model_path": "org/tuned", "model_type": "full",
                    "base_model": None, "benchmarks": {
                        "mmlu": {"accuracy": 0.6868686868686869, "samples": 99, "subjects": ["a", "b", "c"]},
                        "hellaswag": {"accuracy_norm": 0.64, "samples": 100}}},
}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scores")
    for name, content in SCORE_FILES.items():
        (folder / f"{name}.json").write_text(json.dumps(content, indent=2))
    return read_score_files(spark, [str(folder)])


@pytest.fixture(scope="module")
def comparison(records):
    """The base model against its tuned version."""
    file = F.regexp_extract("source_file", r"([^/]+)\.json$", 1)
    kept = records.where(~file.isin("rouge_llama", "rouge_gemma"))
    variant = F.when(file.endswith("tuned"), F.lit("finetuned")).otherwise(F.lit("base"))
    return normalise_scores(kept, variant=variant).drop("base_model")


def test_normalised(records):
    rows = normalise_scores(records.where("model_path IS NULL")).collect()
    assert len(rows) == 4 * 3 + 2 * 3
    found = {(r.model, r.variant, r.metric): (r.value, r.num_samples) for r in rows}
    assert found["org/adapter", "finetuned", "rouge2"] == (0.2830489346672995, 200)
    assert found["org/tuned", "finetuned", "bert_f1"] == (0.8350949287414551, 200)
    assert found["google/gemma-2-2b-it", "base", "rouge1"] == (0.30076379344762494, 200)


def test_published_changes(comparison):
    rows = {r.metric: r for r in change(comparison).collect()}
    assert [round(rows[m].relative_pct, 1) for m in ("rouge1", "rouge2", "rougeL")] == [58.8, 300.8, 133.6]
    assert round(rows["bert_f1"].relative_pct, 1) == -0.1
    assert [round(rows[m].points, 1) for m in ("mmlu", "hellaswag")] == [-2.0, -2.0]
    assert [round(rows[m].retention * 100, 2) for m in ("mmlu", "hellaswag")] == [97.14, 96.97]
    assert rows["rouge1"].direction == "positive" and rows["mmlu"].direction == "negative"


def test_published_summary(comparison):
    rows = [tuple(r) for r in summary(comparison).orderBy("position").collect()]
    assert [r[1:5] for r in rows] == [
        ("ROUGE-1", "30.5%", "48.5%", "+59%"),
        ("ROUGE-2", "7.1%", "28.3%", "+301%"),
        ("ROUGE-L", "16.8%", "39.2%", "+134%"),
        ("BERT F1", "83.6%", "83.5%", "-0.1%"),
        ("MMLU", "70.7%", "68.7%", "-2.0%"),
        ("HellaSwag", "66.0%", "64.0%", "-2.0%"),
    ]
    assert rows[4][5] == "worse than its base"


def test_ranking_and_best(records):
    base = records.where("rouge1 IS NOT NULL AND model_name IS NOT NULL").withColumn(
        "model", F.col("model_name")
    )
    ranks = {r.model: (r["rank"], r.supports_system) for r in rank_models(base, "model", "rouge1", "model").collect()}
    assert ranks["Qwen/Qwen2.5-1.5B-Instruct"] == (1, True) and ranks["google/gemma-2-2b-it"] == (2, False)
    assert best_model(base, "model", "rouge1", "model").first().model == "Qwen/Qwen2.5-1.5B-Instruct"
    closed = base.withColumn("open", ~F.col("model").contains("Qwen"))
    assert best_model(closed, "model", "rouge1", "model", "open").first().model == "meta-llama/Llama-3.2-1B-Instruct"
    assert best_model(base.where("false"), "model", "rouge1", "model").count() == 0


def test_change_edge_cases(spark):
    df = spark.createDataFrame(
        [("m", "base", 0.0), ("m", "finetuned", 0.0), ("n", "base", 0.5)], "metric string, variant string, value double"
    )
    row = change(df).collect()
    assert len(row) == 1 and row[0].relative_pct is None and row[0].direction == "positive"


def test_stack_and_headline(spark):
    a = spark.createDataFrame([("x", 1.0)], "model string, rouge1 double")
    b = spark.createDataFrame([("y", 2.0)], "model string, bert_f1 double")
    assert {tuple(r) for r in stack_scores([a, b]).collect()} == {("x", 1.0, None), ("y", None, 2.0)}
    assert headline_metrics(a.withColumn("rouge1_per_sample", F.array("rouge1"))).columns == ["model", "rouge1"]


def test_dataset_is_stored_once(spark, tmp_path):
    calls = []

    def ingest():
        calls.append(1)
        return spark.createDataFrame([(1, "train"), (2, "test")], "sample_id int, split string")

    for _ in range(2):
        df = load_or_materialise(spark, "org/set:v1", str(tmp_path), ingest)
        assert df.count() == 2
    assert calls == [1] and path_exists(spark, f"{tmp_path}/org_set_v1")
    plan = df.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_unfinished_copy_is_written_again(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "part-0.parquet").write_bytes(b"torn")
    df = load_or_materialise(spark, "set", str(tmp_path), lambda: spark.createDataFrame([(1, "train")], "i int, split string"))
    assert df.count() == 1


def test_splits_and_columns(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.jsonl").write_text('{"title": "%s"}\n' % name)
    df = read_splits(spark, {n: str(tmp_path / f"{n}.jsonl") for n in ("train", "test")}, "json")
    assert {tuple(r) for r in df.select("split", "title").collect()} == {("train", "train"), ("test", "test")}
    assert from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}).collect()[1].b == "y"
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [1], "b": []})


def test_records(spark, tmp_path):
    rows = [("T", None, "i", "d é", "p", 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(
        rows, "title string, NER string, ingredients string, directions string, prediction string, "
        "bert_precision double, bert_recall double, bert_f1 double"
    )
    path = str(tmp_path / "out")
    write_json_lines(prediction_records(df, with_match_scores=True), path)
    line = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert list(line) == ["title", "NER", "ingredients", "directions", "reference_full", "prediction",
                          "bert_precision", "bert_recall", "bert_f1"]
    assert line["NER"] is None and line["directions"] == "d é"
    assert prediction_records(df.drop("NER")).first().NER == ""
    assert dialogue_records(df, "title", "directions").columns == ["dialogue", "reference", "prediction"]


def test_results_append(spark, tmp_path):
    path = str(tmp_path / "results")
    scores = spark.createDataFrame([(0.5, 10)], "rouge1 double, num_samples bigint")
    append_result(scores, path, {"model_name": "a"})
    append_result(scores, path, {"base_model": "a", "adapter_id": "b"})
    rows = normalise_scores(read_score_files(spark, [path])).collect()
    assert {(r.model, r.variant, r.value) for r in rows} == {("a", "base", 0.5), ("b", "finetuned", 0.5)}


def test_phases(spark, tmp_path):
    path = str(tmp_path / "phases")
    part = spark.createDataFrame([("mmlu", "accuracy", 0.7)], "section string, metric string, value double")
    append_phase(spark, path, "r1", "benchmarks", {"model_type": "full", "base_model": "x"}, part)
    append_phase(spark, path, "r1", "final", {"model_type": "lora", "base_model": "x", "duration_minutes": 2.0}, part)
    append_phase(spark, path, "r1", "final", {"model_type": "lora", "base_model": "x", "duration_minutes": 2.0}, part)
    append_phase(spark, path, "r2", "final", {"model_type": "full"}, part)
    assert read_phases(spark, path).count() == 3
    first = read_phases(spark, path).where("run_id = 'r1'").collect()
    rows = {r.phase: (r.base_model, r.duration_minutes, r.value) for r in first}
    assert rows == {"benchmarks": (None, None, 0.7), "final": ("x", 2.0, 0.7)}
    with pytest.raises(ValueError):
        append_phase(spark, path, "r1", "other", {}, part)


def test_snapshots(spark):
    names = ["checkpoint-200", "checkpoint-1000", "checkpoint-300", "checkpoint-x", "checkpoint", "tmp-5000", "checkpoint-7b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert latest_snapshot(df, "name").first().latest == "checkpoint-1000"
    assert latest_snapshot(df.where("name LIKE 'tmp%'"), "name").count() == 0


def test_training_log(spark, tmp_path):
    log = {"epoch": 0.0025, "global_step": 300, "log_history": [
        {"epoch": 0.0002, "grad_norm": 0.48, "learning_rate": 9.6e-05, "loss": 1.6881, "step": 25},
        {"epoch": 0.0008, "eval_loss": 1.2476, "eval_runtime": 6.26, "eval_samples_per_second": 31.948,
         "eval_steps_per_second": 7.987, "step": 100}]}
    (tmp_path / "state.json").write_text(json.dumps(log, indent=2))
    rows = read_training_log(spark, [str(tmp_path / "state.json")]).orderBy("step").collect()
    assert [(r.step, r.loss, r.eval_loss) for r in rows] == [(25, 1.6881, None), (100, None, 1.2476)]
