import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textforge.options import FieldMap, PrepOptions, SuiteOptions
from textforge.plans.evaluate import evaluate_model
from textforge.plans.prepare import prepare_splits, training_batches, training_tokens
from textforge.plans.suite import run_suite
from textforge.session import shared_dir
from textforge.sources.records import read_phases
from textforge.streaming.prepare import append_tokens, token_stream
from textforge.workloads.relations import documents, model_predictions, pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def samples(spark, n=200, test=20):
    rows = [
        (str(i), "test" if i < test else "train", f"T{i}" if i % 10 else " ", "salt", "i", f"step {i}", "[INST] x [/INST]")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "sample_id string, split string, title string, NER string, ingredients string, directions string, prompt string"
    )


def test_prepare(spark):
    options = PrepOptions("x", train=100, validation="all", test=5, base_model="Qwen/x", max_length=64)
    done = prepare_splits(samples(spark), options)
    # 200 rows, 20 of them test; every tenth has a blank title.
    assert {r["split"]: (r.n_before, r.n_after) for r in done.audit.collect()} == {"train": (180, 162), "test": (20, 18)}
    assert (done.train.count(), done.validation.count(), done.test.count()) == (100, 9, 5)
    assert done.train.join(done.validation, "sample_id").count() == 0
    tokens = training_tokens(done.train, options)
    make_encode = lambda: lambda texts: [(list(t.encode()), [(i, i + 1) for i in range(len(t.encode()))]) for t in texts]
    subwords = training_tokens(done.train, options, make_encode=make_encode)
    assert tokens.where("size(input_ids) > 64").count() == 0 and subwords.where("size(labels) = 64").count() == 100
    batches = training_batches(tokens, batch_size=8, drop_last=True)
    assert batches.select("batch_id").distinct().count() == 12 and batches.count() == 96


def test_prepare_field_map_and_missing_test(spark):
    df = samples(spark, 30, 0).withColumnsRenamed({"NER": "list", "directions": "steps"})
    options = PrepOptions("x", fields=FieldMap(input="list", output="steps"))
    with pytest.raises(KeyError):
        prepare_splits(df, options)
    done = prepare_splits(df, PrepOptions("x", fields=options.fields, require_test=False))
    assert done.test is None and done.train.count() + done.validation.count() == 27


def make_echo():
    return lambda prompts: [p.split("Include ingredients: ")[1].split("<|im_end|>")[0] for p in prompts]


def make_client():
    def call(messages):
        if messages[-1]["content"].endswith("7"):
            raise RuntimeError("no")
        return messages[-1]["content"]

    return call


def make_embedder():
    return lambda texts: [[[1.0, float(len(t))]] for t in texts]


def test_evaluate(spark, tmp_path):
    df = samples(spark, 40, 0).withColumn("NER", F.col("sample_id"))
    done = evaluate_model(
        df, "Qwen/x", make_predict=make_echo, make_embedder=make_embedder,
        results_path=str(tmp_path / "r"), records_path=str(tmp_path / "p"),
    )
    row = done.scores.first()
    assert row.num_samples == 40 and 0 < row.rouge1 < 1 and 0 < row.bert_f1 <= 1
    assert spark.read.json(str(tmp_path / "r")).first().model_name == "Qwen/x"
    written = spark.read.json(str(tmp_path / "p"))
    assert written.count() == 40 and "bert_f1" in written.columns
    asked = evaluate_model(df, "gemma", make_client=make_client, max_workers=2, pause=0)
    assert asked.predictions.where("prediction = '' AND error = 'no'").count() == 4
    assert asked.scores.first().num_samples == 40
    with pytest.raises(ValueError):
        evaluate_model(df, "gemma")


def test_suite(spark, tmp_path):
    choices = spark.createDataFrame(
        [(s, i, c, "x" * (c + 1), -float((i + c) % 3), 0) for s in ("a", "b", "c") for i in range(6) for c in range(3)],
        "subject string, item_id int, choice_index int, choice_text string, loglik double, gold_index int",
    )
    options = SuiteOptions(True, True, True, per_subject=3, subjects=("a", "b"), completion_items=6)
    evaluations = []

    def domain():
        evaluations.append(1)
        return evaluate_model(samples(spark, 10, 0), "Qwen/x", make_predict=make_echo)

    path = str(tmp_path / "phases")
    run = run_suite(options, path, {"model_path": "m", "model_type": "full"}, choices,
                    choices.where("subject = 'c'"), domain)
    stored = read_phases(spark, path).where(F.col("run_id") == run)
    values = {(r.phase, r.section, r.metric): r.value for r in stored.collect()}
    assert values["benchmarks", "mmlu", "accuracy"] == pytest.approx(1 / 3)
    assert values["final", "mmlu", "samples"] == 6 and values["final", "hellaswag", "samples"] == 6
    assert ("domain", "domain", "rouge1") in values and ("benchmarks", "domain", "rouge1") not in values
    assert values["operational", "operational", "n_outputs"] == 10
    assert evaluations == [1]


def test_suite_only_operational(spark, tmp_path):
    path = str(tmp_path / "phases")
    run_suite(SuiteOptions(enable_operational=True), path, {},
              evaluate_domain=lambda: evaluate_model(samples(spark, 10, 0), "Qwen/x", make_predict=make_echo))
    assert {r.section for r in read_phases(spark, path).collect()} == {"operational"}


def test_stream_equals_batch(spark, tmp_path):
    df = samples(spark, 60, 5)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    options = PrepOptions("x", base_model="Qwen/x")
    for part in (df.where("sample_id < '3'"), df.where("sample_id >= '3'")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        append_tokens(token_stream(stream, options), out, str(tmp_path / "ck")).awaitTermination(120)
    got = {r.sample_id: r.labels for r in spark.read.parquet(out).collect()}
    kept = prepare_splits(df, PrepOptions("x", base_model="Qwen/x", val_size=0.0))
    whole = training_tokens(kept.train.unionByName(kept.test), options)
    assert got == {r.sample_id: r.labels for r in whole.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


FOLDER = "/root/testdata/sf0.001"


def test_scans_read_needed_columns_only(spark):
    text = plan(pairs(spark, FOLDER).select("conv_id", "turn"))
    assert "EqualTo(role,user)" in text and "text:string" not in text
    assert "html" not in text and "n_chars" not in plan(documents(spark, FOLDER).select("doc_id", "lang"))


def test_predictions_of_models_need_no_extra_join(spark):
    assert plan(model_predictions(spark, FOLDER)).count("Join") == 1


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
