import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textforge.operators.inference import (
    align,
    batch_predict,
    endpoint_predict,
    failure_report,
    predict_once,
    predict_in_waves,
    predict_once,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_sizes():
    """Answers with the size of the batch the prompt came in."""

    def predict(prompts):
        return [f"  {p}:{len(prompts)}\n" for p in prompts]

    return predict


def make_short():
    return lambda prompts: prompts[:-1]


def make_client():
    def call(text):
        if text == "p3":
            raise TimeoutError
        if text == "p4":
            raise ValueError("bad input")
        return f" {text}! "

    return call


@pytest.fixture(scope="module")
def asked(spark):
    return spark.range(10).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)


def test_batches_and_strip(asked):
    rows = {r.id: r for r in batch_predict(asked, ["id"], "prompt", make_sizes, batch_size=4).collect()}
    assert [rows[i].prediction for i in (0, 7, 9)] == ["p0:4", "p7:4", "p9:2"]
    assert all(r.error is None for r in rows.values())


def test_wrong_count_fails(asked):
    with pytest.raises(Exception, match="10 prompts gave"):
        batch_predict(asked, ["id"], "prompt", make_short, batch_size=5).collect()


def test_endpoint_failures_stay_rows(asked):
    out = endpoint_predict(asked, ["id"], "prompt", make_client, max_workers=3, pause=0)
    assert out.rdd.getNumPartitions() == 3
    rows = {r.id: (r.prediction, r.error) for r in out.collect()}
    assert len(rows) == 10
    assert rows[1] == ("p1!", None)
    assert rows[3] == ("", "TimeoutError") and rows[4] == ("", "bad input")
    report = failure_report(out.withColumn("model", F.lit("m")), "model").first()
    assert (report.n_calls, report.n_failed) == (10, 2)


def test_no_errors_keep_the_type(spark):
    df = spark.createDataFrame([(1, "x")], "id int, prompt string")
    assert endpoint_predict(df, ["id"], "prompt", make_client, 1, 0).first().error is None


def test_written_once_and_aligned(spark, asked):
    calls = spark.sparkContext.accumulator(0)

    def make_counting():
        def predict(prompts):
            calls.add(len(prompts))
            return prompts

        return predict

    made = predict_once(batch_predict(asked, ["id"], "prompt", make_counting))
    joined = align(asked, made, ["id"])
    assert joined.where("prediction = prompt").count() == 10
    joined.count()
    assert calls.value == 10


def test_empty_input(asked):
    none = asked.where("id < 0")
    assert batch_predict(none, ["id"], "prompt", make_sizes).count() == 0
    assert endpoint_predict(none, ["id"], "prompt", make_client, 2, 0).count() == 0


def test_waves_resume(asked, tmp_path):
    path, seen = str(tmp_path / "waves"), []

    def predict(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return batch_predict(rows, ["id"], "prompt", make_sizes)

    with pytest.raises(RuntimeError):
        predict_in_waves(asked, ["id"], predict, path, waves=4)
    out = predict_in_waves(asked, ["id"], predict, path, waves=4)
    assert sorted(r.id for r in out.collect()) == list(range(10))
    assert len(seen) == 5 and out.columns == ["id", "prediction", "error"]


def _most_open(rows):
    """Most calls open at once, from answers that say when they began and ended."""
    events = [(float(x), step) for r in rows for x, step in zip(r.prediction.split(":"), (1, -1))]
    now = most = 0
    for _, step in sorted(events):
        now += step
        most = max(most, now)
    return most


@pytest.mark.parametrize("workers,in_flight,tasks", [(6, 3, 2), (4, 4, 1), (3, 1, 3), (2, 9, 1)])
def test_calls_in_flight_are_bounded_and_in_order(spark, workers, in_flight, tasks):
    import time

    def make():
        def call(text):
            begin = time.monotonic()
            time.sleep(0.05)
            return f"{begin}:{time.monotonic()}"

        return call

    df = spark.range(24).select("id", F.col("id").cast("string").alias("prompt"))
    out = endpoint_predict(df, ["id"], "prompt", make, workers, pause=0, in_flight=in_flight)
    assert out.rdd.getNumPartitions() == tasks
    rows = predict_once(out).collect()
    assert {r.id for r in rows} == set(range(24)) and all(r.error is None for r in rows)
    assert 1 < _most_open(rows) <= workers


def test_retries_and_rate(spark):
    import time

    def make():
        seen = {}

        def call(text):
            seen[text] = seen.get(text, 0) + 1
            if seen[text] <= int(text) % 4:
                raise RuntimeError(f"attempt {seen[text]}")
            return f"{text} after {seen[text]}"

        return call

    df = spark.range(12).select("id", F.col("id").cast("string").alias("prompt"))
    rows = {r.id: r for r in endpoint_predict(df, ["id"], "prompt", make, 3, pause=0, in_flight=3, retries=2, backoff=0.001).collect()}
    for i in range(12):
        assert (rows[i].prediction, rows[i].error) == (("", "attempt 3") if i % 4 == 3 else (f"{i} after {i % 4 + 1}", None))
    begin = time.monotonic()
    paced = endpoint_predict(df, ["id"], "prompt", lambda: lambda text: text, 4, pause=0, in_flight=4, calls_per_second=20)
    assert len(paced.collect()) == 12 and time.monotonic() - begin >= 11 / 20


def test_answers_stay_beside_their_rows(spark):
    import random
    import time

    def make():
        def call(text):
            time.sleep(random.random() / 100)
            return "re " + text

        return call

    df = spark.range(200).select("id", F.concat(F.lit("q"), F.col("id")).alias("prompt"), F.lit("x").alias("more"))
    rows = endpoint_predict(df, ["id"], "prompt", make, 8, pause=0, in_flight=8, carry=["more"]).collect()
    assert sorted((r.id, r.prediction, r.more) for r in rows) == [(i, f"re q{i}", "x") for i in range(200)]
