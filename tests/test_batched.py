import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F

from textforge.operators.batched import map_batches
from textforge.operators.bootstrap import change_intervals, poisson_steps, replicate_means, replicate_weights, score_intervals


def test_lists_structs_and_nulls_come_back_typed(spark):
    df = spark.range(1000, numPartitions=3).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"), F.lit("gone").alias("x"))

    def make():
        calls = []

        def run(columns):
            calls.append(len(columns["t"]))
            assert len(columns["t"]) <= 7
            parts = [None if t is None else [int(c) for c in t] for t in columns["t"]]
            return {"digits": parts, "pair": [{"n": sum(calls), "s": t} for t in columns["t"]]}

        return run

    got = map_batches(df, make, ["t"], "digits array<int>, pair struct<n: long, s: string>", ["id"], batch_size=7)
    assert got.columns == ["id", "digits", "pair"] and got.schema["digits"].dataType.simpleString() == "array<int>"
    rows = got.collect()
    assert len(rows) == 1000
    assert all(r.digits == (None if r.id % 3 == 0 else [int(c) for c in str(r.id)]) and r.pair.s == (None if r.id % 3 == 0 else str(r.id)) for r in rows)
    assert map_batches(df.limit(0), make, ["t"], "digits array<int>, pair struct<n: long, s: string>").count() == 0


@pytest.mark.parametrize(
    "made,message",
    [
        (lambda c: {"y": c["id"][:-1]}, "values for"),
        (lambda c: {"z": c["id"]}, "not"),
        (lambda c: {"y": c["id"], "z": c["id"]}, "not"),
        (lambda c: {"y": ["text"] * len(c["id"])}, "text"),
    ],
)
def test_wrong_results_fail_the_job(spark, made, message):
    with pytest.raises(Exception, match=message):
        map_batches(spark.range(10), lambda: made, ["id"], "y long").collect()


def test_kept_and_made_names_must_differ(spark):
    with pytest.raises(ValueError, match="both kept and made"):
        map_batches(spark.range(3), lambda: lambda c: c, ["id"], "id long", ["id"])


def weight(key, replicate, seed=42):
    h = hashlib.md5(f"{seed}:{key}:{replicate // 8}".encode()).hexdigest()
    return sum(h[4 * (replicate % 8) :][:4] >= s for s in poisson_steps())


def test_weights_are_poisson_and_by_key_only(spark):
    steps = [int(s, 16) / 65536 for s in poisson_steps()]
    exact = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(len(steps))]
    assert all(abs(a - b) < 1e-5 for a, b in zip(steps, exact))
    df = spark.range(400).select(F.col("id").cast("string").alias("k"))
    got = {(r.k, r.replicate): r.weight for r in replicate_weights(df.repartition(7), ["k"], 50).collect()}
    want = {(str(k), b): weight(k, b) for k in range(400) for b in range(50)}
    assert got == {k: w for k, w in want.items() if w}
    assert abs(statistics.mean(want.values()) - 1) < 0.03 and abs(statistics.variance(want.values()) - 1) < 0.05


def test_intervals_against_plain_python(spark):
    rows = [(k, m, (k * 37 % 101) / 101 + (0.1 if m == "t" else 0), None if k == 5 else k / 60) for k in range(60) for m in "bt"]
    df = spark.createDataFrame(rows, "k long, model string, x double, y double")

    def mean(model, metric, b):
        used = [(weight(r[0], b), r[metric]) for r in rows if r[1] == model and r[metric] is not None]
        return sum(w * v for w, v in used) / sum(w for w, _ in used)

    means = {(r.model, r.replicate): (r.x, r.y) for r in replicate_means(df.repartition(6), ["k"], ["x", "y"], ["model"], 40).collect()}
    assert len(means) == 80
    for (model, b), (x, y) in means.items():
        assert x == pytest.approx(mean(model, 2, b)) and y == pytest.approx(mean(model, 3, b))
    found = {(r.model, r.metric): r for r in score_intervals(df, ["k"], ["x", "y"], replicates=40).collect()}
    values = sorted(mean("t", 2, b) for b in range(40))
    assert found["t", "x"].median == pytest.approx(statistics.median(values)) and found["t", "x"].replicates == 40
    assert values[0] <= found["t", "x"].low < found["t", "x"].median < found["t", "x"].high <= values[-1]
    change = {r.metric: r for r in change_intervals(df, ["k"], ["x", "y"], "b", replicates=40).collect()}
    assert abs(change["y"].low) < 1e-9 and abs(change["y"].high) < 1e-9
    paired = statistics.median((mean("t", 2, b) - mean("b", 2, b)) / mean("b", 2, b) * 100 for b in range(40))
    assert change["x"].median == pytest.approx(paired)
    spread = change["x"].high - change["x"].low
    assert 0 < spread < 10  # both models drew the same samples, so their difference hardly varies


def test_intervals_of_nothing(spark):
    empty = spark.createDataFrame([], "k long, model string, x double")
    assert score_intervals(empty, ["k"], ["x"]).collect() == []
    nulls = spark.createDataFrame([(None, "m", 1.0), (None, "m", 3.0)], "k long, model string, x double")
    assert {r.x for r in replicate_means(nulls, ["k"], ["x"], ["model"], 64).collect()} == {2.0}
