import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textforge.operators import sampling
from textforge.operators.sampling import (
    extremes,
    find_cut,
    first_n,
    first_n_per_group,
    present_splits,
    select_subset,
    split_report,
    split_validation,
    with_ordinal,
)


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), str(i)))


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000)


@pytest.mark.parametrize("n", ["all", None])
def test_everything(numbers, n):
    assert select_subset(numbers, n, "id") is numbers


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_exact_size_and_rows(numbers, n):
    assert ids(select_subset(numbers, n, "id", 42)) == sorted(order(range(1000), 42)[:n])


@pytest.mark.parametrize("n", [0, 1, 2, 500, 999])
def test_narrowing_gives_the_same_rows(numbers, n, monkeypatch):
    monkeypatch.setattr(sampling, "CUT_DIGITS", 1)
    assert ids(select_subset(numbers, n, "id", 7)) == sorted(order(range(1000), 7)[:n])


def test_too_many_requested_warns(numbers):
    with pytest.warns(UserWarning, match="1000 available"):
        assert select_subset(numbers, 2000, "id").count() == 1000


def test_independent_of_partitioning(numbers):
    few = select_subset(numbers.repartition(2), 100, "id", 1)
    many = select_subset(numbers.repartition(23), 100, "id", 1)
    assert ids(few) == ids(many)


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 64, 999, 1001, 1200, 1500])
def test_repeated_and_null_keys(spark, n):
    """Exactly n rows, the same ones for every partitioning, whatever the keys are."""
    df = spark.range(1200).select(F.when(F.col("id") % 40 != 0, F.col("id") % 7).alias("k"), F.col("id").alias("row"))
    got = select_subset(df, n, "k", 3)
    assert got.count() == min(n, 1200)
    assert ids(got, "row") == ids(select_subset(df.repartition(17), n, "k", 3), "row")


def test_equal_rows_at_the_cut(spark):
    df = spark.createDataFrame([("x",)] * 10, "k string")
    cut = find_cut(df, "k", 1, k=3)
    assert (cut.total, cut.tied, cut.wanted) == (10, 10, 3) and select_subset(df, 3, "k", 1).count() == 3
    with pytest.raises(ValueError, match="must be unique"):
        split_validation(df.withColumn("split", F.lit("train")), "k", 0.3, 1)


@pytest.mark.parametrize("n,share", [(1000, 0.05), (140, 0.05), (7, 0.3), (1, 0.05)])
def test_split_sizes(spark, n, share):
    df = spark.range(n).withColumn("split", F.lit("train")).unionByName(
        spark.range(n, n + 5).withColumn("split", F.lit("test"))
    )
    out = split_validation(df, "id", share, 42)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    wanted = math.ceil(share * n)
    assert counts.get("validation", 0) == wanted
    assert counts.get("train", 0) == n - wanted
    assert counts["test"] == 5
    assert out.select("id").distinct().count() == n + 5


def test_split_needs_no_shuffle(spark):
    df = spark.range(100).withColumn("split", F.lit("train"))
    plan = split_validation(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_present_validation_split_is_kept(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation")], "id int, split string")
    assert split_validation(df, "id") is df
    renamed = split_validation(df.replace("validation", "val", "split"), "id")
    assert sorted(r["split"] for r in renamed.collect()) == ["train", "validation"]
    assert present_splits(df, ["validation", "test"]) == {"validation"}
    assert present_splits(df.where("false"), ["validation"]) == set()


def test_always_splits_anew(spark):
    df = spark.createDataFrame([(i, "train") for i in range(20)] + [(99, "val")], "id int, split string")
    out = split_validation(df, "id", 0.1, always=True)
    assert sorted(r["split"] for r in out.collect()) == ["train"] * 18 + ["validation"] * 2


def test_report(spark):
    df = spark.createDataFrame([("train",)] * 3 + [("test",)], "split string")
    assert {r["split"]: (r.n_rows, r.pct) for r in split_report(df).collect()} == {
        "train": (3, 75.0),
        "test": (1, 25.0),
    }


def test_first_n(numbers):
    assert ids(first_n(numbers, 3, ["id"])) == [0, 1, 2]
    assert first_n(numbers, 0, ["id"]).count() == 1000
    assert first_n(numbers, None, ["id"]).count() == 1000
    assert first_n(numbers, 5000, ["id"]).count() == 1000


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_first_n_per_group_with_a_hot_group(spark, n):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")))
    out = first_n_per_group(df, ["g"], ["id"], n)
    wanted = {}
    for i in range(6000):
        wanted.setdefault("hot" if i % 3 == 0 else str(i % 50), []).append(i)
    assert ids(out) == sorted(i for members in wanted.values() for i in members[:n])
    assert out.columns == ["id", "g"]


def test_ordinals(spark):
    df = spark.range(3000).repartition(5)
    got = {r.id: r.ordinal for r in with_ordinal(df, "id", 9).collect()}
    assert got == {i: position for position, i in enumerate(order(range(3000), 9))}


def test_extremes(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("d", 1), ("c", 1)], "m string, v int")
    row = extremes(df, "m", "v").first()
    assert (row.largest, row.smallest, row.mean_value, row.value_range) == ("a", "c", 3.0, 4)
