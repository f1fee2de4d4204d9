import pytest

from textforge.operators.validity import filter_audit, filter_valid, valid

COLUMNS = "sample_id string, split string, title string, NER string, ingredients string, directions string, prompt string"
OK = "[INST] x [/INST]"
ROWS = [
    ("a1", "train", "Honey Garlic Chicken", "chicken", "2 lbs", "1. Preheat", OK),
    ("a2", "train", None, "salt", "x", "y", OK),
    ("a3", "train", " \t\n", "salt", "x", "y", OK),
    ("a4", "train", " ", "salt", "x", "y", OK),
    ("a5", "train", "T", None, "x", "y", OK),
    ("a6", "test", "T", "salt", "x", "y", "[INST] x"),
    ("a7", "test", "T", "salt", "x", "y", "[inst] x [/inst]"),
    ("a8", "train", "T", "salt", "x", "y", "text [/INST] [INST]"),
    ("a9", "test", "T", "salt", "x", "y", None),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_rows(samples):
    assert sorted(r.sample_id for r in filter_valid(samples).collect()) == ["a1", "a5", "a8"]


def test_switch(samples):
    assert filter_valid(samples, enabled=False).count() == len(ROWS)


def test_audit(samples):
    rows = {r["split"]: (r.n_before, r.n_after, r.n_removed) for r in filter_audit(samples).collect()}
    assert rows == {"train": (6, 3, 3), "test": (3, 0, 3)}


@pytest.mark.parametrize("column", ["title", "ingredients", "directions", "prompt"])
def test_absent_column_keeps_nothing(samples, column):
    assert filter_valid(samples.drop(column)).count() == 0


def test_flag_is_never_null(samples):
    assert samples.select(valid(samples).alias("v")).where("v IS NULL").count() == 0


def test_array_column(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id int, ingredients array<string>")
    kept = filter_valid(df, required=["ingredients"], marker_column=None)
    assert [r.id for r in kept.collect()] == [1]
