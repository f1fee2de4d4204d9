import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textforge.functions.text import fill, fixed, is_blank, path_segment, percent, preview, shown, signed_percent, strip

BLANKS = ["", " ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ",
          " ", " ", " ", "　", " \n\xa0\t"]
NOT_BLANK = ["a", " a ", "\n.\n", "​", "﻿", "\x00"]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


def test_blank_agrees_with_python(spark):
    rows = spark.createDataFrame([(v,) for v in BLANKS + NOT_BLANK], "v string").select("v", is_blank(F.col("v")))
    assert {v: b for v, b in rows.collect()} == {v: not v.strip() for v in BLANKS + NOT_BLANK}


@pytest.mark.parametrize("value", [" a b ", "　x\n\n", "\x1cq\x85", "plain", "", " \n ", "a "])
def test_strip_agrees_with_python(spark, value):
    assert one(spark, value, strip(F.col("v")))[0] == value.strip()


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=" \t\n\xa0　ab.", max_size=12))
def test_strip_any(spark, value):
    assert one(spark, value, strip(F.col("v")))[0] == value.strip()


def test_strip_long_inner_blank_run_is_linear(spark):
    value = "a" + " " * 200_000 + "b"
    assert one(spark, value, strip(F.col("v")))[0] == value


def test_shown_and_preview(spark):
    assert one(spark, None, shown(F.col("v")))[0] == "None"
    assert one(spark, None, shown(F.col("v"), ""))[0] == ""
    assert one(spark, "x" * 100, preview(F.col("v")))[0] == "x" * 100
    assert one(spark, "x" * 101, preview(F.col("v")))[0] == "x" * 100 + "..."
    assert one(spark, None, preview(F.col("v")))[0] is None


def test_fill_and_segment(spark):
    assert one(spark, "salt", fill("<{a}|{a}> {{x}}", {"a": F.col("v")}))[0] == "<salt|salt> {x}"
    assert one(spark, "org/set:v1", path_segment(F.col("v")))[0] == "org_set_v1"


def test_number_formats(spark):
    row = spark.range(1).select(
        percent(F.lit(0.30526)), signed_percent(F.lit(-0.1478)), signed_percent(F.lit(58.8), 0), fixed(F.lit(0.81695276))
    ).first()
    assert list(row) == ["30.5%", "-0.1%", "+59%", "0.8170"]
