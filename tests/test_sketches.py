import pytest

from textforge.operators.sketches import (
    distinct_error, mean, merge_sketches, n_distinct, quantile, rank_error, read_parts, store_part, value_sketches,
)
from pyspark.sql import functions as F


def rows(spark, n=60_000):
    """Three parts of two groups and the null one; a group holds two thirds of all rows."""
    group = F.when(F.col("id") % 30 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "small").otherwise("big")
    return spark.range(n).select(
        group.alias("g"), (F.col("id") % 7 % 3).alias("part"), F.md5((F.col("id") % 20_000).cast("string")).alias("word"), F.pmod(F.xxhash64("id"), F.lit(5_000)).alias("size")
    )


def test_merged_parts_are_within_their_bounds(spark, tmp_path):
    df, path = rows(spark), str(tmp_path / "sketches")
    for part in range(3):
        made = value_sketches(df.where(F.col("part") == part), ["g"], ["word"], ["size"])
        assert store_part(made, path, str(part))
        assert not store_part(made, path, str(part))
    merged = merge_sketches(read_parts(spark, path), ["g"])
    got = {
        r.g: r for r in merged.select("g", "n_rows", "size_min", "size_max", n_distinct("word").alias("words"), mean("size").alias("mean"),
                                      *[quantile("size", q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)]).collect()
    }
    exact = {r.g: r for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("words"), F.avg("size").alias("mean"),
                                                F.min("size").alias("low"), F.max("size").alias("high"), F.sort_array(F.collect_list("size")).alias("sizes")).collect()}
    assert set(got) == set(exact) == {"big", "small", None}
    for g, e in exact.items():
        r = got[g]
        assert (r.n_rows, r.size_min, r.size_max) == (e.n, e.low, e.high)
        assert r.mean == pytest.approx(e.mean)
        assert abs(r.words - e.words) <= 4 * distinct_error() * e.words
        for q, value in ((0.1, r.q10), (0.5, r.q50), (0.9, r.q90)):
            below, upto = sum(x < value for x in e.sizes) / e.n, sum(x <= value for x in e.sizes) / e.n
            assert below - 2 * rank_error() <= q <= upto + 2 * rank_error()


def test_coarser_groups_come_from_finer_ones(spark):
    df = rows(spark, 9_000)
    fine = value_sketches(df, ["g", "part"], [], ["size"])
    left = merge_sketches(fine, ["g"]).select("g", "n_rows", "size_sum", "size_count").collect()
    right = value_sketches(df, ["g"], [], ["size"]).select("g", "n_rows", "size_sum", "size_count").collect()
    assert sorted(left, key=str) == sorted(right, key=str)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "x", None), ("b", "x", 4)], "g string, word string, size int")
    made = value_sketches(df, ["g"], ["word"], ["size"])
    got = {r.g: r for r in made.select("g", "n_rows", n_distinct("word").alias("w"), quantile("size", 0.5).alias("q"), mean("size").alias("m")).collect()}
    assert (got["a"].n_rows, got["a"].w, got["a"].q, got["a"].m) == (2, 1, None, None)
    assert (got["b"].n_rows, got["b"].w, got["b"].q, got["b"].m) == (1, 1, 4, 4.0)
    assert value_sketches(df.limit(0), ["g"], ["word"], ["size"]).count() == 0
    none = value_sketches(df.limit(0), [], ["word"], ["size"]).select("n_rows", n_distinct("word").alias("w"), quantile("size", 0.5).alias("q")).collect()
    assert [tuple(r) for r in none] == [(0, 0, None)]
