import pytest

from pyspark.sql import functions as F

from textforge.operators.rouge import corpus_scores, rouge_scores
from textforge.streaming.scores import add_batch, read_means, stream_means

METRICS = ["rouge1", "rouge2", "rougeL"]
KEYS = ["sample_id", "model"]


def predictions(spark, n=120):
    text = F.concat_ws(" ", F.lit("mix the flour with"), (F.col("id") % 7).cast("string"), F.lit("eggs"))
    made = spark.range(n).select(
        F.when(F.col("id") == 5, None).otherwise(F.col("id")).alias("sample_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model"), text.alias("prediction"), F.lit("mix flour with 3 eggs").alias("reference")
    )
    return made.withColumn("prediction", F.when(F.col("sample_id") == 9, None).otherwise(F.col("prediction")))


def run(spark, schema, source, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_means(rouge_scores(stream, KEYS), out, checkpoint, METRICS, KEYS, ["model"])
    assert query.awaitTermination(120)


def means(df):
    return {r.model: r.asDict() for r in df.collect()}


def same(left, right):
    return left.keys() == right.keys() and all(left[m] == pytest.approx(right[m]) for m in left)


def test_stream_equals_batch_over_the_same_files(spark, tmp_path):
    df, source, out, checkpoint = predictions(spark), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    cuts = (F.col("sample_id") < 40, F.col("sample_id").between(40, 79), (F.col("sample_id") >= 80) | F.col("sample_id").isNull())
    for cut in cuts[:2]:
        df.where(cut).coalesce(1).write.mode("append").parquet(source)
    run(spark, df.schema, source, out, checkpoint)
    # A late file, and one whose samples were all counted before.
    df.where(cuts[2]).coalesce(1).write.mode("append").parquet(source)
    df.where(cuts[0]).coalesce(1).write.mode("append").parquet(source)
    run(spark, df.schema, source, out, checkpoint)
    assert same(means(read_means(spark, out, METRICS, ["model"])), means(corpus_scores(rouge_scores(df, KEYS), METRICS, ["model"])))


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 0.5)], "model string, rouge1 double")
    for number in (0, 0, 1, 1, 2):
        add_batch(df, number, out, ["rouge1"], ["model"])
    got = {r.model: (r.rouge1, r.num_samples) for r in read_means(spark, out, ["rouge1"], ["model"]).collect()}
    assert got == {"a": (1.0, 6), None: (0.5, 3)}
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == ["batch=1", "batch=2"]


def test_no_totals_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_means(spark, str(tmp_path / "none"), METRICS, ["model"])
