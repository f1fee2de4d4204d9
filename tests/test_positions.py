import json

import pytest
from pyspark.sql import functions as F

from textforge.operators.ordering import number_rows
from textforge.plans.evaluate import evaluate_model, score_prediction_file
from textforge.sources.positions import align_by_position, read_lines, read_records


@pytest.fixture()
def small_splits(spark):
    """Files are cut into many splits, several of which one task may read."""
    options = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_keep_their_position_in_any_split(spark, tmp_path, small_splits):
    want = []
    for number, count in ((2, 90), (0, 1), (10, 40), (1, 0)):
        lines = [f"file {number} line {i} " + "é" * (i % 60) for i in range(count)]
        text = "\n \n\n".join(lines) + ("\n\n" if number == 2 else "")
        (tmp_path / f"part-{number:05d}.json").write_text(text)
        want.append((number, lines))
    want = [line for _, lines in sorted(want) for line in lines]
    found = read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    assert [(r.position, r.value) for r in found.orderBy("position").collect()] == list(enumerate(want))


def test_records_by_position(spark, tmp_path, small_splits):
    answers = [{"prediction": f"answer {i}" * (i % 9), "title": None} for i in range(150)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, answers)))
    records = read_records(spark, str(tmp_path), "prediction string")
    samples = spark.range(150).select((149 - F.col("id")).alias("position"), F.lit("own").alias("prediction"), (F.col("id") * 2).alias("x"))
    both = align_by_position(samples.drop("prediction"), records).collect()
    assert len(both) == 150 and all(r.prediction == answers[r.position]["prediction"] and r.x == 2 * (149 - r.position) for r in both)
    assert {r.prediction for r in align_by_position(samples, records).collect()} == {"own"}
    with pytest.raises(ValueError, match="149 samples, but 150 records"):
        align_by_position(samples.where("position > 0"), records)
    with pytest.raises(ValueError, match="not numbered"):
        align_by_position(samples.withColumn("position", F.col("position") + 1), records)
    (tmp_path / "q.jsonl").write_text("no json\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_records(spark, str(tmp_path), "prediction string").collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n")
    assert read_records(spark, str(tmp_path), "prediction string").count() == 0
    assert align_by_position(spark.range(0).withColumnRenamed("id", "position"), read_records(spark, str(tmp_path), "prediction string")).count() == 0


def test_numbering_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.when(F.col("id") % 10 > 0, F.col("id") % 4).alias("b"))
    got = number_rows(df.repartition(5), "b", F.desc("a")).collect()
    want = sorted(((r.b is not None, r.b or 0, -r.a), r.a, r.b) for r in df.collect())
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == [(a, b) for _, a, b in want]
    one = number_rows(spark.range(300).select(F.lit(1).alias("k"), "id"), "k", "id", name="n")
    assert sorted((r.n, r.id) for r in one.collect()) == [(i, i) for i in range(300)]
    assert number_rows(df.limit(0), "a").collect() == []


def samples(spark, n=40):
    rows = [(f"{i:03d}", f"Title {i}", f"a {i}", f"list {i}", f"cook it {i} times") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, title string, NER string, ingredients string, directions string")


def test_prediction_file_is_scored_by_position(spark, tmp_path):
    df = samples(spark)
    half = [json.dumps({"prediction": f"cook it {i} times"}) for i in range(40)]
    (tmp_path / "a.jsonl").write_text("\n".join(half[:13]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(half[13:]) + "\n")
    done = score_prediction_file(df.repartition(4), str(tmp_path))
    assert {(r.sample_id, r.position, r.prediction) for r in done.predictions.collect()} == {(f"{i:03d}", i, f"cook it {i} times") for i in range(40)}
    scores = done.scores.first()
    assert scores.num_samples == 40 and 0 < scores.rouge1 < 1
    backwards = score_prediction_file(df.withColumn("o", -F.col("sample_id").cast("int")), str(tmp_path), order=("o",))
    assert backwards.predictions.where("sample_id = '039'").first().prediction == "cook it 0 times"
    with pytest.raises(ValueError, match="39 samples"):
        score_prediction_file(df.where("sample_id <> '007'"), str(tmp_path))


def test_records_with_an_embedder_are_one_per_sample(spark, tmp_path):
    df = samples(spark, 3).unionByName(samples(spark, 1)).withColumn("sample_id", F.when(F.col("sample_id") != "002", F.col("sample_id")))
    predict = lambda: lambda prompts: [p[-40:] for p in prompts]
    embed = lambda: lambda texts: [[[float(len(w)), 1.0] for w in t.split(" ")] for t in texts]
    out = str(tmp_path / "records")
    done = evaluate_model(df, "Qwen/x", make_predict=predict, make_embedder=embed, records_path=out)
    assert done.scores.first().num_samples == 4 and done.per_sample.count() == 4
    records = spark.read.json(out)
    assert sorted(r.title for r in records.collect()) == ["Title 0", "Title 0", "Title 1", "Title 2"]
    assert records.where("bert_f1 is null").count() == 0
