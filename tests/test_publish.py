import threading

import pytest

from textforge.sources.datasets import load_or_materialise, mark_complete
from textforge.sources.publish import publish_folder, publish_json
from textforge.sources.records import append_result
from textforge.sources.scores import read_score_files


def test_a_folder_is_published_once(spark, tmp_path):
    target = str(tmp_path / "deep" / "table")
    assert publish_folder(spark, target, lambda p: spark.range(3).write.parquet(p))
    assert not publish_folder(spark, target, lambda p: spark.range(9).write.parquet(p))
    assert spark.read.parquet(target).count() == 3
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["table"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    def write(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError, match="half way"):
        publish_folder(spark, str(tmp_path / "table"), write)
    assert list(tmp_path.iterdir()) == []


def test_a_run_stores_its_result_once(spark, tmp_path):
    path = str(tmp_path / "results")
    scores = spark.createDataFrame([(0.5, 10)], "rouge1 double, num_samples long")
    assert append_result(scores, path, {"model_name": "a"}, run_id="2024/1:a")
    assert not append_result(scores.selectExpr("rouge1 * 2 as rouge1", "num_samples"), path, {"model_name": "a"}, run_id="2024/1:a")
    assert append_result(scores, path, {"model_name": "b"}, run_id="other")
    assert {(r.model_name, r.rouge1) for r in read_score_files(spark, [path]).collect()} == {("a", 0.5), ("b", 0.5)}
    assert sorted(p.name for p in (tmp_path / "results").glob("*.json")) == ["2024_1_a.json", "other.json"]


def test_two_drivers_at_once_leave_one_result(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    won, gate = [], threading.Barrier(4)

    def run():
        gate.wait()
        won.append(publish_json(df, str(tmp_path), "run"))

    threads = [threading.Thread(target=run) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False, False, False, True]
    assert [p.name for p in tmp_path.glob("*") if not p.name.startswith(".")] == ["run.json"]


def test_the_slower_ingest_reads_the_copy_of_the_faster(spark, tmp_path):
    def ingest():
        # Another driver publishes while this one reads its source.
        def other(path):
            spark.createDataFrame([(7, "train")], "i int, split string").write.partitionBy("split").parquet(path)
            mark_complete(spark, path)

        assert publish_folder(spark, str(tmp_path / "set"), other)
        return spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")

    assert [r.i for r in load_or_materialise(spark, "set", str(tmp_path), ingest).collect()] == [7]
