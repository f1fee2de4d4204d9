from types import SimpleNamespace

import pytest

from textforge.session import fresh_path, materialise, remove, shared_dir, spread


def test_one_file_is_spread_and_several_left_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    few = materialise(spark.range(1000, numPartitions=1), "few")
    assert spread(few, "id").rdd.getNumPartitions() == cores
    assert spread(few, "id").count() == 1000
    many = materialise(spark.range(1000, numPartitions=3), "many")
    assert spread(many, "id") is many


def test_written_tables_can_be_removed(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert remove(spark, path) and not remove(spark, path)


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_cluster_without_shared_folder_is_refused(master):
    lone = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master)
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(lone)


def test_materialised_copy_has_no_lineage(spark):
    df = materialise(spark.range(10).repartition(3), "numbers")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "Exchange" not in plan and "Range" not in plan
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_local_master_without_shared_folder_gets_one_of_its_own():
    def lone(application):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: default),
            sparkContext=SimpleNamespace(master="local[4]", applicationId=application),
        )

    first = shared_dir(lone("app-1"))
    assert shared_dir(lone("app-1")) == first and shared_dir(lone("app-2")) != first
