"""Named datasets: read once, keep as Parquet partitioned by split."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.options import dataset_path
from textforge.session import remove
from textforge.sources.publish import publish_folder

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("NER", T.StringType()),
        T.StructField("ingredients", T.StringType()),
        T.StructField("directions", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("split", T.StringType(), False),
    ]
)


def _marker(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_COMPLETE")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table lies at ``path``: the marker that :func:`mark_complete` puts there does."""
    place, files = _marker(spark, path)
    return files.exists(place)


def mark_complete(spark: SparkSession, path: str) -> None:
    """Put a marker beside a table that has been written in full, whatever its committer leaves."""
    place, files = _marker(spark, path)
    files.create(place, True).close()


def read_splits(spark: SparkSession, files: Mapping[str, Any], fmt: str, **options: Any) -> DataFrame:
    """One DataFrame with a ``split`` column from one source per split."""
    parts = [
        spark.read.format(fmt).options(**options).load(where).withColumn("split", F.lit(name))
        for name, where in files.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def load_or_materialise(spark: SparkSession, name: str, base_dir: str, ingest, split: str = "split") -> DataFrame:
    """The stored copy of a dataset, or ``ingest()`` stored in full first.

    Filters come later, so every later choice of rows reads the same copy; reading one split
    touches that split's folder only. The copy appears whole, marker included: of two drivers that
    ingest at once, the slower one drops its copy and reads the other's.
    """
    path = dataset_path(name, base_dir)

    def write(staging: str) -> None:
        ingest().write.partitionBy(split).parquet(staging)
        mark_complete(spark, staging)

    if not path_exists(spark, path) and not publish_folder(spark, path, write) and not path_exists(spark, path):
        # What lies there has no marker, so it was not published like this: a torn copy of something else.
        remove(spark, path)
        publish_folder(spark, path, write)
    return spark.read.parquet(path)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], schema=None) -> DataFrame:
    """A small in-memory table from column lists."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*columns.values())), schema or list(columns))
