"""Results that appear whole or not at all, and once per name.

What is written goes to a folder of its own first and then gets its name by one rename that fails if the name is
taken. Of two drivers that write the same thing at once, one wins and the other reads the winner's copy; a
driver that dies leaves only a folder that no reader looks at. A rename is one step on HDFS and on a local
disk; on an object store it is as good as its Hadoop file system makes it.
"""

from __future__ import annotations

import uuid
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give ``source`` the name ``target``; False if there is something of that name."""
    (old, files), (new, _) = _place(spark, source), _place(spark, target)
    files.mkdirs(new.getParent())
    fs = spark._jvm.org.apache.hadoop.fs
    never_over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    never_over[0] = fs.Options.Rename.NONE
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(old), files.makeQualified(new), never_over)
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" in problem.java_exception.getClass().getName() or files.exists(new):
            return False
        raise
    return True


def publish_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Let ``write`` fill a staging folder and give it the name ``path``; False if another one has it already."""
    parent, _, name = path.rstrip("/").rpartition("/")
    staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, staging)
    try:
        write(staging)
        return _rename(spark, staging, path)
    finally:
        files.delete(place, True)


def publish_json(df: DataFrame, path: str, name: str) -> bool:
    """Store a small result as the one file ``path/name.json``; False, and nothing written, if it is there already."""
    spark = df.sparkSession
    target = f"{path.rstrip('/')}/{name}.json"
    place, files = _place(spark, target)
    if files.exists(place):
        return False
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    folder, _ = _place(spark, staging)
    try:
        df.coalesce(1).write.json(staging, ignoreNullFields=False)
        parts = [f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
        return _rename(spark, parts[0], target)
    finally:
        files.delete(folder, True)
