"""Tables written once in the folder that driver and executors share, for results that are read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under the shared one; a temporary one is taken on one machine only, where none is set."""
    context = spark.sparkContext
    top = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not top and not re.match(r"local(\[.*\])?$", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top or tempfile.mkdtemp(prefix='spark-')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Computed once and read from then on; a lost executor costs its running tasks only."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Removes what ``stored`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        at = jvm.org.apache.hadoop.fs.Path(file).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
