"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that cut() uses; the shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{_shared(spark.sparkContext)}/stored-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """stored(), in buckets by a column, so that joins on it move no rows; there are as many as a shuffle has partitions."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{_shared(spark.sparkContext)}/{name.replace('_', '-')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(buckets, by).write.option("compression", "zstd").bucketBy(buckets, by).format("parquet")
    with _tidy(spark):
        out.option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; its files stay until drop()
    return table


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed under spark.checkpoint.dir; only a local session, which is one process, may leave that unset."""
    _shared(df.sparkSession.sparkContext)
    return df.checkpoint()


def _shared(context) -> str:
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()
