"""Steps that are read more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """Where this application's steps are written: below spark.checkpoint.dir, which a cluster's driver and executors share.
    Only a local session may leave that setting unset; it then has a temporary folder of its own."""
    app = spark.sparkContext.applicationId
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="tidemark-")
        _own[app] = where
    return f"{where.rstrip('/')}/tidemark/{app}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` as Parquet in the run's folder, read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes all steps of this application, when no result of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
