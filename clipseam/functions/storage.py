"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder made for each application that names none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset and all tasks run in this one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, tag: str) -> DataFrame:
    """df written to the shared folder in buckets of column and read back; joins and groups on the column then read it without a shuffle."""
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", new_folder(df.sparkSession, tag)).saveAsTable(name)
    return df.sparkSession.table(name)
