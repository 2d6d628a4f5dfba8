"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset on a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="sheaf-")
        root = _OWN["dir"]
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/sheaf/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written; frames that still read them can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove(df: DataFrame) -> None:
    """Remove the table that `written` has made for this frame, which can't be used any more."""
    spark, path = df.sparkSession, df._scratch
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
