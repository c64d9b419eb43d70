"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a new folder if all of Spark is this one process; an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: tables between steps need a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoint')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """The frame, written once as Parquet to the shared folder and read again: its lineage ends here."""
    path = f"{checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(): as saved(), but it also keeps the partitions and the order of their rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A folder of its own, for a table that its owner removes."""
    return f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table between steps that no frame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
