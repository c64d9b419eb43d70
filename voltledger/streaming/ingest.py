"""Incremental ingest: new text files appear in a folder, each micro-batch is processed and appended once."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltledger.plans import flows


def watch(spark: SparkSession, folder: str, supplier: str, glob: str = "*.txt") -> DataFrame:
    """Streaming path, fornecedor, text of whole text files."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.lit(supplier).alias("fornecedor"), F.col("value").alias("text"))


BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")


def committed(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet's rows of the batches that are complete: a batch that failed between two sheets is not seen."""
    return spark.read.parquet(f"{path}/{sheet}").join(F.broadcast(spark.read.parquet(f"{path}/_commits").select("batch").distinct()), "batch")


def append_stream(stream: DataFrame, supplier: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends base sheets under ``path``. An invoice of an earlier batch is left out, and a batch that is repeated after a failure overwrites its own files.

    Ids are kept in ``_ids``, partitioned by bucket, and a batch reads only the buckets of its own ids. ``_commits`` names the complete
    batches and is written last (``committed`` reads by it).
    """

    def write(batch: DataFrame, n: int) -> None:
        spark, held = batch.sparkSession, []
        extracted, _ = flows.extract(batch, [supplier], held)
        try:
            if _exists(spark, f"{path}/_ids"):
                buckets = [r.bucket for r in extracted.select(_bucket("id_fatura")).where("bucket is not null").distinct().collect()]
                seen = spark.read.parquet(f"{path}/_ids").where(F.col("bucket").isin(buckets) & (F.col("batch") < n)).select(F.col("id_fatura").alias("__seen")).distinct()
                extracted = extracted.join(seen, F.col("id_fatura") == F.col("__seen"), "left_anti")
            for name, df in flows.base_sheets(extracted).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
            ids = extracted.where("id_fatura is not null").select("id_fatura", _bucket("id_fatura"), F.lit(n).cast("bigint").alias("batch"))
            ids.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/_ids")
            spark.createDataFrame([(n,)], "n bigint").write.mode("overwrite").parquet(f"{path}/_commits/batch={n}")
        finally:
            for frame in held:
                frame.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one if it is unset and all of Spark is this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a folder that driver and executors share is needed")
    return f"file://{tempfile.mkdtemp(prefix='stream')}"


def windowed(events: DataFrame, time: str, key: str, length: str, late: str, **aggregates: Callable[[], object]) -> DataFrame:
    """Tumbling-window aggregates by key with a watermark: rows later than ``late`` are dropped by the stream. Times without a zone are taken in the session's."""
    keep = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length), key)
    return keep.agg(*(f().alias(n) for n, f in aggregates.items())).select(F.col("window.start").alias("start"), key, *aggregates)
