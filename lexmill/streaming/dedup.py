"""Bounded streams: a file source read to its end, deduplicated, and an append log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import table_dir


def _folder(path: str) -> tuple[str, str]:
    """Folder and file filter of a path that may name one file (a stream reads folders)."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return head, tail


def first_per_key(spark: SparkSession, path: str) -> DataFrame:
    """Events of a Parquet table, read with a stream that stops at its end.

    The stream keeps, per key, the least event id of each micro-batch and appends it to a
    table in the shared folder; a last aggregate settles keys that several batches saw.  The
    state is the table, so a lost executor or a restart repeats nothing."""
    run = table_dir(spark, "stream")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        events = reader.parquet(path)
    else:
        head, tail = _folder(path)
        events = reader.option("pathGlobFilter", tail).parquet(head)
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("second")

    def settle(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("user_id", "event_type", second).agg(F.min("event_id").alias("event_id"))
        once.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    query = events.writeStream.foreachBatch(settle).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.parquet(f"{run}/out")
    out = seen.groupBy("user_id", "event_type", "second").agg(F.min("event_id").alias("event_id"))
    return out.select("event_id", "user_id", "event_type")


def append_log(rows: DataFrame, path: str) -> None:
    """Append runs to a tab-separated log; every part file carries its header."""
    rows.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
