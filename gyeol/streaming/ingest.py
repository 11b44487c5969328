"""Structured Streaming: incremental ingest of FAQ rows, and windowed counts of events.

Windows are bounded by a watermark. What was seen before is no state of the stream but the table it
writes, to which each batch is joined, so state doesn't grow with the rows.
Streams end in a table of the shared folder, with their checkpoints beside it."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gyeol.functions import text as T
from gyeol.session import drop_at_exit, shared_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, file or folder, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "64").parquet(f"{sf_dir}/{name}.parquet*")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run over what is there now, in append mode, and return the table written."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/gyeol-stream-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, at)
    q = stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def run_new_to_table(stream: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """As run_to_table, with only the first row of each key: a batch is reduced to one row per key, those
    that earlier batches wrote are taken out by an anti join, and the rest is written under the number of
    the batch, so a batch that runs again replaces itself."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/gyeol-stream-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, at)
    schema = stream.schema

    def step(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(list(key))
        if number:
            before = batch.sparkSession.read.schema(T_.StructType([*schema.fields, T_.StructField("batch", T_.LongType())])).parquet(f"{at}/table").where(F.col("batch") < number)
            new = new.join(before.select(*key), list(key), "left_anti")
        new.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/table")


def new_faq(stream: DataFrame) -> DataFrame:
    """The hash of each question and answer, with its length; run_new_to_table keeps the first of each hash."""
    body = F.concat_ws("\n", "question", "answer")
    return stream.select(T.content_hash(body).alias("content_hash"), F.length(T.squash(body)).alias("n_chars"))


def event_windows(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Closed windows: window_start, event_type, n, total."""
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
