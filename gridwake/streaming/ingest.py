"""Structured Streaming: new acquisitions into a table once each, and windowed counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over one table's path, a file or a directory of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{folder}/{name}.parquet*")


def deliver_once(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Appends each observation of the stream once to the table at ``out``, whatever is delivered again and however late.

    Each batch is held against the keys delivered before it, which lie on disk, so no row is late and no state is kept in
    memory. A batch has a folder of its own and replaces it when it runs again, so a restart continues where it stopped.
    """
    stream = _source(spark, folder, "observations").select("obs_id", "point_id", "date", "source")

    def keep(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["obs_id"]).alias("new")
        if number:
            before = batch.sparkSession.read.parquet(f"{out}/rows").where(F.col("number") < number).alias("old")
            once = once.join(before, F.col("new.obs_id").eqNullSafe(F.col("old.obs_id")), "left_anti")
        once.write.mode("overwrite").parquet(f"{out}/rows/number={number}")

    query = stream.writeStream.foreachBatch(keep).option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("number")


def hourly_counts(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Counts per event type and hour; each batch leaves the counts of its own events, and these add up, in whatever order events come."""
    stream = _source(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("hour")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
            f"{out}/rows/number={number}"
        )

    query = stream.writeStream.foreachBatch(keep).option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("hour", "event_type").agg(F.sum("n").alias("n"))
