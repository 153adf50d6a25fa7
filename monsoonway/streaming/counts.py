"""Weekly counts as a stream: what a batch gives on the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import anchored_week
from ..operators.network import checkpointed


def weekly_counts(events: DataFrame, anchor: str) -> DataFrame:
    """Rows (week_start, event_type, n, value_sum) of a batch or a stream."""
    return events.groupBy(anchored_week(F.col("ts"), anchor).alias("week_start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))


def stream_weekly_counts(spark: SparkSession, path: str, anchor: str) -> DataFrame:
    """Reads all that lies at ``path`` as a stream and returns the last state of the counts.

    State and output hold one row for each week and type; they lie in the shared checkpoint folder, so a lost
    executor loses nothing.
    """
    schema = spark.read.parquet(path).schema
    checkpointed(spark.range(1))  # sets the shared folder where it is unset
    folder = f"{spark.sparkContext.getCheckpointDir()}/weekly-{uuid.uuid4().hex}"
    counts = weekly_counts(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), anchor)  # a pattern, as a stream takes a single file only so
    empty = counts.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts-{number % 2}")
        keep.last = number % 2

    keep.last = None
    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.createDataFrame([], empty) if keep.last is None else spark.read.schema(empty).parquet(f"{folder}/counts-{keep.last}")
