"""Histograms of road chunks as a stream whose state outlives a chunk: cells already seen, and counts by value.

Chunks are offered one after another. Each is first reduced to one row for each key and cell, in plain batch; the stream then drops the cells that an
earlier chunk has brought (a keyed state that holds each once) and adds the rest to the counts by value (a second keyed state), both in the JVM. In
update mode a micro-batch returns only the counts that it changed; they are written under its number, so a batch that is repeated after a
failure replaces itself. The histogram is the last count of each value.

Everything lies in one folder. A new ``ChunkedHistograms`` on the same folder goes on where the last one ended, whether it ended well or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class ChunkedHistograms:
    """Rows (keys, value, count) over all chunks offered so far.

    ``keys`` name columns of every chunk, ``cell`` the one of which each key counts the first row only, None to count every row. Values that are null, NaN or infinite count nowhere, and
    do not make their cell seen. A null key or cell is one like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], value: str, cell: str | None = None) -> None:
        self.spark, self.folder, self.keys, self.value, self.cell = spark, folder, list(keys), value, cell

    def _counted(self, rows: DataFrame) -> DataFrame:
        if self.cell is not None:
            rows = rows.dropDuplicates([*self.keys, self.cell])
        return rows.groupBy(*self.keys, self.value).agg(F.sum("times").alias("count"))

    def offer(self, chunk: DataFrame, *order: Column) -> None:
        """Counts a chunk; of a cell's rows in it the first by ``order`` is taken. Offering the same rows again changes nothing if cells are named.

        The reduced chunk is committed before the stream reads it, so one that was written counts even if the query fails after; ``catch_up`` brings it in.
        """
        number = F.col(self.value).cast("double")
        finite = chunk.withColumn(self.value, number).where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")))
        if self.cell is None:
            rows = finite.groupBy(*self.keys, self.value).agg(F.count("*").alias("times"))
        else:
            rows = finite.groupBy(*self.keys, self.cell).agg(F.min_by(self.value, F.struct(*(order or (F.col(self.value),)))).alias(self.value), F.lit(1).cast("long").alias("times"))
        rows.write.mode("append").parquet(f"{self.folder}/chunks")
        self.catch_up(rows.schema)

    def catch_up(self, schema: StructType | None = None) -> None:
        """Reads what has been offered and not yet counted."""
        schema = schema or self.spark.read.parquet(f"{self.folder}/chunks").schema
        counted = self._counted(self.spark.readStream.schema(schema).parquet(f"{self.folder}/chunks"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")

        query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def histogram(self) -> DataFrame:
        """Rows (keys, value, count); at least one chunk has been offered."""
        schema = self.spark.read.parquet(f"{self.folder}/chunks").schema
        kinds = StructType([*(schema[c] for c in (*self.keys, self.value)), StructField("count", LongType()), StructField("batch", LongType())])
        changed = self.spark.read.schema(kinds).parquet(f"{self.folder}/counts")
        return changed.groupBy(*self.keys, self.value).agg(F.max_by("count", "batch").alias("count"))
