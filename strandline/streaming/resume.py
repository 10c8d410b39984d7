"""Long jobs as streams that can be stopped and resumed: each row is handled once, results are committed by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(spark: SparkSession, source: str, schema, out: str, state: str, step: Callable[[DataFrame], DataFrame], key: str = "id", files_per_batch: int = 64, time: str | None = None, within: str | None = "7 days") -> None:
    """Handle all rows in the Parquet files at ``source`` that earlier runs didn't, then stop.

    ``state`` keeps what was read and which keys were seen. Results of ``step`` go to ``out``, a folder for each batch, which
    a batch that is run again after a failure writes again: ``results`` reads each once. Keys are known for as long as
    ``within`` says, by the column ``time`` or else by when they came, so that the state is bounded; with neither, for good.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if within is None:
        rows = rows.dropDuplicates([key])
    else:
        # Rows that come late by their own time aren't known any more; by the time of their coming none is late.
        named = rows if time else rows.withColumn("_came", F.current_timestamp())
        rows = named.withWatermark(time or "_came", within).dropDuplicatesWithinWatermark([key]).drop("_came")

    def commit(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.option("checkpointLocation", state).foreachBatch(commit).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    """What all runs wrote."""
    return spark.read.parquet(out).drop("batch")


def windowed(spark: SparkSession, source: str, schema, state: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window, as a stream that has read all there is: (start, event_type, n, total)."""
    name = "windowed_" + state.rsplit("-", 1)[-1]
    # The files' times have no zone; the session's is taken.
    events = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def commit(batch: DataFrame, number: int) -> None:
        # Updated windows, a folder for each batch: of a window the last batch's row holds.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state}/out/number={number}")

    sums.writeStream.queryName(name).outputMode("update").option("checkpointLocation", f"{state}/state").foreachBatch(commit).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{state}/out/*").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "x.n", "x.total")
