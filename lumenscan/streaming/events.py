"""Progress of scans as a stream: events of jobs, counted by window and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WIDTH, LATE = "1 hour", "2 hours"


def read_events(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 1000).parquet(folder)


def windows(events: DataFrame, width: str = WIDTH, late: str = LATE) -> DataFrame:
    """window_start, event_type, n and top (the greatest value), of a stream or a table. In append mode a window is handed on
    when no event of it may come any more, and its state goes: what is held is bounded by kinds and open windows."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "top")


def keep_up(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in all that has come and rewrites the table at `path` with all windows; a later call goes on from the checkpoint.
    A batch that is repeated after a failure writes the same table again."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(replace).start()
    query.awaitTermination()
