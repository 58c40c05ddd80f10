"""Snapshots that arrive as a stream, evaluated one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.extract.tables import fact_tables
from strata.operators import metrics


def summarise_arrivals(entries: DataFrame, cutoffs: list[int], out: str, checkpoint: str) -> StreamingQuery:
    """Append summaries per revision and cutoff for each micro-batch of entries.

    A batch's rows are written to a folder of its own number, so that a batch run
    again after a failure replaces what it left.
    """

    def batch(rows: DataFrame, number: int) -> None:
        functions = fact_tables(rows)["functions"]
        metrics.summaries(functions, cutoffs, ["rev_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_mass(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values per event type in tumbling windows, late rows within the watermark included."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
