"""Feeds as streams: at-least-once deliveries made unique, trailing windows, the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotweave.operators.tabular import keep_last


def unique_deliveries(stream: DataFrame, keys: list[str], time: str, lateness: str = "7 days") -> DataFrame:
    """The first delivery of each message; keys are kept for as long as deliveries may be late, so the state is bounded by the feed's rate."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def trailing_counts(stream: DataFrame, time: str, by: list[str], length: str = "365 days", step: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(window_start, window_end, by, n): rows in sliding windows, each final once the watermark has passed its end."""
    w = F.window(time, length, step)
    out = stream.withWatermark(time, lateness).groupBy(w, *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def keep_latest(stream: DataFrame, table: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """A table of the latest row of each key, in ``<table>/v=<batch>``, a whole version for each batch, so that a batch run again writes the same."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{table}/v={n - 1}").unionByName(batch)
        keep_last(rows, [key], [F.col(c) for c in order]).write.mode("overwrite").parquet(f"{table}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
