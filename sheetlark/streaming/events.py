"""Saves of workbooks as an event-time stream: windows, sessions, and rows that come too late.

A watermark follows the greatest time of the batches so far, less ``delay``. A batch closes and tells the windows that
end at or before the watermark with which it begins; a row whose window an earlier batch has closed is late. Late rows are
dropped by Spark's windows and counted apart by :func:`run_late`, by the window that they would have been in. Counts are written
batch by batch, so a batch that runs again after a failure overwrites its own part.

:func:`windows`, :func:`sessions` and :func:`in_time` are plain DataFrame functions: over a table they give the batch
result, over a stream Spark's own state keeps the open windows. Rows with a null time or key are in no window. Rows that repeat
count each time. An empty stream gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _numbers(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("decimal(28,2)").alias("total")]


def windows(events: DataFrame, length: str, slide: str | None = None, *, time: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling windows of ``length``, or sliding ones if ``slide`` is given: keys, start, end, n, total."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    known = F.col(time).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    grouped = events.where(known).groupBy(*keys, span.alias("w")).agg(*_numbers(value))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str, *, time: str = "ts", keys: tuple[str, ...] = ("user_id",), value: str = "value") -> DataFrame:
    """Counts and sums by sessions: rows of a key of which each is less than ``gap`` after the one before. ``end`` is the last row's time and the gap."""
    known = F.col(time).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    grouped = events.where(known).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(*_numbers(value))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def stream(spark, folder: str, schema: str, *, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of ``folder`` as they arrive, the oldest first, ``files_per_trigger`` to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def run_windows(events: DataFrame, made, delay: str, out: str, checkpoint: str, *, time: str = "ts", **trigger) -> StreamingQuery:
    """Append what ``made`` (one of the functions above, with its options) closes to the table ``out``.

    ``events`` is a stream. A window is told once, when the watermark passes its end; with ``availableNow`` the last windows
    stay open in the checkpoint, and the next run goes on from there.
    """
    held = made(events.withWatermark(time, delay))
    return held.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def run_late(events: DataFrame, length: str, delay_seconds: int, out: str, checkpoint: str, *, time: str = "ts", key: str = "event_type", **trigger) -> StreamingQuery:
    """Count late rows by batch, key and window of ``length`` in the table ``out``; rows in time are not written.

    The last batch that closed windows before this one began with the greatest time of all batches but the last, less the delay.
    Those times are kept beside the counts, one row a batch, so a restart goes on from the last complete batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, marks = batch.sparkSession, f"{out}/marks"
        # a batch that runs again does not see its own row
        before = None
        if number > 1:
            seen = spark.read.schema("batch long, most timestamp").parquet(marks).where(F.col("batch") < number - 1)
            before = seen.agg(F.max("most")).first()[0]
        most = batch.agg(F.max(time).alias("most")).select(F.lit(number).cast("long").alias("batch"), "most")
        span = F.window(time, length)
        rows = batch.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, span.alias("w"))
        mark = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = rows.where(F.col("w.end") <= mark).groupBy(key, "w").agg(F.count("*").alias("n_late"))
        late.select(F.lit(number).cast("long").alias("batch"), key, F.col("w.start").alias("start"), "n_late").write.mode("overwrite").parquet(f"{out}/late/part={number}")
        most.write.mode("overwrite").parquet(f"{marks}/part={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
