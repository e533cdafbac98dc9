"""Continuous ingestion (S-04 to S-07, T-01, M-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylocus.config import FilterConfig
from skylocus.functions.codec import droppable, encode_messages, valid_messages
from skylocus.operators import measurements, monitor


def encode_stream(messages: DataFrame, path: str, checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Messages to landing files: shape check, codec, size check; files close with each trigger."""
    out = encode_messages(valid_messages(messages)).where(~droppable(F.col("encoded"))).select(F.col("encoded").alias("value"))
    return out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def measure_stream(lines: DataFrame, cfg: FilterConfig = FilterConfig(), dedup: str | None = "1 hour") -> DataFrame:
    """Landed lines to measurement rows. An event that is sent again within ``dedup`` of its time counts once, so that the state that is kept is bounded by the watermark."""
    rows = measurements.from_lines(lines, F.current_timestamp(), cfg)
    if not dedup:
        return rows
    timed = rows.withColumn("event_time", F.timestamp_millis("measurement_timestamp")).withWatermark("event_time", dedup)
    return timed.dropDuplicatesWithinWatermark(["event_id", "bssid"]).drop("event_time")


def write_lake_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Measurement rows to the lake; the file sink's log makes a repeated batch write nothing twice."""
    dated = rows.withColumn("ingest_date", F.to_date("ingestion_timestamp"))
    out = dated.writeStream.format("parquet").partitionBy("ingest_date").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="60 seconds")).start()


def metrics_stream(log: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """M-01 in event-time windows with a watermark."""
    return monitor.windows(log.withWatermark("ts", late), width)


def upsert_stream(rows: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """S-14: ``merge(batch, id)`` is called for each micro-batch and must write the same for the same id."""
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_gaps(m: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: Column | None = None) -> DataFrame:
    """Visits: rows of a device with no longer gap than ``gap``."""
    timed = m.withColumn("event_time", ts if ts is not None else F.timestamp_millis("measurement_timestamp"))
    if m.isStreaming:
        timed = timed.withWatermark("event_time", late)
    out = timed.groupBy("device_id", F.session_window("event_time", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("device_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
