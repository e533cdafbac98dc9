"""File-arrival events (E-01 to E-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylocus.schemas import FILE_EVENT

BUCKET = "^[a-z0-9][a-z0-9.-]*[a-z0-9]$"
ETAG = "^[a-fA-F0-9]{32}$"
MAX_OBJECT = 5_368_709_120


def stream_name(key: Column) -> Column:
    """E-07: the folder of the file, of the decoded key; ``unknown`` if there is none or it is not a name."""
    plain = F.when(F.contains(key, F.lit("%")), F.coalesce(F.try_url_decode(key), key)).otherwise(key)
    parts = F.split(F.rtrim(plain, F.lit("/")), "/")
    name = F.try_element_at(parts, F.lit(-2))
    return F.when((F.size(parts) >= 2) & (F.length(F.trim(name)) > 0) & (F.length(name) <= 200), name).otherwise("unknown")


def valid_bucket(c: Column) -> Column:
    """E-03."""
    return F.coalesce(c.rlike(BUCKET) & (F.length(c) <= 63), F.lit(False))


def valid_key(c: Column) -> Column:
    """E-04."""
    return F.coalesce((F.length(c) <= 1024) & (F.length(F.trim(c)) > 0) & ~F.contains(c, F.lit("..")) & ~F.contains(c, F.lit("//")), F.lit(False))


def valid_size(c: Column) -> Column:
    """E-05."""
    return F.coalesce(c.between(0, MAX_OBJECT), F.lit(False))


def valid_time(c: Column, as_of: Column) -> Column:
    """E-02."""
    return F.coalesce(c.between(as_of - F.expr("interval 365 days"), as_of + F.expr("interval 1 day")), F.lit(False))


def etag(c: Column) -> Column:
    """E-06: null unless it is one."""
    return F.when(c.rlike(ETAG), c)


def parse_events(messages: DataFrame, as_of: Column, col: str = "value") -> DataFrame:
    """E-01 to E-07: one row per message, its fields and ``reject`` (null when accepted).

    Notifications carry the first of ``Records``; event-bus messages the same under ``detail``.
    """
    said = F.from_json(F.col(col), FILE_EVENT)
    e = messages.withColumn("_e", said).withColumn("_r", F.try_element_at("_e.Records", F.lit(1)))
    bus = F.col("_e.detail").isNotNull()
    e = e.select(
        col,
        F.coalesce("_r.eventTime", "_e.time").alias("_time"),
        F.coalesce("_r.eventSource", F.when(bus, F.col("_e.source"))).alias("event_source"),
        F.coalesce("_r.s3.bucket.name", "_e.detail.bucket.name").alias("bucket"),
        F.coalesce("_r.s3.object.key", "_e.detail.object.key").alias("key"),
        F.coalesce("_r.s3.object.size", "_e.detail.object.size").alias("size"),
        etag(F.coalesce("_r.s3.object.eTag", "_e.detail.object.etag")).alias("etag"),
        F.coalesce("_r.s3.object.sequencer", "_e.detail.object.sequencer").alias("sequencer"),
        F.col("_r.responseElements.x-amz-request-id").alias("request_id"),
        F.coalesce("_r.awsRegion", "_e.region").alias("region"),
        F.col("_r.eventVersion").alias("event_version"),
    )
    e = e.withColumn("event_time", F.try_to_timestamp("_time")).drop("_time").withColumn("stream_name", stream_name(F.col("key")))
    reject = (
        F.when(~F.coalesce(F.col("event_source").isin("aws:s3", "aws.s3"), F.lit(False)), "source")
        .when(~valid_time(F.col("event_time"), as_of), "time")
        .when(~valid_bucket(F.col("bucket")), "bucket")
        .when(~valid_key(F.col("key")), "key")
        .when(~valid_size(F.col("size")), "size")
    )
    return e.withColumn("reject", reject)


class Processors:
    """E-08: a transformation by stream name, the default otherwise."""

    def __init__(self, default: Callable[[DataFrame], DataFrame]) -> None:
        self.default, self.by_name = default, {}

    def register(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.by_name[name] = run

    def of(self, name: str) -> Callable[[DataFrame], DataFrame]:
        return self.by_name.get(name, self.default)
