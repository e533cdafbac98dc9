"""Queries over the measurement table (Q-01 to Q-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_outlier(flag: str = "is_global_outlier") -> Column:
    """Q-10: null counts as not flagged."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def recent_of(m: DataFrame, bssid: str, since_ms: int, limit: int, columns: list[str], since_date: str | None = None) -> DataFrame:
    """Q-01: the latest clean rows of one access point; ``since_date`` prunes partitions (Q-11)."""
    rows = m.where((F.col("bssid") == bssid) & not_outlier() & (F.col("measurement_timestamp") >= since_ms))
    if since_date:
        rows = rows.where(F.col("ingest_date") >= F.lit(since_date).cast("date"))
    return rows.select(*columns).orderBy(F.desc("measurement_timestamp"), "event_id").limit(limit)


def candidates(m: DataFrame, bssids: DataFrame, after: Column) -> DataFrame:
    """Q-02: clean rows after a time of a set of access points, by access point and time."""
    rows = m.where((F.col("ingestion_timestamp") > after) & not_outlier())
    return rows.join(bssids.select("bssid"), "bssid", "left_semi").orderBy("bssid", "ingestion_timestamp")


def clean(m: DataFrame, bssids: DataFrame, since: Column) -> DataFrame:
    """Q-03: from a time on, latest first."""
    rows = m.where((F.col("ingestion_timestamp") >= since) & not_outlier())
    return rows.join(bssids.select("bssid"), "bssid", "left_semi").orderBy("bssid", F.desc("ingestion_timestamp"))


def label_outliers(m: DataFrame, labels: DataFrame, algorithm: str, version: str, at: Column) -> DataFrame:
    """Q-04: writes labels (event_id, distance, threshold) into the outlier columns; other rows stay."""
    new = labels.select("event_id", F.col("distance").alias("_d"), F.col("threshold").alias("_t"), F.lit(True).alias("_new"))
    hit = F.coalesce("_new", F.lit(False))
    to = {"is_global_outlier": F.lit(True), "global_outlier_distance": F.col("_d"), "global_outlier_threshold": F.col("_t"), "global_detection_algorithm": F.lit(algorithm), "global_detection_version": F.lit(version), "global_detection_timestamp": at}
    joined = m.join(new, "event_id", "left")
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in to.items()}).drop("_d", "_t", "_new").select(*m.columns)


def delete_outliers(m: DataFrame, bssids: DataFrame) -> DataFrame:
    """Q-05: what stays after deleting flagged rows of the given access points."""
    listed = bssids.select("bssid", F.lit(True).alias("_listed")).distinct()
    return m.join(listed, "bssid", "left").where(~(F.coalesce("_listed", F.lit(False)) & F.coalesce("is_global_outlier", F.lit(False)))).drop("_listed").select(*m.columns)


def delete_access_points(m: DataFrame, bssids: DataFrame) -> DataFrame:
    """Q-06."""
    return m.join(bssids.select("bssid"), "bssid", "left_anti").select(*m.columns)


def coverage(m: DataFrame) -> DataFrame:
    """Q-07."""
    kind = lambda s: F.count(F.when(F.col("connection_status") == s, 1))
    return m.groupBy("bssid").agg(
        F.count("*").alias("total"), kind("CONNECTED").alias("connected"), kind("SCAN").alias("scanned"),
        F.min("ingestion_timestamp").alias("first_seen"), F.max("ingestion_timestamp").alias("last_seen"), F.avg("location_accuracy").alias("avg_accuracy"),
    )


def busy(m: DataFrame, least: int = 20) -> DataFrame:
    """Q-08: access points with enough clean rows, most first."""
    return m.where(not_outlier()).groupBy("bssid").agg(F.count("*").alias("total"), F.avg("quality_score").alias("avg_score")).where(F.col("total") >= least).orderBy(F.desc("total"), "bssid")


def spread(m: DataFrame) -> DataFrame:
    """Q-09."""
    return m.groupBy("bssid").agg(
        F.avg("quality_weight").alias("avg_weight"), F.stddev("latitude").alias("lat_stddev"), F.stddev("longitude").alias("lon_stddev"),
        F.countDistinct(F.to_date("ingestion_timestamp")).alias("days"),
    )
