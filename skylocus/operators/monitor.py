"""Monitoring statistics over an event log (M-01 to M-13).

The log has ts, component, event, ok, count, duration_ms and batch_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 6)).otherwise(0.0)


def _ok(value: bool) -> Column:
    return F.count(F.when(F.col("ok") == value, 1))


def consumer(log: DataFrame, by: list[str | Column] = []) -> DataFrame:
    """M-01."""
    n = F.count("*")
    return log.groupBy(*by).agg(
        n.alias("consumed"), _ok(True).alias("processed"), _ok(False).alias("failed"), _pct(_ok(True), n).alias("success_pct"), _pct(_ok(False), n).alias("error_pct"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


def windows(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """M-01, M-08 by event time."""
    return consumer(log, [F.window("ts", width).alias("w"), "component"]).withColumn("window_start", F.col("w.start")).drop("w")


def batches(log: DataFrame) -> DataFrame:
    """M-02, M-09."""
    n = F.count("*")
    return log.groupBy("component").agg(
        n.alias("batches"), _ok(True).alias("delivered"), _ok(False).alias("failed"), F.count(F.when(F.col("event") == "rate_limited", 1)).alias("rate_limited"),
        F.count(F.when(F.col("event") == "partial", 1)).alias("partial"), F.when(n > 0, F.round(_ok(True) / n, 6)).otherwise(1.0).alias("success_rate"),
        F.round(F.avg("batch_size"), 6).alias("avg_messages"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )


def alerts(log: DataFrame, slow_ms: int = 1200) -> DataFrame:
    """M-03."""
    return log.groupBy("component").agg(
        F.count(F.when(F.col("duration_ms") > slow_ms, 1)).alias("slow_polls"),
        (F.round(F.sum("duration_ms") / (F.count("*") * 1500.0) * 100, 6) > 80).alias("thread_busy"),
        (_pct(F.count(F.when(F.col("event") == "rejected", 1)), F.count("*")) > 5).alias("rejecting"),
    )


def fill_time_ok(seconds: Column) -> Column:
    """M-03."""
    return seconds.between(13, 44)


def size_bucket(n: Column) -> Column:
    """M-04."""
    return F.when(n <= 60, "small").when(n <= 100, "medium").otherwise("large")


def by_size(log: DataFrame) -> DataFrame:
    """M-04."""
    return log.groupBy(size_bucket(F.col("batch_size")).alias("bucket")).agg(F.count("*").alias("n"), F.round(_ok(True) / F.count("*"), 6).alias("success_rate"))


def rate_per_minute(log: DataFrame) -> DataFrame:
    """M-05: whole minutes since the first message; all of them if none has passed."""
    minutes = F.floor((F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))) / 60_000)
    return log.groupBy("component").agg(F.count("*").alias("total"), F.round(F.when(minutes > 0, F.count("*") / minutes).otherwise(F.count("*").cast("double")), 6).alias("per_minute"))


def liveness(stats: DataFrame, as_of: Column) -> DataFrame:
    """M-06 over M-01 and M-05 (per_minute): processing, stuck."""
    since = (F.unix_millis(as_of) - F.unix_millis("last_at")) / 60_000
    return stats.withColumns(
        {
            "processing": (F.col("processed") >= 0.8 * F.col("consumed")) & (since <= 5),
            "stuck": (since < 2) & (F.col("per_minute") < 0.01) & (F.col("error_pct") < 5),
        }
    )


def longest_failures(log: DataFrame) -> DataFrame:
    """M-07: the longest run of failures in a row, by gaps and islands, and whether it means stuck."""
    order = ["ts", "event_id"] if "event_id" in log.columns else ["ts"]
    w = Window.partitionBy("component").orderBy(*order)
    rows = log.withColumn("_n", F.row_number().over(w)).where("not ok")
    runs = rows.withColumn("_g", F.col("_n") - F.row_number().over(w)).groupBy("component", "_g").agg(F.count("*").alias("run"))
    return runs.groupBy("component").agg(F.max("run").alias("longest")).withColumn("stuck", F.col("longest") > 5)


def activity(stuck: Column, recent: Column, healthy: Column, total: Column) -> Column:
    """M-11."""
    return F.when(stuck, "STUCK").when(~recent, F.when(total == 0, "IDLE_NO_DATA").otherwise("IDLE_TIMEOUT")).when(~healthy, "SLOW_PROCESSING").otherwise("ACTIVE")


def queue_health(queue_pct: Column, thread_pct: Column, enabled: Column) -> Column:
    """M-12."""
    return (
        F.when(~enabled, "DISABLED")
        .when((queue_pct > 95) | ((thread_pct > 95) & (queue_pct > 50)), "CRITICAL")
        .when((queue_pct > 80) | (thread_pct > 85), "DEGRADED")
        .otherwise("HEALTHY")
    )


def memory_label(used_pct: Column, threshold_pct: float = 90.0) -> Column:
    """M-13."""
    return F.when(used_pct >= threshold_pct, "HIGH_USAGE").when(used_pct > 0.8 * threshold_pct, "APPROACHING_LIMIT").when(used_pct > 0.6 * threshold_pct, "MODERATE_USAGE").otherwise("NORMAL")
