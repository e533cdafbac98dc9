"""Domain tables derived from the star-schema and event tables, in Spark and as SQL text.

The expressions below are plain SQL that Spark and other engines read alike; the few functions that have
another name elsewhere stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"hex": "hex", "ms": "unix_millis(ts)", "k": "cast(get_json_object(props, '$.k') as int)"}
_OTHER = {"hex": "to_hex", "ms": "epoch_us(ts) // 1000", "k": "cast(json_extract_string(props, '$.k') as int)"}

VENDORS = ["cisco", "aruba", "meraki", "ubiquiti", "ruckus", "hpe-aruba", "generic"]
STATUSES = ["active", "warning", "verified", "test", "imported", "error", "expired", "wifi-hotspot"]


def _case(of: str, names: list[str]) -> str:
    return f"case {of} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


REGISTRY = {
    "mac_addr": "lpad(lower({hex}(s_suppkey)), 12, '0')",
    "latitude": "377e-1 + (s_suppkey % 10) * 5e-4",
    "longitude": "-12242e-2 + ((s_suppkey - s_suppkey % 10) / 10) * 7e-4",
    "altitude": "case when s_suppkey % 5 = 0 then null else cast(10 + s_suppkey % 20 as double) end",
    "horizontal_accuracy": "cast(5 + s_suppkey % 30 as double)",
    "confidence": "4e-1 + (s_suppkey % 60) / 1e2",
    "vendor": _case("s_suppkey % 7", VENDORS),
    "status": _case("s_nationkey % 8", STATUSES),
}
_MAC = "concat('aa:bb:cc:', substr(h, 1, 2), ':', substr(h, 3, 2), ':', substr(h, 5, 2))"
_EVENT = {"*": "*", "h": "lpad(lower({hex}(user_id)), 6, '0')", "k": "{k}"}
MEASUREMENT = {
    "event_id": "event_id",
    "device": "concat('dev', user_id % 40)",
    "raw_bssid": f"case when event_id % 53 = 0 then '00:00:00:00:00:00' when event_id % 59 = 0 then 'zz' when event_id % 61 = 0 then '3C:15:C2:00:00:01' when event_id % 3 = 0 then upper(replace({_MAC}, ':', '-')) else {_MAC} end",
    "raw_ssid": "case when event_id % 13 = 0 then '   ' else concat(' net', user_id, ' ') end",
    "rssi": "cast(-floor(value / 3) as int)",
    "latitude": "37e0 + (user_id % 10) * 1e-3 + (event_id % 17) * 1e-5 + case when event_id % 97 = 0 then 1e-2 else 0e0 end",
    "longitude": "-122e0 + (user_id % 7) * 1e-3 + (event_id % 13) * 1e-5",
    "location_accuracy": "case when event_id % 19 = 0 then null else cast(2 * k as double) end",
    "connection_status": "case when event_type in ('purchase', 'signup') then 'CONNECTED' else 'SCAN' end",
    "link_speed": "case when event_type in ('purchase', 'signup') then cast(20 + event_id % 60 as int) end",
    "measurement_timestamp": "{ms}",
    "ingestion_timestamp": "ts",
    "is_global_outlier": "case when event_id % 29 = 0 then true when event_id % 31 = 0 then false end",
}
LOG = {
    "event_id": "event_id",
    "ts": "ts",
    "component": "event_type",
    "event": "case event_id % 11 when 0 then 'rate_limited' when 1 then 'partial' when 2 then 'rejected' else 'poll' end",
    "ok": "event_id % 7 <> 0 and event_id % 50 > 6",
    "duration_ms": "cast(floor(value * 10) as bigint)",
    "batch_size": "k",
}


def _fill(exprs: dict[str, str], names: dict[str, str]) -> list[str]:
    return [e if a == "*" else f"{e.format(**names)} as {a}" for a, e in exprs.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*_fill(REGISTRY, _SPARK))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request and access point: the loudest reading."""
    out = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("pos"))
    out = out.agg(F.max(F.lit(-30.0) - F.lit(1.4) * F.col("l_quantity")).alias("rssi"), F.min(F.expr("case l_linenumber % 3 when 0 then 2412 when 1 then 2437 else 5180 end")).alias("frequency"))
    return out.withColumn("mac_addr", F.lpad(F.lower(F.hex("pos")), 12, "0"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return typed.selectExpr(*_fill(_EVENT, _SPARK))


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_fill(MEASUREMENT, _SPARK))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows with normalised address, weight and score."""
    from skylocus.functions import wifi

    m = raw_measurements(spark, sf_dir)
    fine = wifi.reject_reason(F.col("raw_bssid"), F.col("rssi"), F.col("latitude"), F.col("longitude"), F.col("location_accuracy")).isNull()
    return m.where(fine).withColumns(
        {
            "bssid": wifi.normal_bssid(F.col("raw_bssid")),
            "quality_weight": wifi.quality_weight(F.col("connection_status"), F.col("link_speed"), F.col("rssi")),
            "quality_score": wifi.quality_score(F.col("location_accuracy"), F.col("rssi")),
        }
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_fill(LOG, _SPARK))


def _select(exprs: dict[str, str], table: str) -> str:
    return f"select {', '.join(_fill(exprs, _OTHER))} from {table}"


_FINE = (
    "regexp_matches(lower(trim(raw_bssid)), '^([0-9a-f]{2}[:-]){5}[0-9a-f]{2}$') and replace(replace(lower(trim(raw_bssid)), ':', ''), '-', '') not in ('000000000000', 'ffffffffffff')",
    "rssi between -100 and 0",
    "latitude between -90 and 90 and longitude between -180 and 180 and (location_accuracy is null or location_accuracy <= 150)",
)
WEIGHT_SQL = "case when connection_status = 'CONNECTED' then case when link_speed < 50 and rssi > -70 then 15e-1 else 2e0 end else 1e0 end"
SCORE_SQL = "least(1e0, 5e-1 + coalesce(greatest(0e0, 1 - location_accuracy / 1e2) * 3e-1, 0e0) + coalesce(greatest(0e0, (rssi + 100) / 1e2) * 2e-1, 0e0))"
VALID_SQL = "('active', 'warning', 'verified', 'test', 'imported')"

#: Common table expressions, to follow WITH.
SQL = {
    "reg": f"reg as ({_select(REGISTRY, 'supplier')})",
    "scans": "scans as (select l_orderkey as request_id, l_suppkey as pos, lpad(lower(to_hex(l_suppkey)), 12, '0') as mac_addr, max(-30e0 - 14e-1 * l_quantity) as rssi, "
    "min(case l_linenumber % 3 when 0 then 2412 when 1 then 2437 else 5180 end) as frequency from lineitem group by l_orderkey, l_suppkey)",
    "raw": f"raw as ({_select(MEASUREMENT, '(' + _select(_EVENT, 'events') + ')')})",
    "m": f"m as (select *, lower(replace(raw_bssid, '-', ':')) as bssid, {WEIGHT_SQL} as quality_weight, {SCORE_SQL} as quality_score from raw where {' and '.join('(' + f + ')' for f in _FINE)})",
    "log": f"log as ({_select(LOG, '(' + _select(_EVENT, 'events') + ')')})",
    "reason": f"case when not ({_FINE[0]}) then 'bssid' when not coalesce({_FINE[1]}, false) then 'rssi' when not ({_FINE[2]}) then 'location' end",
}


def with_sql(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names) + " "
