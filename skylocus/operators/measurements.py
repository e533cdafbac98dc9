"""Scan documents to measurement rows (T-01 to T-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylocus.config import FilterConfig
from skylocus.functions import wifi
from skylocus.functions.codec import decode_lines
from skylocus.schemas import MEASUREMENT, RAW_SCAN


def parse(messages: DataFrame, col: str = "message") -> DataFrame:
    """T-04: documents that are not JSON are dropped, unknown fields ignored."""
    said = F.from_json(F.col(col), RAW_SCAN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return messages.select(said.alias("d"), F.sha2(F.col(col), 256).alias("message_id")).where("d is not null and d._corrupt is null")


def _candidates(docs: DataFrame) -> DataFrame:
    """T-05 to T-07: connected events, then scan entries; one pass over the documents."""
    none = lambda kind: F.lit(None).cast(kind)
    connected = F.transform(
        F.filter(F.coalesce("d.wifiConnectedEvents", F.array()), lambda e: e["wifiConnectedInfo"].isNotNull()),
        lambda e: F.struct(
            F.lit("CONNECTED").alias("status"), e["timestamp"].alias("ts"), e["eventId"].alias("event"), e["location"].alias("loc"), e["isCaptive"].alias("captive"), none("bigint").alias("scantime"),
            *[e["wifiConnectedInfo"][a].alias(a) for a in ("bssid", "ssid", "rssi", "linkSpeed", "frequency", "channelWidth", "centerFreq0", "centerFreq1", "capabilities", "is80211mcResponder", "isPasspointNetwork", "operatorFriendlyName", "venueName", "numOfScanResults")],
        ),
    )
    scanned = F.flatten(
        F.transform(
            F.filter(F.coalesce("d.scanResults", F.array()), lambda s: s["results"].isNotNull()),
            lambda s: F.transform(
                s["results"],
                lambda r: F.struct(
                    F.lit("SCAN").alias("status"), s["timestamp"].alias("ts"), wifi.scan_event_id(s["timestamp"], r["bssid"]).alias("event"), s["location"].alias("loc"), none("boolean").alias("captive"), r["scantime"].alias("scantime"),
                    r["bssid"].alias("bssid"), r["ssid"].alias("ssid"), r["rssi"].alias("rssi"), none("int").alias("linkSpeed"), none("int").alias("frequency"), none("int").alias("channelWidth"), none("int").alias("centerFreq0"), none("int").alias("centerFreq1"),
                    none("string").alias("capabilities"), none("boolean").alias("is80211mcResponder"), none("boolean").alias("isPasspointNetwork"), none("string").alias("operatorFriendlyName"), none("string").alias("venueName"), none("int").alias("numOfScanResults"),
                ),
            ),
        )
    )
    rows = docs.select("d", "message_id", F.posexplode(F.concat(connected, scanned)).alias("n", "m"))
    return rows.select("message_id", "n", F.struct(*[F.col(f"d.{c}") for c in ("osVersion", "model", "device", "manufacturer", "appNameVersion", "dataVersion")]).alias("d"), "m.*")


def judged(docs: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """T-13: candidate rows with ``reject`` (null when accepted)."""
    reason = wifi.reject_reason(F.col("bssid"), F.col("rssi"), F.col("loc.latitude"), F.col("loc.longitude"), F.col("loc.accuracy"), cfg)
    return _candidates(docs).withColumn("reject", reason)


def project(rows: DataFrame, ingested_at: Column, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """T-08, T-09, T-17 to T-23: the 45 columns. Ids come from content, so a rerun writes the same rows."""
    connected, link = F.col("status") == "CONNECTED", F.col("linkSpeed")
    by_name: dict[str, Column] = {
        "bssid": wifi.normal_bssid(F.col("bssid")), "id": F.sha2(F.concat_ws(":", "message_id", "n"), 256), "measurement_timestamp": F.col("ts"), "event_id": F.col("event"),
        "device_id": wifi.device_id(F.col("d.manufacturer"), F.col("d.model"), F.col("d.device"), F.col("d.osVersion")), "device_model": F.col("d.model"), "device_manufacturer": F.col("d.manufacturer"),
        "os_version": F.col("d.osVersion"), "app_version": F.col("d.appNameVersion"), "latitude": F.col("loc.latitude"), "longitude": F.col("loc.longitude"), "altitude": F.col("loc.altitude"),
        "location_accuracy": F.col("loc.accuracy"), "location_timestamp": F.col("loc.time"), "location_provider": F.col("loc.provider"), "location_source": F.col("loc.source"), "speed": F.col("loc.speed"), "bearing": F.col("loc.bearing"),
        "ssid": wifi.clean_ssid(F.col("ssid")), "rssi": F.col("rssi"), "frequency": F.col("frequency"), "scan_timestamp": F.when(connected, F.col("ts")).otherwise(F.col("scantime")), "connection_status": F.col("status"),
        "quality_weight": wifi.quality_weight(F.col("status"), link, F.col("rssi"), cfg), "link_speed": link, "channel_width": F.col("channelWidth"), "center_freq0": F.col("centerFreq0"), "center_freq1": F.col("centerFreq1"),
        "capabilities": F.col("capabilities"), "is_80211mc_responder": F.col("is80211mcResponder"), "is_passpoint_network": F.col("isPasspointNetwork"), "operator_friendly_name": F.col("operatorFriendlyName"), "venue_name": F.col("venueName"),
        "is_captive": F.col("captive"), "num_scan_results": F.col("numOfScanResults"), "ingestion_timestamp": ingested_at, "data_version": F.col("d.dataVersion"), "processing_batch_id": F.substring("message_id", 1, 32),
        "quality_score": wifi.quality_score(F.col("loc.accuracy"), F.col("rssi")),
    }
    fields = [f.strip().split(" ") for f in MEASUREMENT.split(",")]
    return rows.select(*[by_name.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def from_lines(lines: DataFrame, ingested_at: Column, cfg: FilterConfig = FilterConfig(), col: str = "value") -> DataFrame:
    """T-01: encoded lines to measurement rows; what cannot be read is skipped. Narrow: no shuffle."""
    return project(judged(parse(decode_lines(lines, col)), cfg).where("reject is null"), ingested_at, cfg)


def counters(rows: DataFrame) -> DataFrame:
    """T-24: accepted rows and rejects by reason."""
    count = lambda what: F.count(F.when(F.col("reject") == what, 1)).alias(f"invalid_{what}")
    return rows.agg(F.count("*").alias("seen"), F.count(F.when(F.col("reject").isNull(), 1)).alias("accepted"), *map(count, ("bssid", "rssi", "location", "hotspot")))
