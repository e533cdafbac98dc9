"""Column functions over Wi-Fi measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylocus.config import FilterConfig

EARTH_M = 6_371_000.0
_MAC = "^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def valid_bssid(c: Column) -> Column:
    """T-10: a MAC address, neither all zeros nor all ones; blanks around it do not count."""
    said = F.lower(F.trim(c))
    digits = F.translate(said, ":-", "")
    return F.coalesce(said.rlike(_MAC) & ~digits.isin("0" * 12, "f" * 12), F.lit(False))


def valid_rssi(c: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """T-11."""
    return F.coalesce(c.between(cfg.min_rssi, cfg.max_rssi), F.lit(False))


def valid_location(lat: Column, lon: Column, accuracy: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """T-12: coordinates in range; accuracy unknown or good enough."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)) & (accuracy.isNull() | (accuracy <= cfg.max_location_accuracy))


def valid_timestamp(ms: Column, as_of_ms: Column) -> Column:
    """T-14: not in the future, at most 365 days old."""
    return F.coalesce(ms.between(as_of_ms - 365 * 86_400_000, as_of_ms), F.lit(False))


def oui(bssid: Column) -> Column:
    said = F.translate(F.upper(bssid), "-", ":")
    fits = (F.substring(said, 3, 1) == ":") & (F.substring(said, 6, 1) == ":")
    return F.when(fits, F.substring(said, 1, 8))


def is_hotspot(bssid: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """T-15."""
    return F.coalesce(oui(bssid).isin(*cfg.hotspot_ouis), F.lit(False))


def excluded_as_hotspot(bssid: Column, cfg: FilterConfig) -> Column:
    """T-16: only EXCLUDE drops rows."""
    return is_hotspot(bssid, cfg) if cfg.hotspot_enabled and cfg.hotspot_action == "EXCLUDE" else F.lit(False)


def reject_reason(bssid: Column, rssi: Column, lat: Column, lon: Column, accuracy: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """T-13: the first check that fails, or null."""
    return (
        F.when(~valid_bssid(bssid), "bssid")
        .when(~valid_rssi(rssi, cfg), "rssi")
        .when(~valid_location(lat, lon, accuracy, cfg), "location")
        .when(excluded_as_hotspot(bssid, cfg), "hotspot")
    )


def quality_weight(status: Column, link_speed: Column, rssi: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """T-17."""
    slow = (link_speed < 50) & (rssi > -70)
    return F.when(status == "CONNECTED", F.when(slow, cfg.low_link_speed_weight).otherwise(cfg.connected_weight)).otherwise(cfg.scan_weight)


def quality_score(accuracy: Column, rssi: Column) -> Column:
    """T-18."""
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - accuracy / 100) * 0.3, F.lit(0.0))
    loud = F.coalesce(F.greatest(F.lit(0.0), (rssi + 100) / 100) * 0.2, F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.5) + near + loud)


def device_id(manufacturer: Column, model: Column, device: Column, os_version: Column) -> Column:
    """T-19."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (manufacturer, model, device, os_version)]), 256)


def scan_event_id(ms: Column, bssid: Column) -> Column:
    """T-20: from the address as sent."""
    return F.sha2(F.concat(F.coalesce(ms.cast("string"), F.lit("null")), F.lit(":"), bssid), 256)


def normal_bssid(c: Column) -> Column:
    """T-21."""
    return F.translate(F.lower(c), "-", ":")


def clean_ssid(c: Column) -> Column:
    """T-22."""
    return F.nullif(F.trim(F.translate(c, "\0", "")), F.lit(""))


def report_mac(c: Column, strict: bool = True) -> Column:
    """C-02: upper case in pairs; an address of another length is null if ``strict``, else as it was."""
    digits = F.upper(F.regexp_replace(c, "[:-]", ""))
    pairs = F.concat_ws(":", *[F.substring(digits, 2 * i + 1, 2) for i in range(6)])
    return F.when(F.length(digits) == 12, pairs) if strict else F.when(F.length(digits) == 12, pairs).otherwise(c)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """C-07."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))
