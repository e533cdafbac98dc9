"""Comparison of two providers' positions (C-01 to C-20).

Scenario and agreement labels carry the providers' names; give the names that reports should show.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylocus.functions import wifi
from skylocus.sources.registry import ELIGIBLE

#: An accuracy of so many metres or more comes from cell towers.
CELL_M = 250.0
DEFAULT_FREQUENCY = 2412


@dataclass(frozen=True)
class Names:
    a: str = "A"
    b: str = "B"


def to_request(reports: DataFrame, strict: bool = True) -> DataFrame:
    """C-01, C-20: the positioning request of a report, with ``mapped`` scans and counts of defaults used and entries dropped; ``invalid`` when no scan is left or an address is malformed."""
    req = F.col("sourceRequest.svcBody.svcReq")
    wifi_info = F.coalesce(req["wifiInfo"], F.array())
    usable = F.filter(wifi_info, lambda w: (F.length(F.trim(w["id"])) > 0) & w["signalStrength"].isNotNull())
    scans = F.transform(
        usable,
        lambda w: F.struct(
            wifi.report_mac(w["id"], strict).alias("mac_addr"), w["signalStrength"].alias("signal_strength"), F.coalesce(w["frequency"], F.lit(DEFAULT_FREQUENCY)).alias("frequency"), w["ssid"].alias("ssid")
        ),
    )
    return reports.withColumns(
        {
            "request_id": req["requestId"], "client": req["clientId"], "scans": scans,
            "defaults_used": F.size(F.filter(usable, lambda w: w["frequency"].isNull())), "dropped": F.size(wifi_info) - F.size(usable),
            "invalid": (F.size(scans) == 0) | F.exists(scans, lambda s: s["mac_addr"].isNull()),
        }
    )


def request_kind(reports: DataFrame) -> DataFrame:
    """C-19."""
    req = F.col("sourceRequest.svcBody.svcReq")
    w, cells = F.coalesce(req["wifiInfo"], F.array()), F.coalesce(req["cellInfo"], F.array())
    signals = F.filter(F.transform(w, lambda x: x["signalStrength"]), lambda x: x.isNotNull())
    return reports.withColumns(
        {
            "request_kind": F.when(F.size(cells) > 0, "CELL_PRESENT").otherwise("WIFI_ONLY"),
            "aps_with_frequency": F.size(F.filter(w, lambda x: x["frequency"].isNotNull())), "cell_towers": F.size(cells),
            "min_signal": F.array_min(signals), "max_signal": F.array_max(signals),
            "avg_signal": F.when(F.size(signals) > 0, F.aggregate(signals, F.lit(0.0), lambda a, x: a + x) / F.size(signals)),
        }
    )


def insufficient(message: Column) -> Column:
    """C-05."""
    said = F.lower(message)
    has = lambda s: F.contains(said, F.lit(s))
    found = has("no known access points found in database") | has("no access points with valid status found") | (has("insufficient") & has("access point"))
    return F.coalesce(found, F.lit(False))


def success_b(result: Column) -> Column:
    """C-03."""
    return F.coalesce(result == "SUCCESS", F.lit(False))


def scenario(success_a: Column, success_b: Column, error_b: Column, accuracy_a: Column, names: Names = Names()) -> Column:
    """C-04."""
    a, b = names.a, names.b
    cell = F.coalesce(accuracy_a >= CELL_M, F.lit(False))
    fine_b = F.coalesce(success_b, F.lit(False))
    return (
        F.when(success_a.isNull(), f"{b}_ONLY_ANALYSIS")
        .when(success_a & fine_b, "BOTH_WIFI_SUCCESS")
        .when(success_a & insufficient(error_b) & cell, f"{a}_CELL_FALLBACK_DETECTED")
        .when(success_a & cell, f"{a}_SUCCESS_{b}_ERROR_CELL")
        .when(success_a, f"{a}_SUCCESS_{b}_ERROR_WIFI")
        .when(fine_b, f"{a}_ERROR_{b}_SUCCESS")
        .otherwise("BOTH_INSUFFICIENT_DATA")
    )


def location_type(label: Column, names: Names = Names()) -> Column:
    """C-06."""
    a, b = names.a, names.b
    return (
        F.when(label.isin(f"{a}_CELL_FALLBACK_DETECTED", f"{a}_SUCCESS_{b}_ERROR_CELL"), "CELL")
        .when(label == "BOTH_INSUFFICIENT_DATA", "NONE")
        .when(label.isin("BOTH_WIFI_SUCCESS", f"{a}_ERROR_{b}_SUCCESS", f"{b}_ONLY_ANALYSIS", f"{a}_SUCCESS_{b}_ERROR_WIFI"), "WIFI")
        .otherwise("UNKNOWN")
    )


def agreement(label: Column, distance: Column, accuracy_a: Column, accuracy_b: Column, names: Names = Names()) -> Column:
    """C-09: null when there is nothing to compare."""
    a, b = names.a, names.b
    ratio = F.when(accuracy_b > 0, distance / accuracy_b)
    both = distance.isNotNull() & accuracy_a.isNotNull() & accuracy_b.isNotNull()
    return (
        F.when(label.isin(f"{a}_CELL_FALLBACK_DETECTED", f"{a}_SUCCESS_{b}_ERROR_CELL"), "NO WIFI COVERAGE")
        .when(label == f"{a}_SUCCESS_{b}_ERROR_WIFI", f"{b} FAILURE")
        .when(~both, F.lit(None))
        .when(distance == 0, "PERFECT AGREEMENT")
        .when(accuracy_a >= CELL_M, "WIFI VS CELL DISAGREEMENT")
        .when(distance < uncertainty(accuracy_a, accuracy_b), "GOOD AGREEMENT")
        .when(ratio <= 1.0, f"{b} WITHIN BOUNDS")
        .when(ratio <= 1.5, f"{b} MODERATELY OVERCONFIDENT")
        .when(ratio <= 2.5, f"{b} OVERCONFIDENT")
        .when(ratio > 2.5, f"{b} EXTREMELY OVERCONFIDENT")
    )


def uncertainty(accuracy_a: Column, accuracy_b: Column) -> Column:
    """C-08."""
    return F.sqrt(accuracy_a * accuracy_a + accuracy_b * accuracy_b)


def confidence_ratio(distance: Column, accuracy_a: Column, accuracy_b: Column) -> Column:
    """C-10: 0 for identical positions, none against a cell position."""
    return F.when(accuracy_b > 0, F.when(distance == 0, 0.0).when(accuracy_a < CELL_M, distance / accuracy_b))


def used_ratio(used: Column, total: Column) -> Column:
    """C-11."""
    return F.when(total > 0, used / total)


def error_details(response: Column) -> Column:
    """C-13: ``Code c: m (d)`` of every error, or the message of the older format."""
    errors = F.filter(F.coalesce(response["svcError"]["errors"], F.array()), lambda e: e.isNotNull())
    one = lambda e: F.concat(F.lit("Code "), F.coalesce(e["code"], F.lit("")), F.lit(": "), F.coalesce(e["message"], F.lit("")), F.when(e["description"].isNotNull(), F.concat(F.lit(" ("), e["description"], F.lit(")"))).otherwise(""))
    return F.when(F.size(errors) > 0, F.array_join(F.transform(errors, one), "; ")).otherwise(response["errorMessage"])


def quality_factors(detail_json: Column) -> list[Column]:
    """C-12: factors, methods and time from the calculation detail."""
    get = lambda path: F.get_json_object(detail_json, path)
    return [
        get("$.calculationInfo.selectionContext.apCountFactor").alias("ap_count_factor"), get("$.calculationInfo.selectionContext.signalQuality").alias("signal_quality"),
        get("$.calculationInfo.selectionContext.geometricQuality").alias("geometric_quality"), get("$.calculationInfo.selectionContext.signalDistribution").alias("signal_distribution"),
        get("$.wifiPosition.methodsUsed").alias("methods"), get("$.wifiPosition.calculationTimeMs").cast("long").alias("calculation_ms"),
    ]


def compare(pairs: DataFrame, names: Names = Names()) -> DataFrame:
    """C-03 to C-10, C-18 over rows with success_a, lat_a, lon_a, acc_a, result_b, error_b, lat_b, lon_b, acc_b (and alt_, conf_ of both if there)."""
    a_ok, b_ok = F.col("success_a"), success_b(F.col("result_b"))
    out = pairs.withColumn("success_b", b_ok).withColumn("scenario", scenario(a_ok, b_ok, F.col("error_b"), F.col("acc_a"), names))
    out = out.withColumn("location_type", location_type(F.col("scenario"), names))
    apart = wifi.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    failed = F.col("scenario").isin(f"{names.a}_CELL_FALLBACK_DETECTED", f"{names.a}_SUCCESS_{names.b}_ERROR_CELL", f"{names.a}_SUCCESS_{names.b}_ERROR_WIFI")
    out = out.withColumn("distance_m", F.when(~failed, F.round(apart, 6)))
    out = out.withColumn("uncertainty_m", F.when(F.col("distance_m").isNotNull(), uncertainty(F.col("acc_a"), F.col("acc_b"))))
    out = out.withColumn("agreement", agreement(F.col("scenario"), F.col("distance_m"), F.col("acc_a"), F.col("acc_b"), names))
    out = out.withColumn("confidence_ratio", confidence_ratio(F.col("distance_m"), F.col("acc_a"), F.col("acc_b")))
    for field in ("lat", "lon", "acc", "alt", "conf"):
        if {f"{field}_a", f"{field}_b"} <= set(pairs.columns):
            out = out.withColumn(f"{field}_delta", F.col(f"{field}_b") - F.col(f"{field}_a"))
    return out


def enrich(asked: DataFrame, known: DataFrame, used: DataFrame) -> DataFrame:
    """C-14, J-03: every access point of a request (request_id, mac_addr), whether it is known (mac_addr, status), used and eligible."""
    mark = used.select("request_id", "mac_addr", F.lit(True).alias("_used")).distinct()
    rows = asked.join(known.select("mac_addr", "status"), "mac_addr", "left").join(mark, ["request_id", "mac_addr"], "left")
    return rows.select("request_id", "mac_addr", F.col("status").isNotNull().alias("found"), F.coalesce("_used", F.lit(False)).alias("used"), F.coalesce(F.col("status").isin(*ELIGIBLE), F.lit(False)).alias("eligible"), F.coalesce("status", F.lit("unknown")).alias("status"))


def enrichment(rows: DataFrame) -> DataFrame:
    """C-15."""
    n = lambda c: F.count(F.when(c, 1))
    by_status = rows.where("found").groupBy("request_id", "status").count().groupBy("request_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("status_counts"))
    totals = rows.groupBy("request_id").agg(F.count("*").alias("total"), n(F.col("found")).alias("found"), n(~F.col("found")).alias("not_found"), n(F.col("eligible")).alias("eligible"), n(F.col("used")).alias("used"))
    totals = totals.withColumns({"found_pct": F.round(100.0 * F.col("found") / F.col("total"), 6), "used_pct": F.round(100.0 * F.col("used") / F.col("total"), 6), "unknown_exclusions": F.greatest(F.lit(0), F.col("eligible") - F.col("used"))})
    return totals.join(by_status, "request_id", "left")


def report_events(rows: DataFrame) -> DataFrame:
    """C-16, S-18: one nested event per report, as JSON."""
    section = lambda *c: F.struct(*[x for x in c if x in rows.columns])
    return rows.select(
        F.to_json(
            F.struct(
                section("request_id", "client").alias("request"), section("success_a", "lat_a", "lon_a", "acc_a").alias("provider_a"), section("result_b", "error_b", "lat_b", "lon_b", "acc_b").alias("provider_b"),
                section("scenario", "location_type", "distance_m", "uncertainty_m", "agreement", "confidence_ratio").alias("comparison"), section("n_aps", "signal", "geometry", "distribution", "methods").alias("context"),
            )
        ).alias("value")
    )
