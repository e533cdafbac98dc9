"""Device positions from scans and the access-point registry (P-01 to P-23, A-01 to A-07).

Scans joined to the registry are gathered into one bounded array per request (at most 20 scans), and all
of context, selection, five estimators and the combiner are expressions over that array: one exchange, on
the request, for the whole calculation. Only the iterative estimator leaves the JVM, as an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylocus.functions.wifi import EARTH_M, clamp

ALGORITHMS = ["LOG_DISTANCE", "MAXIMUM_LIKELIHOOD", "PROXIMITY", "RSSI_RATIO", "TRILATERATION", "WEIGHTED_CENTROID"]
METHOD = {"PROXIMITY": "proximity", "RSSI_RATIO": "rssiratio", "WEIGHTED_CENTROID": "weighted_centroid", "TRILATERATION": "trilateration", "MAXIMUM_LIKELIHOOD": "maximum_likelihood", "LOG_DISTANCE": "log_distance_path_loss"}

#: P-01, fixed values: what a valid request holds. ``pos`` numbers a request's scans from 0 or 1.
MOST_SCANS, MAC_PATTERN = 20, "^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
SIGNAL_RANGE, FREQUENCY_RANGE, WIDTH_RANGE = (-100, 0), (2400, 6000), (20, 160)
LONGEST = {"client": ("Client", 50), "application": ("Application", 100)}

#: P-15, fixed values: for each algorithm its weight by number of access points (1, 2, 3, 4 or more), then
#: factors by signal (strong, medium, weak, very weak), geometry (excellent, good, fair, poor, collinear)
#: and distribution (uniform, mixed, outliers), and its own confidence.
WEIGHTS: dict[str, tuple[list[float], list[float], list[float], list[float], float]] = {
    "PROXIMITY": ([1, 0.4, 0.3, 0.2], [0.9, 0.7, 0.4, 0.5], [1, 1, 1, 1, 1], [1, 0.7, 0.9], 0.6),
    "RSSI_RATIO": ([0, 1, 0.7, 0.5], [1, 0.9, 0.6, 0], [1, 1, 0.9, 0.8, 1], [1.2, 0.9, 0.7], 0.75),
    "WEIGHTED_CENTROID": ([0, 0.8, 0.8, 0.7], [1, 1, 0.8, 0], [1, 1.1, 1.2, 1.3, 1.1], [1, 1.8, 1.4], 0.7),
    "TRILATERATION": ([0, 0, 1, 0.8], [1.1, 0.8, 0.3, 0], [1.3, 0.9, 0.6, 0.3, 0], [1.1, 0.8, 0.5], 0.85),
    "MAXIMUM_LIKELIHOOD": ([0, 0, 0, 1], [1.2, 0.9, 0.5, 0], [1.2, 1.1, 0.9, 0.7, 1.1], [0.9, 1.1, 1.2], 0.8),
    "LOG_DISTANCE": ([0.4, 0.5, 0.5, 0.4], [1, 0.8, 0.6, 0], [1, 1, 0.8, 0.7, 0.3], [1.1, 0.8, 0.8], 0.85),
}
#: P-14, fixed values: the algorithms allowed by number of access points.
ALLOWED = [
    ["PROXIMITY", "LOG_DISTANCE"],
    ["PROXIMITY", "LOG_DISTANCE", "RSSI_RATIO", "WEIGHTED_CENTROID"],
    ["PROXIMITY", "LOG_DISTANCE", "RSSI_RATIO", "WEIGHTED_CENTROID", "TRILATERATION"],
    ALGORITHMS,
]
#: P-18, fixed values: what is said of an algorithm. By number of access points (1, 2, 3, 4 or more) where it is allowed.
VALID_REASONS = ["Valid for single AP", "Valid for two APs", "Valid for three APs", "Valid for 4+ APs"]
MODEL_REASON = "Valid for single AP with path loss model"
FEW_REASON = "DISQUALIFIED (insufficient APs)"
LEAST_REASONS = {"TRILATERATION": "DISQUALIFIED (requires at least 3 APs)", "MAXIMUM_LIKELIHOOD": "DISQUALIFIED (requires at least 4 APS)"}
ONLY_REASON = "Only viable algorithm for extremely weak signals"
WEAK_REASON = "DISQUALIFIED (signal too weak)"
LINE_REASON = "DISQUALIFIED (collinear APs)"
POOR_REASON = "DISQUALIFIED (poor geometry)"
CHOSEN_REASON = "SELECTED. Weight Calculation: "
BELOW_REASON = "DISQUALIFIED  (below threshold %.2f) . Weight Calculation: "
TOP_TWO_REASON = "DISQUALIFIED (not in top 2 High Confidence). Weight Calculation: "
TOP_THREE_REASON = "DISQUALIFIED (not in top 3 below High Confidence). Weight Calculation: "
WEIGHT_REASON = "Weight=%.2f: base(%.2f) × signal(%.2f) × geometric(%.2f) × distribution(%.2f)"
SIGNALS = ["STRONG", "MEDIUM", "WEAK", "VERY_WEAK"]
GEOMETRIES = ["EXCELLENT", "GOOD", "FAIR", "POOR", "COLLINEAR"]
DISTRIBUTIONS = ["UNIFORM", "MIXED", "OUTLIERS"]
VENDOR_EXPONENT = {"cisco": 3.0, "aruba": 2.8, "meraki": 3.0, "ubiquiti": 2.7, "ruckus": 2.9, "hpe-aruba": 2.8}
LIGHT, LN10 = 299_792_458.0, float(np.log(10))
DOUBLE_MAX = 1.7976931348623157e308
_POSITION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "altitude", "accuracy", "confidence")])


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))


def let(value: Column, f) -> Column:
    """f(value), with value planned and evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def settled(df: DataFrame) -> DataFrame:
    """The same rows, narrow, behind a generator that the optimizer does not inline projections across."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def _mean(arr: Column, f) -> Column:
    return F.try_divide(_sum(arr, f), F.size(arr))


def _position(lat: Column, lon: Column, alt: Column, acc: Column, conf: Column) -> Column:
    """P-20: null unless the coordinates are numbers in range."""
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(fine, F.struct(lat.alias("latitude"), lon.alias("longitude"), alt.cast("double").alias("altitude"), acc.alias("accuracy"), conf.alias("confidence")))


def scan_faults(columns: list[str]) -> Column:
    """P-01: the messages of the rules that a scan breaks; of the columns that may be absent, those in ``columns`` count."""
    mac, rssi, freq = F.col("mac_addr"), F.col("rssi"), F.col("frequency")
    blank = mac.isNull() | (F.trim(mac) == "")
    rules = [
        (blank, "MAC address is required"),
        (~blank & ~mac.rlike(MAC_PATTERN), "Invalid MAC address format"),
        (rssi.isNull(), "Signal strength cannot be null"),
        (rssi < SIGNAL_RANGE[0], f"Signal strength must be at least {SIGNAL_RANGE[0]} dBm"),
        (rssi > SIGNAL_RANGE[1], f"Signal strength must be at most {SIGNAL_RANGE[1]} dBm"),
        (freq.isNull(), "Frequency cannot be null"),
        (freq < FREQUENCY_RANGE[0], f"Frequency must be at least {FREQUENCY_RANGE[0]} MHz"),
        (freq > FREQUENCY_RANGE[1], f"Frequency must be at most {FREQUENCY_RANGE[1]} MHz"),
    ]
    if "channel_width" in columns:
        rules += [(F.col("channel_width") < WIDTH_RANGE[0], f"Channel width must be at least {WIDTH_RANGE[0]} MHz"), (F.col("channel_width") > WIDTH_RANGE[1], f"Channel width must be at most {WIDTH_RANGE[1]} MHz")]
    if "link_speed" in columns:
        rules.append((F.col("link_speed") < 0, "Link speed must be non-negative"))
    if "client" in columns:
        rules.append((F.col("client").isNull() | (F.trim("client") == ""), "Client is required"))
    rules += [(F.length(c) > most, f"{said} must be at most {most} characters") for c, (said, most) in LONGEST.items() if c in columns]
    return F.array_compact(F.array(*[F.when(broken, F.lit(said)) for broken, said in rules]))


def fault_text(messages: Column, n_scans: Column) -> Column:
    """P-01: the messages in order, as one text; null if there are none. ``messages``: one array for each scan."""
    many = F.when(~n_scans.between(1, MOST_SCANS), F.lit(f"Between 1 and {MOST_SCANS} WiFi scan results must be provided"))
    found = F.array_sort(F.array_compact(F.array_append(F.array_distinct(F.flatten(messages)), many)))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def request_faults(scans: DataFrame) -> DataFrame:
    """P-01: request_id, n_scans and faults (null if valid) of each request. Sets of messages are bounded by the rules, however many scans there are."""
    broken = scans.withColumn("_faults", scan_faults(scans.columns))
    out = broken.groupBy("request_id").agg(F.count("*").alias("n_scans"), F.collect_set("_faults").alias("_all"))
    return out.select("request_id", "n_scans", fault_text(F.col("_all"), F.col("n_scans")).alias("faults"))


def method_names(selected: Column) -> Column:
    """P-21: the names of the selected algorithms' methods, in order, joined by commas."""
    return F.array_join(F.array_sort(F.transform(selected, lambda c: reduce(lambda a, kv: a.when(c["algorithm"] == kv[0], kv[1]), METHOD.items(), F.when(F.lit(False), "")))), ",")


def status_histogram(known: DataFrame) -> DataFrame:
    """P-22: request_id and statuses, ``status=count`` in order of status, of the known access points' rows."""
    n = known.groupBy("request_id", "status").count()
    pair = F.struct("status", F.concat_ws("=", "status", F.col("count").cast("string")).alias("t"))
    return n.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["t"]), ",").alias("statuses"))


def location_certainty(known: DataFrame) -> DataFrame:
    """P-23: request_id and certainty, the mean confidence of the access points used."""
    return known.groupBy("request_id").agg(F.avg("confidence").alias("certainty"))


def signal_pairs(aps: Column) -> Column:
    """J-04: the difference of signals of every pair of scans inside a request's bounded array, without a self-join."""
    return F.flatten(F.transform(aps, lambda a: F.transform(F.filter(aps, lambda b: b["pos"] > a["pos"]), lambda b: F.abs(a["s"] - b["s"]))))


def gather(joined: DataFrame, keep: list[str] = []) -> DataFrame:
    """request_id and ``aps``, its scans with their access points in scan order. ``joined`` has a row per scan: request_id, pos, mac_addr, rssi, frequency and the registry's columns."""
    one = F.struct("pos", "mac_addr", F.col("rssi").cast("double").alias("s"), F.col("frequency").cast("double").alias("f"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("altitude").alias("alt"), F.col("horizontal_accuracy").alias("hacc"), F.col("confidence").alias("conf"), F.lower("vendor").alias("vendor"))
    return joined.groupBy("request_id").agg(F.sort_array(F.collect_list(one)).alias("aps"), *[F.first(c).alias(c) for c in keep])


def physics_ok(aps: Column) -> Column:
    """P-02: every signal in [-100, -30]; on one frequency a loud access point rules out one more than 45 dB weaker, unless exactly -30 and -100 meet."""
    ranged = F.forall(aps, lambda a: a["s"].between(-100, -30))

    def band(f: Column) -> Column:
        own = F.transform(F.filter(aps, lambda a: a["f"] == f), lambda a: a["s"])
        top, low = F.array_max(own), F.array_min(own)
        return (F.size(own) < 2) | (top <= -50) | (top - low <= 45) | ((top == -30) & (low == -100))

    return ranged & F.forall(F.array_distinct(F.transform(aps, lambda a: a["f"])), band)


def ap_count_class(n: Column) -> Column:
    """P-04: 1 to 4, 4 for more."""
    return F.least(n, F.lit(4))


def signal_class(mean: Column) -> Column:
    """P-05."""
    return F.when(mean > -70, "STRONG").when(mean > -85, "MEDIUM").when(mean > -95, "WEAK").otherwise("VERY_WEAK")


def distribution_class(std: Column, n: Column) -> Column:
    """P-06."""
    return F.when(n < 2, "UNIFORM").when(std > 10, "OUTLIERS").when(std > 3, "MIXED").otherwise("UNIFORM")


def collinear(points: Column) -> Column:
    """P-07: ``points`` have lat and lon."""
    n = F.size(points)
    mx, my = _mean(points, lambda p: p["lon"]), _mean(points, lambda p: p["lat"])
    vx = _mean(points, lambda p: F.pow(p["lon"] - mx, 2))
    vy = _mean(points, lambda p: F.pow(p["lat"] - my, 2))
    slope = _mean(points, lambda p: (p["lon"] - mx) * (p["lat"] - my)) / vx
    worst = F.array_max(F.transform(points, lambda p: F.abs(p["lat"] - (my + slope * (p["lon"] - mx)))))
    return F.when(n < 3, F.lit(False)).when((vx < 1e-10) | (vy < 1e-10), F.lit(True)).otherwise(F.round(worst, 12) <= 0.0002)


def _unit(lat: Column, lon: Column, at_lat: Column, at_lon: Column) -> Column:
    """East and north of the unit vector from an access point; (1, 0) if it is nearer than a metre."""
    k = EARTH_M * np.pi / 180
    north, east = (at_lat - lat) * k, (at_lon - lon) * k * F.cos(F.radians(at_lat))
    d = F.sqrt(north * north + east * east)
    return F.struct(F.when(d < 1, 1.0).otherwise(north / d).alias("x"), F.when(d < 1, 0.0).otherwise(east / d).alias("y"))


def gdop_bias(units: Column) -> Column:
    """P-09 in the plane with a clock column: sqrt of the trace of the inverse normal matrix, at most 30."""
    xx, yy, xy = (_sum(units, f) for f in (lambda u: u["x"] * u["x"], lambda u: u["y"] * u["y"], lambda u: u["x"] * u["y"]))
    x, y, n = _sum(units, lambda u: u["x"]), _sum(units, lambda u: u["y"]), F.size(units).cast("double")
    det = xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x)
    trace = ((yy * n - y * y) + (xx * n - x * x) + (xx * yy - xy * xy)) / det
    return F.when((n < 3) | (F.abs(det) < 1e-10) | (trace < 0), 30.0).otherwise(F.least(F.lit(30.0), F.sqrt(F.greatest(trace, F.lit(0.0)))))


def gdop_plain(units: Column) -> Column:
    """P-09 in the plane without a clock column."""
    xx, yy, xy = (_sum(units, f) for f in (lambda u: u["x"] * u["x"], lambda u: u["y"] * u["y"], lambda u: u["x"] * u["y"]))
    det = xx * yy - xy * xy
    return F.when((F.size(units) < 3) | (F.abs(det) < 1e-10), 30.0).otherwise(F.least(F.lit(30.0), F.sqrt((xx + yy) / det)))


def gdop_factor(g: Column) -> Column:
    """P-10."""
    return F.when(g <= 2, 1.0).when(g <= 4, 1 + 0.5 * (g - 2) / 2).when(g <= 6, 1.5 + 0.5 * (g - 4) / 2).otherwise(F.least(F.lit(4.0), 2 + (g - 6) / 2))


def condition_number(a: Column, b: Column, c: Column) -> Column:
    """P-11: of the matrix (a c; c b)."""
    det, half = a * b - c * c, (a + b) / 2
    disc = half * half - det
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when((F.abs(det) < 1e-10) | (disc < 0), DOUBLE_MAX).otherwise(F.abs((half + root) / (half - root)))


def geometry_factor(line: Column, kappa: Column) -> Column:
    """P-12."""
    return (
        F.when(line, 2 + F.least(F.lit(1.0), F.log10(kappa) / 2))
        .when(kappa < 5, 1.0)
        .when(kappa < 20, 1 + (kappa - 5) / 15)
        .otherwise(2 + F.least(F.lit(1.0), (kappa - 20) / 80))
    )


def with_context(req: DataFrame) -> DataFrame:
    """P-04 to P-08: adds n_aps, mean_rssi, signal, distribution, gdop and geometry."""
    aps = F.col("aps")
    req = req.withColumn("n_aps", F.size(F.array_distinct(F.transform(aps, lambda a: a["mac_addr"]))))
    req = req.withColumn("mean_rssi", F.round(_mean(aps, lambda a: a["s"]), 9))
    req = req.withColumn("std_rssi", F.round(F.sqrt(_mean(aps, lambda a: F.pow(a["s"] - F.col("mean_rssi"), 2))), 9))
    w = lambda a: F.pow(F.lit(10.0), a["s"] / 10)
    req = req.withColumn("_w", _sum(aps, w))
    req = req.withColumn("_lat", F.try_divide(_sum(aps, lambda a: w(a) * a["lat"]), F.col("_w"))).withColumn("_lon", F.try_divide(_sum(aps, lambda a: w(a) * a["lon"]), F.col("_w")))
    req = settled(req)
    units = F.transform(aps, lambda a: _unit(a["lat"], a["lon"], F.col("_lat"), F.col("_lon")))
    req = req.withColumn("gdop", F.round(let(units, gdop_bias), 9)).withColumn("collinear", collinear(aps))
    geometry = F.when(F.size(aps) < 3, "POOR").when(F.col("collinear"), "COLLINEAR").when(F.col("gdop") < 2, "EXCELLENT").when(F.col("gdop") < 4, "GOOD").when(F.col("gdop") < 6, "FAIR").otherwise("POOR")
    return req.withColumns({"signal": signal_class(F.col("mean_rssi")), "distribution": distribution_class(F.col("std_rssi"), F.size(aps)), "geometry": geometry}).drop("_w", "_lat", "_lon").transform(settled)


def _pick(of: Column, names: list, values: list[float]) -> Column:
    return reduce(lambda c, nv: c.when(of == nv[0], float(nv[1])), zip(names, values), F.when(F.lit(False), 0.0))


def eligible(name: str) -> Column:
    """P-14."""
    at = [i + 1 for i, names in enumerate(ALLOWED) if name in names]
    fits = ap_count_class(F.col("n_aps")).isin(*at)
    if name == "TRILATERATION":
        fits = fits & ~F.col("geometry").isin("COLLINEAR", "POOR")
    weak = F.col("signal") == "VERY_WEAK"
    return F.when(weak, F.lit(name == "PROXIMITY")).otherwise(fits)


def factors(name: str) -> list[Column]:
    """P-15: base weight by number of access points, then the factors by signal, geometry and distribution."""
    base, signal, geometry, spread, _ = WEIGHTS[name]
    return [_pick(ap_count_class(F.col("n_aps")), [1, 2, 3, 4], base), _pick(F.col("signal"), SIGNALS, signal), _pick(F.col("geometry"), GEOMETRIES, geometry), _pick(F.col("distribution"), DISTRIBUTIONS, spread)]


def weight(name: str) -> Column:
    """P-15."""
    return F.round(reduce(lambda a, b: a * b, factors(name)), 12)


def with_selection(req: DataFrame, threshold: float = 0.4) -> DataFrame:
    """P-14 to P-18: adds ``candidates`` (algorithm, weight of those eligible) and ``selected``, best first."""
    each = F.array(*[F.struct(F.lit(n).alias("algorithm"), F.when(eligible(n), weight(n)).alias("weight")) for n in ALGORITHMS])
    req = settled(req.withColumn("candidates", F.filter(each, lambda c: c["weight"].isNotNull())))
    # by falling weight, then by name
    order = F.array_sort("candidates", lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["algorithm"] < b["algorithm"], -1).otherwise(1))
    least = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))["weight"]).otherwise(threshold)
    req = settled(req.withColumn("_over", F.filter(order, lambda c: c["weight"] >= least)))
    most = F.when(F.try_element_at("_over", F.lit(1))["weight"] > 0.8, 2).otherwise(3)
    return settled(req.withColumn("selected", F.slice("_over", 1, most)).drop("_over"))


def _first_reason(name: str) -> Column:
    """P-18: what the signal, else the number of access points, says of an algorithm."""
    by_count = []
    for i, names in enumerate(ALLOWED):
        if name in names:
            by_count.append(MODEL_REASON if (i, name) == (0, "LOG_DISTANCE") else VALID_REASONS[i])
        else:
            by_count.append(FEW_REASON if i == 0 else LEAST_REASONS[name])
    at = ap_count_class(F.col("n_aps"))
    said = reduce(lambda c, nv: c.when(at == nv[0], nv[1]), zip([1, 2, 3], by_count), F.when(F.lit(False), ""))
    return F.when(F.col("signal") == "VERY_WEAK", ONLY_REASON if name == "PROXIMITY" else WEAK_REASON).otherwise(said.otherwise(by_count[3]))


def reasons(name: str, threshold: float = 0.4) -> Column:
    """P-18: all that was said of an algorithm, in order, of this request alone. Needs the columns of ``with_selection``."""
    own = F.exists("candidates", lambda c: c["algorithm"] == name)
    chosen = F.exists("selected", lambda c: c["algorithm"] == name)
    held = F.filter("candidates", lambda c: c["algorithm"] == name)
    top = F.array_max(F.transform("candidates", lambda c: c["weight"]))
    shape = F.when((F.col("signal") != "VERY_WEAK") & ~own, F.when(F.col("geometry") == "COLLINEAR", LINE_REASON).when(F.col("geometry") == "POOR", POOR_REASON))
    parts = factors(name)
    numbers = F.format_string(WEIGHT_REASON, reduce(lambda a, b: a * b, parts), *parts)
    below = (F.size("candidates") > 1) & (F.get(held, F.lit(0))["weight"] < threshold)
    verdict = (
        F.when(chosen, F.lit(CHOSEN_REASON))
        .when(below, F.format_string(BELOW_REASON, F.lit(threshold)))
        .when(top > 0.8, F.lit(TOP_TWO_REASON))
        .otherwise(F.lit(TOP_THREE_REASON))
    )
    return F.array_compact(F.array(_first_reason(name), shape, F.when(own, F.concat(verdict, numbers))))


def with_reasons(req: DataFrame, threshold: float = 0.4) -> DataFrame:
    """P-18: adds ``reasons``, for each algorithm its name, whether it is selected and all that was said of it."""
    each = [F.struct(F.lit(n).alias("algorithm"), F.exists("selected", lambda c: c["algorithm"] == n).alias("chosen"), reasons(n, threshold).alias("reasons")) for n in ALGORITHMS]
    return req.withColumn("reasons", F.array(*each))


def proximity(aps: Column) -> Column:
    """A-01: the loudest access point, the first of equals."""
    best = F.array_max(F.transform(aps, lambda a: F.struct(a["s"].alias("s"), (-a["pos"]).alias("o"), a.alias("a"))))
    a = best["a"]
    return _position(a["lat"], a["lon"], F.coalesce(a["alt"], F.lit(0.0)), a["hacc"], clamp((best["s"] + 90) / 60, 0.0, 0.85))


def weighted_centroid(aps: Column) -> Column:
    """A-02."""
    w = lambda a: F.pow(F.lit(10.0), clamp((a["s"] + 30) / -70, 0.0, 1.0))
    total = _sum(aps, w)
    high = F.filter(aps, lambda a: F.abs(F.coalesce(a["alt"], F.lit(0.0)) * w(a)) > 1e-10)
    alt = F.when(F.size(high) > 0, _sum(high, lambda a: a["alt"] * w(a)) / _sum(high, w)).otherwise(0.0)
    known = F.size(F.array_distinct(F.transform(aps, lambda a: a["mac_addr"])))
    return _position(F.try_divide(_sum(aps, lambda a: w(a) * a["lat"]), total), F.try_divide(_sum(aps, lambda a: w(a) * a["lon"]), total), alt, _mean(aps, lambda a: a["hacc"]), F.least(F.lit(0.8), F.try_divide(F.size(aps), known) * 0.7))


def rssi_ratio(aps: Column) -> Column:
    """A-03: every pair once; null when all signals are equal."""
    later = lambda a: F.filter(aps, lambda b: b["pos"] > a["pos"])

    def point(a: Column, b: Column) -> Column:
        r = F.pow(F.lit(10.0), (a["s"] - b["s"]) / 20)
        mid = lambda c: (a[c] + r * b[c]) / (1 + r)
        w = F.abs(a["s"] - b["s"]) / 30
        return F.struct(w.alias("w"), mid("lat").alias("lat"), mid("lon").alias("lon"), mid("alt").alias("alt"))

    pairs = F.flatten(F.transform(aps, lambda a: F.transform(later(a), lambda b: point(a, b))))
    total, n, mean = _sum(pairs, lambda p: p["w"]), F.size(aps), _mean(aps, lambda a: a["s"])
    tall = F.filter(pairs, lambda p: p["alt"].isNotNull())
    tall_w = _sum(tall, lambda p: p["w"])
    alt = F.when(tall_w > 0, _sum(tall, lambda p: p["w"] * p["alt"]) / tall_w).otherwise(0.0)
    acc = _mean(aps, lambda a: a["hacc"]) * clamp((-mean - 50) / 10, 1.0, 3.0)
    base = F.least(F.lit(0.85), F.try_divide(total, n * (n - 1) / 2))
    conf = F.least(F.lit(0.85), base + _mean(aps, lambda a: clamp((a["s"] + 95) / 45, 0.0, 1.0)))
    conf = F.when(mean >= -70, F.greatest(F.lit(0.7), conf)).otherwise(conf)
    found = _position(F.try_divide(_sum(pairs, lambda p: p["w"] * p["lat"]), total), F.try_divide(_sum(pairs, lambda p: p["w"] * p["lon"]), total), alt, acc, conf)
    return F.when((n >= 2) & (total > 0), found)


def log_distance(aps: Column) -> Column:
    """A-04: null if an address occurs twice."""

    def model(a: Column) -> Column:
        s, f = a["s"], a["f"]
        n0 = reduce(lambda c, kv: c.when(a["vendor"] == kv[0], kv[1]), VENDOR_EXPONENT.items(), F.when(F.lit(False), 0.0)).otherwise(3.0)
        n = F.when(s >= -50, F.greatest(F.lit(2.0), n0 - F.least(F.lit(1.0), (s + 50) / 5))).when(s <= -80, F.least(F.lit(5.0), n0 + F.least(F.lit(1.5), (-80 - s) / 5))).otherwise(n0)
        ref = F.when(f >= 5000, -45.0).when(f >= 2400, -40.0).otherwise(-43.0)
        sigma = F.when(s >= -50, 2.0).when(s <= -80, 5.0).otherwise(2.0 + (-50 - s) / 30 * 3)
        env = F.when((s >= -50) & (sigma <= 2), 1.0).when((s >= -80) & (sigma <= 4), 0.8).otherwise(0.6)
        d = F.pow(F.lit(10.0), F.abs(ref - s) / (10 * n)) * (1 + sigma / 10) * env
        known = F.coalesce(a["vendor"].isin(*VENDOR_EXPONENT), F.lit(False))
        return F.struct(a["lat"].alias("lat"), a["lon"].alias("lon"), a["alt"].alias("alt"), s.alias("s"), n.alias("n"), d.alias("d"), (1 / F.greatest(F.lit(1.0), d)).alias("w"), known.cast("double").alias("known"))

    m = F.transform(aps, model)
    total = _sum(m, lambda x: x["w"])
    alt = F.when(F.exists(m, lambda x: x["alt"].isNotNull()), _sum(m, lambda x: F.coalesce(x["alt"], F.lit(0.0)) * x["w"]) / total).otherwise(0.0)
    mean, ds, n = _mean(m, lambda x: x["s"]), F.transform(m, lambda x: x["d"]), F.size(m)
    low, high = F.array_min(ds), F.array_max(ds)
    acc = F.when(mean >= -50, 0.5 * low).when(mean <= -80, 3 * high).otherwise(low * (3 - 2.5 * (mean + 80) / 30))
    std = F.sqrt(_mean(m, lambda x: F.pow(x["s"] - mean, 2)))
    geo = F.when(n == 1, 0.7).when(n == 2, 0.8).when(n == 3, 0.9).otherwise(1.0)
    conf = (
        0.25 * clamp((mean + 100) / 50, 0.0, 1.0)
        + 0.20 * F.exp(-_mean(m, lambda x: x["d"]) / 30)
        + 0.10 * (1 - F.least(F.lit(1.0), F.abs(_mean(m, lambda x: x["n"]) - 3) / 2))
        + 0.20 * geo
        + 0.20 * (0.6 + 0.4 * _mean(m, lambda x: x["known"]))
        + 0.05 * (1 - 0.3 * F.least(F.lit(1.0), std / 20))
    )
    once = F.size(F.array_distinct(F.transform(aps, lambda a: a["mac_addr"]))) == F.size(aps)
    return F.when(once, _position(F.try_divide(_sum(m, lambda x: x["w"] * x["lat"]), total), F.try_divide(_sum(m, lambda x: x["w"] * x["lon"]), total), alt, acc, clamp(conf, 0.6, 0.95)))


def trilateration(req: DataFrame) -> DataFrame:
    """A-05: adds ``trilateration``. Distances are linearised against the first scan and solved by normal equations; a singular system falls back to the weighted centre. The dilution is taken over metres as if they were degrees, on purpose."""
    aps = F.col("aps")
    top = F.array_max(F.transform(aps, lambda a: F.struct(a["s"].alias("s"), (-a["pos"]).alias("o"), a["lat"].alias("lat"), a["lon"].alias("lon"))))
    req = settled(req.withColumn("_o", top))
    scale = 111_000.0

    def local(a: Column) -> Column:
        ref = -20 * F.log10(F.lit(4 * np.pi) * a["f"] * 1e6 / LIGHT)
        n = F.when(a["s"] >= -65, 2.5).otherwise(3.0)
        d = clamp(F.pow(F.lit(10.0), (ref - a["s"]) / (10 * n)), 1.0, 100.0)
        x = (a["lon"] - F.col("_o.lon")) * scale * F.cos(F.radians(F.col("_o.lat")))
        return F.struct(x.alias("x"), ((a["lat"] - F.col("_o.lat")) * scale).alias("y"), d.alias("d"), a["s"].alias("s"), a["alt"].alias("alt"))

    req = settled(settled(req.withColumn("_t", F.transform(aps, local))).withColumn("_p", F.get("_t", F.lit(0))))
    p = F.col("_p")
    rows = F.transform(
        F.slice("_t", 2, 1000),
        lambda q: F.struct((2 * (q["x"] - p["x"])).alias("a"), (2 * (q["y"] - p["y"])).alias("b"), (q["x"] * q["x"] + q["y"] * q["y"] - p["x"] * p["x"] - p["y"] * p["y"] + p["d"] * p["d"] - q["d"] * q["d"]).alias("c")),
    )
    req = settled(req.withColumn("_r", rows))
    r = F.col("_r")
    saa, sbb, sab = _sum(r, lambda q: q["a"] * q["a"]), _sum(r, lambda q: q["b"] * q["b"]), _sum(r, lambda q: q["a"] * q["b"])
    sac, sbc = _sum(r, lambda q: q["a"] * q["c"]), _sum(r, lambda q: q["b"] * q["c"])
    req = settled(req.withColumns({"_saa": saa, "_sbb": sbb, "_sab": sab, "_sac": sac, "_sbc": sbc}))
    det = F.col("_saa") * F.col("_sbb") - F.col("_sab") * F.col("_sab")
    w = lambda q: F.pow(F.lit(10.0), q["s"] / 20)
    t = F.col("_t")
    centre = lambda c: F.try_divide(_sum(t, lambda q: w(q) * q[c]), _sum(t, w))
    x = F.when(det == 0, centre("x")).otherwise((F.col("_sac") * F.col("_sbb") - F.col("_sbc") * F.col("_sab")) / F.nullif(det, F.lit(0.0)))
    y = F.when(det == 0, centre("y")).otherwise((F.col("_sbc") * F.col("_saa") - F.col("_sac") * F.col("_sab")) / F.nullif(det, F.lit(0.0)))
    req = settled(req.withColumn("_x", x).withColumn("_y", y))
    units = F.transform(t, lambda q: _unit(q["y"], q["x"], F.col("_y"), F.col("_x")))
    req = req.withColumn("_g", let(let(units, gdop_plain), gdop_factor)).withColumn("_m", _mean(t, lambda q: q["s"]))
    req = settled(req)
    g, mean, n = F.col("_g"), F.col("_m"), F.size(t)
    lat = clamp(F.col("_o.lat") + F.col("_y") / scale, -90.0, 90.0)
    lon = clamp(F.col("_o.lon") + F.col("_x") / (scale * F.cos(F.radians(F.col("_o.lat")))), -180.0, 180.0)
    tall = F.filter(t, lambda q: q["alt"].isNotNull())
    alt = F.when(F.size(tall) > 0, _sum(tall, lambda q: q["alt"] / q["d"]) / _sum(tall, lambda q: 1 / q["d"])).otherwise(0.0)
    acc = F.when(mean >= -65, clamp(3 * (1 + 0.5 * (g - 1)), 1.0, 5.0)).otherwise(clamp(F.least(0.3 * _mean(t, lambda q: q["d"]), F.lit(50.0)) * g, 1.0, 50.0))
    sf = F.when(mean >= -65, clamp((mean + 80) / 15, 0.0, 1.0)).otherwise(clamp((mean + 100) / 20, 0.0, 1.0))
    conf = (0.55 + 0.30 * (0.7 * sf + 0.3 * clamp((n - 3) / 5, 0.0, 1.0))) * (1 - 0.3 * (1 - 1 / F.greatest(F.lit(1.0), g)))
    conf = F.when(mean >= -65, clamp(conf, 0.8, 0.85)).when(mean < -80, F.least(conf, F.lit(0.58))).otherwise(conf)
    found = F.when(n >= 3, _position(lat, lon, alt, acc, clamp(conf, 0.55, 0.85)))
    return req.withColumn("trilateration", found).drop("_o", "_t", "_p", "_r", "_saa", "_sbb", "_sab", "_sac", "_sbc", "_x", "_y", "_g", "_m").transform(settled)


def _likelihood(s: np.ndarray, f: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """A-06 for requests of as many scans each, a row per request: gradient steps in degrees and metres from the loudness-weighted centre. NaN if there is none."""
    n, known = s.shape[1], ~np.isnan(conf).any(1)
    found = np.full((len(s), 5), np.nan)
    if not n or not known.any():
        return found
    s, f, lat, lon, alt, conf = (x[known] for x in (s, f, lat, lon, alt, conf))
    dot = lambda a, b: np.matmul(a[:, None, :], b[:, :, None])[:, 0, 0]
    w = 10 ** (s / 10)
    has = ~np.isnan(alt)
    z, loud = np.where(has, alt, 0.0), np.where(has, w, 0.0)
    mean = s.mean(1)
    sigma = np.where(s >= -60, 2.5, np.where(s >= -80, 4.0, 6.0))
    loss = -20 * np.log10(4 * np.pi * f * 1e6 / LIGHT)
    b = np.radians(lat)
    scans = (s, lat, lon, z, conf, sigma**2, loss, b, np.cos(b))
    k = EARTH_M * np.pi / 180

    def reached(p: np.ndarray, scans: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances from ``p``, the errors of the signals there, and the likelihood."""
        s, lat, lon, z, conf, square, loss, b, cos = scans
        a = np.radians(p[:, :1])
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * cos * np.sin(np.radians(lon - p[:, 1:2]) / 2) ** 2
        flat = 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        d = np.sqrt(flat**2 + (z - p[:, 2:]) ** 2)
        e = s - (loss - 30 * np.log10(d))
        return d, e, (-(e**2) / (2 * square) * conf).sum(1)

    with np.errstate(all="ignore"):
        at = np.stack([dot(w, lat) / w.sum(1), dot(w, lon) / w.sum(1), np.where(has.any(1), dot(loud, z) / loud.sum(1), 0.0)], 1)
        north, east, up = (at[:, :1] - lat) * k, (at[:, 1:2] - lon) * k * np.cos(np.radians(at[:, :1])), at[:, 2:] - z
        d = np.sqrt(north**2 + east**2 + up**2)
        h = np.where((d < 1)[:, :, None], np.array([1.0, 0.0, 0.0]), np.stack([north, east, up], 2) / np.maximum(d, 1e-300)[:, :, None])
        h = np.concatenate([h, np.ones((*s.shape, 1))], 2)
        gdop = np.full(len(s), 30.0)
        if n >= 4:
            normal = h.transpose(0, 2, 1) @ h
            firm = np.abs(np.linalg.det(normal)) >= 1e-10
            gdop[firm] = np.fmin(30.0, np.sqrt(np.fmax(0.0, np.trace(np.linalg.inv(normal[firm]), axis1=1, axis2=2))))
        g = np.where(gdop <= 2, 1.0, np.where(gdop <= 4, 1 + 0.25 * (gdop - 2), np.where(gdop <= 6, 1.5 + 0.25 * (gdop - 4), np.fmin(4.0, 2 + (gdop - 6) / 2))))
        out = np.zeros(len(s), bool)
        rate, live = np.ones(len(s)), np.arange(len(s))
        d, e, best = reached(at, scans)
        for _ in range(100):  # those that still move
            if not len(live):
                break
            p, (_, lat, lon, z, conf, square, *_) = at[live], scans
            pull = e / (square * d) * conf
            step = p + rate[live][:, None] * np.stack([(pull * (to - p[:, c : c + 1])).sum(1) for c, to in enumerate((lat, lon, z))], 1)
            out[live] = ~((np.abs(step[:, 0]) <= 90) & (np.abs(step[:, 1]) <= 180))
            d_next, e_next, got = reached(step, scans)
            better = (got > best[live]) & ~out[live]
            at[live[better]], best[live[better]] = step[better], got[better]
            d, e = np.where(better[:, None], d_next, d), np.where(better[:, None], e_next, e)
            rate[live[~better]] /= 2
            stay = ~out[live] & (rate[live] >= 0.1)
            if not stay.all():
                live, d, e, scans = live[stay], d[stay], e[stay], tuple(x[stay] for x in scans)
        strong = mean >= -60
        base = np.where(strong, 3.0, 6 + np.abs(mean + 70) * 0.2)
        acc = np.fmax(1.0, np.fmin(25.0, np.where(strong, base * (1 + 0.5 * (g - 1)), base * g)))
        acc = np.where(strong, np.fmax(1.0, np.fmin(5.0, acc * (1 + 0.5 * (g - 1)))), np.fmin(25.0, acc * g))
        sf = np.fmin(1.0, np.fmax(0.0, np.where(strong, (mean + 80) / 20, (mean + 100) / 20)))
        af = min(1.0, max(0.0, (n - 2) / 6))
        lf = np.where(np.isfinite(best), np.fmin(1.0, np.fmax(0.0, (np.exp(best / n) - 0.1) / 0.8)), 0.7)
        low, high, wa, wl = (np.where(strong, x, np.where(mean >= -80, y, v)) for x, y, v in zip((0.8, 0.95, 0.3, 0.1), (0.65, 0.8, 0.25, 0.15), (0.6, 0.65, 0.2, 0.1)))
        sure = (low + (high - low) * (0.7 * sf + wa * af + wl * lf)) * (1 - 0.3 * (1 - 1 / np.fmax(1.0, g)))
        sure = np.where(strong, np.fmax(0.8, np.fmin(0.95, sure)), np.where(mean < -80, np.fmin(0.65, sure), sure))
    found[known] = np.where(out[:, None], np.nan, np.concatenate([at, acc[:, None], sure[:, None]], 1))
    return found


def _likelihoods(columns: list[pa.Array]) -> pa.Array:
    """A-06 for the requests of a batch, those of as many scans at once; ``columns``: s, f, lat, lon, alt and conf of their scans."""
    size = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
    found = np.full((len(size), 5), np.nan)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        at = begin[rows][:, None] + np.arange(n)
        found[rows] = _likelihood(*(x[at] for x in flat))
    names = ["latitude", "longitude", "altitude", "accuracy", "confidence"]
    return pa.StructArray.from_arrays([pa.array(found[:, k].copy(), from_pandas=True) for k in range(5)], names)


@F.arrow_udf(_POSITION)
def _maximum_likelihood(s: pa.Array, f: pa.Array, lat: pa.Array, lon: pa.Array, alt: pa.Array, conf: pa.Array) -> pa.Array:
    return _likelihoods([s, f, lat, lon, alt, conf])


def maximum_likelihood(aps: Column) -> Column:
    """A-06: null when it runs out of range or an access point has no confidence."""
    p = _maximum_likelihood(*(aps[c].cast("array<double>") for c in ("s", "f", "lat", "lon", "alt", "conf")))
    return F.when(p["latitude"].isNotNull(), p)


def combine(est: Column) -> Column:
    """A-07 over an array of (weight, position): null if it is empty."""
    n = F.size(est)

    def means(total: Column) -> Column:
        def field(c: str) -> Column:
            return _sum(est, lambda e: F.try_divide(e["weight"], total) * e["position"][c]).alias(c)

        return F.struct(total.alias("total"), field("latitude"), field("longitude"), field("altitude"), field("confidence"))

    def shape(p: Column) -> Column:
        dy, dx = (lambda e: e["position"]["latitude"] - p["latitude"]), (lambda e: e["position"]["longitude"] - p["longitude"])
        kappa = let(
            F.struct(_mean(est, lambda e: dy(e) * dy(e)).alias("yy"), _mean(est, lambda e: dx(e) * dx(e)).alias("xx"), _mean(est, lambda e: dx(e) * dy(e)).alias("xy")),
            lambda v: condition_number(v["yy"], v["xx"], v["xy"]),
        )
        line = let(F.transform(est, lambda e: F.struct(e["position"]["latitude"].alias("lat"), e["position"]["longitude"].alias("lon"))), collinear)
        both = F.struct(line.alias("line"), kappa.alias("kappa"))
        return let(both, lambda v: F.struct(v["line"].alias("line"), v["kappa"].alias("kappa"), geometry_factor(v["line"], v["kappa"]).alias("q")))

    def mid(a: Column) -> Column:
        return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2

    def robust(accs: Column) -> Column:
        cut = F.floor(n * 0.25).cast("int")
        inner = F.slice(accs, cut + 1, F.greatest(n - 2 * cut, F.lit(1)))

        def about(median: Column) -> Column:
            trimmed = F.when(n <= 2, median).otherwise(_mean(inner, lambda a: a))
            base = F.when(n <= 3, median).otherwise(0.7 * median + 0.3 * trimmed)
            mad = let(F.sort_array(F.transform(accs, lambda a: F.abs(a - median))), mid)
            out = let(mad, lambda m: F.size(F.filter(accs, lambda a: a > median + 2 * m)) / n)
            return base * let(out, lambda o: F.when(o > 0, 1 + 0.5 * o).otherwise(1.0))

        return let(mid(accs), about)

    def joint(p: Column, g: Column, r: Column) -> Column:
        acc = F.when(g["line"], F.greatest(F.lit(6.0), r * F.greatest(g["q"], F.sqrt(g["kappa"] / 10)))).otherwise(F.greatest(r, r * g["q"]))
        conf = F.when(g["line"], F.least(F.lit(0.69), p["confidence"] / (1.2 * g["q"]))).otherwise(p["confidence"] / F.sqrt(g["q"]))
        return F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), p["altitude"].alias("altitude"), acc.alias("accuracy"), conf.alias("confidence"))

    def whole(p: Column) -> Column:
        found = let(shape(p), lambda g: let(let(F.sort_array(F.transform(est, lambda e: e["position"]["accuracy"])), robust), lambda r: joint(p, g, r)))
        return F.when((n == 1) | (p["total"] == 0), F.get(est, F.lit(0))["position"]).otherwise(found)

    return F.when(n > 0, let(let(_sum(est, lambda e: e["weight"]), means), whole))


def with_estimates(req: DataFrame, likelihood: bool = True) -> DataFrame:
    """P-19: adds a position of each algorithm, and ``estimates`` of the selected that gave one, weighed by their own confidence."""
    aps = F.col("aps")
    chosen = lambda n: F.exists("selected", lambda c: c["algorithm"] == n)
    if likelihood:
        # only where it was selected does the array go to Python; null otherwise
        req = req.withColumn("maximum_likelihood", maximum_likelihood(F.when(chosen("MAXIMUM_LIKELIHOOD"), aps).otherwise(F.slice(aps, 1, 0))))
    else:
        req = req.withColumn("maximum_likelihood", F.lit(None).cast(_POSITION))
    req = trilateration(req)
    req = req.withColumns({"proximity": proximity(aps), "weighted_centroid": weighted_centroid(aps), "rssi_ratio": rssi_ratio(aps), "log_distance": log_distance(aps)})
    req = settled(req)
    mine = [F.struct(F.col("selected"), F.lit(n).alias("name"), (F.lit(WEIGHTS[n][4])).alias("base"), F.col(n.lower()).cast(_POSITION).alias("position")) for n in ALGORITHMS]
    each = F.transform(F.array(*mine), lambda m: F.struct((F.get(F.filter(m["selected"], lambda c: c["algorithm"] == m["name"]), F.lit(0))["weight"] * m["base"]).alias("weight"), m["name"].alias("name"), m["position"].alias("position")))
    return settled(req.withColumn("estimates", F.filter(each, lambda e: e["weight"].isNotNull() & e["position"].isNotNull())))


def positions(scans: DataFrame, registry: DataFrame, likelihood: bool = True) -> DataFrame:
    """P-03, P-21: one row per request of ``scans`` (request_id, pos, mac_addr, rssi, frequency).

    The registry keeps every status; access points of no valid status are known but do not position.
    """
    from skylocus.sources.registry import VALID, known_scans

    known = known_scans(scans, registry, "left")
    keep = ["n_scans", "n_known"]
    counted = known.withColumn("_valid", F.col("status").isin(*VALID))
    one = F.struct("pos", "mac_addr", F.col("rssi").cast("double").alias("s"), F.col("frequency").cast("double").alias("f"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("altitude").alias("alt"), F.col("horizontal_accuracy").alias("hacc"), F.col("confidence").alias("conf"), F.lower("vendor").alias("vendor"), F.col("_valid").alias("valid"))
    counted = counted.withColumn("_faults", scan_faults(scans.columns))
    few = F.when(F.col("pos") <= MOST_SCANS, one)  # requests of more are not valid; their scans are counted, not gathered
    req = counted.groupBy("request_id").agg(F.sort_array(F.collect_list(few)).alias("raw"), F.collect_set("_faults").alias("_all"), F.count("*").alias("n_scans"), F.count("status").alias("n_known"))
    req = req.withColumn("faults", fault_text(F.col("_all"), F.col("n_scans"))).drop("_all")
    req = req.withColumn("raw", F.when(F.col("faults").isNull(), F.col("raw")).otherwise(F.slice("raw", 1, 0)))
    req = req.withColumn("physics", physics_ok(F.col("raw"))).withColumn("aps", F.filter("raw", lambda a: F.coalesce(a["valid"], F.lit(False)))).drop("raw")
    req = req.withColumn("physics_known", physics_ok(F.col("aps")))  # P-02 holds once more for the scans that position
    req = with_selection(with_context(req))
    req = settled(with_estimates(req, likelihood).withColumn("position", combine(F.col("estimates"))))
    methods = method_names(F.col("selected"))
    error = (
        F.when(F.col("faults").isNotNull(), F.col("faults"))
        .when(~F.col("physics"), "physically impossible signals")
        .when(F.col("n_known") == 0, "no known access points found in database")
        .when(F.size("aps") == 0, "no access points with valid status found")
        .when(~F.col("physics_known") | F.col("position").isNull(), "position calculation failed")
    )
    req = settled(req.withColumn("error", error))
    fine = F.col("error").isNull()
    return req.select(
        "request_id", F.when(fine, "SUCCESS").otherwise("ERROR").alias("result"), "error", *keep, "n_aps", "signal", "distribution", "geometry",
        *[F.when(fine, F.col(f"position.{c}")).alias(c) for c in ("latitude", "longitude", "altitude", "accuracy", "confidence")],
        F.lit(0.0).alias("vertical_accuracy"), F.when(fine, methods).alias("methods"), "selected", "candidates", "aps",
    )
