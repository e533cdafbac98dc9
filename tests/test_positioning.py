import math
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skylocus.operators import positioning as op

EST = "id int, other string, estimates array<struct<weight: double, name: string, position: struct<latitude: double, longitude: double, altitude: double, accuracy: double, confidence: double>>>"


def estimates(*rows):
    return [(w, "x", (lat, lon, 1.0, acc, conf)) for w, lat, lon, acc, conf in rows]


def test_settled_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, []), (2, "b", estimates((1.0, 0.0, 0.0, 5.0, 0.5)))], EST)
    out = op.settled(df)
    assert out.schema == df.schema and sorted(out.collect()) == sorted(df.collect())


def test_let_evaluates_on_any_value(spark):
    got = spark.range(3).select(op.let(F.col("id") * 2, lambda v: v + v).alias("x")).collect()
    assert [r.x for r in got] == [0, 4, 8]


def test_combine_of_none_is_null_and_of_one_is_that_one(spark):
    one = estimates((0.3, 10.0, 20.0, 5.0, 0.5))
    df = spark.createDataFrame([(1, "", []), (2, "", one), (3, "", estimates((0.0, 1.0, 2.0, 5.0, 0.5), (0.0, 3.0, 4.0, 6.0, 0.6)))], EST)
    got = {r.id: r.p for r in df.select("id", op.combine(F.col("estimates")).alias("p")).collect()}
    assert got[1] is None and tuple(got[2]) == one[0][2] and got[3].latitude == 1.0


def test_combine_weighs_positions_and_takes_the_median_accuracy(spark):
    est = estimates((1.0, 10.0, 20.0, 4.0, 0.8), (3.0, 10.2, 20.1, 6.0, 0.4), (1.0, 10.1, 20.3, 50.0, 0.6))
    p = spark.createDataFrame([(1, "", est)], EST).select(op.combine(F.col("estimates")).alias("p")).first().p
    assert p.latitude == pytest.approx((10.0 + 30.6 + 10.1) / 5) and p.longitude == pytest.approx((20.0 + 60.3 + 20.3) / 5)
    median = statistics.median([4.0, 6.0, 50.0])
    assert p.accuracy >= median * (1 + 0.5 / 3) - 1e-9  # one of three lies over two deviations out
    assert 0 < p.confidence <= (0.8 + 1.2 + 0.6) / 5 + 1e-9


def scan(pos, s, lat, lon):
    return {"pos": pos, "mac_addr": f"m{pos}", "s": s, "f": 2437.0, "lat": lat, "lon": lon, "alt": None, "hacc": 10.0, "conf": 0.9, "vendor": "x"}


APS = "id int, aps array<struct<pos: int, mac_addr: string, s: double, f: double, lat: double, lon: double, alt: double, hacc: double, conf: double, vendor: string>>"


def test_selection_and_estimates_survive_requests_without_access_points(spark):
    near = [scan(0, -60.0, 37.7, -122.4), scan(1, -65.0, 37.7003, -122.4), scan(2, -70.0, 37.7, -122.4004)]
    df = spark.createDataFrame([(1, []), (2, near[:1]), (3, near)], APS)
    out = op.with_estimates(op.with_selection(op.with_context(df)), likelihood=False)
    got = {r.id: r for r in out.select("id", "proximity", "trilateration", "selected", "estimates").collect()}
    assert got[1].estimates == [] and got[2].proximity.latitude == 37.7 and got[2].trilateration is None
    weights = [c.weight for c in got[3].selected]
    assert weights == sorted(weights, reverse=True) and 1 <= len(weights) <= 3
    assert all(math.isfinite(e.position.latitude) for e in got[3].estimates)
    assert abs(got[3].trilateration.latitude - 37.7) < 0.01


def test_reasons_of_the_recorded_request_of_two_access_points(spark):
    ctx = [(2, "MEDIUM", "POOR", "UNIFORM"), (1, "STRONG", "POOR", "UNIFORM"), (4, "STRONG", "COLLINEAR", "MIXED"), (3, "VERY_WEAK", "GOOD", "MIXED")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(ctx)], "id int, n_aps int, signal string, geometry string, distribution string")
    got = {r.id: {x.algorithm: (x.chosen, x.reasons) for x in r.reasons} for r in op.with_reasons(op.with_selection(df)).collect()}
    numbers = ". Weight Calculation: Weight={}: base({}) × signal({}) × geometric({}) × distribution({})"
    assert got[0] == {
        "WEIGHTED_CENTROID": (True, ["Valid for two APs", "SELECTED" + numbers.format("1.04", "0.80", "1.00", "1.30", "1.00")]),
        "RSSI_RATIO": (True, ["Valid for two APs", "SELECTED" + numbers.format("0.86", "1.00", "0.90", "0.80", "1.20")]),
        "TRILATERATION": (False, ["DISQUALIFIED (requires at least 3 APs)", "DISQUALIFIED (poor geometry)"]),
        "MAXIMUM_LIKELIHOOD": (False, ["DISQUALIFIED (requires at least 4 APS)", "DISQUALIFIED (poor geometry)"]),
        "PROXIMITY": (False, ["Valid for two APs", "DISQUALIFIED  (below threshold 0.40) " + numbers.format("0.28", "0.40", "0.70", "1.00", "1.00")]),
        "LOG_DISTANCE": (False, ["Valid for two APs", "DISQUALIFIED  (below threshold 0.40) " + numbers.format("0.31", "0.50", "0.80", "0.70", "1.10")]),
    }
    assert got[1]["RSSI_RATIO"][1] == ["DISQUALIFIED (insufficient APs)", "DISQUALIFIED (poor geometry)"]
    assert got[1]["LOG_DISTANCE"][1][0] == "Valid for single AP with path loss model"
    assert got[2]["TRILATERATION"][1] == ["Valid for 4+ APs", "DISQUALIFIED (collinear APs)"]
    assert sum(chosen for chosen, _ in got[2].values()) == 2 and any("(not in top 2 High Confidence)" in said[-1] for _, said in got[2].values())
    assert got[3]["PROXIMITY"][1][0] == "Only viable algorithm for extremely weak signals" and got[3]["LOG_DISTANCE"] == (False, ["DISQUALIFIED (signal too weak)"])


def climbed(own):
    """A-06 by the book: the position of one request, climbed step by step in plain numbers, or None."""
    if not own or any(a["conf"] is None for a in own):
        return None
    w = [10 ** (a["s"] / 10) for a in own]
    tall = [(x, a["alt"]) for x, a in zip(w, own) if a["alt"] is not None]
    at = [sum(x * a[c] for x, a in zip(w, own)) / sum(w) for c in ("lat", "lon")]
    at.append(sum(x * y for x, y in tall) / sum(x for x, _ in tall) if tall else 0.0)
    z = [a["alt"] or 0.0 for a in own]
    square = [(2.5 if a["s"] >= -60 else 4.0 if a["s"] >= -80 else 6.0) ** 2 for a in own]

    def terms(p):
        out = []
        for a, tz in zip(own, z):
            x, y = math.radians(p[0]), math.radians(a["lat"])
            h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(a["lon"] - p[1]) / 2) ** 2
            d = math.hypot(2 * op.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h)), tz - p[2])
            out.append((d, a["s"] + 20 * math.log10(4 * math.pi * a["f"] * 1e6 / op.LIGHT) + 30 * (math.log10(d) if d else -math.inf)))
        return out, sum(-(e**2) / (2 * q) * a["conf"] for (_, e), q, a in zip(out, square, own))

    rate, (now, best) = 1.0, terms(at)
    for _ in range(100):
        if not all(d for d, _ in now):  # on an access point: no way to go
            return None
        pull = [e / (q * d) * a["conf"] for (d, e), q, a in zip(now, square, own)]
        step = [at[c] + rate * sum(g * (to - at[c]) for g, to in zip(pull, goal)) for c, goal in enumerate(([a["lat"] for a in own], [a["lon"] for a in own], z))]
        if not (abs(step[0]) <= 90 and abs(step[1]) <= 180):
            return None
        then, got = terms(step)
        if got > best:
            at, now, best = step, then, got
        else:
            rate /= 2
            if rate < 0.1:
                break
    return at


def test_likelihood_of_many_requests_is_climbed_at_once(spark, monkeypatch):
    rng, rows = random.Random(6), [(0, None), (1, [])]
    for i in range(2, 400):
        own = [scan(k, -30 - 1.4 * rng.randrange(1, 51), 37.7 + rng.random() / 200, -122.4 + rng.random() / 200) for k in range(rng.randrange(1, 9))]
        own = [a | {"f": rng.choice([2412.0, 5180.0]), "alt": rng.choice([None, 12.5, 20.0]), "conf": rng.choice([0.4, 0.9, 0.9, 0.9])} for a in own]
        if i % 50 == 0:
            own[-1]["conf"] = None
        if i % 60 == 0:
            own = [a | {"lat": 89.9, "s": -30.0} if k % 2 else a | {"lat": -89.9, "lon": 179.9} for k, a in enumerate(own)]
        rows.append((i, own))
    got = {r.id: r.p for r in spark.createDataFrame(rows, APS).select("id", op.maximum_likelihood(F.col("aps")).alias("p")).collect()}
    want = {i: climbed(own) for i, own in rows}
    assert {i for i in want if want[i] is None} == {i for i in got if got[i] is None} and len(got) == len(rows)
    for i, p in got.items():
        if p is not None:
            assert (p.latitude, p.longitude, p.altitude) == pytest.approx(tuple(want[i]), abs=1e-6), i
            assert 1 <= p.accuracy <= 25 and 0 < p.confidence <= 0.95

    calls, one = [], op._likelihood
    monkeypatch.setattr(op, "_likelihood", lambda *c: calls.append(len(c[0])) or one(*c))
    columns = [pa.array([own and [a[c] for a in own] for _, own in rows], pa.list_(pa.float64())) for c in ("s", "f", "lat", "lon", "alt", "conf")]
    found = op._likelihoods(columns).to_pylist()
    assert len(calls) == len({len(own) for _, own in rows if own}) and sum(calls) == 398
    assert [x["latitude"] for x in found] == [got[i] and got[i].latitude for i, _ in rows]
