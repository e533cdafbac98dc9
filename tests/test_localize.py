import random

from skylocus.operators import localize as op

SCHEMA = "bssid string, event_id string, latitude double, longitude double, rssi int, connection_status string, quality_weight double"


def rows(n=150):
    rng = random.Random(4)
    out = []
    for b, count in (("hot", n), ("cool", 20), (None, 12)):
        for i in range(count):
            far = i < 12  # a tight cluster away from the rest
            lat, lon = (48.01 + rng.random() * 1e-5, 11.01) if far else (48 + rng.random() * 1e-3, 11 + rng.random() * 1e-3)
            out.append((b, f"{b}{i}", lat, lon, -40 - rng.randrange(50), rng.choice(["CONNECTED", "SCAN"]), rng.choice([1.0, 2.0])))
    return out


def test_blocks_do_not_change_outlier_factors(spark, monkeypatch):
    m = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = {r.event_id: r.lof for r in op.local_outlier_factor(m).collect()}
    monkeypatch.setattr(op, "BLOCK_ROWS", 40)
    got = {r.event_id: r.lof for r in op.local_outlier_factor(m).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) <= 1e-6 * want[e] for e in want)


def test_blocks_do_not_change_estimates(spark, monkeypatch):
    m = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = {r.bssid: r for r in op.estimate(m, rounds=12).collect()}
    monkeypatch.setattr(op, "BLOCK_ROWS", 40)
    got = {r.bssid: r for r in op.estimate(m, rounds=12).collect()}
    assert got.keys() == want.keys()
    for b, r in want.items():
        assert got[b].n == r.n and abs(got[b].latitude - r.latitude) < 1e-7 and abs(got[b].longitude - r.longitude) < 1e-7


def test_neighbours_are_counted_without_holding_them(spark, monkeypatch):
    """Both ways of counting equal the sets; no row holds the neighbours of an access point."""
    rng = random.Random(7)
    made = [(rng.choice([*"abcdefghij", None]), rng.choice([*(f"t{i}" for i in range(25)), None]), rng.randrange(1000)) for _ in range(160)] + [("x", "y1", 1), ("x", "y2", 2)]
    m = spark.createDataFrame(made, "bssid string, processing_batch_id string, measurement_timestamp long").repartition(3)
    seen, first = {}, {}
    for b, batch, ts in made:
        if b and batch:
            seen.setdefault(batch, set()).add(b)
            first[b, batch] = min(ts, first.get((b, batch), ts))
    want = {}
    for b in {b for b, _ in first}:
        order = [batch for _, batch in sorted((ts, batch) for (o, batch), ts in first.items() if o == b)]
        pairs = [(seen[x] - {b}, seen[y] - {b}) for x, y in zip(order, order[1:])]
        if pairs:
            want[b] = (len(pairs), sum(len(x & y) / len(x | y) if x | y else 1.0 for x, y in pairs) / len(pairs))
    for cost in (0, 10**6):
        monkeypatch.setattr(op, "PAIRS_A_MEMBER", cost, raising=False)
        out = op.neighbour_stability(m)
        got = {r.bssid: (r.n, r.stability) for r in out.collect()}
        assert got.keys() == want.keys() and all(got[b][0] == n and abs(got[b][1] - j) < 1e-6 for b, (n, j) in want.items())
        assert "array_intersect" not in out._jdf.queryExecution().toString()
