from pyspark.sql import functions as F
from skylocus.operators import positioning as op


def scans(spark, rows):
    return spark.createDataFrame(rows, "request_id long, pos int, mac_addr string, rssi double, frequency int, channel_width int, client string")


def test_faults_of_requests(spark):
    good = "aa:bb:cc:dd:ee:ff"
    rows = [(1, 1, good, -60.0, 2412, 20, "c"), (2, 1, " ", -101.0, 2399, 10, ""), (2, 2, "aa:bb", 1.0, 6001, 161, "x" * 51), (3, 1, None, None, None, None, None)]
    rows += [(4, i + 1, good, -60.0, 2412, 20, "c") for i in range(21)] + [(5, i + 1, good, -60.0, 2412, 20, "c") for i in range(20)]
    got = {r.request_id: (r.n_scans, r.faults) for r in op.request_faults(scans(spark, rows)).collect()}
    assert got[1] == (1, None) and got[5] == (20, None)
    assert got[4] == (21, "Between 1 and 20 WiFi scan results must be provided")
    assert got[2][1].split("; ") == sorted([
        "MAC address is required", "Invalid MAC address format", "Signal strength must be at least -100 dBm", "Signal strength must be at most 0 dBm", "Frequency must be at least 2400 MHz",
        "Frequency must be at most 6000 MHz", "Channel width must be at least 20 MHz", "Channel width must be at most 160 MHz", "Client is required", "Client must be at most 50 characters",
    ])
    assert got[3][1] == "Client is required; Frequency cannot be null; MAC address is required; Signal strength cannot be null"
    assert op.request_faults(scans(spark, [])).count() == 0


def test_positions_answer_faults_and_second_physics(spark):
    macs = [f"00:00:00:00:00:{i:02x}" for i in range(30)]
    registry = spark.createDataFrame([(m, 37.0 + i / 1e4, -122.0, 5.0, 10.0, 0.9, "cisco", "error" if i == 2 else "active") for i, m in enumerate(macs)], "mac_addr string, latitude double, longitude double, altitude double, horizontal_accuracy double, confidence double, vendor string, status string")
    rows = [(1, i, m, -60.0, 2412, 20, "c") for i, m in enumerate(macs[:22])]
    rows += [(2, 0, macs[0], -30.0, 2412, 20, "c"), (2, 1, macs[1], -80.0, 2412, 20, "c"), (2, 2, macs[2], -100.0, 2412, 20, "c")]  # possible only with the one that does not position
    rows += [(3, 0, macs[0], -60.0, 2412, 20, "c")]
    got = {r.request_id: (r.result, r.error, r.n_scans, r.methods) for r in op.positions(scans(spark, rows), registry).collect()}
    assert got[1] == ("ERROR", "Between 1 and 20 WiFi scan results must be provided", 22, None)
    assert got[2][:2] == ("ERROR", "position calculation failed")
    assert got[3] == ("SUCCESS", None, 1, "proximity")
    assert op.positions(scans(spark, rows).where(F.lit(False)), registry).count() == 0


def test_method_names(spark):
    chosen = F.array(*[F.struct(F.lit(n).alias("algorithm")) for n in ("RSSI_RATIO", "LOG_DISTANCE", "PROXIMITY")])
    assert spark.range(1).select(op.method_names(chosen).alias("m")).first().m == "log_distance_path_loss,proximity,rssiratio"
