"""Access-point localization from measurements (L-01 to L-10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylocus.functions.wifi import clamp, haversine_m
from skylocus.recovery import cut

#: Rows of one access point that one task handles in the per-access-point numeric operators; a larger one is dealt over blocks, with the same result.
BLOCK_ROWS = 5_000
#: Pairs of batches of one access point that cost as much as one member of a batch sought in another, and pairs of batches that are broadcast.
PAIRS_A_MEMBER, BROADCAST_PAIRS = 8, 1_000_000


def maturity(n: Column, goodness: Column) -> Column:
    """L-01: ``goodness`` is the spread of bearings in [0, 1], our reading of the situation goodness."""
    return F.when(n < 20, "none").when(n < 50, "centroid").when(n >= 100, "bayesian").when(goodness >= 0.5, "likelihood").otherwise("centroid")


def centroid(m: DataFrame) -> DataFrame:
    """L-02: mean weighted by quality and loudness."""
    w = F.col("quality_weight") * F.pow(F.lit(10.0), F.col("rssi") / 10)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return m.groupBy("bssid").agg(F.count("*").alias("n"), mean("latitude").alias("latitude"), mean("longitude").alias("longitude"))


def outliers(m: DataFrame, times: float = 3.0) -> DataFrame:
    """L-03: distance to the access point's centroid against the median distance plus ``times`` its median deviation. Adds distance, threshold and is_outlier."""
    centre = m.groupBy("bssid").agg(F.avg("latitude").alias("_lat"), F.avg("longitude").alias("_lon"))
    far = m.join(centre, "bssid").withColumn("distance", F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")), 6)).drop("_lat", "_lon")
    mid = far.groupBy("bssid").agg(F.median("distance").alias("_mid"))
    far = far.join(mid, "bssid").withColumn("_dev", F.abs(F.col("distance") - F.col("_mid")))
    mad = far.groupBy("bssid").agg(F.median("_dev").alias("_mad"))
    out = far.join(mad, "bssid").withColumn("threshold", F.round(F.col("_mid") + times * F.col("_mad"), 6))
    return out.withColumn("is_outlier", F.col("distance") > F.col("threshold")).drop("_mid", "_dev", "_mad")


def hotspot_spread(m: DataFrame, least: int = 5, metres: float = 200.0) -> DataFrame:
    """L-05: access points whose coordinates spread too far to stand still."""
    k = 111_320.0
    spread = F.sqrt(F.pow(F.coalesce(F.stddev("latitude"), F.lit(0.0)) * k, 2) + F.pow(F.coalesce(F.stddev("longitude"), F.lit(0.0)) * k * F.cos(F.radians(F.avg("latitude"))), 2))
    return m.groupBy("bssid").agg(F.count("*").alias("n"), F.round(spread, 3).alias("spread_m")).withColumn("mobile", (F.col("n") >= least) & (F.col("spread_m") > metres))


def neighbour_stability(m: DataFrame, batch: str = "processing_batch_id") -> DataFrame:
    """L-05: how alike the neighbours of an access point are from one scan batch to its next: mean Jaccard.

    The access point is in both batches, so the common neighbours are those common to the batches less itself: they
    are counted once for each two batches that follow each other somewhere, and no set of neighbours is ever held.
    """
    rows = _cut(m.groupBy("bssid", F.col(batch).alias("batch")).agg(F.min("measurement_timestamp").alias("ts")).where("bssid is not null and batch is not null"))
    steps = rows.withColumn("was", F.lag("batch").over(Window.partitionBy("bssid").orderBy("ts", "batch"))).where("was is not null")
    steps = _cut(steps.select("bssid", F.least("batch", "was").alias("x"), F.greatest("batch", "was").alias("y")))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("size"))
    size = lambda c: sizes.select(F.col("batch").alias(c), F.col("size").alias(f"size_{c}"))
    met = _cut(steps.select("x", "y").distinct().join(size("x"), "x").join(size("y"), "y"))
    own = rows.select("bssid", F.col("batch").alias("x"))
    by_batch = met.agg(F.sum("size_x"), F.count("*")).first()
    by_point = rows.groupBy("bssid").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0
    if by_point <= PAIRS_A_MEMBER * (by_batch[0] or 0):  # all pairs of batches of an access point: counted where they arise
        pairs = own.join(own.withColumnRenamed("x", "y"), "bssid").where("x < y")
        if by_batch[1] <= BROADCAST_PAIRS:
            pairs = pairs.join(F.broadcast(met.select("x", "y")), ["x", "y"], "left_semi")
    else:  # the members of a batch, sought in the other
        pairs = met.select("x", "y").join(own, "x").join(own.withColumnRenamed("x", "y"), ["bssid", "y"])
    common = F.col("common") - 1
    union = F.col("size_x") + F.col("size_y") - 2 - common
    alike = met.join(pairs.groupBy("x", "y").agg(F.count("*").alias("common")), ["x", "y"]).select("x", "y", F.when(union == 0, 1.0).otherwise(common / F.nullif(union, F.lit(0))).alias("j"))
    return steps.join(alike, ["x", "y"]).groupBy("bssid").agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("stability"))


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, "localize")


def _by_size(m: DataFrame, *sums: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of access points of up to ``BLOCK_ROWS`` rows, and of larger ones with their number ``_n`` and ``sums``."""
    of = m.groupBy(F.col("bssid").alias("_of")).agg(F.count("*").alias("_n"), *sums)
    rows = m.join(of, m.bssid.eqNullSafe(F.col("_of"))).drop("_of")
    return rows.where(F.col("_n") <= BLOCK_ROWS).select(*m.columns), rows.where(F.col("_n") > BLOCK_ROWS)


def local_outlier_factor(m: DataFrame, k: int = 10) -> DataFrame:
    """L-04: factor of each row among its access point's, by ``k`` nearest. The rows of a large one meet all others of it, block by block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon = pdf["latitude"].to_numpy(float), pdf["longitude"].to_numpy(float)
        xy = np.stack([lat * 111_320.0, lon * 111_320.0 * np.cos(np.radians(lat.mean()))], 1)
        n = len(xy)
        if n <= 2:
            return pd.DataFrame({"bssid": pdf["bssid"], "event_id": pdf["event_id"], "lof": np.ones(n)})
        q = min(k, n - 1)
        near, dist = np.empty((n, q), np.int64), np.empty((n, q))
        for i in range(0, n, 512):
            d = np.sqrt(((xy[i : i + 512, None, :] - xy[None]) ** 2).sum(2))
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            near[i : i + 512] = np.argsort(d, 1, kind="stable")[:, :q]
            dist[i : i + 512] = np.take_along_axis(d, near[i : i + 512], 1)
        reach = np.maximum(dist, dist[near, q - 1])
        density = 1 / np.maximum(reach.mean(1), 1e-9)
        return pd.DataFrame({"bssid": pdf["bssid"], "event_id": pdf["event_id"], "lof": density[near].mean(1) / density})

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, has = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        own, ids = asks["row"].to_numpy(), has["row"].to_numpy()
        a, b = asks[["x", "y"]].to_numpy(float), has[["x", "y"]].to_numpy(float)
        out = []
        for i in range(0, len(a), 256):
            d = np.sqrt(((a[i : i + 256, None, :] - b[None]) ** 2).sum(2))
            d[own[i : i + 256, None] == ids[None]] = np.inf
            at = np.argsort(d, 1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"row": np.repeat(own[i : i + 256], at.shape[1]), "near": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"row": own, "near": own, "d": own.astype(float)})

    kind = f"bssid string, event_id {m.schema['event_id'].dataType.simpleString()}, lof double"
    small, large = _by_size(m.select("bssid", "event_id", "latitude", "longitude"), F.avg("latitude").alias("_lat"))
    done = small.groupBy("bssid").applyInPandas(run, kind)
    if large.isEmpty():
        return done
    k_lat = F.lit(111_320.0)
    large = large.select(F.monotonically_increasing_id().alias("row"), "bssid", "event_id", "_n", (F.col("latitude") * k_lat).alias("x"), (F.col("longitude") * k_lat * F.cos(F.radians("_lat"))).alias("y"))
    rows = _cut(large.withColumn("_of", F.ceil(F.col("_n") / BLOCK_ROWS)).withColumn("_in", F.pmod(F.xxhash64("row"), F.col("_of"))))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))
    asks = rows.select("bssid", F.col("_in").alias("_ask"), each.alias("_has"), "row", "x", "y", F.lit(True).alias("asks"))
    has = rows.select("bssid", each.alias("_ask"), F.col("_in").alias("_has"), "row", "x", "y", F.lit(False).alias("asks"))
    met = asks.unionByName(has).groupBy("bssid", "_ask", "_has").applyInPandas(nearest, "row long, near long, d double").where("row <> near")
    near = _cut(met.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near"))), 1, k).alias("nn")))
    pairs = near.select("row", F.explode("nn").alias("p")).select("row", F.col("p.near").alias("near"), F.col("p.d").alias("d"))
    edge = near.select(F.col("row").alias("near"), F.element_at("nn", -1)["d"].alias("edge"))
    density = _cut(pairs.join(edge, "near").groupBy("row").agg((1 / F.greatest(F.avg(F.greatest("d", "edge")), F.lit(1e-9))).alias("density")))
    around = pairs.join(density.withColumnRenamed("row", "near"), "near").groupBy("row").agg(F.avg("density").alias("around"))
    lof = rows.join(density, "row").join(around, "row").select("bssid", "event_id", (F.col("around") / F.col("density")).alias("lof"))
    return done.unionByName(lof)


def relocation(m: DataFrame, drift: float = 0.5, limit: float = 5.0) -> DataFrame:
    """L-06: first time at which the two-sided cumulative sum of standardised positions passes ``limit``; all in window functions, S_t = X_t - min of X so far."""
    w = Window.partitionBy("bssid")
    order = w.orderBy("measurement_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = m.select("bssid", "event_id", "measurement_timestamp", "latitude", "longitude")
    for c in ("latitude", "longitude"):
        z = (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
        out = out.withColumn(f"_z{c}", F.coalesce(z, F.lit(0.0)))
    for c in ("latitude", "longitude"):
        for sign in (1, -1):
            out = out.withColumn("_x", F.sum(sign * F.col(f"_z{c}") - drift).over(order))
            out = out.withColumn(f"_s{c}{sign > 0}", F.col("_x") - F.least(F.lit(0.0), F.min("_x").over(order)))
    top = F.greatest(*[F.col(f"_s{c}{s}") for c in ("latitude", "longitude") for s in (True, False)])
    return out.groupBy("bssid").agg(F.count("*").alias("n"), F.round(F.max(top), 6).alias("max_cusum"), F.min(F.when(top > limit, F.col("measurement_timestamp"))).alias("moved_at"))


def since_relocation(m: DataFrame, moved: DataFrame) -> DataFrame:
    """L-06: rows from before a relocation no longer count."""
    return m.join(moved.select("bssid", "moved_at"), "bssid", "left").where(F.col("moved_at").isNull() | (F.col("measurement_timestamp") >= F.col("moved_at"))).drop("moved_at")


def smooth_rssi(m: DataFrame, process: float = 1.0, noise: float = 9.0) -> DataFrame:
    """L-07: Kalman filter of the signal in time order. Rows pass one task per access point as a stream; only the state is held. Loud and faint readings (soft classes) weigh the noise."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, p = object(), 0.0, 0.0
        for frame in frames:
            out = []
            for b, s in zip(frame["bssid"].to_numpy(), frame["rssi"].to_numpy(float)):
                r = noise * (1 + 1 / (1 + np.exp((s + 75) / 5)))
                if b != key:
                    key, x, p = b, s, r
                else:
                    p += process
                    g = p / (p + r)
                    x, p = x + g * (s - x), (1 - g) * p
                out.append(x)
            yield frame.assign(rssi_smooth=out)

    rows = m.select("bssid", "event_id", "measurement_timestamp", F.col("rssi").cast("double").alias("rssi")).where("rssi is not null and bssid is not null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("bssid").sortWithinPartitions("bssid", "measurement_timestamp", "event_id").mapInPandas(run, kinds + ", rssi_smooth double")


def estimate(m: DataFrame, prior_m: float = 50.0, rounds: int = 50) -> DataFrame:
    """L-08: maximum a posteriori position by path loss, exponent and noise by connection; the prior is the centroid. A large access point's scores and gradients are summed over all its rows in each round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, s = (pdf[c].to_numpy(float) for c in ("latitude", "longitude", "rssi"))
        on = (pdf["connection_status"] == "CONNECTED").to_numpy()
        n, sd = np.where(on, 2.5, 3.0), np.where(on, 4.0, 6.0)
        w = pdf["quality_weight"].to_numpy(float) * 10 ** (s / 10)
        c0, k = np.array([w @ lat, w @ lon]) / w.sum(), 111_320.0
        xy = np.stack([(lat - c0[0]) * k, (lon - c0[1]) * k * np.cos(np.radians(c0[0]))], 1)
        at, rate = np.zeros(2), 1.0

        def score(p):
            d = np.maximum(np.sqrt(((xy - p) ** 2).sum(1)), 1.0)
            return -(((s + 40 + 10 * n * np.log10(d)) ** 2) / (2 * sd**2)).sum() - (p**2).sum() / (2 * prior_m**2)

        best = score(at)
        for _ in range(rounds):
            diff = at - xy
            d = np.maximum(np.sqrt((diff**2).sum(1)), 1.0)
            g = -((s + 40 + 10 * n * np.log10(d)) / sd**2 * 10 * n / (d**2 * np.log(10)))[:, None] * diff
            step = at + rate * prior_m * (g.sum(0) - at / prior_m**2)
            got = score(step)
            if got > best:
                at, best = step, got
            else:
                rate /= 2
        out = c0 + at / np.array([k, k * np.cos(np.radians(c0[0]))])
        return pd.DataFrame({"bssid": [pdf["bssid"].iloc[0]], "lat": [out[0]], "lon": [out[1]], "rows": [len(pdf)]})

    rows = m.select("bssid", "event_id", "latitude", "longitude", F.col("rssi").cast("double").alias("rssi"), "connection_status", "quality_weight")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    w = value("quality_weight") * F.pow(F.lit(10.0), value("rssi") / 10)
    small, large = _by_size(rows, *[(F.sum(w * value(c)) / F.sum(w)).alias(o) for c, o in (("latitude", "_lat"), ("longitude", "_lon"))])
    done = small.groupBy("bssid").applyInPandas(run, "bssid string, lat double, lon double, rows long").select("bssid", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("rows").alias("n"))
    if large.isEmpty():
        return done
    k = F.lit(111_320.0)
    on = F.col("connection_status") == "CONNECTED"
    large = _cut(large.select("bssid", "_lat", "_lon", "_n", ((value("latitude") - F.col("_lat")) * k).alias("x"), ((value("longitude") - F.col("_lon")) * k * F.cos(F.radians("_lat"))).alias("y"), value("rssi").alias("s"), F.when(on, 2.5).otherwise(3.0).alias("path"), F.when(on, 4.0).otherwise(6.0).alias("sd")))

    def scored(to: DataFrame) -> DataFrame:
        """The score and its gradient at (px, py) of each access point."""
        at = large.select("bssid", "x", "y", "s", "path", "sd").join(F.broadcast(to.select(F.col("bssid").alias("_of"), "px", "py")), F.col("bssid").eqNullSafe(F.col("_of")))
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        at = at.withColumn("d", F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1.0)))
        at = at.withColumn("r", F.col("s") + 40 + 10 * F.col("path") * F.log10("d"))
        g = -(F.col("r") / F.pow("sd", F.lit(2)) * 10 * F.col("path") / (F.col("d") * F.col("d") * float(np.log(10))))
        sums = at.groupBy("_of").agg(F.sum(-F.col("r") * F.col("r") / (2 * F.col("sd") * F.col("sd"))).alias("got"), F.sum(g * dx).alias("gx"), F.sum(g * dy).alias("gy"))
        both = to.join(sums, to.bssid.eqNullSafe(sums["_of"])).drop("_of")
        px, py = F.col("px"), F.col("py")
        return both.withColumn("got", F.col("got") - (px * px + py * py) / (2 * prior_m**2)).withColumn("gx", F.col("gx") - px / prior_m**2).withColumn("gy", F.col("gy") - py / prior_m**2)

    start = large.select("bssid", "_lat", "_lon", "_n").distinct().withColumn("px", F.lit(0.0)).withColumn("py", F.lit(0.0))
    state = scored(start).select("bssid", "_lat", "_lon", "_n", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("got").alias("best"), F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.lit(1.0).alias("rate"))
    for _ in range(rounds):
        state = _cut(state)
        tried = scored(state.withColumn("px", F.col("ax") + F.col("rate") * prior_m * F.col("hx")).withColumn("py", F.col("ay") + F.col("rate") * prior_m * F.col("hy")))
        better = (F.col("got") > F.col("best")) & ~F.isnan("got")
        pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old)).alias(old)
        state = tried.select("bssid", "_lat", "_lon", "_n", pick("px", "ax"), pick("py", "ay"), pick("got", "best"), pick("gx", "hx"), pick("gy", "hy"), F.when(better, F.col("rate")).otherwise(F.col("rate") / 2).alias("rate"))
    state = _cut(state)
    return done.unionByName(state.select("bssid", (F.col("_lat") + F.col("ax") / k).alias("latitude"), (F.col("_lon") + F.col("ay") / (k * F.cos(F.radians("_lat")))).alias("longitude"), F.col("_n").alias("n")))


def fuse(state: DataFrame, update: DataFrame, reset_sigma: float = 5.0) -> DataFrame:
    """L-09: Kalman fusion of a stored position (bssid, latitude, longitude, variance) with a new one; an innovation beyond ``reset_sigma`` starts afresh."""
    new = update.select("bssid", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("variance").alias("_v"))
    both = state.join(new, "bssid", "full")
    gain = F.col("variance") / (F.col("variance") + F.col("_v"))
    jump = haversine_m(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    reset = jump > reset_sigma * F.sqrt(F.col("variance") + F.col("_v"))
    pick = lambda old, fresh, mixed: F.when(F.col("_v").isNull(), old).when(F.col("variance").isNull() | reset, fresh).otherwise(mixed)
    return both.select(
        "bssid",
        pick(F.col("latitude"), F.col("_lat"), F.col("latitude") + gain * (F.col("_lat") - F.col("latitude"))).alias("latitude"),
        pick(F.col("longitude"), F.col("_lon"), F.col("longitude") + gain * (F.col("_lon") - F.col("longitude"))).alias("longitude"),
        pick(F.col("variance"), F.col("_v"), (1 - gain) * F.col("variance")).alias("variance"),
        F.coalesce(reset, F.lit(False)).alias("reset"),
    )


def confidence(variance_m2: Column, n: Column, goodness: Column) -> Column:
    """L-10: 0 to 100."""
    return F.round(100 * clamp(0.5 * F.exp(-F.sqrt(variance_m2) / 50) + 0.3 * (1 - F.exp(-n / 50)) + 0.2 * goodness, 0.0, 1.0), 6)
