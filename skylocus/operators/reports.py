"""Report statistics (R-01 to R-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(c: str, name: str | None = None, digits: int = 6) -> list[Column]:
    """Mean, median, largest and least."""
    n = name or c
    r = lambda x, a: F.round(x, digits).alias(f"{a}_{n}")
    return [r(F.avg(c), "mean"), r(F.median(c), "median"), F.max(c).alias(f"max_{n}"), F.min(c).alias(f"min_{n}")]


def factor_counts(rows: DataFrame, factors: list[str]) -> DataFrame:
    """R-01: counts by each factor, all in one pass."""
    sets = [[F.col(f)] for f in factors]
    out = rows.groupingSets(sets, *[F.col(f) for f in factors]).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    # each set groups by one factor: the bit that is 0
    k = len(factors)
    full = 2**k - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(factors):
        own = F.col("_g") == full - 2 ** (k - 1 - i)
        name, value = F.when(own, f).otherwise(name), F.when(own, F.col(f).cast("string")).otherwise(value)
    return out.select(name.alias("factor"), value.alias("value"), "n")


def ap_histogram(rows: DataFrame, n: str = "n_scans") -> DataFrame:
    """R-02."""
    label = F.when(F.col(n) > 4, "4+").otherwise(F.col(n).cast("string"))
    return rows.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def status_counts(aps: DataFrame, used: str = "used") -> DataFrame:
    """R-03: access points by status, all and used."""
    return aps.groupBy("status").agg(F.count("*").alias("n"), F.count(F.when(F.col(used), 1)).alias("n_used"))


def method_counts(rows: DataFrame, methods: str = "methods") -> DataFrame:
    """R-04."""
    return rows.where(F.col(methods).isNotNull()).select(F.explode(F.split(methods, ",")).alias("method")).groupBy("method").agg(F.count("*").alias("n"))


def success(rows: DataFrame, result: str = "result", accuracy: str = "accuracy", confidence: str = "confidence") -> DataFrame:
    """R-05."""
    rate = F.round(100 * F.avg(F.when(F.col(result) == "SUCCESS", 1.0).otherwise(0.0)), 6).alias("success_pct")
    r = lambda c: [F.round(x, 3).alias(x_name) for x, x_name in ((F.avg(c), f"mean_{c}"), (F.median(c), f"median_{c}"), (F.max(c), f"max_{c}"), (F.min(c), f"min_{c}"))]
    return rows.agg(F.count("*").alias("n"), rate, *r(accuracy), *r(confidence))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """R-06: counts and their share of all."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counted.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def distances(rows: DataFrame, by: str | None = None, distance: str = "distance_m") -> DataFrame:
    """R-07."""
    d = F.col(distance)
    out = [F.count(d).alias("n"), F.round(F.avg(d), 4).alias("mean"), F.round(F.median(d), 4).alias("median"), F.round(F.percentile(d, F.lit(0.9)), 4).alias("p90"), F.round(F.max(d), 4).alias("max"), F.round(F.stddev(d), 4).alias("stddev")]
    rows = rows.where(d.isNotNull())
    return rows.groupBy(by).agg(*out) if by else rows.agg(*out)


def accuracy_by(rows: DataFrame, factors: list[str], measures: list[str]) -> DataFrame:
    """R-08: accuracy of both providers by each factor, in one pass of grouping sets."""
    named = [F.col(f).cast("string").alias(f) for f in factors]
    long = rows.select(*measures, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), c.alias("value")) for f, c in zip(factors, named)])).alias("_f")).select(*measures, "_f.*")
    return long.groupBy("factor", "value").agg(*[F.round(f(m), 4).alias(f"{a}_{m}") for m in measures for f, a in ((F.avg, "mean"), (F.median, "median"), (F.min, "min"), (F.max, "max"))])


def agreement_rates(rows: DataFrame, limits: tuple[int, ...] = (5, 10, 20, 30, 50, 100), distance: str = "distance_m", kind: str = "location_type") -> DataFrame:
    """R-09: share of Wi-Fi positions closer than each limit."""
    wifi = F.count(F.when(F.col(kind) == "WIFI", 1))
    near = lambda m: F.count(F.when((F.col(kind) == "WIFI") & (F.col(distance) < m), 1))
    return rows.agg(wifi.alias("n_wifi"), *[F.round(F.when(wifi > 0, 100.0 * near(m) / wifi), 6).alias(f"within_{m}_pct") for m in limits])


def confidence_correlation(rows: DataFrame, confidence: str = "confidence", distance: str = "distance_m") -> DataFrame:
    """R-10: Pearson correlation and what it says."""
    both = rows.where(F.col(confidence).isNotNull() & F.col(distance).isNotNull())
    r = F.col("r")
    said = F.when(r <= -0.7, "strong negative").when(r <= -0.3, "moderate negative").when(r < 0.3, "weak").when(r < 0.7, "moderate positive").when(r >= 0.7, "strong positive")
    return both.agg(F.count("*").alias("n"), F.round(F.corr(confidence, distance), 6).alias("r")).withColumn("reading", said)
