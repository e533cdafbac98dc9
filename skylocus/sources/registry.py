"""The access-point registry (S-11 to S-14, J-01, J-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that may position, and that count as eligible in reports: fixed values.
VALID = ("active", "warning", "verified", "test", "imported")
ELIGIBLE = ("active", "warning")
#: A registry of at most so many rows (about 100 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000


def lookup(registry: DataFrame, mac: str) -> DataFrame:
    """S-11."""
    return registry.where(F.col("mac_addr") == mac)


def first_of_each(registry: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """J-01: one row per address, the first by ``order``."""
    if not order:
        return registry.dropDuplicates(["mac_addr"])
    return registry.withColumn("_n", F.row_number().over(Window.partitionBy("mac_addr").orderBy(*order))).where("_n = 1").drop("_n")


def usable(registry: DataFrame) -> DataFrame:
    """J-02."""
    return registry.where(F.col("status").isin(*VALID))


def known_scans(scans: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """S-12, J-01: scans with their access points; the registry is broadcast only when it is small, which is checked."""
    small = registry.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return scans.join(F.broadcast(registry) if small else registry, "mac_addr", how)


def upsert(current: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """S-14: the latest version of each address."""
    both = current.unionByName(changes)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("mac_addr").orderBy(F.desc(version)))).where("_n = 1").drop("_n")
