"""Settings with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Makers whose prefixes mark mobile hotspots: fixed values.
HOTSPOT_OUIS = ("00:23:6C", "3C:15:C2", "58:55:CA", "40:B0:FA", "E8:50:8B", "DA:A1:19", "F8:A9:D0")


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds of measurement filtering (T-10 to T-18), checked on construction (T-26)."""

    max_location_accuracy: float = 150.0
    min_rssi: int = -100
    max_rssi: int = 0
    connected_weight: float = 2.0
    scan_weight: float = 1.0
    low_link_speed_weight: float = 1.5
    hotspot_enabled: bool = False
    hotspot_action: str = "LOG_ONLY"
    hotspot_ouis: tuple[str, ...] = field(default=HOTSPOT_OUIS)

    def __post_init__(self) -> None:
        if not self.max_location_accuracy >= 0:
            raise ValueError("max_location_accuracy must not be negative")
        if not -150 <= self.min_rssi <= self.max_rssi <= 0:
            raise ValueError("rssi bounds must satisfy -150 <= min <= max <= 0")
        for name in ("connected_weight", "scan_weight", "low_link_speed_weight"):
            if not 0 <= getattr(self, name) <= 10:
                raise ValueError(f"{name} must lie in [0, 10]")
        if self.hotspot_action not in ("FLAG", "EXCLUDE", "LOG_ONLY"):
            raise ValueError("hotspot_action is FLAG, EXCLUDE or LOG_ONLY")


@dataclass(frozen=True)
class BatchLimits:
    """Delivery limits (S-04, I-05, I-06)."""

    records: int = 500
    batch_bytes: int = 4 * 1024 * 1024
    record_bytes: int = 1024 * 1024
