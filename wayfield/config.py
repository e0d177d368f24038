"""Settings of a coverage run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CoverageConfig:
    """Thresholds are inclusive; a zone size of 0 or less means 100 m."""

    zone_size: float = 100.0
    zone_mode: str = "grid"  # grid (or center), original (grid, with the coordinates as measured), or segments
    rsrp_threshold: float = -110.0
    sinr_threshold: float = -5.0
    densify: bool = False
    mobile: bool = False
    sync_tolerance_ms: int = 1000
    keep_original_rows: bool = False
    canonical_keys: bool = False
    exclude_windows: tuple[tuple[str, str], ...] = ()
    exclude_row_ids: tuple[int, ...] = ()
    custom_operators: tuple[tuple[str, str, str], ...] = ()
    rule_paths: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)  # logical name -> column name, where chosen by hand

    @property
    def size(self) -> float:
        return self.zone_size if self.zone_size > 0 else 100.0

    @property
    def segments(self) -> bool:
        return self.zone_mode == "segments"

    def validate(self) -> None:
        if self.zone_mode not in ("grid", "center", "original", "segments"):
            raise ValueError(f"unknown zone mode {self.zone_mode!r}")
        if self.sync_tolerance_ms < 0:
            raise ValueError("the tolerance can't be negative")
