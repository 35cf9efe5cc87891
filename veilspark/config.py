"""The disclosure thresholds that every released number is held to."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    k: int = 5
    row_cap: int = 20
    cardinality_cap: int = 50
    bin_min_count: int = 5
    cadence_sample_rows: int | None = None  # all
    diurnal_block_hours: int = 4

    def as_dict(self) -> dict[str, int | None]:
        return asdict(self)


DEFAULTS = Thresholds()
