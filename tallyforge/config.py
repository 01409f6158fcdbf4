"""Tunables of the detectors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    vendor_threshold: int = 85
    amount_tolerance: float = 0.01
    date_window_days: int = 30
    bucket_width: float = 0.05  # of amounts in the band join; twice the tolerance where that is more
    name_similarity: str = "tokens"  # or "sequence"
    resave_quality: int = 90
    amplification: float = 12.0
    pixel_threshold: int = 25
    ela_fraction: float = 0.04
    ela_peak: int = 80
    medium_from: float = 0.30
    high_from: float = 0.65
    max_bytes: int = 20 * 1024 * 1024
    strict_ein: bool = False
    strict_extract: bool = False

    def __post_init__(self) -> None:
        if self.amount_tolerance < 0 or self.name_similarity not in ("tokens", "sequence"):
            raise ValueError("a tolerance is negative, or a similarity is unknown")
        object.__setattr__(self, "bucket_width", max(self.bucket_width, 2 * self.amount_tolerance))


DEFAULT = Config()
