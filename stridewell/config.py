"""Defaults of the analysis."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the canonical configuration."""

    condition: str = "popmatched"
    n_users: int = 300
    seed: int = 0
    hist_n: int = 30
    hist_order: str = "recent"
    k: int = 5
    test_frac: float = 0.2
    min_events: int = 20
    n_bands: int = 20
    n_generic: int = 5
    split_year: int = 2017
    support: int = 20
    cap_per_user: int = 20


DEFAULT = Config()
