"""Settings of read mapping."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlignConfig:
    """The fixed values of the mapping method (see the README for what each does)."""

    min_length: int = 15
    combine_length: int = 8
    short_length: int = 30
    short_divisions: tuple[int, ...] = (2,)
    divisions: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    max_gap: int = 25
    accurate_max_gap: int = 1
    tolerance: int = 4
    max_padding: int = 10
    reject_errors: int = 8
    repair_limit: int = 5
    chunk: int = 100_000


DEFAULT = AlignConfig()
