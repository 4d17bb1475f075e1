"""User parameters of the three filter sets. ``None`` means "do not filter"."""

from __future__ import annotations

from dataclasses import dataclass

from paylens.model import SKILLS


@dataclass(frozen=True)
class PostingFilter:
    lo: float | None = 10
    hi: float | None = 260
    role: str | None = None
    sector: str | None = None
    seniority: str | None = None


@dataclass(frozen=True)
class CompanyFilter:
    size: str | None = None
    ownership: str | None = None


@dataclass(frozen=True)
class Profile:
    role: str | None = None
    state: str | None = None
    seniority: str | None = None
    skills: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = [s for s in self.skills if s not in SKILLS]
        if unknown:
            raise ValueError(f"unknown skill columns: {unknown}")
