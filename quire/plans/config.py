"""Settings from the environment, checked before anything starts."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from quire.sources.router import Limits


def listed(value: str | None) -> tuple[str, ...]:
    """The parts of a comma-separated list, without blanks around them; empty ones are left out."""
    return tuple(x for x in map(str.strip, (value or "").split(",")) if x)


def number(name: str, value: str | None, default: int) -> int:
    if value is None or not value.strip():
        return default
    if not re.fullmatch(r"[0-9]{1,18}", value.strip()) or int(value) < 1:
        raise ValueError(f"{name} must be a whole number above 0")
    return int(value)


def bearer(header: str | None) -> str | None:
    """The token of an Authorization header; None where it has none."""
    m = re.fullmatch(r"\s*bearer +([A-Za-z0-9._~+/-]+=*)\s*", header or "", re.I)
    return m[1] if m else None


def profile_variable(profile: str) -> str:
    """The environment's name for a profile's token."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", profile):
        raise ValueError("a profile's name has letters, digits, hyphens and underscores")
    return "QUIRE_TOKEN_" + profile.upper().replace("-", "_")


@dataclass(frozen=True)
class Settings:
    roots: tuple[str, ...] = ()
    store: str = "quire-store"
    hosts: tuple[str, ...] = ()
    limits: Limits = Limits()

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        limits = {f.name: number(f"QUIRE_MAX_{f.name.upper()}", env.get(f"QUIRE_MAX_{f.name.upper()}"), f.default) for f in fields(Limits)}
        return cls(listed(env.get("QUIRE_ROOTS")), env.get("QUIRE_STORE") or cls.store, listed(env.get("QUIRE_HOSTS")), Limits(**limits))
