"""Opaque tokens that resume an enumeration: canonical claims with a checksum, not encrypted."""

from __future__ import annotations

import hashlib
import json

READ, UNITS = "quire-read/1", "quire-units/1"
PREFIXES = {READ: "qr-", UNITS: "qu-"}
#: The longest token.
MAX_CHARS = 16_384


class CursorError(ValueError):
    """A token that was changed, outgrew its bound, or belongs to another enumeration."""


def _sum(version: str, claims: str) -> str:
    return hashlib.sha256(f"quire-cursor\0{version}\0{claims}".encode()).hexdigest()


def encode(version: str, claims: dict) -> str:
    body = json.dumps(claims, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    token = PREFIXES[version] + json.dumps({"v": version, "c": body, "s": _sum(version, body)}, sort_keys=True).encode().hex()
    if len(token) > MAX_CHARS:
        raise CursorError("the cursor is too long")
    return token


def decode(version: str, token: str, scope: dict | None = None) -> dict:
    """The claims of a token of this version, which must agree with scope."""
    if len(token) > MAX_CHARS or not token.startswith(PREFIXES[version]):
        raise CursorError("not a cursor of this kind")
    try:
        held = json.loads(bytes.fromhex(token[len(PREFIXES[version]) :]))
        body, given, said = held["c"], held["s"], held["v"]
        claims = json.loads(body)
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("the cursor can't be read") from e
    if said != version or given != _sum(version, body):
        raise CursorError("the cursor was changed")
    for k, v in (scope or {}).items():
        if claims.get(k) != v:
            raise CursorError(f"the cursor is for another {k}")
    return claims
