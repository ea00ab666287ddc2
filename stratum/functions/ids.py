"""Sortable ids: 48 bits of milliseconds and 80 bits that are random or derived."""

from __future__ import annotations

import hashlib
import secrets
import time

_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode(ms: int, tail: bytes) -> str:
    value = ms << 80 | int.from_bytes(tail[:10], "big")
    return "".join(_DIGITS[value >> shift & 31] for shift in range(125, -1, -5))


def generate(ms: int | None = None) -> str:
    return encode(time.time_ns() // 1_000_000 if ms is None else ms, secrets.token_bytes(10))


def derive(ms: int, *parts: str) -> str:
    """The same id for the same parts, whoever makes it and however often."""
    return encode(ms, hashlib.sha256("\0".join(parts).encode()).digest())


def milliseconds(name: str) -> int:
    value = 0
    for c in name:
        value = value << 5 | _DIGITS.index(c)
    return value >> 80
