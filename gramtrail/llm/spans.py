"""Spans (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def apart(found: list[Span], base: list[Span]) -> list[Span]:
    """The found spans that touch no base span and no earlier found one."""
    taken = [(a, b) for _, a, b in base]
    out = []
    for k, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((k, a, b))
    return out
