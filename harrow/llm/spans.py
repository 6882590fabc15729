"""Spans in texts: as tuples (kind, start, end), in code points, end exclusive."""

from __future__ import annotations

import hashlib


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then by the place of the kind in ``kinds``, then by end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def overlaps(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)
