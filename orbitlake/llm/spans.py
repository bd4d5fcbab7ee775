"""How spans of several kinds are written down and told apart."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]


def written(base: list[Span], order: dict[str, int], further: list[Span]) -> tuple[str, str]:
    """(SHA-256 of the base spans, all spans), each kind:start:end, by start and then by kind."""
    def line(found: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(
            found, key=lambda s: (s[0], order[s[2]], s[1])))
    return hashlib.sha256(line(base).encode()).hexdigest(), line(base + further)


def apart(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap no base span."""
    held = sorted((a, b) for a, b, _ in base)
    out, i, reach = [], 0, 0
    for a, b, k in sorted(found):
        while i < len(held) and held[i][0] < b:
            reach = max(reach, held[i][1])
            i += 1
        if reach <= a:
            out.append((a, b, k))
    return out
