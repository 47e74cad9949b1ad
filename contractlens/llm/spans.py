"""Span lists of one text: base rules and their digests, shared by the secret and personal-data operators."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]  # kind, start, end (code points, end exclusive)


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
