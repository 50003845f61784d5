"""Spans found in a text: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``, joined by commas."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], kinds: Sequence[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def outside(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of ``spans`` that touch none of ``others``; time grows with their number, but for the sort."""
    if not others:
        return spans
    out, merged = [], []
    for a, b in sorted((a, b) for _, a, b in others):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    starts = [a for a, _ in merged]
    for s in spans:
        k = bisect_left(starts, s[2]) - 1  # the last that begins before the span ends
        if k < 0 or merged[k][1] <= s[1]:
            out.append(s)
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps merge."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
