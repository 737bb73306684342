"""The duration arithmetic of :mod:`stavewright.functions.duration` for parsers that run in Python workers."""

from __future__ import annotations

from fractions import Fraction
from functools import cache

from stavewright.functions.fixed import BASE, CANONICAL_RATIOS, MAX_DOTS, TYPES, plain_durations

_PLAIN = plain_durations()
_SMALLEST = min(BASE.values())


@cache
def divisions(kind: str, dots: int, ratio: tuple[int, int] | None = None) -> int | None:
    """Divisions of a written duration; None if it is unknown or doesn't come out whole."""
    if kind not in BASE or not 0 <= dots <= MAX_DOTS:
        return None
    length = BASE[kind] * (2 - Fraction(1, 2**dots)) * (Fraction(ratio[1], ratio[0]) if ratio else 1)
    return length.numerator if length.denominator == 1 else None


def plain(span: int) -> tuple[str, int] | None:
    return _PLAIN.get(span)


def _fill(span: int, ratio: tuple[int, int] | None) -> list | None:
    sizes = sorted(((size, t) for t in TYPES if (size := divisions(t, 0, ratio))), reverse=True)
    out = []
    for size, t in sizes:
        n, span = divmod(span, size)
        out += [(t, 0, ratio)] * n
    return None if span else out


def rests(span: int) -> list[tuple[str, int, tuple[int, int] | None]] | None:
    """A span of divisions as rests ``(type, dots, ratio)``, the way ``decompose_rests`` does it; None if there is none."""
    if span < 0:
        return None
    if (out := _fill(span, None)) is not None:
        return out
    for ratio in CANONICAL_RATIOS:
        if (out := _fill(span, ratio)) is not None:
            return out
        grain = _SMALLEST * ratio[1] // ratio[0]
        for k in range(1, ratio[0]):
            if span >= k * grain and (span - k * grain) % _SMALLEST == 0:
                head, tail = _fill(span - k * grain, None), _fill(k * grain, ratio)
                if head is not None and tail is not None:
                    return head + tail
    return None
