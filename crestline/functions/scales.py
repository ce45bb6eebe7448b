"""Scale lists: parsing, sorting, rounding.  A scale is a variance."""

from __future__ import annotations

import math

from .kernels import rint


def parse_scales(text: str) -> list[float]:
    """"t" or "start:step:end" (inclusive); a negative step counts down from start to end."""
    fields = text.split(":")
    if len(fields) not in (1, 3):
        raise ValueError(f"a scale is t or start:step:end, not {text!r}")
    try:
        numbers = [float(f) for f in fields]
    except ValueError:
        raise ValueError(f"not a number in scale {text!r}") from None
    if not all(map(math.isfinite, numbers)):
        raise ValueError(f"scale {text!r} is not finite")
    if len(numbers) == 1:
        out = numbers
    else:
        start, step, end = numbers
        if step == 0:
            raise ValueError("the step of a scale range must not be 0")
        if step < 0:
            start, step, end = end, -step, start
        out, i = [], 0
        while start + i * step <= end + 1e-9 * step:
            out.append(start + i * step)
            i += 1
        if not out:
            raise ValueError(f"scale range {text!r} is empty")
    if min(out) < 0:
        raise ValueError(f"scale {text!r} is negative")
    return out


def sorted_distinct(scales: list[float]) -> list[float]:
    return sorted(set(scales))


def to_thirds(scales: list[float]) -> list[float]:
    """Rounded to the variances that the discrete kernel can reach."""
    return [rint(3.0 * s) / 3.0 for s in scales]
