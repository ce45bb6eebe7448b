"""Filter taps, built on the driver and placed in plans as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

DERIVATIVE = (-0.5, 0.0, 0.5)


@dataclass(frozen=True)
class Kernel:
    """taps[ofs + n] weighs the sample n places back: out[i] = sum taps[ofs+n] * in[i-n]."""

    taps: tuple[float, ...]

    @property
    def ofs(self) -> int:
        return len(self.taps) // 2

    def terms(self) -> list[tuple[int, float]]:
        """(shift, weight) with in[i + shift], in order of growing n; zero taps left out."""
        return [(-n, self.taps[self.ofs + n]) for n in range(-self.ofs, self.ofs + 1) if self.taps[self.ofs + n] != 0.0]


def derivative() -> Kernel:
    return Kernel(DERIVATIVE)


def rint(x: float) -> int:
    """Round half to even, as C's rint; Python's round does the same."""
    return round(x)


def gaussian(variance: float, sampled: bool = False) -> Kernel | None:
    """Discrete Gaussian of the variance, None if it rounds to no smoothing.

    N = rint(3 * variance) passes of [1/6, 2/3, 1/6] over a unit impulse; ``sampled``
    takes exp(-i^2 / 2t) / sqrt(2 pi t) at |i| <= N instead, not normalised.
    """
    n = rint(3.0 * variance)
    if n < 1:
        return None
    if sampled:
        return Kernel(tuple(math.exp(-i * i / (2 * variance)) / math.sqrt(2 * math.pi * variance) for i in range(-n, n + 1)))
    taps = [0.0] * (2 * n + 1)
    taps[n] = 1.0
    for _ in range(n):
        padded = [0.0, *taps, 0.0]
        taps = [padded[i] / 6.0 + padded[i + 1] * 2.0 / 3.0 + padded[i + 2] / 6.0 for i in range(len(taps))]
    return Kernel(tuple(taps))
