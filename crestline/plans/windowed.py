"""Passes over an image or scale space of which only a window is asked for.

A ``Windowed`` holds where pixels come from and what is done to them, unplanned.  Its
region, wherever it was named, goes down through the passes: each widens it by what it
reaches, planes after the last one needed are not made, and the source gets the region
that is left, so a scan reads no more of the image than the answer rests on.  What a cut
side makes of pixels near it lies outside the region and goes before the next pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import finite_or
from ..functions.kernels import Kernel, gaussian
from ..operators import blocks, scalespace
from ..operators.blocks import reach_of
from ..operators.region import EVERYWHERE, Region

Source = Callable[[Region], DataFrame]


@dataclass(frozen=True)
class Pass:
    """``needs``: the region of its input that a region of its result rests on."""

    needs: Callable[[Region], Region]
    run: Callable[[DataFrame, Region], DataFrame]


@dataclass(frozen=True)
class Windowed:
    source: Source
    passes: tuple[Pass, ...] = ()
    region: Region = EVERYWHERE

    def then(self, needs: Callable[[Region], Region], run: Callable[[DataFrame, Region], DataFrame]) -> Windowed:
        """One more pass; a region named before it holds for its input as for its result."""
        return replace(self, passes=(*self.passes, Pass(needs, run)))

    def where(self, rows=None, cols=None, scales=None) -> Windowed:
        return replace(self, region=self.region.met(Region(rows, cols, scales)))

    def _reaching(self, reach: int, run: Callable[[DataFrame], DataFrame]) -> Windowed:
        return self.then(lambda r: r.widened(reach), lambda df, _: run(df))

    def filled(self, fill: float = 0.0) -> Windowed:
        return self._reaching(0, lambda df: df.withColumn("v", finite_or(F.col("v"), fill)))

    def smoothed(self, t: float) -> Windowed:
        return self._reaching(reach_of(gaussian(t)), lambda df: blocks.smoothed(df, t))

    def derivatives(self, t: float = 0.0) -> Windowed:
        return self._reaching(reach_of(gaussian(t)) + 2, lambda df: blocks.derivatives(df, t))

    def metrics(self, t: float, metric: str = "N", fill: float = 0.0) -> Windowed:
        return self._reaching(reach_of(gaussian(t)) + 2, lambda df: blocks.metrics_by_blocks(df, t, metric, fill))

    def edges(self, t: float = 0.0, metric: str = "N", fill: float = 0.0) -> Windowed:
        return self._reaching(reach_of(gaussian(t)) + 3, lambda df: blocks.edges_by_blocks(df, t, metric, fill))

    def scale_space(self, scales: list[float]) -> Windowed:
        ordered, kernels = blocks.scale_kernels(scales)
        upto = lambda r: min(len(ordered), r.scales[1]) if r.scales else len(ordered)
        needs = lambda r: replace(r.widened(sum(map(reach_of, kernels[: upto(r)]))), scales=None)
        return self.then(needs, lambda df, r: blocks.scale_space(df, scales, planes=(r.scales[0] if r.scales else 0, upto(r))))

    def filtered(self, kernel: Kernel | None, axes: tuple[str, ...] = ("rows", "cols")) -> Windowed:
        """``axes``: "rows" runs along a row, over columns; "cols" over rows; "scale" over planes."""
        by = lambda axis: reach_of(kernel) if axis in axes else 0
        return self.then(lambda r: r.widened(by("cols"), by("rows"), by("scale")), lambda df, _: scalespace.filter_space(df, kernel, axes))

    def scale_metrics(self, metric: str = "N") -> Windowed:
        """Two derivatives in each plane and two along the scales."""
        return self.then(lambda r: r.widened(2, 2, 2), lambda df, _: scalespace.scale_metrics(df, metric))

    def section(self, axis: str, offset: int) -> Windowed:
        """A planar cut of a scale space: axis "scale", "row" or "col"."""
        at = offset, offset + 1
        return self.where(**{{"scale": "scales", "row": "rows", "col": "cols"}[axis]: at})

    def df(self) -> DataFrame:
        regions = [self.region]
        for p in reversed(self.passes):
            regions.append(p.needs(regions[-1]))
        df = regions[-1].of(self.source(regions[-1]))
        for p, region in zip(self.passes, regions[-2::-1]):
            df = region.of(p.run(df, region))
        return df

    def view(self, top: int, left: int, height: int, width: int, first: int = 0, scales: int | None = None) -> DataFrame:
        """A box of a scale space, moved to its origin."""
        some = self.where((top, top + height), (left, left + width), (first, first + scales if scales is not None else 2**31 - 1))
        return some.df().withColumns({"row": F.col("row") - top, "col": F.col("col") - left, "scale_idx": F.col("scale_idx") - first})
