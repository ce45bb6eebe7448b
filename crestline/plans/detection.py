"""From a surface to ridge points, segments or lines.

The image stage has three physical plans with equal results: "blocks" (one shuffle of
halo blocks, the default for pixels), "tiles" (dense tiles that exchange halo strips, the
plan for images that several passes read) and "windows" (SQL windows, an exchange per axis).  Its
edges are sparse and feed several consumers, so they are staged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.kernels import gaussian
from ..functions.scales import sorted_distinct
from ..operators import blocks, detect, lines, surface, tiles
from .staging import stage

MODES = ("points", "segments", "lines")
METRICS = ("A", "M", "N")


@dataclass(frozen=True)
class Detection:
    """Staged edges of a set of images and their sizes."""

    edges: DataFrame
    dims: DataFrame

    def points(self) -> DataFrame:
        return detect.points(self.edges)

    def cells(self) -> DataFrame:
        return detect.cells(self.edges, self.dims)

    def segments(self) -> DataFrame:
        return detect.segments(self.edges, self.dims)

    def line_points(self) -> DataFrame:
        return lines.line_points(self.edges, self.dims)

    def lines(self) -> DataFrame:
        return lines.lines(self.edges, self.dims)

    def entries(self, mode: str) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
        return getattr(self, mode)()


def detection_of_tiles(image: DataFrame, scales: list[float] | float = 0.0, metric: str = "N", fill: float = 0.0, compat: bool = False) -> Detection:
    """Ridges of raw images as staged tiles; sizes come from the tiles' places."""
    t = _smallest(scales, metric)
    return Detection(stage(tiles.edges(image, t, metric, fill, compat), "edges"), stage(tiles.dims(image), "dims"))


def _smallest(scales: list[float] | float, metric: str) -> float:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}, not {metric!r}")
    return sorted_distinct([float(s) for s in (scales if isinstance(scales, list) else [scales])])[0]


def detection(image: DataFrame, scales: list[float] | float = 0.0, metric: str = "N", fill: float = 0.0, plan: str = "blocks", compat: bool = False) -> Detection:
    """Ridges of raw surfaces at the smallest of the scales.

    Brightness is read from the raw surface, strength from the chosen metric.  ``compat``
    works in the arithmetic of 32-bit floats with the literal eigen shift.
    """
    if compat and plan == "windows":
        raise ValueError("the window plan works in 64-bit floats only")
    t = _smallest(scales, metric)
    if plan == "tiles":
        return detection_of_tiles(tiles.staged(tiles.from_pixels(image, blocks.side(blocks.reach_of(gaussian(t)) + 3))), t, metric, fill, compat)
    found = blocks.edges_by_blocks(image, t, metric, fill, literal=compat) if plan == "blocks" else detect.edges_by_windows(image, t, metric, fill)
    return Detection(stage(found, "edges"), stage(surface.size(image), "dims"))
