"""Windows of an image or scale space, and how far passes make them reach."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[int, int] | None  # half-open; None is everything


def _met(a: Range, b: Range) -> Range:
    if a is None or b is None:
        return a or b
    low, high = max(a[0], b[0]), min(a[1], b[1])
    return low, max(low, high)


@dataclass(frozen=True)
class Region:
    """Half-open ranges of rows, columns and scale indices."""

    rows: Range = None
    cols: Range = None
    scales: Range = None

    def widened(self, rows: int = 0, cols: int | None = None, scales: int = 0) -> Region:
        """What passes that reach so far read of an image for the result to be whole here."""
        wide = lambda r, by: r and (max(0, r[0] - by), r[1] + by if r[1] > r[0] else r[0])
        return Region(wide(self.rows, rows), wide(self.cols, rows if cols is None else cols), wide(self.scales, scales))

    def met(self, other: Region) -> Region:
        return Region(_met(self.rows, other.rows), _met(self.cols, other.cols), _met(self.scales, other.scales))

    def condition(self, row: Column | None = None, col: Column | None = None, scale: Column | None = None) -> Column:
        """Whether the given coordinates lie inside."""
        out = F.lit(True)
        for at, bounds in ((row, self.rows), (col, self.cols), (scale, self.scales)):
            if at is not None and bounds is not None:
                out = out & (at >= bounds[0]) & (at < bounds[1])
        return out

    def of(self, df: DataFrame) -> DataFrame:
        """The rows of a surface or scale space inside."""
        has = lambda name, r: F.col(name) if r is not None and name in df.columns else None
        if self == Region():
            return df
        return df.filter(self.condition(has("row", self.rows), has("col", self.cols), has("scale_idx", self.scales)))


EVERYWHERE = Region()
