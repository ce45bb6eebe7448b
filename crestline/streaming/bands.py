"""Ridge detection over image rows as they arrive.

A stream of rows (image_id, row, rows, v; ``rows`` is the image's height, v an array) gives
the edges of the batch.  Rows are cut into stretches of COLUMNS columns with a halo at either
side, so an image is worked on by as many tasks as it has stretches.  Each keeps the rows
that later ones still reach back to, and rows that came before their turn.  Edges of a row
come out once all rows they rest on are there, at the latest with the image's last row.

A row that came before (late or repeated) is ignored, whatever it holds; so are rows outside
the image.  Columns that a shorter row lacks are NaN, as are nulls.  State of an image ends
with its last row; rows of an image that is never completed stay in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import edge_table, reach_of
from ..operators.detect import EDGE_SCHEMA
from ..functions.kernels import gaussian

COLUMNS = 1024
_STATE = "done bigint, first bigint, next bigint, width int, held binary, waiting map<bigint,binary>"


def _stretches(rows: DataFrame, halo: int, columns: int) -> DataFrame:
    last = F.floor((F.size("v") - 1) / columns).cast("int")
    cut = rows.filter(F.size("v") > 0).select("image_id", "row", "rows", "v", F.size("v").alias("cols"), F.explode(F.sequence(F.lit(0), last)).alias("tc"))
    left = F.greatest(F.lit(0), F.col("tc") * columns - halo)
    right = F.least(F.col("cols"), (F.col("tc") + 1) * columns + halo)
    return cut.select("image_id", "tc", F.col("row").cast("bigint").alias("row"), F.col("rows").cast("bigint").alias("rows"), left.alias("left"), F.slice("v", left + 1, right - left).cast("array<double>").alias("v"))


def _run(t: float, metric: str, fill: float, halo: int, columns: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        image_id, tc = key
        done, first, nxt, width, held, waiting = state.get if state.exists else (0, 0, 0, 0, b"", {})
        waiting, rows, left = dict(waiting or {}), 0, 0
        for part in parts:
            part = part.sort_values("row", kind="stable")
            rows, left = int(part["rows"].iloc[0]), int(part["left"].iloc[0])
            for row, v in zip(part["row"], part["v"]):
                if nxt <= row < rows and row not in waiting:
                    waiting[int(row)] = np.array(v, np.float64).tobytes()
        new = []
        while nxt in waiting:
            new.append(np.frombuffer(waiting.pop(nxt)))
            nxt += 1
        if not new and done < rows:
            state.update((done, first, nxt, width, bytes(held), waiting))
            return
        wide = max([width, *map(len, new)])
        grid = np.full((nxt - first, wide), np.nan)
        if width:
            old = np.frombuffer(bytes(held)).reshape(-1, width)
            grid[: len(old), :width] = old
        for i, v in enumerate(new, len(grid) - len(new)):
            grid[i, : len(v)] = v
        upto = rows if nxt >= rows else max(done, nxt - halo)
        if upto > done:
            own = (done, upto, tc * columns, (tc + 1) * columns)
            yield edge_table(image_id, grid, first, left, t, metric, fill, own).to_pandas()
        if nxt >= rows:  # what remains marks the image as seen
            state.update((rows, rows, rows, 0, b"", {}))
            return
        begin = max(first, upto - halo)
        state.update((upto, begin, nxt, wide, grid[begin - first :].tobytes(), waiting))

    return run


def edges_stream(rows: DataFrame, t: float = 0.0, metric: str = "N", fill: float = 0.0, columns: int = COLUMNS) -> DataFrame:
    """Edges of a stream of (image_id, row, rows, v), as ``operators.blocks.edges_by_blocks`` gives for whole images."""
    halo = reach_of(gaussian(t)) + 3
    if columns < halo:
        raise ValueError(f"stretches must be {halo} columns wide at least")
    cut = _stretches(rows, halo, columns).groupBy("image_id", "tc")
    return cut.applyInPandasWithState(_run(t, metric, fill, halo, columns), EDGE_SCHEMA, _STATE, "append", "NoTimeout")
