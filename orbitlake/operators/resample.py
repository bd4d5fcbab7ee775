"""Moving pixels onto a finer or coarser grid over the same ground."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..registry import QueryError
from ..session import materialise
from .stencil import tasks_for

_REACH = {"bilinear": 1, "cubic": 2}


def sampling_for(ground_res_m: float, native_m: float, merging: bool) -> str:
    """Averaging when the grid is coarser, untouched samples for a merge, else cubic."""
    if ground_res_m >= native_m:
        return "bilinear"
    return "nearest" if merging else "cubic"


def kernel(distance: Column, method: str) -> Column:
    """Interpolation weight at a distance in source cells (linear, or Catmull-Rom cubic)."""
    d = F.abs(distance)
    if method == "bilinear":
        return F.greatest(F.lit(1.0) - d, F.lit(0.0))
    near = (d * 1.5 - 2.5) * d * d + 1.0
    far = ((d * -0.5 + 2.5) * d - 4.0) * d + 2.0
    return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)


def _step(source: str, out: int, corners: bool) -> tuple[Column, Column]:
    """Source position of output cell i is ``a * i + b``."""
    n = F.col(source).cast("double")
    if corners:
        return (n - 1.0) / float(max(out - 1, 1)), F.lit(0.0)
    ratio = n / float(out)
    return ratio, ratio / 2.0 - 0.5


def resample(df: DataFrame, keys: Sequence[str], bands: Sequence[str], height: int, width: int,
             method: str = "cubic", corners: bool = False) -> DataFrame:
    """Images onto ``height`` x ``width`` cells; each source cell gives to the cells it reaches.

    NULL and absent neighbours are left out and the remaining weights rescaled.  Two passes,
    rows then columns; each deals whole lines of cells, before they give, to as many tasks as the
    new cells ask for, so what a task holds doesn't grow with the table.  ``corners`` aligns
    the outermost cell centres instead of the cell edges.  ``spline`` goes through every cell of
    images that have all of them, see :func:`spline_lines`.
    """
    keys, bands = list(keys), list(bands)
    if method == "nearest":
        return _nearest(df, keys, bands, height, width, corners)
    if method == "spline":
        return _spline(df, keys, bands, height, width, corners)
    if method not in _REACH:
        raise QueryError(f"Unknown resampling {method!r}")
    px = df.select(*keys, "height", "width", "row", "col", *[
        c for b in bands for c in (F.col(b).cast("double").alias(f"__v_{b}"),
                                   F.col(b).isNotNull().cast("double").alias(f"__w_{b}"))])
    px = materialise(px)            # read for its size and again for its cells
    # a cell gives to many new ones, so images full of holes may come out without any
    tasks = tasks_for(px.select(*keys).distinct(), F.lit(float(height * width)))
    sums = [f"__{p}_{b}" for b in bands for p in ("v", "w")]
    px = px.repartition(tasks, *keys, "col")
    px = _spread(px, keys + ["col", "width"], "row", "height", height, sums, method, corners)
    px = px.repartition(tasks, *keys, "row")
    px = _spread(px, keys + ["row"], "col", "width", width, sums, method, corners)
    return px.select(*keys, "row", "col", F.lit(height).alias("height"),
                     F.lit(width).alias("width"), *[
        F.when(F.abs(F.col(f"__w_{b}")) > 1e-9, F.col(f"__v_{b}") / F.col(f"__w_{b}")).alias(b)
        for b in bands])


def _spread(px: DataFrame, group: list[str], axis: str, size: str, out: int, sums: list[str],
            method: str, corners: bool) -> DataFrame:
    reach = _REACH[method]
    a, b = _step(size, out, corners)
    px = px.withColumns({"__a": a, "__b": b})
    low = F.ceil((F.col(axis) - reach - F.col("__b")) / F.col("__a"))
    high = F.floor((F.col(axis) + reach - F.col("__b")) / F.col("__a"))
    target = F.explode_outer(F.sequence(F.greatest(low, F.lit(0)).cast("int"),
                                  F.least(high, F.lit(out - 1)).cast("int")))
    # A cell can always reach one output cell or more except past the frame edge.
    px = px.where(F.greatest(low, F.lit(0)) <= F.least(high, F.lit(out - 1)))
    px = px.withColumn("__to", target)
    weight = kernel(F.col("__a") * F.col("__to") + F.col("__b") - F.col(axis), method)
    px = px.withColumn("__k", weight).where("__k != 0")
    return (px.groupBy(*group, F.col("__to").alias(axis))
            .agg(*[F.sum(F.col(s) * F.col("__k")).alias(s) for s in sums])
            .withColumnRenamed("__to", axis))


#: Pole of the cubic spline's recursive prefilter, and cells on either side that it reaches: the
#: rest of the response is below 1e-12.
POLE, REACH = 3.0 ** 0.5 - 2.0, 21


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """The places of cells in a line of n cells that is mirrored in its outermost cells."""
    turn = max(2 * (n - 1), 1)
    at = at % turn
    return np.minimum(at, turn - at) % n


def spline_lines(lines: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Lines of cells (the rows of an array), read at ``places`` (positions in cells, from 0)
    through the cubic splines that go through all of their cells.

    The coefficients are the cells under the prefilter's response, -6z / (1 - z^2) * z^|k| for the
    pole z; each place is then a weighted sum of four of them.
    """
    n = lines.shape[1]
    if n > 1:
        gain = -6.0 * POLE / (1.0 - POLE ** 2)
        cells = np.arange(n)
        total = lines * gain
        for k in range(1, REACH + 1):
            total = total + gain * POLE ** k * (lines[:, _mirrored(cells - k, n)]
                                                + lines[:, _mirrored(cells + k, n)])
        lines = total
    base = np.floor(places).astype(int)
    t = places - base
    weights = ((1.0 - t) ** 3 / 6.0, (4.0 - 6.0 * t * t + 3.0 * t ** 3) / 6.0,
               (1.0 + 3.0 * t + 3.0 * t * t - 3.0 * t ** 3) / 6.0, t ** 3 / 6.0)
    return sum(w * lines[:, _mirrored(base + j, n)] for j, w in enumerate(weights, -1))


def _read_lines(bands: Sequence[str], out: int, corners: bool):
    """Every packed line of a batch at ``out`` places; lines of one length together."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for band in bands:
                held = columns[band]
                sizes, first = np.diff(held.offsets.to_numpy()), held.offsets.to_numpy()[:-1]
                cells = held.values.to_numpy(zero_copy_only=False)
                new = np.empty((len(held), out))
                for n in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == n)
                    a, b = _scale(n, out, corners)
                    new[own] = spline_lines(cells[first[own][:, None] + np.arange(n)],
                                            a * np.arange(out) + b)
                columns[band] = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(held) + 1) * out, pa.int32()),
                    pa.array(new.reshape(-1), from_pandas=True))
            yield pa.record_batch(columns)
    return read


def _scale(n: int, out: int, corners: bool) -> tuple[float, float]:
    """Source position of output cell i of a line of n cells is ``a * i + b``."""
    return ((n - 1.0) / max(out - 1, 1), 0.0) if corners else (n / out, n / out / 2.0 - 0.5)


def _spline(df: DataFrame, keys, bands, height: int, width: int, corners: bool) -> DataFrame:
    """Columns, then rows: an image's lines are packed, read at the new places and unpacked."""
    df = df.select(*keys, "height", "width", "row", "col",
                   *[F.col(b).cast("double").alias(b) for b in bands])
    for axis, other, out in (("col", "row", width), ("row", "col", height)):
        lines = df.groupBy(*keys, "height", "width", other).agg(
            F.array_sort(F.collect_list(F.struct(axis, *bands))).alias("line")).select(
            *keys, "height", "width", other, *[F.col(f"line.{band}").alias(band) for band in bands])
        lines = lines.mapInArrow(_read_lines(bands, out, corners), lines.schema)
        df = lines.select(*keys, "height", "width", other,
                          F.posexplode(F.arrays_zip(*bands)).alias(axis, "cell")).select(
            *keys, "height", "width", "row", "col", *[F.col(f"cell.{b}").alias(b) for b in bands])
    return df.select(*keys, "row", "col", F.lit(height).alias("height"),
                     F.lit(width).alias("width"), *bands)


def _nearest(df: DataFrame, keys, bands, height: int, width: int, corners: bool) -> DataFrame:
    """Every source cell becomes the block of cells nearest to it."""
    for axis, size, out in (("row", "height", height), ("col", "width", width)):
        a, b = _step(size, out, corners)
        low = F.ceil((F.col(axis) - 0.5 - b) / a)
        high = F.ceil((F.col(axis) + 0.5 - b) / a) - 1
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(out - 1))
        df = df.where(low <= high).withColumn(
            axis, F.explode_outer(F.sequence(low.cast("int"), high.cast("int"))))
    return df.select(*keys, "row", "col", F.lit(height).alias("height"),
                     F.lit(width).alias("width"), *bands)


def as_seen(image: DataFrame, keys: Sequence[str], value: str, scale: float, height: int,
            width: int, method: str = "spline") -> DataFrame:
    """One sample per ``scale`` block, enlarged smoothly back to the image's own grid: through the
    interpolating spline of images without holes, or by the ``cubic`` kernel."""
    step = max(int(round(scale)), 1)
    if step == 1:
        return image
    offset = step // 2
    rows, cols = -(-(height - offset) // step), -(-(width - offset) // step)
    coarse = image.where((F.col("row") % step == offset) & (F.col("col") % step == offset))
    coarse = coarse.select(*keys, F.floor(F.col("row") / step).cast("int").alias("row"),
                           F.floor(F.col("col") / step).cast("int").alias("col"), value,
                           F.lit(rows).alias("height"), F.lit(cols).alias("width"))
    return resample(coarse, keys, [value], height, width, method, corners=True)
