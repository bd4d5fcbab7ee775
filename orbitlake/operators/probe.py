"""What was measured at a point, and how uniform its neighbourhood is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import registry
from ..functions.numeric import half_even
from ..functions.spectral import index_value
from .keyed import checked_broadcast

WINDOW_PIXELS, WINDOW_MIN_M = 15, 200.0


def window_radius(kind: str) -> float:
    native = next(s["resolution"] for s in registry.SATELLITES.values() if s["kind"] == kind)
    return max(native * WINDOW_PIXELS, WINDOW_MIN_M)


def probe(pixels: DataFrame, points: DataFrame, kind: str = "optical",
          bands: Sequence[str] | None = None, radius: float | None = None,
          pixel_size: float = 10.0) -> DataFrame:
    """One row per point: each band's value at the centre, its spread, and the indices there.

    ``pixels`` carry ``x``, ``y`` (cell centres in metres), one row per scene and cell, and
    ``points`` carry ``point_id``, ``x``, ``y``.  Points meet pixels in square buckets of the
    window's size, so the join is an equi-join.  Pixels outside every point's buckets are dropped
    first; the rest are reduced to the median of their dates once, however many points share
    them.  Clouds are not masked.
    """
    bands = list(bands or registry.PROBE_BANDS[kind])
    r = radius or window_radius(kind)
    near = lambda c: F.floor((F.col(c) - r) / (2 * r)).cast("int")
    far = lambda c: F.floor((F.col(c) + r) / (2 * r)).cast("int")
    spots = (points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"),
                           near("x").alias("x0"), far("x").alias("x1"), near("y").alias("y0"),
                           far("y").alias("y1"))
             .withColumn("bx", F.explode_outer(F.sequence("x0", "x1")))
             .withColumn("by", F.explode_outer(F.sequence("y0", "y1"))).drop("x0", "x1", "y0", "y1"))
    cells = pixels.withColumns({"bx": F.floor(F.col("x") / (2 * r)).cast("int"),
                                "by": F.floor(F.col("y") / (2 * r)).cast("int")})
    spots = checked_broadcast(spots)
    wanted = cells.join(spots.select("bx", "by"), ["bx", "by"], "left_semi")
    per_cell = (wanted.groupBy("bx", "by", "x", "y").agg(*[F.median(b).alias(b) for b in bands])
                .join(spots, ["bx", "by"])
                .where((F.abs(F.col("x") - F.col("px")) <= r)
                       & (F.abs(F.col("y") - F.col("py")) <= r)))
    half = pixel_size / 2.0
    centre = ((F.col("x") - half <= F.col("px")) & (F.col("px") < F.col("x") + half)
              & (F.col("y") - half < F.col("py")) & (F.col("py") <= F.col("y") + half))
    found = per_cell.groupBy("point_id").agg(
        *[F.max(F.when(centre, F.col(b))).alias(b) for b in bands],
        *[F.stddev_pop(b).alias(f"{b}_spread") for b in bands])
    shown = [n for n in registry.PROBE_INDICES[kind]
              if set(registry.INDICES[n]["bands"]) <= set(bands)]
    found = found.withColumns({n: index_value(n) for n in shown})
    return found.select("point_id", *[
        half_even(F.col(c), 4).alias(c) for c in [*bands, *shown]], *[
        F.when(F.col(b).isNotNull(), half_even(F.col(f"{b}_spread"), 4)).alias(f"{b}_spread")
        for b in bands])
