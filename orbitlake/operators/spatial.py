"""Spatial joins on a degree grid, and clipping pixels to a polygon by scan lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import contains, edges, meets_box
from .keyed import checked_broadcast

CELL_DEGREES = 5.0
BOUNDS = ("west", "south", "east", "north")


def _edge_bytes() -> Column:
    """Bytes of a row's edges: four doubles and a header each."""
    return F.coalesce(F.size("__edges"), F.lit(0)).cast("long") * 48


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _covering(df: DataFrame, size: float, prefix: str = "__") -> DataFrame:
    """One row per grid bucket a row's bounds reach, with the lowest bucket alongside."""
    df = df.withColumns({f"{prefix}x0": _bucket(F.col("west"), size),
                         f"{prefix}y0": _bucket(F.col("south"), size)})
    return (df.withColumn("__cx", F.explode_outer(F.sequence(F.col(f"{prefix}x0"),
                                                       _bucket(F.col("east"), size))))
            .withColumn("__cy", F.explode_outer(F.sequence(F.col(f"{prefix}y0"),
                                                     _bucket(F.col("north"), size)))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str = "lon", y: str = "lat",
                    cell: float = CELL_DEGREES, small: str = "boxes",
                    extra: Column | None = None) -> DataFrame:
    """Every (point, box) pair with the point in the box, as an equi-join on grid buckets.

    ``small`` names the side that may be broadcast if its counted size allows; ``extra`` counts
    the bytes of arrays that a box row carries.
    """
    keyed = points.withColumns({"__cx": _bucket(F.col(x), cell), "__cy": _bucket(F.col(y), cell)})
    cover = _covering(boxes, cell).drop("__x0", "__y0")
    if small == "boxes":
        cover = checked_broadcast(cover, extra=extra)
    else:
        keyed = checked_broadcast(keyed)
    inside = (F.col(x).between(F.col("west"), F.col("east"))
              & F.col(y).between(F.col("south"), F.col("north")))
    return keyed.join(cover, ["__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def points_in_areas(points: DataFrame, areas: DataFrame, x: str = "lon", y: str = "lat",
                    cell: float = CELL_DEGREES) -> DataFrame:
    """Every (point, area) pair with the point inside the area's ``geometry``."""
    shaped = areas.withColumn("__edges", edges(F.col("geometry"))).drop("geometry")
    near = points_in_boxes(points, shaped, x, y, cell, extra=_edge_bytes())
    return near.where(contains(F.col("__edges"), F.col(x), F.col(y))).drop("__edges", *BOUNDS)


def areas_meet_boxes(areas: DataFrame, boxes: DataFrame,
                     cell: float = CELL_DEGREES) -> DataFrame:
    """Every (area, box row) pair that shares ground.

    Both sides are spread over grid buckets; a pair is kept only in the lowest bucket they
    share, so no de-duplication is needed.
    """
    left = _covering(areas.withColumn("__edges", edges(F.col("geometry"))).drop("geometry"),
                     cell, "__a")
    left = checked_broadcast(left.drop(*BOUNDS), extra=_edge_bytes())
    right = _covering(boxes, cell, "__b")
    first = ((F.col("__cx") == F.greatest("__ax0", "__bx0"))
             & (F.col("__cy") == F.greatest("__ay0", "__by0")))
    pairs = right.join(left, ["__cx", "__cy"]).where(first)
    return pairs.where(meets_box(F.col("__edges"), *[F.col(b) for b in BOUNDS])).drop(
        "__edges", "__cx", "__cy", "__ax0", "__ay0", "__bx0", "__by0")


# -- clipping -----------------------------------------------------------------


def clip_spans(outlines: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Runs of columns each frame row keeps, from outlines in pixel units.

    ``outlines`` has the keys, ``height``, ``width`` and ``edges`` (x right, y down, one unit
    per pixel).  A pixel is kept when its centre is inside or an edge passes through it.  Work
    grows with the outline's length in pixels, not with the area inside it.
    """
    keys = list(keys)
    e = (outlines.select(*keys, "height", "width", F.explode_outer("edges").alias("e"))
         .where("e is not null").select(*keys, "height", "width", "e.*"))
    e = e.withColumns({"__lo": F.least("y1", "y2"), "__hi": F.greatest("y1", "y2")})
    # Outer explodes throughout: an inner one makes the optimiser test the computed array in a
    # filter of its own, evaluating it twice and far below where it belongs.
    rows = lambda a, b: F.explode_outer(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast(
        "array<int>")))
    x_at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.coalesce(
        F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")), F.lit(0.0))

    first = F.greatest(F.ceil(F.col("__lo") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("__hi") - 0.5) - 1, F.col("height") - 1).cast("int")
    crossings = (e.withColumn("row", rows(first, last))
                 .withColumn("x", x_at(F.col("row") + 0.5)))
    line = Window.partitionBy(*keys, "row").orderBy("x")
    inner = (crossings.withColumn("n", F.row_number().over(line))
             .withColumn("until", F.lead("x").over(line)).where("n % 2 = 1")
             .select(*keys, "row", "width", F.ceil(F.col("x") - 0.5).cast("int").alias("c0"),
                     (F.ceil(F.col("until") - 0.5) - 1).cast("int").alias("c1")))

    # Cells are closed: an edge that runs along or ends on a cell border touches both cells.
    top = F.greatest(F.ceil("__lo") - 1, F.lit(0)).cast("int")
    bottom = F.least(F.floor("__hi"), F.col("height") - 1).cast("int")
    passed = e.withColumn("row", rows(top, bottom))
    upper = F.greatest(F.col("__lo"), F.col("row").cast("double"))
    lower = F.least(F.col("__hi"), F.col("row") + 1.0)
    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.col("x1")).otherwise(x_at(upper))
    xb = F.when(flat, F.col("x2")).otherwise(x_at(lower))
    touched = passed.select(*keys, "row", "width",
                            (F.ceil(F.least(xa, xb)) - 1).cast("int").alias("c0"),
                            F.floor(F.greatest(xa, xb)).cast("int").alias("c1"))

    spans = inner.unionByName(touched).withColumns({
        "c0": F.greatest("c0", F.lit(0)), "c1": F.least("c1", F.col("width") - 1)})
    spans = spans.where("row is not null and c1 >= c0").drop("width")
    seen = Window.partitionBy(*keys, "row").orderBy("c0", "c1")
    before = F.max("c1").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("c0") > F.coalesce(before, F.lit(-2)) + 1, 1).otherwise(0)
    return (spans.withColumn("__new", starts)
            .withColumn("__run", F.sum("__new").over(
                seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*keys, "row", "__run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
            .drop("__run"))


def clip_to_area(pixels: DataFrame, outlines: DataFrame, bands: Sequence[str],
                 keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """NULL every band outside the frame's outline."""
    spans = checked_broadcast(clip_spans(outlines, keys).withColumnRenamed("row", "__row"))
    on = [pixels[k] == spans[k] for k in keys]
    on += [pixels["row"] == spans["__row"], pixels["col"].between(spans["c0"], spans["c1"])]
    inside = F.col("c0").isNotNull()
    joined = pixels.join(spans, on, "left")
    return joined.select(*[
        F.when(inside, pixels[c]).alias(c) if c in bands else pixels[c] for c in pixels.columns])


def crop(pixels: DataFrame, rect: tuple[float, float, float, float],
         bounds: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """The pixels inside a Mercator rectangle, renumbered from its corner.

    Corners may come in any order; parts outside the frame are dropped.  Halves round up.
    """
    gx0, gy0, gx1, gy1 = bounds
    left, right = sorted((rect[0], rect[2]))
    bottom, top = sorted((rect[1], rect[3]))
    share = lambda v: min(1.0, max(0.0, v))
    fx0, fx1 = share((left - gx0) / (gx1 - gx0)), share((right - gx0) / (gx1 - gx0))
    fy0, fy1 = share((gy1 - top) / (gy1 - gy0)), share((gy1 - bottom) / (gy1 - gy0))
    nearest = lambda v: int(v + 0.5)
    c0, r0 = nearest(fx0 * width), nearest(fy0 * height)
    n_cols = max(1, nearest((fx1 - fx0) * width))
    n_rows = max(1, nearest((fy1 - fy0) * height))
    if fx1 <= fx0 or fy1 <= fy0:
        return pixels.where(F.lit(False))
    kept = pixels.where(F.col("row").between(r0, r0 + n_rows - 1)
                        & F.col("col").between(c0, c0 + n_cols - 1))
    return kept.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
