"""Web-Mercator grids and polygon geometry as Column expressions.

A polygon is ``array<ring>``, a ring ``array<struct<lon, lat>>``; the first ring is the outer
one.  A geometry is ``array<polygon>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..registry import MAX_SIZE, MIN_SIZE
from .numeric import half_even

EARTH_RADIUS = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0)) * EARTH_RADIUS


# -- grids --------------------------------------------------------------------


def grid_columns(west: Column, south: Column, east: Column, north: Column,
                 size: int | Column, smallest: int = MIN_SIZE,
                 largest: int = MAX_SIZE) -> dict[str, Column]:
    """First stage of a grid: Mercator bounds, centre and the long side, which is kept between
    ``smallest`` and ``largest`` pixels."""
    asked = size if isinstance(size, Column) else F.lit(int(size))
    return {"x0": mercator_x(west), "y0": mercator_y(south), "x1": mercator_x(east),
            "y1": mercator_y(north), "center_lon": (west + east) / 2.0,
            "center_lat": (south + north) / 2.0,
            "long_side": F.least(F.greatest(asked, F.lit(smallest)), F.lit(largest))}


def grid_shape() -> dict[str, Column]:
    """Second stage, over the columns of :func:`grid_columns`: width and height."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short = lambda a, b: F.greatest(F.lit(MIN_SIZE // 4),
                                    F.rint(F.col("long_side") * a / b).cast("int"))
    wide = dx >= dy
    return {"width": F.when(wide, F.col("long_side")).otherwise(short(dx, dy)),
            "height": F.when(wide, short(dy, dx)).otherwise(F.col("long_side"))}


def ground_res() -> Column:
    """Metres of ground per pixel at the centre, over grid columns."""
    return ((F.col("x1") - F.col("x0")) / F.col("width")
            * F.cos(F.radians(F.col("center_lat"))))


def with_grid(df, size: int | Column, bounds=("west", "south", "east", "north"),
              smallest: int = MIN_SIZE, largest: int = MAX_SIZE):
    """Add a whole grid to a table of bounds; ``largest`` may be raised for print-size work."""
    df = df.withColumns(grid_columns(*[F.col(b) for b in bounds], size, smallest, largest))
    df = df.withColumns(grid_shape()).drop("long_side")
    return df.withColumn("ground_res_m", ground_res())


def refined(df, factor: int):
    """The same ground sampled ``factor`` times more finely."""
    factor = max(1, int(factor))
    df = df.withColumns({"width": F.col("width") * factor, "height": F.col("height") * factor})
    return df.withColumn("ground_res_m", ground_res())


def pixel_of(x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) of a Mercator position on the grid columns of its row."""
    row = F.floor((F.col("y1") - y) / ((F.col("y1") - F.col("y0")) / F.col("height")))
    col = F.floor((x - F.col("x0")) / ((F.col("x1") - F.col("x0")) / F.col("width")))
    return row.cast("int"), col.cast("int")


# -- shapes -------------------------------------------------------------------


def circle(lon: Column, lat: Column, radius_m: Column, steps: int = 96) -> Column:
    """A closed ring of ``steps`` + 1 vertices around a point."""
    d_lat = radius_m / EARTH_RADIUS
    shrink = F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))

    def vertex(i: Column) -> Column:
        theta = (i % steps).cast("double") * (2.0 * math.pi) / float(steps)
        return F.struct((lon + F.degrees(d_lat * F.sin(theta) / shrink)).alias("lon"),
                        (lat + F.degrees(d_lat * F.cos(theta))).alias("lat"))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), vertex)


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
                     for x, y in corners])


def geometry(ring: Column) -> Column:
    """A one-ring polygon as a geometry."""
    return F.array(F.array(ring))


def geojson_geometry(text: Column) -> Column:
    """Polygon, MultiPolygon, Feature, circle or bbox text to a geometry; NULL otherwise."""
    poly = "array<array<array<double>>>"
    body = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind = F.get_json_object(body, "$.type")
    rings = lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(
        v[0].alias("lon"), v[1].alias("lat"))))
    coords = F.get_json_object(body, "$.coordinates")
    num = lambda name: F.get_json_object(body, f"$.{name}").try_cast("double")
    bbox = F.from_json(F.coalesce(F.get_json_object(body, "$.bbox"), coords), "array<double>")
    is_circle = (F.coalesce(kind, F.lit("")) == "circle") | (
        num("lon").isNotNull() & num("lat").isNotNull() & num("radius").isNotNull())
    is_box = (F.coalesce(kind, F.lit("")) == "bbox") | F.get_json_object(body, "$.bbox").isNotNull()
    return (F.when(is_circle, geometry(circle(num("lon"), num("lat"), num("radius"))))
            .when(is_box, geometry(box(*[F.get(bbox, F.lit(i)) for i in range(4)])))
            .when(kind == "Polygon", F.array(rings(F.from_json(coords, poly))))
            .when(kind == "MultiPolygon",
                  F.transform(F.from_json(coords, f"array<{poly}>"), rings)))


def edges(geom: Column) -> Column:
    """All ring edges of a geometry as array<struct<x1, y1, x2, y2>>; rings are closed."""
    def of_ring(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
                         F.slice(ring, 1, 1))
        return F.zip_with(ring, after, lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"),
            b["lat"].alias("y2")))
    return F.flatten(F.flatten(F.transform(geom, lambda p: F.transform(p, of_ring))))


def bounds(geom: Column) -> dict[str, Column]:
    points = F.flatten(F.flatten(geom))
    lon, lat = points["lon"], points["lat"]
    return {"west": F.array_min(lon), "south": F.array_min(lat),
            "east": F.array_max(lon), "north": F.array_max(lat)}


def area_km2(geom: Column) -> Column:
    """Spherical-excess area: per polygon the outer ring less its holes, then summed."""
    def ring_area(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
                         F.slice(ring, 1, 1))
        parts = F.zip_with(ring, after, lambda a, b: F.radians(b["lon"] - a["lon"]) * (
            F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])) + 2.0))
        total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
        return F.abs(total) * (EARTH_RADIUS * EARTH_RADIUS / 2.0)

    def polygon_area(poly: Column) -> Column:
        outer = ring_area(F.get(poly, F.lit(0)))
        holes = F.transform(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), ring_area)
        return F.abs(outer - F.aggregate(holes, F.lit(0.0), lambda acc, v: acc + v))
    areas = F.transform(geom, polygon_area)
    return F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v) / 1e6


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether the point is inside."""
    def crossing(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"])
        return (straddles & (x < at)).cast("int")
    crossed = F.aggregate(edge_list, F.lit(0), lambda acc, e: acc + crossing(e))
    return crossed % 2 == 1


def edge_meets_box(e: Column, w: Column, s: Column, e_: Column, n: Column) -> Column:
    """Whether a segment touches a rectangle: overlapping spans and corners not all one side."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    side = lambda x, y: dx * (y - e["y1"]) - dy * (x - e["x1"])
    corners = [side(w, s), side(w, n), side(e_, s), side(e_, n)]
    apart = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
    return ((F.least(e["x1"], e["x2"]) <= e_) & (F.greatest(e["x1"], e["x2"]) >= w)
            & (F.least(e["y1"], e["y2"]) <= n) & (F.greatest(e["y1"], e["y2"]) >= s) & ~apart)


def meets_box(edge_list: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether a polygon and a rectangle share a point."""
    return (F.exists(edge_list, lambda g: edge_meets_box(g, w, s, e, n))
            | contains(edge_list, (w + e) / 2.0, (s + n) / 2.0))


def area_report(df, geom: str = "geometry"):
    """Bounds, centre and area (four decimals) of every geometry of a table."""
    df = df.withColumns(bounds(F.col(geom)))
    return df.withColumns({
        "area_km2": half_even(area_km2(F.col(geom)), 4),
        "center_lon": (F.col("west") + F.col("east")) / 2.0,
        "center_lat": (F.col("south") + F.col("north")) / 2.0})
