"""Areas, grids, clipping, resampling, probing and merge planning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from orbitlake import registry
from orbitlake.functions import geo
from orbitlake.functions.numeric import half_even
from orbitlake.operators import probe as probing
from orbitlake.operators import resample, spatial, units
from orbitlake.operators.stencil import sized
from orbitlake.plans import merging, render

from . import views
from .event_queries import AREAS, areas
from .pixel_queries import merged, optical, r6, refl_cte, rounded
from .render_queries import comp_cte
from .stencil_queries import dense, dense_cte, frames

QUERIES: dict = {}
ORACLES: dict = {}
CELL = ["frame_id", "row", "col"]
H, W = views.HEIGHT, views.WIDTH
R = "6378137e0"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


_RING = views.with_views("points") + f"""
, v AS (SELECT p.point_id, CAST(k.i AS INT) AS vertex,
  lon + degrees(radius_m / {R} * sin((k.i % 96) * 2 * pi() / 96e0) / greatest(cos(radians(lat)), 1e-9::DOUBLE)) AS lon,
  lat + degrees(radius_m / {R} * cos((k.i % 96) * 2 * pi() / 96e0)) AS lat FROM points p CROSS JOIN range(97) k(i))
"""


def circles(spark, sf_dir) -> DataFrame:
    p = views.points(spark, sf_dir)
    return p.withColumn("geometry", geo.geometry(geo.circle(*[
        F.col(c) for c in ("lon", "lat", "radius_m")])))


@query(_RING + f"SELECT point_id, vertex, {r6('lon', 8)} AS lon, {r6('lat', 8)} AS lat FROM v")
def circle(spark, sf_dir):
    ring = F.posexplode(F.get(F.get("geometry", F.lit(0)), F.lit(0))).alias("vertex", "at")
    out = circles(spark, sf_dir).select("point_id", ring).select("point_id", "vertex", "at.*")
    return rounded(out, ["lon", "lat"], 8)


@query(_RING + f"""
, e AS (SELECT *, coalesce(lead(lon) OVER w, first(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS lat2
  FROM v WINDOW w AS (PARTITION BY point_id ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT point_id, abs(sum(radians(lon2 - lon) * (2 + sin(radians(lat)) + sin(radians(lat2)))) * {R} * {R} / 2e0) / 1e6 AS a,
 min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM e GROUP BY 1)
SELECT point_id, {r6('a', 4)} AS area_km2, {r6('west')} AS west, {r6('south')} AS south, {r6('east')} AS east, {r6('north')} AS north,
 {r6('(west + east) / 2')} AS center_lon, {r6('(south + north) / 2')} AS center_lat FROM a""")
def aoi_area(spark, sf_dir):
    named = ["west", "south", "east", "north", "center_lon", "center_lat"]
    out = geo.area_report(circles(spark, sf_dir).select("point_id", "geometry"))
    return rounded(out.drop("geometry"), named)


@query(_RING + f"""
, b AS (SELECT point_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v GROUP BY 1),
m AS (SELECT *, radians(w) * {R} AS x0, radians(e) * {R} AS x1, ln(tan(pi() / 4 + radians(s) / 2)) * {R} AS y0, ln(tan(pi() / 4 + radians(n) / 2)) * {R} AS y1 FROM b),
g AS (SELECT *, CASE WHEN x1 - x0 >= y1 - y0 THEN 512 ELSE greatest(32, round_even(512 * (x1 - x0) / (y1 - y0), 0)) END AS width,
 CASE WHEN x1 - x0 >= y1 - y0 THEN greatest(32, round_even(512 * (y1 - y0) / (x1 - x0), 0)) ELSE 512 END AS height FROM m)
SELECT point_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, {r6('x0', 3)} AS x0, {r6('y0', 3)} AS y0,
 {r6('x1', 3)} AS x1, {r6('y1', 3)} AS y1, {r6('(x1 - x0) / width * cos(radians((s + n) / 2))', 3)} AS ground_res_m FROM g""")
def grid(spark, sf_dir):
    px = circles(spark, sf_dir).withColumns(geo.bounds(F.col("geometry")))
    out = geo.with_grid(px, 512).select("point_id", "width", "height", "x0", "y0", "x1", "y1",
                                        "ground_res_m")
    return rounded(out, ["x0", "y0", "x1", "y1", "ground_res_m"], 3)


@query(views.with_views("dets") + f"""
, areas AS ({AREAS}), v AS (SELECT aoi_id, unnest([{{'x1': w, 'y1': s, 'x2': w + 12, 'y2': s}},
  {{'x1': w + 12, 'y1': s, 'x2': w + 4, 'y2': s + 9}}, {{'x1': w + 4, 'y1': s + 9, 'x2': w, 'y2': s}}]) AS e FROM areas),
c AS (SELECT d.ordinal, v.aoi_id FROM dets d JOIN v ON (e.y1 > lat) <> (e.y2 > lat) AND lon < e.x1 + (e.x2 - e.x1) * ((lat - e.y1) / (e.y2 - e.y1)))
SELECT ordinal, aoi_id FROM c GROUP BY ALL HAVING count(*) % 2 = 1""")
def point_in_aoi(spark, sf_dir):
    return spatial.points_in_areas(views.dets(spark, sf_dir).select("ordinal", "lon", "lat"),
                                   areas(spark, sf_dir)).select("ordinal", "aoi_id")


_GON = f"""
, fr AS (SELECT DISTINCT frame_id FROM obs),
gv AS (SELECT frame_id, k.i, 64e0 + (20 + frame_id % 10) * cos(k.i * 2 * pi() / 24e0) AS x, 32e0 + (20 + frame_id % 10) * sin(k.i * 2 * pi() / 24e0) AS y FROM fr CROSS JOIN range(25) k(i)),
ge AS (SELECT frame_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM gv WINDOW w AS (PARTITION BY frame_id ORDER BY i)),
cx AS (SELECT c.frame_id, c."row", c.col,
  sum(CASE WHEN (y1 > c."row" + 0.5e0) <> (y2 > c."row" + 0.5e0) AND c.col + 0.5e0 < x1 + (x2 - x1) * (c."row" + 0.5e0 - y1) / (y2 - y1) THEN 1 ELSE 0 END) AS n,
  bool_or(least(x1, x2) <= c.col + 1 AND greatest(x1, x2) >= c.col AND least(y1, y2) <= c."row" + 1 AND greatest(y1, y2) >= c."row"
   AND NOT (least((x2-x1)*(c."row"-y1)-(y2-y1)*(c.col-x1), (x2-x1)*(c."row"+1-y1)-(y2-y1)*(c.col-x1), (x2-x1)*(c."row"-y1)-(y2-y1)*(c.col+1-x1), (x2-x1)*(c."row"+1-y1)-(y2-y1)*(c.col+1-x1)) > 0
     OR greatest((x2-x1)*(c."row"-y1)-(y2-y1)*(c.col-x1), (x2-x1)*(c."row"+1-y1)-(y2-y1)*(c.col-x1), (x2-x1)*(c."row"-y1)-(y2-y1)*(c.col+1-x1), (x2-x1)*(c."row"+1-y1)-(y2-y1)*(c.col+1-x1)) < 0)) AS touched
  FROM comp c JOIN ge ON ge.frame_id = c.frame_id WHERE x2 IS NOT NULL GROUP BY ALL)
"""


def outlines(spark, sf_dir) -> DataFrame:
    """A 24-sided outline per frame, in pixel units."""
    r = F.lit(20) + F.col("frame_id") % 10
    angle = lambda i: i * (2.0 * math.pi) / 24.0
    x = lambda i: F.lit(64.0) + r * F.cos(angle(i))
    y = lambda i: F.lit(32.0) + r * F.sin(angle(i))
    edge = lambda i: F.struct(x(i).alias("x1"), y(i).alias("y1"), x(i + 1).alias("x2"),
                              y(i + 1).alias("y2"))
    return frames(spark, sf_dir).withColumn(
        "edges", F.transform(F.sequence(F.lit(0), F.lit(23)), edge))


@query(comp_cte(("red",)) + _GON + f"""
SELECT c.frame_id, c."row", c.col, {r6('CASE WHEN x.n % 2 = 1 OR x.touched THEN c.red END')} AS red
FROM comp c JOIN cx x USING (frame_id, "row", col)""")
def clip(spark, sf_dir):
    px = spatial.clip_to_area(merged(spark, sf_dir, ("red",)), outlines(spark, sf_dir), ["red"])
    return rounded(px, ["red"])


def steady(expr: str) -> str:
    """Six decimals, with exact halves moved off the boundary that summing order decides."""
    return f"round_even(({expr}) * 1e6 + 1e-3, 0) / 1e6"


def _kernel_sql(d: str, method: str) -> str:
    if method == "bilinear":
        return f"greatest(1e0 - abs({d}), 0e0)"
    a = f"abs({d})"
    return (f"CASE WHEN {a} < 1 THEN ({a} * 1.5e0 - 2.5e0) * {a} * {a} + 1e0 "
            f"WHEN {a} < 2 THEN (({a} * -0.5e0 + 2.5e0) * {a} - 4e0) * {a} + 2e0 ELSE 0e0 END")


def _resample_sql(method: str, h: int, w: int) -> str:
    reach = {"bilinear": 1, "cubic": 2}[method]

    def axis(n_in: int, n_out: int, name: str) -> str:
        ratio = n_in / n_out
        pos = f"({ratio!r}::DOUBLE * o.i + {ratio / 2 - 0.5!r}::DOUBLE)"
        return (f"{name} AS (SELECT CAST(o.i AS INT) AS o, s.i AS s, {_kernel_sql(f'{pos} - s.i', method)} AS w "
                f"FROM range({n_out}) o(i) JOIN range({n_in}) s(i) ON abs({pos} - s.i) <= {reach})")
    return comp_cte(("red",)) + f""", {axis(H, h, 'ay')}, {axis(W, w, 'ax')}
SELECT c.frame_id, ay.o AS "row", ax.o AS col, {steady('sum(ay.w * ax.w * c.red) / nullif(sum(CASE WHEN c.red IS NOT NULL THEN ay.w * ax.w END), 0)')} AS red
FROM comp c JOIN ay ON ay.s = c."row" JOIN ax ON ax.s = c.col WHERE c.red IS NOT NULL
GROUP BY ALL HAVING abs(sum(ay.w * ax.w)) > 1e-6::DOUBLE"""


def _resampled(spark, sf_dir, method: str, h: int, w: int) -> DataFrame:
    px = sized(merged(spark, sf_dir, ("red",)), H, W).where("red is not null")
    out = resample.resample(px, ["frame_id"], ["red"], h, w, method).where("red is not null")
    return out.select(*CELL, (F.rint(F.col("red") * 1e6 + 1e-3) / 1e6).alias("red"))


@query(_resample_sql("bilinear", 96, 192))
def resample_bilinear(spark, sf_dir):
    return _resampled(spark, sf_dir, "bilinear", 96, 192)


@query(comp_cte(("red",)) + f"""
SELECT c.frame_id, CAST(a.i AS INT) AS "row", CAST(b.i AS INT) AS col, {r6('c.red')} AS red FROM comp c
JOIN range(160) a(i) ON CAST(floor((a.i + 0.5e0) * {H} / 160e0) AS INT) = c."row"
JOIN range(320) b(i) ON CAST(floor((b.i + 0.5e0) * {W} / 320e0) AS INT) = c.col WHERE c.red IS NOT NULL""")
def resample_nearest(spark, sf_dir):
    return _resampled(spark, sf_dir, "nearest", 160, 320)


def resample_cubic(spark, sf_dir):
    return _resampled(spark, sf_dir, "cubic", 128, 256)


QUERIES["resample_cubic"] = resample_cubic
ORACLES["resample_cubic"] = _resample_sql("cubic", 128, 256)

#: A grid twice as fine as the 10 m bands, which fuses frames of several dates: even frames have
#: two, odd ones one.  nir stands for a band of 20 m, of every second row and column.
_FINE = (2 * H, 2 * W)
_CHOSEN = "scene_ord = 1 OR scene_ord = 2 AND frame_id % 2 = 0"


def _regridded_sql() -> str:
    def axis(n_in: int, n_out: int, name: str) -> str:
        ratio = n_in / n_out
        pos = f"({ratio!r}::DOUBLE * o.i + {ratio / 2 - 0.5!r}::DOUBLE)"
        return (f"{name} AS (SELECT CAST(o.i AS INT) AS o, s.i AS s, {_kernel_sql(f'{pos} - s.i', 'cubic')} AS w "
                f"FROM range({n_out}) o(i) JOIN range({n_in}) s(i) ON abs({pos} - s.i) <= 2)")

    def cubic(band: str, table: str, y: str, x: str) -> str:
        return (f"""SELECT c.frame_id, c.scene_ord, ay.o AS "row", ax.o AS col, sum(ay.w * ax.w * c.{band}) / """
                f"""nullif(sum(ay.w * ax.w), 0) AS {band} FROM {table} c JOIN {y} ay ON ay.s = c."row" JOIN {x} ax """
                f"""ON ax.s = c.col JOIN plan USING (frame_id) WHERE c.{band} IS NOT NULL AND plan.n = 1 GROUP BY ALL """
                f"""HAVING abs(sum(ay.w * ax.w)) > 1e-9::DOUBLE""")

    def nearest(column: str, table: str, step: int, only: str) -> str:
        return (f"""SELECT c.frame_id, c.scene_ord, CAST(c."row" * {step} + a.i AS INT) AS "row", CAST(c.col * {step} + b.i AS INT) AS col, """
                f"""c.{column} FROM {table} c JOIN plan USING (frame_id), range({step}) a(i), range({step}) b(i) """
                f"""WHERE c.{column} IS NOT NULL AND {only}""")
    return views.with_views("obs") + f"""
, px1 AS (SELECT frame_id, scene_ord, "row", col, nullif(dn_red, 0)::DOUBLE AS red, nullif(dn_nir, 0)::DOUBLE AS nir FROM obs WHERE {_CHOSEN}), half AS (SELECT frame_id, scene_ord, "row" // 2 AS "row", col // 2 AS col, nir FROM px1
 WHERE "row" % 2 = 0 AND col % 2 = 0), plan AS (SELECT frame_id, count(DISTINCT scene_ord) AS n FROM px1 GROUP BY 1),
o1 AS (SELECT frame_id, scene_ord, "row", col, scl FROM obs WHERE {_CHOSEN}),
{axis(H, 2 * H, 'ay1')}, {axis(W, 2 * W, 'ax1')}, {axis(H // 2, 2 * H, 'ay2')}, {axis(W // 2, 2 * W, 'ax2')},
red AS ({cubic('red', 'px1', 'ay1', 'ax1')} UNION ALL {nearest('red', 'px1', 2, 'plan.n = 2')}),
nir AS ({cubic('nir', 'half', 'ay2', 'ax2')} UNION ALL {nearest('nir', 'half', 4, 'plan.n = 2')}),
scl AS ({nearest('scl', 'o1', 2, 'true')})
SELECT frame_id, scene_ord, "row", col, {r6('red.red', 5)} AS red, {r6('nir.nir', 5)} AS nir, scl
FROM red FULL JOIN nir USING (frame_id, scene_ord, "row", col) FULL JOIN scl USING (frame_id, scene_ord, "row", col)"""


@query(_regridded_sql())
def render_regridded(spark, sf_dir):
    """A render's stack on its grid, from bands of two sizes and frames that do and don't merge."""
    # stored numbers: sums of whole numbers by these weights have no rounding that could differ
    px = views.obs(spark, sf_dir).where(_CHOSEN).withColumns({
        b: F.nullif(F.col(f"dn_{b}"), F.lit(0)).cast("double") for b in ("red", "nir")})
    cell = ["frame_id", "scene_ord", "row", "col"]
    half = px.where("row % 2 = 0 AND col % 2 = 0").select(
        "frame_id", "scene_ord", (F.col("row") / 2).cast("int").alias("row"),
        (F.col("col") / 2).cast("int").alias("col"), "nir")
    tables = {(H, W): px.select(*cell, "red", "scl"), (H // 2, W // 2): half}
    sat = registry.satellite("sentinel-2")
    plan = render.frame_plans(px.select("frame_id", "scene_ord").distinct(), sat, 5.0, {},
                              ["frame_id"], "scene_ord")
    out = render.on_grid(tables, plan, sat, _FINE, 5.0, ["red", "nir"], ["frame_id"], "scene_ord",
                         classes=True)
    out = out.where("red is not null or nir is not null or scl is not null")
    return rounded(out.select(*cell, "red", "nir", "scl"), ["red", "nir"], 5)


_SPOTS = """
SELECT s_suppkey AS point_id, CAST((s_suppkey * 377) % 1280 + (s_suppkey % 20) * 2000 AS DOUBLE) + 0.25e0 AS x,
       -CAST((s_suppkey * 211) % 640 AS DOUBLE) - 0.25e0 AS y FROM supplier
"""
_PB = ("blue", "green", "red", "nir", "swir16")


@query(refl_cte(_PB) + f"""
, spots AS ({_SPOTS}), xy AS (SELECT *, col * 10e0 + 5e0 + frame_id * 2000e0 AS x, -("row" * 10e0 + 5e0) AS y FROM px),
cell AS (SELECT s.point_id, s.x AS sx, s.y AS sy, p.x, p.y, {', '.join(f'median(p.{b}) AS {b}' for b in _PB)}
  FROM xy p JOIN spots s ON abs(p.x - s.x) <= 200 AND abs(p.y - s.y) <= 200 GROUP BY ALL),
hr AS (SELECT *, x - 5 <= sx AND sx < x + 5 AND y - 5 < sy AND sy <= y + 5 AS here FROM cell),
f AS (SELECT point_id, {', '.join(f'max(CASE WHEN here THEN {b} END) AS {b}, stddev_pop({b}) AS {b}_s' for b in _PB)} FROM hr GROUP BY 1)
SELECT point_id, {', '.join(f'{r6(b, 4)} AS {b}, CASE WHEN {b} IS NOT NULL THEN {r6(b + "_s", 4)} END AS {b}_spread' for b in _PB)},
 {r6('(nir - red) / nullif(nir + red, 0)', 4)} AS ndvi, {r6('(green - nir) / nullif(green + nir, 0)', 4)} AS ndwi,
 {r6('(swir16 - nir) / nullif(swir16 + nir, 0)', 4)} AS ndbi FROM f""")
def probe(spark, sf_dir):
    px = optical(spark, sf_dir, _PB)
    px = px.withColumns({"x": F.col("col") * 10.0 + 5.0 + F.col("frame_id") * 2000.0,
                         "y": -(F.col("row") * 10.0 + 5.0)})
    spots = spark.sql(_SPOTS.replace("FROM supplier", "FROM {supplier}"),
                      supplier=views.table(spark, sf_dir, "supplier"))
    return probing.probe(px, spots)


@query(views.with_views("cat") + f"""
, g AS (SELECT west, south, satellite, count(*) AS scenes, (abs(west) + 1) / 12e0 AS gr FROM cat GROUP BY ALL),
p AS (SELECT *, CASE satellite WHEN 'sentinel-2' THEN 10 ELSE 20 END / gr AS over, satellite = 'sentinel-2' AS can,
 CASE WHEN scenes >= 9 THEN 4 WHEN scenes >= 5 THEN 3 WHEN scenes >= 2 THEN 2 ELSE 1 END AS sup FROM g),
q AS (SELECT *, can AND scenes > 1 AND sup > 1 AND over > 1.2e0 AS sharpening, NOT can AND scenes > 1 AS despeckling FROM p)
SELECT west, south, satellite, scenes, sharpening, despeckling, {r6('over', 2)} AS oversampling,
 CAST(CASE WHEN can THEN sup ELSE 1 END AS INT) AS supported, {r6('CASE WHEN sharpening THEN least(over, sup) ELSE 1e0 END')} AS resolves,
 scenes >= 2 AND can AND sup > 1 AND over < sup AS size_limited, CAST(CASE WHEN can AND sup > 1 THEN sup * sup ELSE 2 END AS INT) AS frames_wanted, {r6('CASE WHEN despeckling THEN 1 - 1 / sqrt(scenes) END')} AS speckle_drop,
 CASE WHEN scenes <= 1 THEN 'single' WHEN sharpening THEN 'fuse' WHEN despeckling THEN 'mean' ELSE 'median' END AS method FROM q""")
def merge_plan(spark, sf_dir):
    groups = merging.group_scenes(views.cat(spark, sf_dir), ["west", "south"])
    groups = groups.withColumn("ground_res_m", (F.abs("west") + 1) / 12.0)
    out = merging.merge_method(merging.merge_plan(groups)).drop("ground_res_m")
    return rounded(out, ["resolves", "speckle_drop"])


@query(views.with_views("obs") + """
, fine AS (SELECT frame_id, scene_ord, "row", col, CAST(dn_red AS DOUBLE) AS red, CAST(dn_nir AS DOUBLE) AS nir FROM obs),
coarse AS (SELECT frame_id, scene_ord, "row" // 2 AS r, col // 2 AS c, max(dn_swir16) AS swir16 FROM obs WHERE "row" % 2 = 0 AND col % 2 = 0 GROUP BY ALL)
SELECT f.*, CAST(c.swir16 AS DOUBLE) AS swir16 FROM fine f LEFT JOIN coarse c ON c.frame_id = f.frame_id AND c.scene_ord = f.scene_ord
 AND c.r = f."row" // 2 AND c.c = f.col // 2""")
def band_alignment(spark, sf_dir):
    px = views.obs(spark, sf_dir)
    at = ["frame_id", "scene_ord", "row", "col"]
    coarse = px.where("row % 2 = 0 and col % 2 = 0").select(
        "frame_id", "scene_ord", (F.col("row") / 2).cast("int").alias("row"),
        (F.col("col") / 2).cast("int").alias("col"), F.col("dn_swir16").alias("value"))
    return units.align_bands({"red": (px.select(*at, F.col("dn_red").alias("value")), 1),
                              "nir": (px.select(*at, F.col("dn_nir").alias("value")), 1),
                              "swir16": (coarse, 2)}, at)


@query(comp_cte(("red",)) + f"""
SELECT frame_id, "row" - 16 AS "row", col - 32 AS col, {r6('red')} AS red FROM comp
WHERE "row" BETWEEN 16 AND 47 AND col BETWEEN 32 AND 95""")
def crop(spark, sf_dir):
    bounds = (0.0, 0.0, 1280.0, 640.0)
    px = spatial.crop(merged(spark, sf_dir, ("red",)), (960.0, 480.0, 320.0, 160.0), bounds, H, W)
    return rounded(px, ["red"])


@query(comp_cte(("red",)) + f"""
, xy AS (SELECT frame_id, "row", col, (col + 0.5e0) * 10e0 AS x, -("row" + 0.5e0) * 10e0 AS y, red FROM comp)
SELECT frame_id, CAST(floor((0e0 - y) / 20e0) AS INT) AS "row", CAST(floor(x / 20e0) AS INT) AS col, {r6('max(red)')} AS red
FROM xy GROUP BY ALL""")
def pixel_assignment(spark, sf_dir):
    px = merged(spark, sf_dir, ("red",)).withColumns({
        "x": (F.col("col") + 0.5) * 10.0, "y": -(F.col("row") + 0.5) * 10.0,
        "x0": F.lit(0.0), "x1": F.lit(1280.0), "y0": F.lit(-640.0), "y1": F.lit(0.0),
        "width": F.lit(64), "height": F.lit(32)})
    row, col = geo.pixel_of(F.col("x"), F.col("y"))
    px = px.select("frame_id", row.alias("row"), col.alias("col"), "red")
    return px.groupBy(*CELL).agg(half_even(F.max("red"), 6).alias("red"))


#: The cubic B-spline and its prefilter's response by the pole sqrt(3) - 2, mirrored in the
#: outermost cells.
_POLE = 3.0 ** 0.5 - 2.0


def _mirror_sql(i: str, n: int) -> str:
    turn = 2 * (n - 1)
    return f"least((({i}) % {turn} + {turn}) % {turn}, {turn} - (({i}) % {turn} + {turn}) % {turn})"


def _as_seen_sql(step: int = 2) -> str:
    rows, cols = H // step, W // step

    def axis(n_in: int, n_out: int, name: str) -> str:
        pos = f"(o.i * {(n_in - 1) / (n_out - 1)!r}::DOUBLE)"
        d = f"abs({pos} - j.i)"
        spline = (f"CASE WHEN {d} < 1 THEN (4e0 - 6e0 * {d} * {d} + 3e0 * {d} * {d} * {d}) / 6e0 "
                  f"ELSE (2e0 - {d}) * (2e0 - {d}) * (2e0 - {d}) / 6e0 END")
        response = f"{-6 * _POLE / (1 - _POLE ** 2)!r}::DOUBLE * pow({_POLE!r}::DOUBLE, abs(k.i))"
        source = _mirror_sql(f"{_mirror_sql('j.i', n_in)} + k.i", n_in)
        return (f"{name} AS (SELECT CAST(o.i AS INT) AS o, {source} AS s, sum(({spline}) * {response}) AS w "
                f"FROM range({n_out}) o(i) JOIN range(-1, {n_in + 1}) j(i) ON {d} < 2, range(-25, 26) k(i) GROUP BY 1, 2)")
    return dense_cte() + f""", {axis(rows, H, 'ay')}, {axis(cols, W, 'ax')},
co AS (SELECT frame_id, "row" // {step} AS r, col // {step} AS c, v FROM d WHERE "row" % {step} = {step // 2} AND col % {step} = {step // 2}),
half AS (SELECT co.frame_id, co.r, ax.o AS col, sum(ax.w * co.v) AS v FROM co JOIN ax ON ax.s = co.c GROUP BY ALL)
SELECT half.frame_id, ay.o AS "row", half.col, {r6('sum(ay.w * half.v)')} AS red
FROM half JOIN ay ON ay.s = half.r GROUP BY ALL"""


@query(_as_seen_sql())
def as_seen(spark, sf_dir):
    out = resample.as_seen(dense(spark, sf_dir), ["frame_id"], "red", 2.0, H, W)
    return rounded(out.select(*CELL, "red"), ["red"])
