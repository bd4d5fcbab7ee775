"""Neighbourhood filters over the composited stack, made dense at each frame's mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orbitlake import materialise
from orbitlake.functions.tone import gaussian_weights
from orbitlake.operators import measure, stencil

from . import views
from .pixel_queries import merged, r6, rounded
from .render_queries import UNIT, comp_cte, unit_picture

QUERIES: dict = {}
ORACLES: dict = {}
KEYS = ["frame_id"]
CELL = ["frame_id", "row", "col"]
TILE = 64
H, W = views.HEIGHT, views.WIDTH


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def frames(spark, sf_dir) -> DataFrame:
    return views.images(spark, sf_dir).select("frame_id", "height", "width").distinct()


def padded(spark, sf_dir, halo: int, fill="mean") -> DataFrame:
    """Tiled red composite with every cell present; ``red_ok`` marks the measured ones."""
    # Read twice below, for the fill and for the image: written once, as a render does.
    px = materialise(stencil.sized(merged(spark, sf_dir, ("red",)), H, W))
    value = stencil.band_means(px, KEYS, ["red"]) if fill == "mean" else fill
    return stencil.pad_tiles(px, KEYS, ["red"], halo, TILE, frames=frames(spark, sf_dir),
                             fill=value)


def dense(spark, sf_dir) -> DataFrame:
    return stencil.crop_tiles(padded(spark, sf_dir, 0))


def mirror(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END"


def dense_cte(fill: str = "coalesce(m.m, 0e0)") -> str:
    return comp_cte(("red",)) + f"""
, fr AS (SELECT DISTINCT frame_id FROM obs), mn AS (SELECT frame_id, avg(red) AS m FROM comp GROUP BY 1),
d AS (SELECT fr.frame_id, CAST(a.i AS INT) AS "row", CAST(b.i AS INT) AS col, coalesce(c.red, {fill}) AS v, c.red IS NOT NULL AS ok
  FROM fr CROSS JOIN range({H}) a(i) CROSS JOIN range({W}) b(i) JOIN mn m ON m.frame_id = fr.frame_id
  LEFT JOIN comp c ON c.frame_id = fr.frame_id AND c."row" = a.i AND c.col = b.i)
"""


def blur_cte(src: str, value: str, out: str, sigma: float) -> str:
    """CTE ``out`` (frame_id, row, col, v): separable blur of ``src.value``."""
    ws = gaussian_weights(sigma)
    r = len(ws) // 2
    taps = ", ".join(f"({k - r}, {w!r}::DOUBLE)" for k, w in enumerate(ws))
    return f"""
, {out}_w AS (SELECT * FROM (VALUES {taps}) t(k, w)),
{out}_h AS (SELECT c.frame_id, c."row", c.col, sum(w.w * s.{value}) AS v FROM {src} c CROSS JOIN {out}_w w
  JOIN {src} s ON s.frame_id = c.frame_id AND s."row" = c."row" AND s.col = {mirror('c.col + w.k', W)} GROUP BY ALL),
{out} AS (SELECT c.frame_id, c."row", c.col, sum(w.w * s.v) AS v FROM {out}_h c CROSS JOIN {out}_w w
  JOIN {out}_h s ON s.frame_id = c.frame_id AND s.col = c.col AND s."row" = {mirror('c."row" + w.k', H)} GROUP BY ALL)
"""


def window_cte(src: str, value: str, out: str, size: int, agg: str) -> str:
    r = size // 2
    return f"""
, {out} AS (SELECT c.frame_id, c."row", c.col, {agg.format(v=f's.{value}')}
  FROM {src} c CROSS JOIN range({-r}, {r + 1}) a(k) CROSS JOIN range({-r}, {r + 1}) b(k)
  JOIN {src} s ON s.frame_id = c.frame_id AND s."row" = {mirror('c."row" + a.k', H)}
   AND s.col = {mirror('c.col + b.k', W)} GROUP BY c.frame_id, c."row", c.col)
"""


@query(dense_cte() + blur_cte("d", "v", "g", 0.8) +
       f'SELECT frame_id, "row", col, {r6("v")} AS red FROM g')
def gauss(spark, sf_dir):
    wide = padded(spark, sf_dir, stencil.radius_of(0.8))
    out = stencil.crop_tiles(stencil.gaussian(wide, KEYS, {"red": "red"}, 0.8))
    return rounded(out.select(*CELL, "red"), ["red"])


@query(dense_cte() + window_cte("d", "v", "g", 3, "avg({v}) AS v") +
       f'SELECT frame_id, "row", col, {r6("v")} AS red FROM g')
def box(spark, sf_dir):
    out = stencil.crop_tiles(stencil.box_mean(padded(spark, sf_dir, 1), KEYS, ["red"], 3))
    return rounded(out.select(*CELL, "red"), ["red"])


@query(dense_cte() + window_cte("d", "v", "g", 3, "median({v}) AS v") +
       f'SELECT frame_id, "row", col, {r6("v")} AS red FROM g')
def median3(spark, sf_dir):
    wide = stencil.median_filter(padded(spark, sf_dir, 1), KEYS, {"red": "red"}, 3)
    return rounded(stencil.crop_tiles(wide).select(*CELL, "red"), ["red"])


@query(dense_cte() + window_cte("d", "v", "g", 3, "min({v}) AS lo, max({v}) AS hi") +
       f'SELECT frame_id, "row", col, {r6("lo")} AS lo, {r6("hi")} AS hi FROM g')
def local_range(spark, sf_dir):
    wide = stencil.local_range(padded(spark, sf_dir, 1), KEYS, ["red"])
    out = stencil.crop_tiles(wide).select(*CELL, F.col("red_lo").alias("lo"),
                                          F.col("red_hi").alias("hi"))
    return rounded(out, ["lo", "hi"])


@query(dense_cte("0e0") + window_cte("d", "v", "g", 3, "median({v}) AS m") + f"""
SELECT d.frame_id, d."row", d.col, {r6('CASE WHEN ok THEN v * (1e0 - 0.4e0 / 0.66e0) + m * (0.4e0 / 0.66e0) END')} AS red
FROM d JOIN g USING (frame_id, "row", col)""")
def denoise(spark, sf_dir):
    px = stencil.sized(merged(spark, sf_dir, ("red",)), H, W)
    out = stencil.denoise(px, KEYS, ["red"], 0.4, frames(spark, sf_dir), TILE)
    return rounded(out.select(*CELL, "red"), ["red"])


_UD = UNIT + f"""
, fr AS (SELECT DISTINCT frame_id FROM obs),
d AS (SELECT fr.frame_id, CAST(a.i AS INT) AS "row", CAST(b.i AS INT) AS col, coalesce(u.r, 0e0) AS r, coalesce(u.g, 0e0) AS g
  FROM fr CROSS JOIN range({H}) a(i) CROSS JOIN range({W}) b(i)
  LEFT JOIN u ON u.frame_id = fr.frame_id AND u."row" = a.i AND u.col = b.i)
"""


@query(_UD + blur_cte("d", "r", "br", 1.2) + blur_cte("d", "g", "bg", 1.2) +
       'SELECT d.frame_id, d."row", d.col, ' + ", ".join(r6(
           f"least(greatest({c} + least(greatest({c} - b{c}.v, -0.1e0), 0.1e0) * 0.45e0, 0e0), 1e0)")
           + f" AS {c}" for c in "rg") +
       ' FROM d JOIN br USING (frame_id, "row", col) JOIN bg USING (frame_id, "row", col)')
def unsharp(spark, sf_dir):
    """Cells outside the swath are black in the picture being sharpened."""
    pic = unit_picture(spark, sf_dir)
    full = stencil.crop_tiles(stencil.pad_tiles(pic, KEYS, ["r", "g"], 0, TILE,
                                                frames=frames(spark, sf_dir), fill=0.0))
    out = stencil.unsharp(full, KEYS, ["r", "g"], 0.45, tile=TILE)
    return rounded(out.select(*CELL, "r", "g"), ["r", "g"])


@query(dense_cte() + f"""
, bad AS (SELECT frame_id, "row", col FROM d WHERE NOT ok),
near AS (SELECT DISTINCT b.frame_id, b."row" + a.k AS "row", b.col + c.k AS col FROM bad b, range(-2, 3) a(k), range(-2, 3) c(k)
         WHERE abs(a.k) + abs(c.k) <= 2)
SELECT d.frame_id, d."row", d.col,
  d."row" BETWEEN 2 AND {H - 3} AND d.col BETWEEN 2 AND {W - 3} AND n.frame_id IS NULL AS kept
FROM d LEFT JOIN near n ON n.frame_id = d.frame_id AND n."row" = d."row" AND n.col = d.col""")
def erosion(spark, sf_dir):
    wide = stencil.erode(padded(spark, sf_dir, 2), KEYS, "red_ok", 2)
    return stencil.crop_tiles(wide).select(*CELL, F.col("red_ok").alias("kept"))


@query(dense_cte() + blur_cte("d", "v", "fa", 0.6) + blur_cte("d", "v", "fb", 2.0) + f"""
SELECT fa.frame_id, {r6('stddev_pop(fa.v - fb.v)')} AS sharpness
FROM fa JOIN fb USING (frame_id, "row", col) GROUP BY 1""")
def sharpness(spark, sf_dir):
    return rounded(measure.sharpness(dense(spark, sf_dir), KEYS, "red", 2.0, tile=TILE),
                   ["sharpness"])


@query(dense_cte() + window_cte("d", "v", "g", 3, "median({v}) AS m") + f"""
, r AS (SELECT d.frame_id, v - m AS r FROM d JOIN g USING (frame_id, "row", col)),
q AS (SELECT frame_id, median(r) AS q FROM r GROUP BY 1)
SELECT frame_id, {r6('median(abs(r - q)) * 1.4826e0')} AS noise FROM r JOIN q USING (frame_id) GROUP BY 1""")
def noise(spark, sf_dir):
    return rounded(measure.noise(dense(spark, sf_dir), KEYS, "red", 3, tile=TILE), ["noise"])


def _deconvolve_sql(sigma: float = 0.6, amount: float = 0.75, rounds: int = 3) -> str:
    sql = dense_cte() + window_cte("d", "v", "lr", 3, "min({v}) AS lo, max({v}) AS hi")
    sql += """, e0 AS (SELECT d.frame_id, d."row", d.col, d.v, d.v AS img, lo - (hi - lo) * 0.2e0 AS lo, hi + (hi - lo) * 0.2e0 AS hi
  FROM d JOIN lr USING (frame_id, "row", col))\n"""
    for i in range(rounds):
        sql += blur_cte(f"e{i}", "v", f"g{i}", sigma)
        sql += (f', e{i + 1} AS (SELECT e.frame_id, e."row", e.col, least(greatest(e.v + (e.img - g.v) * {amount!r}::DOUBLE, e.lo), e.hi) AS v, '
                f'e.img, e.lo, e.hi FROM e{i} e JOIN g{i} g USING (frame_id, "row", col))\n')
    return sql + f'SELECT frame_id, "row", col, {r6("v")} AS red FROM e{rounds}'


@query(_deconvolve_sql())
def deconvolve(spark, sf_dir):
    wide = padded(spark, sf_dir, 3 * stencil.radius_of(0.6) + 1)
    wide = stencil.deconvolve(wide, KEYS, ["red"], 0.6, 0.75, iterations=3)
    return rounded(stencil.crop_tiles(wide).select(*CELL, "red"), ["red"])


@query(dense_cte() + blur_cte("d", "v", "g", 0.8) + f"""
SELECT d.frame_id, d."row", d.col, {r6('g.v + (d.v - g.v) * 1.3e0')} AS red
FROM d JOIN g USING (frame_id, "row", col)""")
def match_detail(spark, sf_dir):
    wide = padded(spark, sf_dir, stencil.radius_of(0.8))
    wide = stencil.match_detail(wide, KEYS, ["red"], 1.3)
    return rounded(stencil.crop_tiles(wide).select(*CELL, "red"), ["red"])
