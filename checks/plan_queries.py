"""Whole questions: rendering with its description, and rolling fire activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitlake.plans import render as rendering
from orbitlake.sources.pixels import output_name
from orbitlake.streaming.fires import rolling_activity

from . import views
from .geo_queries import _GON, outlines
from .pixel_queries import optical, r6
from .render_queries import comp_cte, true_color_cte

QUERIES: dict = {}
ORACLES: dict = {}
SHAPE = (views.HEIGHT, views.WIDTH)


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def _render(spark, sf_dir, bands, **kw):
    px = optical(spark, sf_dir, bands)
    return rendering.render(px, views.obs_scenes(spark, sf_dir), "sentinel-2", SHAPE, 10.0,
                            sparse=True, tile=64, **kw)


_META = comp_cte(("nir", "red")) + f"""
, ix AS (SELECT frame_id, (nir - red) / nullif(nir + red, 0) AS ndvi FROM comp),
st AS (SELECT frame_id, count(ndvi) AS n, {r6('avg(ndvi)', 4)} AS mean, {r6('quantile_cont(ndvi, 0.5::DOUBLE)', 4)} AS median FROM ix GROUP BY 1),
cl AS (SELECT frame_id, scene_ord, sum(CASE WHEN scl IN (3,8,9,10) THEN 1 ELSE 0 END) / {views.CELLS}e0 AS f FROM obs GROUP BY ALL),
cm AS (SELECT frame_id, min(f) AS f FROM cl GROUP BY 1)
SELECT frame_id, 'NDVI - vegetation' AS label, 'median' AS method, {r6('f * 100e0', 2)} AS cloud_masked_pct,
 {r6(f'n * 100e0 / {views.CELLS}e0', 2)} AS valid_pct, n > 0 AS covered, 0.8192e0 AS scene_area_km2, mean, median,
 '#0c3c78' AS first_stop FROM st JOIN cm USING (frame_id)"""


@query(_META)
def render_meta(spark, sf_dir):
    meta = _render(spark, sf_dir, ("nir", "red"), mode="index", name="ndvi",
                   opts={"mask_clouds": True}).meta
    return meta.select("frame_id", "label", "method", "cloud_masked_pct", "valid_pct", "covered",
                       "scene_area_km2", F.col("stats.mean").alias("mean"),
                       F.col("stats.median").alias("median"),
                       F.col("legend.stops")[0]["color"].alias("first_stop"))


@query(true_color_cte() + """
SELECT frame_id, "row", col, r, g, b, valid, CASE WHEN valid THEN 255 ELSE 0 END AS a FROM pic""")
def render_picture(spark, sf_dir):
    return _render(spark, sf_dir, ("red", "green", "blue"), opts={"mask_clouds": True}).picture


@query(true_color_cte().replace(", st AS (SELECT *,", _GON + """, shut AS (SELECT c.frame_id, c."row", c.col, """ + ", ".join(
    f"CASE WHEN x.n % 2 = 1 OR x.touched THEN c.{b} END AS {b}" for b in ("red", "green", "blue")) + """
FROM comp c JOIN cx x USING (frame_id, "row", col)), st AS (SELECT *,""").replace("FROM comp)\n, pk", "FROM shut)\n, pk") + """
SELECT frame_id, "row", col, r, g, b, valid, CASE WHEN valid THEN 255 ELSE 0 END AS a FROM pic""")
def render_clipped(spark, sf_dir):
    """The picture of an area: cells outside its outline are empty before the merge."""
    return _render(spark, sf_dir, ("red", "green", "blue"), opts={"mask_clouds": True},
                   outlines=outlines(spark, sf_dir)).picture


def render_enhanced(spark, sf_dir):
    """Every correction at once, rows only: each step has its own oracle-checked query."""
    opts = dict(mask_clouds=True, haze_removal=0.8, denoise=0.4, adaptive_contrast=1.8,
                white_balance=0.3, sharpen=0.45, vibrance=0.2)
    return _render(spark, sf_dir, ("red", "green", "blue"), opts=opts).picture


QUERIES["render_enhanced"] = render_enhanced


@query(comp_cte(("nir", "red")) + """
SELECT 'sentinel2_' || CAST(s.scene_date AS VARCHAR) || '_ndvi' AS name, count(*) AS scenes
FROM obs_scenes s GROUP BY 1""")
def output_names(spark, sf_dir):
    scenes = views.obs_scenes(spark, sf_dir)
    return scenes.groupBy(output_name(F.lit("sentinel-2"), F.col("scene_date"), "ndvi")
                          .alias("name")).agg(F.count(F.lit(1)).alias("scenes"))


@query(views.with_views("dets") + """
, w AS (SELECT d.*, date_trunc('hour', acquired) - to_hours(CAST(k.i AS INT)) AS s FROM dets d CROSS JOIN range(24) k(i))
SELECT s AS window_start, s + INTERVAL 24 HOURS AS window_end, CAST(floor(lon / 10e0) AS INT) AS cell_x, CAST(floor(lat / 10e0) AS INT) AS cell_y,
 count(*) AS detections, max(frp) AS max_frp FROM w GROUP BY ALL""")
def fire_activity(spark, sf_dir):
    """The streaming aggregate run over the whole detection table as a batch."""
    return rolling_activity(views.dets(spark, sf_dir), 10.0, dedupe=False)
