"""Registration and fusion: iterative numeric operators, checked in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitlake import materialise
from orbitlake.functions.numeric import half_even
from orbitlake.operators import registration, stencil
from orbitlake.plans import fusion

from . import views
from .pixel_queries import optical, r6, refl_cte, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def chips(spark, sf_dir):
    """Embeddings as 8 x 8 image chips: one frame per label, one scene per vector."""
    v = views.table(spark, sf_dir, "embeddings")
    px = v.select(F.col("label").alias("frame_id"), F.col("vec_id").alias("scene_ord"),
                  F.posexplode("embedding").alias("pos", "guide"))
    return px.select("frame_id", "scene_ord", F.floor(F.col("pos") / 8).cast("int").alias("row"),
                     (F.col("pos") % 8).alias("col"), F.col("guide").cast("double"))


def registration_chips(spark, sf_dir):
    """Best whole-cell match of every chip with its frame's first; cells over 0.2 are holes."""
    px = chips(spark, sf_dir).withColumn("guide", F.when(F.col("guide") <= 0.2, F.col("guide")))
    refs = px.groupBy("frame_id").agg(F.min("scene_ord").alias("reference"))
    found = registration.tile_shifts(px, refs, tile=8, least=12, refine=False)
    return found.select("frame_id", "scene_ord", "whole_dy", "whole_dx", "cells",
                        half_even(F.col("correlation"), 6).alias("correlation"))


#: Every move of up to 9 cells: sums over the cells that both chips know, then correlations.
_CHIPS = """WITH c AS (SELECT label AS frame_id, vec_id AS scene_ord, unnest(range(64)) AS pos,
 unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT frame_id, scene_ord, pos // 8 AS y, pos % 8 AS x, v FROM c WHERE v <= 0.2),
refs AS (SELECT frame_id, min(scene_ord) AS reference FROM c GROUP BY 1),
means AS (SELECT scene_ord, avg(v) AS m FROM px GROUP BY 1),
z AS (SELECT frame_id, scene_ord, y, x, v - m AS v FROM px JOIN means USING (scene_ord)),
held AS (SELECT z.scene_ord, count(*) AS n, sum(v * v) AS power FROM z GROUP BY 1),
sums AS (SELECT a.frame_id, b.scene_ord, a.scene_ord AS reference, a.y - b.y AS dy, a.x - b.x AS dx,
 count(*) AS n, sum(a.v) AS s1, sum(b.v) AS s2, sum(a.v * a.v) AS q1, sum(b.v * b.v) AS q2,
 sum(a.v * b.v) AS p
 FROM z a JOIN refs r ON r.frame_id = a.frame_id AND r.reference = a.scene_ord
 JOIN z b ON b.frame_id = a.frame_id AND b.scene_ord <> a.scene_ord GROUP BY ALL),
most AS (SELECT *, max(n) OVER (PARTITION BY frame_id, scene_ord) AS top FROM sums),
scored AS (SELECT m.frame_id, m.scene_ord, dy, dx, m.n,
 (p - s1 * s2 / m.n) / sqrt((q1 - s1 * s1 / m.n) * (q2 - s2 * s2 / m.n)) AS score
 FROM most m JOIN held h ON h.scene_ord = m.scene_ord JOIN held g ON g.scene_ord = m.reference
 WHERE m.n >= 12 AND m.n >= 0.3 * top AND h.n >= 12 AND g.n >= 12
 AND q1 - s1 * s1 / m.n > 1e-10 * g.power AND q2 - s2 * s2 / m.n > 1e-10 * h.power),
best AS (SELECT *, max(score) OVER (PARTITION BY frame_id, scene_ord) AS best FROM scored),
picked AS (SELECT * FROM best WHERE score >= best - 1e-9 QUALIFY row_number() OVER (
 PARTITION BY frame_id, scene_ord ORDER BY dy * dy + dx * dx, dy, dx) = 1)
SELECT s.frame_id, s.scene_ord, dy::INT AS whole_dy, dx::INT AS whole_dx, n::INT AS cells,
 """ + r6("score") + """ AS correlation
FROM (SELECT DISTINCT frame_id, scene_ord FROM c) s JOIN refs r ON r.frame_id = s.frame_id
 AND r.reference <> s.scene_ord LEFT JOIN picked p ON p.frame_id = s.frame_id
 AND p.scene_ord = s.scene_ord"""


#: Where each scene starts on a grid twice as fine as its own, by its number.
_STARTS = {0: (0, 0), 1: (1, 0), 2: (0, 1), 3: (1, 1), 4: (3, 0), 5: (2, 5)}


def registration_query(spark, sf_dir):
    """Every second cell of each frame's softened picture, from known starts: moves of halves of a
    cell, returned to the nearest half."""
    px = views.obs(spark, sf_dir).where("scene_ord = 1").select(
        "frame_id", "height", "width", "row", "col", F.col("dn_blue").cast("double").alias("v"))
    frames = px.select("frame_id", "height", "width").distinct()
    radius = stencil.radius_of(3.0)
    wide = stencil.pad_tiles(px, ["frame_id"], ["v"], radius, 128, frames=frames,
                             fill=stencil.band_means(px, ["frame_id"], ["v"]))
    soft = stencil.crop_tiles(stencil.gaussian(wide, ["frame_id"], {"v": "v"}, 3.0))
    start = F.explode(F.array(*[F.struct(
        F.lit(k).alias("scene_ord"), F.lit(y).alias("y"), F.lit(x).alias("x"))
        for k, (y, x) in _STARTS.items()])).alias("s")
    row, col = F.col("row") - F.col("s.y"), F.col("col") - F.col("s.x")
    seen = (soft.select("frame_id", "row", "col", "v", start)
            .where((row >= 0) & (col >= 0) & (row % 2 == 0) & (col % 2 == 0))
            .select("frame_id", F.col("s.scene_ord").alias("scene_ord"),
                    (row / 2).cast("int").alias("row"), (col / 2).cast("int").alias("col"),
                    F.col("v").alias("guide")))
    seen = materialise(seen)        # read for its scenes, its references and its tiles
    refs = seen.select("frame_id", F.lit(0).alias("reference")).distinct()
    found = registration.estimate_shifts(seen, refs, tile=128)
    half = lambda c: (F.rint(F.col(c) * 2) / 2 + 0.0).alias(c)
    return found.select("frame_id", "scene_ord", half("dy"), half("dx"), "determined")


def fuse_report(spark, sf_dir):
    px = optical(spark, sf_dir, ("red",), clouds=True)
    scenes = views.obs_scenes(spark, sf_dir)
    out = fusion.fuse(px, scenes, ["red"], (views.HEIGHT, views.WIDTH), scale=2.0, sparse=True,
                      tile=64, registration_tile=128)
    return out.report


QUERIES["registration"] = registration_query
ORACLES["registration"] = views.with_views("obs") + """
SELECT f.frame_id, m.k AS scene_ord, m.dy, m.dx, true AS determined
FROM (SELECT DISTINCT frame_id FROM obs WHERE scene_ord = 1) f, (VALUES """ + ", ".join(
    f"({k}::INT, {y / 2}::DOUBLE, {x / 2}::DOUBLE)" for k, (y, x) in _STARTS.items() if k) + """
) m(k, dy, dx)"""
QUERIES["registration_chips"] = registration_chips
ORACLES["registration_chips"] = _CHIPS
QUERIES["fuse_report"] = fuse_report


def guide(spark, sf_dir):
    px = optical(spark, sf_dir, ("red", "green", "nir"))
    out = px.select("frame_id", "scene_ord", "row", "col", registration.guide(
        ("red", "green", "nir")).alias("guide"))
    return rounded(out, ["guide"])


QUERIES["guide"] = guide
ORACLES["guide"] = refl_cte(("red", "green", "nir")) + f"""
SELECT frame_id, scene_ord, "row", col,
 {r6("(coalesce(red, 0) + coalesce(green, 0) + coalesce(nir, 0)) / nullif((red IS NOT NULL)::INT + (green IS NOT NULL)::INT + (nir IS NOT NULL)::INT, 0)")} AS guide FROM px"""


#: Whole cells by which each scene of a frame is moved, by its number.
_MOVES = {0: (0, 0), 1: (2, -3), 2: (-1, 4), 3: (5, 1)}


def registration_known(spark, sf_dir):
    """Scenes that are their frame's picture, holes and all, moved round by known whole cells."""
    px = views.obs(spark, sf_dir).where("scene_ord = 1").select(
        "frame_id", "row", "col", F.col("dn_blue").cast("double").alias("guide"))
    moves = F.explode(F.array(*[F.struct(
        F.lit(k).alias("scene_ord"), F.lit(y).alias("dy"), F.lit(x).alias("dx"))
        for k, (y, x) in _MOVES.items()])).alias("m")
    moved = px.select("frame_id", "row", "col", "guide", moves).select(
        "frame_id", F.col("m.scene_ord").alias("scene_ord"),
        F.pmod(F.col("row") + F.col("m.dy"), F.lit(views.HEIGHT)).alias("row"),
        F.pmod(F.col("col") + F.col("m.dx"), F.lit(views.WIDTH)).alias("col"), "guide")
    refs = moved.select("frame_id", F.lit(0).alias("reference")).distinct()
    found = registration.estimate_shifts(moved, refs, tile=128)
    return found.select("frame_id", "scene_ord", F.rint("dy").cast("int").alias("dy"),
                        F.rint("dx").cast("int").alias("dx"), "determined")


QUERIES["registration_known"] = registration_known
ORACLES["registration_known"] = views.with_views("obs") + """
SELECT f.frame_id, m.k AS scene_ord, m.dy, m.dx, true AS determined
FROM (SELECT DISTINCT frame_id FROM obs WHERE scene_ord = 1) f, (VALUES """ + ", ".join(
    f"({k}::INT, {-y}::INT, {-x}::INT)" for k, (y, x) in _MOVES.items() if k) + """) m(k, dy, dx)"""
