import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.functions import geo
from orbitlake.operators import resample, spatial
from orbitlake.plans import merging

from conftest import to_array


def shape_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(
        geo.geojson_geometry(F.col("t")).alias("geometry"))


def test_circle_area_and_bounds(spark):
    row = geo.area_report(shape_of(spark, '{"lon": 0.5, "lat": 51.5, "radius": 3000}')).first()
    assert row.area_km2 == pytest.approx(math.pi * 9, rel=0.02)
    assert row.center_lon == pytest.approx(0.5) and len(row.geometry[0][0]) == 97


SQUARE = "[[0,50],[1,50],[1,51],[0,51],[0,50]]"
HOLE = "[[0.4,50.4],[0.6,50.4],[0.6,50.6],[0.4,50.6],[0.4,50.4]]"


def test_shapes_are_normalised(spark):
    area = lambda t: geo.area_report(shape_of(spark, t)).first().area_km2
    plain = area(f'{{"type": "Polygon", "coordinates": [{SQUARE}]}}')
    assert area('{"type": "bbox", "bbox": [0, 50, 1, 51]}') == plain
    assert area(f'{{"type": "Feature", "geometry": {{"type": "Polygon", '
                f'"coordinates": [{SQUARE}]}}}}') == plain
    hole = area(f'{{"type": "Polygon", "coordinates": [{HOLE}]}}')
    cut = area(f'{{"type": "Polygon", "coordinates": [{SQUARE}, {HOLE}]}}')
    assert cut == pytest.approx(plain - hole, abs=1e-3)
    both = area(f'{{"type": "MultiPolygon", "coordinates": [[{SQUARE}], [{HOLE}]]}}')
    assert both == pytest.approx(plain + hole, abs=1e-3)
    assert shape_of(spark, '{"type": "Point"}').first().geometry is None


def test_grid_keeps_the_long_side_and_the_clamps(spark):
    df = spark.createDataFrame([(-0.1, 51.4, 0.1, 51.6), (0.0, 50.0, 10.0, 50.001)],
                               "west double, south double, east double, north double")
    a, b = geo.with_grid(df, 512).collect()
    assert max(a.width, a.height) == 512 and b.width == 512 and b.height == 32
    tall, _ = geo.with_grid(df, 9999).collect()
    assert max(tall.width, tall.height) == 4096
    fine = geo.refined(geo.with_grid(df, 512), 2).first()
    assert fine.width == 2 * a.width and fine.ground_res_m == pytest.approx(a.ground_res_m / 2)


@pytest.mark.parametrize("bounds, size, over", [
    ((-.1, 51.4, -.0857, 51.409), 512, True), ((-.1, 51.4, .2, 51.6), 256, False)])
def test_merging_sharpens_only_below_the_native_grid(spark, bounds, size, over):
    df = spark.createDataFrame([(*bounds, "sentinel-2", 6)], "west double, south double, east "
                               "double, north double, satellite string, scenes int")
    row = merging.merge_method(merging.merge_plan(geo.with_grid(df, size))).first()
    assert row.sharpening == over and row.method == ("fuse" if over else "median")
    assert row.supported == 3
    off = merging.merge_plan(geo.with_grid(df, size), 1).first()
    assert not off.sharpening


def test_radar_never_sharpens(spark):
    df = spark.createDataFrame([("sentinel-1", 6, 2.0), ("sentinel-2", 1, 2.0)],
                               "satellite string, scenes int, ground_res_m double")
    radar, single = merging.merge_method(merging.merge_plan(df)).collect()
    assert radar.despeckling and not radar.sharpening and radar.method == "mean"
    assert radar.speckle_drop == pytest.approx(1 - 1 / math.sqrt(6)) and single.method == "single"


def test_clipping_a_circle_keeps_its_share(image, spark):
    n = 80
    c = n / 2
    pts = [(c + c * math.cos(t), c + c * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 97)]
    edges = [(*a, *b) for a, b in zip(pts, pts[1:])]
    outline = spark.createDataFrame(
        [(0, n, n, edges)], "frame_id int, height int, width int, edges array<struct<x1:double,"
                            "y1:double,x2:double,y2:double>>")
    out = to_array(spatial.clip_to_area(image(np.ones((n, n))), outline, ["v"]), "v", (n, n))
    kept = ~np.isnan(out)
    assert kept.mean() == pytest.approx(math.pi / 4, abs=0.04)
    r, k = np.indices((n, n)) + 0.5
    inside = np.hypot(r - c, k - c) < c - 0.1
    assert kept[inside].all() and not kept[0, 0]


def test_every_area_and_footprint_pair_appears_once(spark):
    poly = F.array(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
                             for x, y in ((0, 0), (20, 0), (20, 20), (0, 20), (0, 0))]))
    areas = spark.range(1).select(F.lit(1).alias("aoi_id"), F.array(poly[0]).alias("ring"))
    areas = areas.select("aoi_id", F.array("ring").alias("geometry"))
    areas = areas.withColumns(geo.bounds(F.col("geometry")))
    boxes = spark.createDataFrame([("in", 3.0, 3.0, 14.0, 9.0), ("across", 18.0, 18.0, 30.0, 30.0),
                                   ("out", 21.0, 0.0, 22.0, 1.0), ("over", -5.0, -5.0, 25.0, 25.0)],
                                  "id string, west double, south double, east double, north double")
    got = sorted(r.id for r in spatial.areas_meet_boxes(areas, boxes).collect())
    assert got == ["across", "in", "over"]


def test_cropping_takes_corners_in_any_order(image):
    a = np.arange(64.0).reshape(8, 8)
    out = spatial.crop(image(a), (6.0, 6.0, 2.0, 4.0), (0.0, 0.0, 8.0, 8.0), 8, 8)
    assert np.array_equal(to_array(out, "v", (2, 4)), a[2:4, 2:6])
    assert spatial.crop(image(a), (20, 20, 30, 30), (0, 0, 8, 8), 8, 8).count() == 0


def test_resampling_rules():
    assert resample.sampling_for(12.0, 10.0, True) == "bilinear"
    assert resample.sampling_for(5.0, 10.0, True) == "nearest"
    assert resample.sampling_for(5.0, 10.0, False) == "cubic"


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_a_flat_image_stays_flat(image, method):
    flat = np.full((6, 9), 0.4)
    flat[2, 3] = np.nan
    out = resample.resample(image(flat), ["frame_id"], ["v"], 12, 27, method)
    got = to_array(out, "v", (12, 27))
    assert np.allclose(got[~np.isnan(got)], 0.4)
