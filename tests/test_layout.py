"""Tables along a curve, and SQL functions."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orbitlake import QueryError, registry
from orbitlake.functions import sql, tone
from orbitlake.operators import layout
from orbitlake.sources import firms, pixels


def woven(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(31))


def test_keys_weave_the_bits_of_both_coordinates(spark):
    draw = random.Random(1)
    rows = [(draw.getrandbits(k), draw.getrandbits(k)) for k in (1, 5, 16, 31) for _ in range(20)]
    rows += [(0, 0), (2 ** 31 - 1, 2 ** 31 - 1), (2 ** 31 - 1, 0)]
    found = spark.createDataFrame(rows, "x long, y long").select(
        "x", "y", layout.curve_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert all(r.k == woven(r.x, r.y) for r in found)
    edge = spark.createDataFrame([(-200.0, 95.0), (None, 1.0)], "lon double, lat double").select(
        layout.ground_key(F.col("lon"), F.col("lat")).alias("k")).collect()
    assert edge[0].k == woven(0, 2 ** 31 - 1) and edge[1].k is None


def groups_met(folder, **box):
    """(row groups whose statistics meet the box, row groups) of the files below a folder."""
    met = every = 0
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(names.index(n)).statistics for n in box}
            met += all(stats[n].min <= hi and lo <= stats[n].max for n, (lo, hi) in box.items())
            every += 1
    return met, every


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """A box of a hundredth of the world's surface reads under a tenth of its row groups."""
    rows = spark.range(120_000).select(
        (F.rand(3) * 360 - 180).alias("lon"), (F.rand(4) * 180 - 90).alias("lat"),
        F.timestamp_micros("id").cast("timestamp_ntz").alias("acquired"),
        F.lit("24h").alias("window"))
    layout.write_detections(rows, str(tmp_path / "d"), 32 << 10)
    met, every = groups_met(tmp_path / "d", lon=(10.0, 46.0), lat=(20.0, 38.0))
    assert every >= 40 and met <= every / 10
    found = firms.read_area(spark, str(tmp_path / "d"), 24, 10, 20, 46, 38)
    plan = found._jdf.queryExecution().toString()
    assert "LessThanOrEqual(lat,38.0)" in plan.partition("PushedFilters")[2]
    assert found.count() == rows.where("lon between 10 and 46 and lat between 20 and 38").count()


def test_a_window_of_a_scene_reads_few_row_groups(spark, tmp_path):
    px = spark.range(512 * 512).select(
        F.lit("sentinel-2").alias("satellite"), F.lit("s1").alias("scene_id"),
        (F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"),
        (F.rand(1) * 1e4).cast("int").alias("red"))
    pixels.write_pixels(px, str(tmp_path / "p"), group_bytes=32 << 10)
    met, every = groups_met(tmp_path / "p", row=(100, 150), col=(300, 350))
    assert every >= 30 and met <= every / 6


# -- SQL functions --------------------------------------------------------------

def test_functions_equal_the_columns(spark):
    sql.register_functions(spark)
    df = spark.createDataFrame([(200, 210, 220), (0, 0, 0), (10, 90, 10), (255, 255, 255),
                                (None, 1, 2)], "r int, g int, b int")
    got = df.select("*", F.expr("cloudiness(r, g, b)").alias("plain"),
                    F.expr("cloudiness(r, g, b, 0.9)").alias("keen"),
                    tone.cloudiness(*map(F.col, "rgb")).alias("want"),
                    tone.cloudiness(*map(F.col, "rgb"), 0.9).alias("want_keen")).collect()
    for r in got:
        assert (r.plain, r.keen) == pytest.approx((r.want, r.want_keen)) or r.r is None
    one = spark.sql("select reflectance(0, 0) a, reflectance(2000, -1000) b, decibels(0) c, "
                    "decibels(10) d, from_decibels(20) e, is_cloud(null) f, is_cloud(9) g, "
                    "boa_offset(date'2022-02-01', false) h, boa_offset(date'2022-02-01', true) i, "
                    "ndvi(0, 0) j, ndvi(0.6, 0.2) k, savi(double('inf'), 1) l").first()
    assert (one.a, one.c, one.j, one.l) == (None, None, None, None)
    assert (one.b, one.d, one.e, one.k) == pytest.approx((0.1, 20.0, 100.0, 0.5))
    assert (one.f, one.g, one.h, one.i) == (False, True, registry.BOA_OFFSET, 0)
    assert "Python" not in df.select(F.expr("ndvi(r, g)"))._jdf.queryExecution().toString()


def test_unknown_functions_are_refused(spark):
    with pytest.raises(QueryError, match="nonsense"):
        sql.register_functions(spark, "ndvi", "nonsense")
    with pytest.raises(QueryError):
        sql.register_passes_over(spark, "a view; drop")
