import math

import pytest

from pyspark.sql import functions as F

from orbitlake import registry
from orbitlake.operators import catalog, clouds, fires
from orbitlake.operators.keyed import top_k
from orbitlake.sources import firms, pixels


def test_index_and_picture_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, None)],
                               "frame_id int, row int, col int, ndvi double")
    named = df.withColumn("name", pixels.output_name(F.lit("sentinel-2"), F.lit("2024-05-04"),
                                                     "ndvi"))
    pixels.write_index(named, str(tmp_path / "index"), "ndvi")
    back = spark.read.parquet(str(tmp_path / "index")).orderBy("col").collect()
    assert back[0].name == "sentinel2_2024-05-04_ndvi" and math.isnan(back[1].ndvi)
    picture = df.select("frame_id", "row", "col", *[F.lit(9).alias(c) for c in "rgba"])
    pixels.write_picture(picture, str(tmp_path / "rgba"))
    assert spark.read.parquet(str(tmp_path / "rgba")).count() == 2


def test_radar_presets_leave_out_corrections_of_light():
    assert "haze_removal" in registry.enhancement_options("optical")
    assert registry.enhancement_options("radar", "Smooth") == {"denoise": 0.55,
                                                               "adaptive_contrast": 1.2}


def test_default_search_days():
    assert catalog.search_days("2024-06-01") == ("2023-06-02", "2024-06-01")
    assert catalog.search_days("2024-06-01", "2024-01-02T10:00:00Z")[0] == "2024-01-02"


def test_the_answering_catalogue_is_credited(spark):
    df = spark.createDataFrame([("sentinel-1", "planetary-computer"), ("sentinel-2", None),
                                (None, "other")], "satellite string, source string")
    got = [r.provider for r in catalog.with_satellite(df).collect()]
    assert got == ["Microsoft Planetary Computer"] + ["Earth Search (AWS Open Data)"] * 2


def test_a_box_reaches_the_scan(spark, tmp_path):
    spark.range(100).select((F.col("id") * 1.0).alias("lat"), F.lit(1.0).alias("lon")).write.parquet(
        str(tmp_path / "d"))
    df = fires.within_box(spark.read.parquet(str(tmp_path / "d")), 2, 20, 0, 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 11 and "GreaterThanOrEqual(lat,10.0)" in plan


def test_top_k_of_a_hot_key_with_map_columns(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"),
                                  "id", F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    got = top_k(df, ["k"], [F.col("id").desc()], 3).where("k = 0").collect()
    assert sorted(r.id for r in got) == [3997, 3998, 3999]


def test_cloud_layer_meets_the_scene_of_its_day(spark):
    scenes = spark.sql("select date'2024-05-04' as date")
    layer = spark.sql("select * from values (date'2024-05-04', 250, 250, 250), "
                      "(date'2024-05-05', 10, 90, 10) as t(date, r, g, b)")
    got = clouds.match_layer(scenes, clouds.cloud_layer(layer)).collect()
    assert len(got) == 1 and got[0].a == 255


def test_the_area_source_prunes_by_window_and_box(spark, tmp_path):
    rows = [(float(i), float(-i), w) for i in range(20) for w in ("24h", "48h", "7d")]
    spark.createDataFrame(rows, "lat double, lon double, window string").write.partitionBy(
        "window").parquet(str(tmp_path / "area"))
    found = firms.read_area(spark, str(tmp_path / "area"), 30, 0, 12, -8, 3)
    assert {(r.lat, r.window) for r in found.collect()} == {(float(i), "48h") for i in range(3, 9)}
    assert "PartitionFilters: [isnotnull(window" in found._jdf.queryExecution().toString()


def test_hours_are_not_clamped(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-21 00:00:00' as acquired")
    assert fires.within_hours(rows, "2024-01-31 00:00:00", 240).count() == 1
    assert fires.within_hours(rows, "2024-01-31 00:00:00", 239).count() == 0
    with pytest.raises(registry.QueryError):
        fires.within_hours(rows, "2024-01-31 00:00:00", 0)


def test_pixels_are_stored_and_read_back(spark, tmp_path):
    px = spark.createDataFrame(
        [("sentinel-2", "s1", 0, r, c, 4, 4, 100 * r + c + 1000) for r in range(4) for c in range(4)],
        "satellite string, scene_id string, frame_id int, row int, col int, height int, "
        "width int, red int")
    pixels.write_pixels(px, str(tmp_path / "px"))
    scenes = spark.sql("select 's1' as scene_id, date'2020-01-01' as scene_date, "
                       "false as boa_offset_applied")
    back = pixels.read_bands(spark, str(tmp_path / "px"), scenes, ["red"], "sentinel-2",
                             window=(1, 2, 0, 3))
    assert back.count() == 8
    assert {round(r.red * 10000) for r in back.collect()} == {
        100 * r + c + 1000 for r in (1, 2) for c in range(4)}
