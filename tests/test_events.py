import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from orbitlake import QueryError, registry
from orbitlake.operators import catalog, fires, passes
from orbitlake.sources import firms, stac
from orbitlake.streaming.fires import detection_stream, rolling_activity

VIIRS = ("country_id,latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,"
         "instrument,confidence,version,bright_ti5,frp,daynight")
MODIS = ("latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,"
         "confidence,version,bright_t31,frp,daynight")


@pytest.fixture
def files(tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "m").mkdir()
    (tmp_path / "v" / "a.csv").write_text(
        f"{VIIRS}\nNZL,-41.3,174.8,351.6,.4,.4,2024-08-15,0742,N,VIIRS,h,2,290,37.4,D\n"
        "NZL,,174.8,351.6,.4,.4,2024-08-15,0742,N,VIIRS,h,2,290,37.4,D\n")
    (tmp_path / "m" / "b.csv").write_text(
        f"{MODIS}\n-41.4,174.6,331.5,1,1,2024-08-15,5,T,MODIS,64,6,295,20.1,N\n")
    return {"viirs-snpp": str(tmp_path / "v"), "modis": str(tmp_path / "m"), "nonsense": "x"}


def test_two_sensor_formats_become_one_table(spark, files):
    got = {r.sensor: r for r in firms.read_detections(spark, files).collect()}
    v, m = got["viirs-snpp"], got["modis"]
    assert (v.confidence, v.confidence_label, v.brightness_k, v.frp) == (0.95, "high", 351.6, 37.4)
    assert (v.resolution_m, v.day, v.acquired) == (375, True, dt.datetime(2024, 8, 15, 7, 42))
    assert (m.confidence, m.confidence_label, m.resolution_m, m.day) == (0.64, "nominal", 1000,
                                                                         False)
    assert m.acquired == dt.datetime(2024, 8, 15, 0, 5) and len(got) == 2
    with pytest.raises(QueryError):
        firms.read_detections(spark, files, ["nonsense"])


def test_confidence_scales(spark):
    df = spark.createDataFrame([(c,) for c in ("l", " Nominal ", "HIGH", "12", "79", "80", "",
                                               "what", None, "nan")], "c string")
    level = firms.confidence_level(F.col("c"))
    got = [tuple(r) for r in df.select(level, firms.confidence_label(level)).collect()]
    assert got == [(0.25, "low"), (0.65, "nominal"), (0.95, "high"), (0.12, "low"),
                   (0.79, "nominal"), (0.8, "high")] + [(0.65, "nominal")] * 4


def test_the_window_always_covers_the_hours():
    assert [firms.covering_window(h)[0] for h in (0, 1, 24, 25, 36, 48, 49, 168)] == [
        24, 24, 24, 48, 48, 48, 168, 168]
    for ask in (firms.covering_window, firms.area_days):
        with pytest.raises(registry.QueryError, match="168"):
            ask(169)
    assert [firms.area_days(h) for h in (1, 30, 100)] == [1, 2, 7]


NOW = "2024-08-16 08:00:00"


def detections(spark, rows):
    return spark.createDataFrame(rows, "ordinal int, lat double, lon double, frp double, "
                                       "sensor string, acquired timestamp_ntz")


def box(spark, *corners):
    return spark.createDataFrame([(1, *map(float, corners))], "box_id int, west double, "
                                 "south double, east double, north double")


def at(hours):
    return dt.datetime(2024, 8, 16, 8) - dt.timedelta(hours=hours)


@pytest.mark.parametrize("corners", [(150.2, -34.6, 151.7, -33.1), (151.7, -33.1, 150.2, -34.6)])
def test_box_and_hours(spark, corners):
    df = detections(spark, [(1, -33.8, 150.9, 5.0, "modis", at(2)),
                            (2, -33.9, 151.0, None, "viirs-snpp", at(40)),
                            (3, 10.0, 10.0, 9.0, "modis", at(1))])
    for hours, n in ((24, 1), (36, 1), (48, 2)):
        assert fires.fire_counts(df, box(spark, *corners), NOW, hours).first().total == n
    assert fires.fire_counts(df, box(spark, 0, 50, 1, 51), NOW).first().total == 0


def test_too_many_keeps_the_fiercest_newest_first(spark):
    df = detections(spark, [(i, -33.8, 150.9, float(i), "modis", at(i % 7)) for i in range(40)])
    area = box(spark, 150, -34, 151, -33)
    out = fires.active_fires(df, area, NOW, most=5).collect()
    assert sorted(r.frp for r in out) == [35.0, 36.0, 37.0, 38.0, 39.0]
    assert [r.acquired for r in out] == sorted((r.acquired for r in out), reverse=True)
    counts = fires.fire_counts(df, area, NOW, most=5).first()
    assert (counts.total, counts["count"], counts.capped) == (40, 5, True)


def test_symbol_classes_are_strict(spark):
    df = spark.createDataFrame([(v, 0.5) for v in (None, 10.0, 10.1, 100.0, 480.0)],
                               "frp double, confidence double")
    out = fires.with_style(df).collect()
    labels = [c[3] for c in registry.FIRE_CLASSES]
    assert [labels.index(r.power_class) for r in out] == [3, 3, 2, 1, 0]
    assert out[0].radius == 3.5 and out[-1].radius == 15.0 and out[0].opacity == 0.5


def test_files_stream_into_a_rolling_count(spark, files, tmp_path):
    stream = rolling_activity(detection_stream(spark, files["viirs-snpp"], "viirs-snpp"))
    query = (stream.writeStream.outputMode("complete").format("memory").queryName("rolling")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
             .start())
    query.awaitTermination(120)
    rows = spark.table("rolling").collect()
    assert len(rows) == 24 and {r.detections for r in rows} == {1}
    assert {(r.cell_x, r.cell_y) for r in rows} == {(174, -42)}


# -- overpasses -----------------------------------------------------------------

ASKED = "2024-06-01 00:00:00"


def log(spark, rows):
    data = [(1, sat, orbit, t, i) for i, (sat, orbit, t) in enumerate(rows)]
    return spark.createDataFrame(data, "point_id int, satellite string, orbit int, "
                                       "passed_at timestamp_ntz, ordinal int")


def days(*offsets, start=dt.datetime(2024, 5, 1, 6)):
    return [start + dt.timedelta(days=d) for d in offsets]


def answer(spark, rows):
    return passes.next_passes(passes.recent_passes(log(spark, rows), ASKED), ASKED).first()


def test_the_shortest_gap_is_the_period(spark):
    times = days(0, 5, 10, 20, 25) + [dt.datetime(2024, 5, 26, 6, 4)]
    got = answer(spark, [("sentinel-1", 59, t) for t in times])
    assert got.period_days == 5.0 and got.measured and got.passes_seen == 6
    assert got.next_at == dt.datetime(2024, 6, 5, 6)


def test_one_pass_falls_back_to_the_nominal_cycle(spark):
    got = answer(spark, [("sentinel-1", 59, days(25)[0])])
    assert got.period_days == 12.0 and not got.measured


def test_the_soonest_track_wins(spark):
    rows = [("sentinel-1", 59, t) for t in days(9, 21)] + [
        ("sentinel-1", 132, t) for t in days(14, 26)]
    got = answer(spark, rows)
    assert got.next_orbit == 59 and got.next_at == dt.datetime(2024, 6, 3, 6)
    assert got.orbits_seen == 2 and got.last_orbit == 132


def test_a_chain_of_slices_is_folded_from_the_last_kept(spark):
    times = [dt.datetime(2024, 5, 20, h) for h in (0, 8, 16)]
    recent = passes.recent_passes(log(spark, [("sentinel-2", 7, t) for t in times]), ASKED)
    kept = [r.passed_at.hour for r in passes.distinct_passes(recent).collect()]
    assert sorted(kept) == [0, 16]


def test_islands_fold_as_whole_tracks_do(spark):
    rng = random.Random(3)
    rows, want = [], []
    for orbit in (1, 2, None):
        at, kept = dt.datetime(2024, 4, 20), []
        for _ in range(300):
            at += dt.timedelta(minutes=rng.choice([0, 1, 95, 300, 719, 720, 721, 4000]))
            if at <= dt.datetime(2024, 6, 1):
                rows.append(("sentinel-2", orbit, at))
                if not kept or at - kept[-1] >= dt.timedelta(hours=12):
                    kept.append(at)
        gap = min(b - a for a, b in zip(kept, kept[1:]))
        want.append((orbit, sum(r[1] == orbit for r in rows), len(kept), kept[-1], gap))
    rng.shuffle(rows)
    recent = passes.recent_passes(log(spark, rows), ASKED, 60)
    found = passes.tracks(recent)
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    got = {r.orbit: (r.passes, r.distinct_passes, r.anchor, r.gap) for r in found.collect()}
    assert got == {o: (n, k, us(last), gap // dt.timedelta(microseconds=1))
                   for o, n, k, last, gap in want}
    plan = passes.next_passes(recent, ASKED)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_track_is_folded_in_islands(spark):
    """A track of 200,000 passes, three close ones a day: no array holds more than three."""
    log_rows = spark.range(200_000).select(
        F.lit(1).alias("point_id"), F.lit("sentinel-2").alias("satellite"), F.lit(5).alias("orbit"),
        F.timestamp_micros(((F.col("id") / 3).cast("long") * 24 + F.col("id") % 3) * passes.HOUR)
        .cast("timestamp_ntz").alias("passed_at"))
    track = passes.tracks(log_rows).first()
    assert (track.passes, track.distinct_passes, track.gap) == (200_000, 66_667, passes.DAY)


def test_points_never_passed_are_listed(spark):
    points = spark.createDataFrame([(1,), (2,)], "point_id int")
    recent = passes.recent_passes(log(spark, [("sentinel-2", None, days(25)[0])]), ASKED)
    out = passes.next_passes(recent, ASKED, points).collect()
    assert len(out) == 4 and sum(r.passes_seen for r in out) == 1
    assert sum(r.next_at is None for r in out) == 3


# -- catalogue ------------------------------------------------------------------


def items(spark, *dicts):
    df = spark.createDataFrame([(json.dumps(d),) for d in dicts], "item string")
    return stac.parse_items(df)


def test_optical_and_radar_items(spark):
    optical = {"id": "S2A", "collection": "sentinel-2-l2a", "properties": {
        "datetime": "2023-06-15T11:00:00Z", "eo:cloud_cover": 8.26, "proj:epsg": 32630,
        "earthsearch:boa_offset_applied": True, "mgrs:utm_zone": 33, "mgrs:latitude_band": "V",
        "mgrs:grid_square": "XE"}, "assets": {"red": {"href": "s3://b/k/red.tif"}, "x": {}}}
    radar = {"id": "S1A", "collection": "sentinel-1-grd", "properties": {
        "datetime": "2024-05-04T06:00:00Z", "sat:relative_orbit": 81,
        "sat:orbit_state": "descending", "sar:instrument_mode": "IW"},
        "assets": {"VV": {"href": "s3://b/vv", "alternate": {"https": {"href": "https://h/vv"}}}}}
    empty = {"id": "none", "properties": {}, "assets": {"red": {}}}
    got = {r.scene_id: r for r in stac.scenes_from_items(items(spark, optical, radar,
                                                               empty)).collect()}
    assert set(got) == {"S2A", "S1A"}
    a, b = got["S2A"], got["S1A"]
    assert (a.cloud, a.tile, a.epsg, a.boa_offset_applied) == (8.3, "33VXE", 32630, True)
    assert a.assets == {"red": "https://b.s3.amazonaws.com/k/red.tif"}
    assert (b.satellite, b.tile, b.cloud) == ("sentinel-1", "IW DES #81", None)
    assert b.assets == {"VV": "https://h/vv"} and b.platform == "Sentinel-1 A/C"


def test_asset_names_are_matched_whatever_their_case(spark):
    df = spark.createDataFrame([("s", {"VV": "a", "vh": "b"}), ("t", {"vv": "c"})],
                               "scene_id string, assets map<string,string>")
    got = {r.scene_id: r for r in stac.with_asset_links(df, ["vvvh"], "sentinel-1").collect()}
    assert got["s"].links == {"vv": "a", "vh": "b"} and got["s"].missing == []
    assert got["t"].missing == ["vh"]


def test_rasters_without_a_map_are_set_aside(spark):
    df = spark.createDataFrame([("a", 32630, False, 0), ("b", None, True, 4), ("c", 32630, True, 0)],
                               "id string, epsg int, identity_transform boolean, "
                               "control_points int")
    good, bad = stac.split_georeferenced(df)
    assert [r.id for r in good.collect()] == ["a"]
    reasons = {r.id: r.reason for r in bad.collect()}
    assert "control points" in reasons["b"] and reasons["c"] == "no map projection"


def scenes(spark, rows):
    return spark.createDataFrame(rows, "aoi_id int, scene_id string, satellite string, source "
                                       "string, cloud double")


def test_the_best_catalogue_that_answers_is_used(spark):
    df = scenes(spark, [(1, "a", "sentinel-1", "earth-search", None),
                        (1, "b", "sentinel-1", "planetary-computer", None),
                        (2, "c", "sentinel-1", "earth-search", None)])
    assert {r.scene_id for r in catalog.best_source(df).collect()} == {"b", "c"}
    assert catalog.get_scene(df, "S1-nothing").count() == 0


def test_mixing_satellites_is_refused(spark):
    one = scenes(spark, [(1, "a", "sentinel-1", "s", None), (1, "b", "sentinel-1", "s", None)])
    assert catalog.single_satellite(one).first().satellite == "sentinel-1"
    two = scenes(spark, [(1, "a", "sentinel-1", "s", None), (1, "b", None, "s", None)])
    with pytest.raises(Exception, match="One satellite at a time"):
        catalog.single_satellite(two).collect()
