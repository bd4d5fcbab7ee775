import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake import QueryError, register_index, registry
from orbitlake.functions.spectral import with_indices
from orbitlake.operators import merge, units
from orbitlake.operators.quantiles import order_code, pooled_quantiles, quantiles
from orbitlake.operators.stats import array_stats, histogram
from orbitlake.sources import pixels

from conftest import to_array


def scenes(spark, date="2023-06-15", applied=False):
    return spark.sql(f"select 's' as scene_id, 0 as scene_ord, date'{date}' as scene_date, "
                     f"{str(applied).lower()} as boa_offset_applied")


@pytest.mark.parametrize("date, applied, expected", [
    ("2023-06-15", False, (0.20, 0.60)), ("2023-06-15", True, (0.30, 0.70)),
    ("2021-06-15", False, (0.30, 0.70))])
def test_reflectance_uses_the_scene_offset(spark, date, applied, expected):
    px = spark.createDataFrame([(0, 3000), (0, 7000), (0, 0)], "scene_ord int, dn int")
    out = units.to_reflectance(px, scenes(spark, date, applied), {"red": "dn"})
    got = sorted((r.red for r in out.collect()), key=lambda v: (v is None, v))
    assert got[:2] == pytest.approx(expected) and got[2] is None


def test_pixels_of_unlisted_scenes_stay_without_a_value(spark):
    px = spark.createDataFrame([(0, 3000), (1, 7000)], "scene_ord int, dn int")
    out = units.to_reflectance(px, scenes(spark), {"red": "dn"}).collect()
    assert {r.scene_ord: r.red for r in out} == {0: pytest.approx(0.2), 1: None}


def test_decibels(spark):
    px = spark.createDataFrame([(1000,), (250,), (0,)], "a int")
    got = [r.vv for r in units.to_decibels(px, {"vv": "a"}).collect()]
    assert got[:2] == pytest.approx([60.0, 47.9588], abs=1e-3) and got[2] is None


def test_cloud_mask_and_fraction(spark):
    px = spark.createDataFrame([(0, 4, 1.0), (0, 9, 1.0), (0, 3, 1.0), (0, None, 1.0)],
                               "frame_id int, scl int, red double")
    assert [r.red for r in units.mask_clouds(px, ["red"]).collect()] == [1.0, None, None, 1.0]
    assert units.cloud_fraction(px, ["frame_id"]).first().cloud_fraction == 0.5


def test_a_new_index_is_a_sql_expression(spark):
    register_index("greenness", "try_divide(green, red + green + blue)",
                   ("red", "green", "blue"), (0.0, 1.0))
    px = spark.createDataFrame([(0.1, 0.2, 0.1), (0.0, 0.0, 0.0)],
                               "red double, green double, blue double")
    assert [r.greenness for r in with_indices(px, ["greenness"]).collect()] == [0.5, None]
    registry.INDICES.pop("greenness")


def test_bands_are_checked_before_anything_is_read():
    assert registry.stored_behind(["vv", "vvvh"], "sentinel-1") == ["vv", "vh"]
    assert set(registry.picture("composite", "radar_grey", "sentinel-1").bands) == {"vv"}
    for strangers, key in ((["thermal"], "sentinel-2"), (["vv"], "sentinel-2")):
        with pytest.raises(QueryError, match="offer no"):
            registry.stored_behind(strangers, key)
    with pytest.raises(QueryError, match="made from sentinel-1"):
        registry.picture("index", "radar_ratio", "sentinel-2")
    with pytest.raises(QueryError, match="no index is called"):
        registry.picture("index", "ripeness", "sentinel-2")
    with pytest.raises(QueryError, match="no such satellite"):
        registry.satellites_among(["landsat"])
    assert registry.satellites_among("all") == ["sentinel-2", "sentinel-1"]
    assert registry.satellites_among(["sentinel-1", "landsat"]) == ["sentinel-1"]


def test_reading_bands_scans_only_what_is_needed(spark, tmp_path):
    raw = spark.range(64).select(
        F.lit("sentinel-2").alias("satellite"), F.lit("s").alias("scene_id"),
        F.lit(0).alias("frame_id"), (F.col("id") / 8).cast("int").alias("row"),
        (F.col("id") % 8).cast("int").alias("col"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), F.lit(4).alias("scl"),
        *[F.lit(3000).alias(b) for b in ("red", "nir", "blue")])
    path = str(tmp_path / "px")
    pixels.write_pixels(raw, path)
    out = pixels.read_bands(spark, path, scenes(spark), ["red", "nir"], "sentinel-2",
                            scene_ids=["s"], window=(0, 3, 0, 7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    assert "PushedFilters" in scan and "blue" not in scan.split("ReadSchema")[1].split("\n")[0]
    assert out.count() == 32 and out.first().red == pytest.approx(0.2)


def test_composites_fill_gaps(spark, stack):
    a, b = np.full((4, 4), 0.1), np.full((4, 4), 0.9)
    a[:2], b[2:] = np.nan, np.nan
    px, listed = stack([a, b])
    first = to_array(merge.composite(px, ["red"], "first"), "red", (4, 4))
    assert np.allclose(first[2:], 0.1) and np.allclose(first[:2], 0.9)
    report = merge.composite_report(px, "red", 16).first()
    assert (report.scenes, report.best_single_pct, report.combined_pct) == (2, 50.0, 100.0)
    with pytest.raises(QueryError):
        merge.composite(px, ["red"], "mode")


def test_packed_and_mergeable_medians_agree(spark, stack):
    rng = np.random.default_rng(0)
    layers = rng.random((5, 6, 6))
    layers[rng.random(layers.shape) < 0.3] = np.nan
    px, _ = stack(list(layers))
    packed = to_array(merge.composite(px, ["red"], packed=True), "red", (6, 6))
    plain = to_array(merge.composite(px, ["red"]), "red", (6, 6))
    with np.errstate(all="ignore"):
        want = np.nanmedian(layers, axis=0)
    assert np.allclose(packed, plain, equal_nan=True) and np.allclose(packed, want, equal_nan=True)


def test_robust_mean_drops_the_cloud(spark, stack):
    layers = [np.full((4, 4), v) for v in (0.20, 0.20, 0.20, 0.20, 0.85)]
    px, listed = stack(layers)
    for packed in (True, False):
        row = merge.robust_mean(px, ["red"], listed, packed=packed).first()
        assert row.red == pytest.approx(0.20) and row.red_kept == 4


def test_both_robust_means_agree(spark, stack):
    rng = np.random.default_rng(1)
    layers = 0.3 + rng.normal(0, 0.02, (7, 5, 5))
    layers[rng.random(layers.shape) < 0.3] = np.nan
    px, listed = stack(list(layers))
    a = to_array(merge.robust_mean(px, ["red"], listed, packed=True), "red", (5, 5))
    b = to_array(merge.robust_mean(px, ["red"], listed, packed=False), "red", (5, 5))
    assert np.allclose(a, b, equal_nan=True)


@pytest.mark.parametrize("accuracy", [10000, 50])
def test_percentiles_are_exact_for_hot_keys(spark, accuracy):
    """A key far larger than the sketch, with ties, NULLs and NaN-free gaps."""
    rng = np.random.default_rng(2)
    hot = np.round(rng.normal(0, 1, 20000), 3)
    small = rng.random(7)
    rows = [(0, float(v)) for v in hot] + [(1, float(v)) for v in small] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(8)
    probs = [0.02, 0.25, 0.5, 0.98, 1.0]
    got = {r.k: r.v_q for r in quantiles(df, ["k"], ["v"], probs, accuracy=accuracy).collect()}
    assert got[0] == pytest.approx(list(np.percentile(hot, [2, 25, 50, 98, 100])), abs=1e-12)
    assert got[1] == pytest.approx(list(np.percentile(small, [2, 25, 50, 98, 100])), abs=1e-12)
    assert 2 not in got


@pytest.mark.parametrize("parts", [1, 13])
def test_radix_selection_of_any_values(spark, parts):
    """One key with most rows; values of all magnitudes, signs and ties, infinities, equal bits."""
    rng = np.random.default_rng(7)
    sets = {0: np.concatenate([rng.normal(0, 1, 9000), np.full(4000, 0.25),
                               0.25 + np.arange(500) * 2.0 ** -52]),
            1: rng.normal(0, 1, 301) * 10.0 ** rng.integers(-300, 300, 301),
            2: np.array([0.0, -0.0, 5e-324, -5e-324]), 3: np.array([-np.inf, 1.0, 2.0]),
            4: np.full(9, -7.5), 5: np.array([np.pi])}
    rows = [(k, float(v)) for k, values in sets.items() for v in values]
    df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
    probs = [0.0, 0.02, 0.3, 0.5, 0.9999, 1.0]
    got = {r.k: r.v_q for r in quantiles(df, ["k"], ["v"], probs).collect()}
    for k, values in sets.items():
        ordered = np.sort(values)
        for p, have in zip(probs, got[k], strict=True):
            at = p * (len(values) - 1)
            lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
            assert np.array_equal(have, want, equal_nan=True)


def test_codes_sort_as_values(spark):
    values = [float("-inf"), -1e300, -2.0, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0000001,
              7e200, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    codes = [r.c for r in df.select("i", order_code(F.col("v")).alias("c")).orderBy("i").collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)


def test_pooled_percentiles(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, None), (0, 3.0, 9.0)],
                               "k int, a double, b double")
    got = pooled_quantiles(df, ["k"], ["a", "b"], [0.5]).first()
    assert got.pool_q == [3.0]


def test_stats_and_histogram(spark):
    df = spark.createDataFrame([(0, v / 10) for v in range(11)] + [(1, None)],
                               "frame_id int, v double")
    got = {r.frame_id: r for r in array_stats(df, "v").collect()}
    assert (got[0]["count"], got[0].mean, got[0].median, got[0].p5) == (11, 0.5, 0.5, 0.05)
    assert got[1]["count"] == 0 and got[1].mean is None
    h = histogram(df, "v", 0.0, 1.0, bins=5).orderBy("bin").collect()
    counts = np.histogram([v / 10 for v in range(11)], bins=5, range=(0, 1))[0]
    assert [r.pixels for r in h] == list(counts) and h[0].width == 0.2


def test_common_bands(spark):
    df = spark.createDataFrame([(0, "a", {"red": "x", "nir": "y"}), (0, "b", {"red": "z"})],
                               "frame_id int, scene_id string, assets map<string,string>")
    assert [r.band for r in merge.common_bands(df).collect()] == ["red"]
