import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake import registry
from orbitlake.functions import tone
from orbitlake.operators import enhance, measure, render, stencil

from conftest import to_array


def reflect(a, r):
    return np.pad(a, r, mode="symmetric")


def blur(a, sigma):
    w = np.array(tone.gaussian_weights(sigma))
    r = len(w) // 2
    p = reflect(a, r)
    p = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, p)
    return np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, p)


def windows(a, size):
    return np.lib.stride_tricks.sliding_window_view(reflect(a, size // 2), (size, size))


RNG = np.random.default_rng(3)
PICTURE = RNG.random((40, 52))


@pytest.mark.parametrize("tile", [16, 64])
def test_gaussian_matches_numpy_across_tiles(image, tile):
    px = stencil.pad_tiles(image(PICTURE), ["frame_id"], ["v"], stencil.radius_of(1.2), tile)
    out = stencil.crop_tiles(stencil.gaussian(px, ["frame_id"], {"v": "v"}, 1.2))
    assert out.count() == PICTURE.size
    assert np.allclose(to_array(out, "v", PICTURE.shape), blur(PICTURE, 1.2), atol=1e-12)


def test_a_chain_of_filters_costs_one_exchange(image):
    px = stencil.pad_tiles(image(PICTURE), ["frame_id"], ["v"], 22, 64)
    out = stencil.crop_tiles(stencil.deconvolve(px, ["frame_id"], ["v"], 1.0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("size", [3, 5])
def test_median_filter(image, size):
    px = stencil.pad_tiles(image(PICTURE), ["frame_id"], ["v"], size // 2, 16)
    out = stencil.crop_tiles(stencil.median_filter(px, ["frame_id"], {"v": "v"}, size))
    want = np.median(windows(PICTURE, size), axis=(2, 3))
    assert np.allclose(to_array(out, "v", PICTURE.shape), want)


def test_box_mean_skips_missing_cells(image):
    holes = PICTURE.copy()
    holes[5:9, 10:30] = np.nan
    px = stencil.pad_tiles(image(holes), ["frame_id"], ["v"], 2, 16)
    out = stencil.crop_tiles(stencil.box_mean(px, ["frame_id"], ["v"], 5))
    want = np.nanmean(windows(holes, 5), axis=(2, 3))
    assert np.allclose(to_array(out, "v", holes.shape), want)


def test_deconvolution_restores_without_overshoot(image):
    truth = np.kron(RNG.random((10, 13)), np.ones((4, 4)))
    seen = blur(truth, 1.0)
    px = stencil.pad_tiles(image(seen), ["frame_id"], ["v"], 3 * stencil.radius_of(1.0) + 1, 32)
    out = stencil.crop_tiles(stencil.deconvolve(px, ["frame_id"], ["v"], 1.0))
    got = to_array(out, "v", seen.shape)
    assert np.abs(got - truth).mean() < np.abs(seen - truth).mean()
    spread = windows(seen, 3)
    lo, hi = spread.min(axis=(2, 3)), spread.max(axis=(2, 3))
    slack = (hi - lo) * 0.2 + 1e-9
    assert (got >= lo - slack).all() and (got <= hi + slack).all()


def test_denoise_removes_salt(image):
    flat = np.full((30, 30), 0.4) + RNG.normal(0, 0.001, (30, 30))
    salted = np.where(RNG.random(flat.shape) < 0.1, 1.0, flat)
    out = stencil.denoise(image(salted), ["frame_id"], ["v"], 0.8)
    assert to_array(out, "v", flat.shape).std() < salted.std() / 3


def test_erosion_is_diamond_shaped(image):
    flag = np.ones((15, 15))
    flag[7, 7] = 0
    df = image(flag).withColumn("ok", F.col("v") > 0)
    px = stencil.pad_tiles(df, ["frame_id"], ["ok"], 3, 8)
    out = stencil.crop_tiles(stencil.erode(px, ["frame_id"], "ok", 3))
    got = to_array(out.withColumn("v", F.col("ok").cast("double")), "v", flag.shape)
    r, c = np.indices(flag.shape)
    want = ((np.abs(r - 7) + np.abs(c - 7) > 3) & (r >= 3) & (r <= 11) & (c >= 3) & (c <= 11))
    assert (got == want).all()


def test_noise_measure(image):
    flat = RNG.normal(0.5, 0.02, (50, 50))
    rest = flat - np.median(windows(flat, 3), axis=(2, 3))
    want = np.median(np.abs(rest - np.median(rest))) * 1.4826
    got = measure.noise(image(flat), ["frame_id"], "v").first().noise
    assert got == pytest.approx(want, abs=1e-9)


# -- colour ---------------------------------------------------------------------


def test_colour_tables():
    lut = np.array(render.colormap_lut("rdylgn"))
    assert tuple(lut[0]) == (165, 0, 38) and tuple(lut[-1]) == (0, 104, 55)
    assert render.colormap_lut("no such map") == render.colormap_lut("viridis")
    assert len(registry.COLORMAPS) == 12
    for name, points in registry.COLORMAPS.items():
        p = np.array(points)
        ramp = np.arange(256) / 255.0
        want = np.stack([np.interp(ramp, p[:, 0], p[:, c]) for c in (1, 2, 3)], axis=1)
        assert np.abs(np.array(render.colormap_lut(name)) - want).max() < 1.001


def test_legend():
    item = render.legend("ndvi")
    assert item["stops"][0] == (0.0, "#0c3c78") and item["stops"][-1] == (1.0, "#084418")
    assert (item["vmin"], item["vmax"]) == (-0.2, 0.9)


def test_tone_curve_keeps_hue_and_stays_in_range(spark):
    base = np.array([0.62, 0.42, 0.26])
    rows = [tuple(base * e) for e in (0.2, 0.5, 1.0, 2.0, 3.5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows],
                               "a double, b double, c double")
    df, toned = render.tone_mapped(df, ["a", "b", "c"], 1.15, 0.72)
    for r in df.select(*[t.alias(n) for t, n in zip(toned, "rgb")]).collect():
        out = np.array([r.r, r.g, r.b])
        assert out.max() <= 1.0
        assert np.allclose(out / out.max(), base / base.max(), atol=1e-3)


def test_stretch_plans():
    plan = render.stretch_plan("radar_color")
    assert plan.windows == ((0.0, 0.35), (0.0, 0.08), (1.0, 8.0)) and plan.linear_power
    assert render.stretch_plan("radar_color", {"vmin": 0, "vmax": 1}).windows == ((0, 1),) * 3
    assert render.stretch_plan("urban").mode == "percentile_linked"
    assert render.stretch_plan("true_color").ceiling == 2.2
    assert render.stretch_plan("true_color", {"highlight_knee": 1.0}).ceiling == 1.0


def test_an_empty_channel_is_black(spark):
    df = spark.createDataFrame([(0, 0, 0, None, 0.1, 0.2)], "frame_id int, row int, col int, "
                               "red double, green double, blue double")
    row = render.render_composite(df, render.stretch_plan("true_color", {
        "stretch": "percentile"})).first()
    assert row.r == 0 and not row.valid


def rgb(image, arrays):
    df = image(arrays[0], "r")
    for name, a in zip("gb", arrays[1:]):
        df = df.join(image(a, name).drop("height", "width"), ["frame_id", "row", "col"])
    return df.withColumn("valid", F.lit(True))


def test_adaptive_contrast_spreads_a_flat_picture(image):
    flat = 0.5 + RNG.random((32, 32)) * 0.02
    out = enhance.clahe(image(flat), "v", clip_limit=40.0, tiles=4)
    assert to_array(out, "v", flat.shape).std() > 3 * flat.std()


def test_white_balance_evens_the_channels(image):
    base = RNG.random((16, 16)) * 0.5
    out = enhance.white_balance(rgb(image, [base * 1.2, base * 0.8, base * 0.4]))
    means = [to_array(out, c, base.shape).mean() for c in "rgb"]
    assert np.allclose(means, means[0], atol=1e-6)


def test_vibrance_moves_muted_colours_most(image):
    df = rgb(image, [np.array([[0.5, 0.9]]), np.array([[0.45, 0.1]]), np.array([[0.45, 0.1]])])
    out = {r.col: r for r in enhance.vibrance(df, 0.5).collect()}
    assert out[0].r - out[0].g > 0.05 * 1.3 and out[1].r - out[1].g < 0.8 * 1.2


def test_haze_removal_brings_the_darkest_near_zero(image):
    ramp = np.linspace(0.08, 0.6, 400).reshape(20, 20)
    out = to_array(enhance.dark_object_subtraction(image(ramp), ["v"]), "v", ramp.shape)
    assert out.min() < 0.005 and out.max() < 0.53


def test_cloudiness_of_known_colours(spark):
    df = spark.createDataFrame([(20, 60, 110), (30, 70, 30), (250, 250, 252), (0, 0, 0)],
                               "r int, g int, b int")
    got = [r[0] for r in df.select(tone.cloudiness(*[F.col(c) for c in "rgb"], 0.42)).collect()]
    assert got == pytest.approx([0, 0, 1, 0], abs=0.01)


def test_the_deconvolve_query_makes_all_three_rounds(spark):
    from checks import stencil_queries as stencils
    small = "/root/testdata/sf0.001"
    seen = stencils.dense(spark, small).toPandas()
    got = stencils.deconvolve(spark, small).toPandas()
    for frame, cells in seen.groupby("frame_id"):
        img, out = (x.pivot(index="row", columns="col", values="red").to_numpy()
                    for x in (cells, got[got["frame_id"] == frame]))
        lo, hi = windows(img, 3).min(axis=(2, 3)), windows(img, 3).max(axis=(2, 3))
        slack, now = (hi - lo) * 0.2, img
        for _ in range(3):
            last, now = now, np.clip(now + 0.75 * (img - blur(now, 0.6)), lo - slack, hi + slack)
        assert np.allclose(out, now, atol=1e-6) and not np.allclose(last, now, atol=1e-5)
