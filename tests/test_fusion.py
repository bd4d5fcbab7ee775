import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake import registry
from orbitlake.operators import registration, resample
from orbitlake.plans import fusion, render

from conftest import to_array
from test_images import blur

RNG = np.random.default_rng(11)


def shifted(a, dy, dx):
    """Periodic sub-pixel move of a band-limited image by the Fourier shift theorem."""
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    return np.real(np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (fy * dy + fx * dx))))


@pytest.mark.parametrize("dy, dx", [(0, 0), (1.4, -2.35), (-0.6, 0.3), (3, 2)])
def test_known_shifts_are_recovered(dy, dx):
    texture = blur(RNG.normal(size=(192, 192)), 2.0)
    moved = shifted(texture, dy, dx)
    got = registration.tile_shift(texture, moved, cutoff=0.08)
    assert got[0] == pytest.approx(-dy, abs=0.15) and got[1] == pytest.approx(-dx, abs=0.15)
    assert got[2] >= registration.MIN_LEAD


def test_unrelated_ground_has_no_clear_peak():
    a, b = (blur(RNG.normal(size=(96, 96)), 2.0) for _ in range(2))
    assert registration.tile_shift(a, b, 0.08)[2] < registration.MIN_LEAD
    assert registration.tile_shift(a, np.full(a.shape, np.nan), 0.08)[2] == 0.0


@pytest.mark.parametrize("dy, dx", [(0.0, 0.0), (1.4, -2.35), (-4, 6), (5.5, 0.25)])
def test_holes_that_stay_do_not_hold_a_picture_back(dy, dx):
    """Clouds over a third of both dates, in the same place or in others."""
    texture = blur(RNG.normal(size=(160, 160)), 2.0)
    moved = shifted(texture, dy, dx)
    clouds = blur(RNG.normal(size=(160, 160)), 8.0)
    others = blur(RNG.normal(size=(160, 160)), 8.0)
    for cover in (clouds, others):
        a = np.where(clouds > np.quantile(clouds, 0.67), np.nan, texture)
        b = np.where(cover > np.quantile(cover, 0.67), np.nan, moved)
        got = registration.tile_shift(a, b, cutoff=0.08)
        assert got.lead >= registration.MIN_LEAD
        assert got.dy == pytest.approx(-dy, abs=0.15) and got.dx == pytest.approx(-dx, abs=0.15)


def test_masked_correlation_equals_plain_sums():
    a, b = RNG.normal(size=(14, 17)), RNG.normal(size=(14, 17))
    a[RNG.random(a.shape) < 0.3] = np.nan
    b[RNG.random(b.shape) < 0.3] = np.nan
    best = {}
    for dy in range(-9, 10):
        for dx in range(-9, 10):
            x, y = registration._common(a, b, dy, dx)
            both = np.isfinite(x) & np.isfinite(y) if x.size else np.zeros(0, bool)
            if both.sum() > 2:
                best[dy, dx] = both.sum(), np.corrcoef(x[both], y[both])[0, 1]
    most = max(n for n, _ in best.values())
    dy, dx = max((k for k, (n, _) in best.items() if n >= max(20, 0.3 * most)),
                 key=lambda k: best[k][1])
    got = registration.masked_match(a, b, least=20)
    assert (got.dy, got.dx, got.cells) == (dy, dx, best[dy, dx][0])
    assert got.correlation == pytest.approx(best[dy, dx][1], abs=1e-9)


def test_too_few_common_cells_are_not_determinable(stack):
    texture = blur(RNG.normal(size=(40, 40)), 2.0)
    few = np.full(texture.shape, np.nan)
    few[:6, :6] = texture[:6, :6]
    flat = np.full(texture.shape, 0.25)
    px, listed = stack([texture, few, flat, texture])
    refs = listed.groupBy("frame_id").agg(F.min("scene_ord").alias("reference"))
    got = {r.scene_ord: r for r in registration.estimate_shifts(px, refs, "red").collect()}
    assert [got[k].determined for k in (1, 2, 3)] == [False, False, True]
    assert got[1].dy == got[2].dx == 0.0 and got[1].tiles == 0
    tiles = {r.scene_ord: r for r in registration.tile_shifts(px, refs, "red").collect()}
    assert tiles[1].whole_dy is None and tiles[3].cells == 1600


def test_shifts_are_agreed_over_tiles(stack, spark):
    texture = blur(RNG.normal(size=(128, 128)), 2.0)
    px, listed = stack([texture, shifted(texture, 1.5, -2.0), shifted(texture, 0.0, 0.0)])
    refs = listed.groupBy("frame_id").agg(F.min("scene_ord").alias("reference"))
    out = registration.estimate_shifts(px, refs, "red", tile=64, cutoff=0.08)
    got = {r.scene_ord: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1].tiles == 4
    assert got[1].dy == pytest.approx(-1.5, abs=0.15)
    assert got[1].dx == pytest.approx(2.0, abs=0.15)
    assert abs(got[2].dy) < 0.05


def test_alignment_moves_values_and_holes(stack, spark):
    texture = blur(RNG.normal(size=(40, 44)), 2.5)
    moved = shifted(texture, 1.25, -0.5)
    moved[20:24, 20:24] = np.nan
    px, _ = stack([texture, moved])
    moves = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, -1.25, 0.5)],
                                  "frame_id int, scene_ord int, dy double, dx double")
    out = registration.align(px, moves, ["red"], tile=16)
    still = to_array(out.where("scene_ord = 0"), "red", texture.shape)
    assert np.allclose(still, texture)
    back = to_array(out.where("scene_ord = 1"), "red", texture.shape)
    inner = (slice(4, 16), slice(4, 40))
    assert np.abs(back[inner] - texture[inner]).max() < 0.02 * np.ptp(texture)
    assert np.isnan(back[20, 22]) and not np.isnan(back[30, 30])
    assert np.isnan(back[-1]).all() and np.isnan(back[:, 0]).all()


def test_a_single_sample_per_block_is_enlarged_smoothly(image):
    r, c = np.indices((24, 24))
    ramp = (r + 2.0 * c) / 100.0
    blocks = np.kron(ramp[::2, ::2], np.ones((2, 2)))
    seen = to_array(resample.as_seen(image(blocks), ["frame_id"], "v", 2.0, 24, 24), "v", (24, 24))
    assert np.abs(np.diff(seen[:, 4:-4], axis=1)).std() < np.abs(np.diff(blocks, axis=1)).std() / 3


@pytest.mark.parametrize("shape, out", [((6, 9), (11, 17)), ((5, 5), (5, 5)), ((4, 30), (13, 31)),
                                        ((1, 7), (3, 13))])
def test_splines_go_through_all_cells(image, shape, out):
    """Against the spline found by solving its equations, mirrored in the outermost cells."""
    values = RNG.normal(size=shape)

    def along(line, places):
        n = len(line)
        mirror = lambda i: min(i % max(2 * n - 2, 1), max(2 * n - 2, 1) - i % max(2 * n - 2, 1))
        matrix = np.zeros((n, n))
        for i in range(n):
            for j, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
                matrix[i, mirror(i + j) if n > 1 else 0] += w
        c = np.linalg.solve(matrix, line)
        b = lambda d: (4 - 6 * d * d + 3 * d ** 3) / 6 if d < 1 else max(2 - d, 0) ** 3 / 6
        return [sum(b(abs(p - j)) * c[mirror(j) if n > 1 else 0]
                    for j in range(int(p) - 2, int(p) + 4)) for p in places]
    steps = [np.arange(o) * ((n - 1) / (o - 1)) for n, o in zip(shape, out)]
    half = np.array([along(line, steps[1]) for line in values])
    want = np.array([along(line, steps[0]) for line in half.T]).T
    got = resample.resample(image(values), ["frame_id"], ["v"], *out, "spline", corners=True)
    assert np.allclose(to_array(got, "v", out), want, atol=1e-10)


@pytest.fixture(scope="module")
def dates():
    """Six dates of one scene, each sampled at another sub-pixel phase, with noise."""
    n, scale = 64, 2
    truth = 0.3 + 0.1 * blur(RNG.normal(size=(n, n)), 1.1) / 0.2
    layers = []
    for oy, ox in ((0, 0), (1, 0), (0, 1), (1, 1), (1, 0), (0, 1)):
        soft = blur(truth, 0.9)
        moved = np.roll(soft, (-oy, -ox), axis=(0, 1))
        native = moved[::scale, ::scale] + RNG.normal(0, 0.004, (n // scale, n // scale))
        layers.append(np.roll(np.kron(native, np.ones((scale, scale))), (oy, ox), axis=(0, 1)))
    return truth, layers


def test_a_merge_is_sharper_than_one_date(stack, dates):
    truth, layers = dates
    px, listed = stack(layers)
    fused = fusion.fuse(px, listed, ["red"], truth.shape, scale=2.0, tile=64)
    report = fused.report.first()
    assert report.scenes == 6 and report.well_supported and report.frames_wanted == 4
    assert report.max_shift_px < 1.5
    assert report.sharpness_gain_pct > 0
    picture = to_array(fused.picture, "red", truth.shape)
    inner = (slice(8, -8), slice(8, -8))
    error = lambda a: np.abs(a[inner] - truth[inner]).mean()
    assert error(picture) < error(layers[0])


def test_render_chooses_the_merge_by_dates_and_grid(stack, dates):
    truth, layers = dates
    px, listed = stack(layers[:3])
    px = px.withColumns({"green": F.col("red"), "blue": F.col("red") * 0.8})
    wide = render.render(px, listed, "sentinel-2", truth.shape, 12.0, tile=64)
    meta = wide.meta.first()
    assert meta.method == "median" and meta.effective_res_m == 10.0 and meta.covered
    assert meta.valid_pct == 100.0 and meta.label == "True colour"
    row = wide.picture.first()
    assert row.a == 255 and 0 <= row.b <= row.r <= 255


def test_radar_is_averaged(stack, dates):
    _, layers = dates
    px, listed = stack([a * 10 + 40 for a in layers[:2]], "vv")
    out = render.render(px, listed, "sentinel-1", layers[0].shape, 5.0, name="radar_grey", tile=64)
    meta = out.meta.first()
    assert meta.method == "mean" and meta.native_res_m == 20


def test_a_render_brings_the_stack_onto_its_grid(spark, stack):
    from orbitlake.operators.resample import resample
    from orbitlake.plans import render
    rng = np.random.default_rng(3)
    px, scenes = stack([rng.random((24, 32))], "red")
    px = px.withColumns({"green": F.col("red") * 0.8, "blue": F.col("red") * 0.6})
    bands = ["red", "green", "blue"]
    own = render.render(px.drop("height", "width"), scenes, "sentinel-2", (12, 16), 20.0, tile=64,
                        native_shape=(24, 32)).picture
    ready = resample(px, ["frame_id", "scene_ord"], bands, 12, 16, "bilinear")
    want = render.render(ready, scenes, "sentinel-2", (12, 16), 20.0, tile=64).picture
    rows = lambda df: sorted(map(tuple, df.select("row", "col", "r", "g", "b").collect()))
    assert rows(own) == rows(want) and len(rows(own)) == 12 * 16


def test_clouds_are_counted_on_the_grid(stack):
    """A date wholly under cloud, on cells twice as coarse as the grid, and one half under it."""
    rng = np.random.default_rng(4)
    px, scenes = stack([rng.random((16, 16)), rng.random((16, 16))], "red")
    cloud = F.when((F.col("scene_ord") == 0) | (F.col("row") < 8), 9).otherwise(4)
    px = px.withColumns({"green": F.col("red"), "blue": F.col("red"), "scl": cloud}).drop(
        "height", "width")
    for some, share in (("scene_ord = 0", 100.0), ("scene_ord = 1", 50.0), ("true", 50.0)):
        out = render.render(px.where(some), scenes.where(some), "sentinel-2", (32, 32), 5.0,
                            tile=64, native_shape=(16, 16),
                            opts={"mask_clouds": True, "superres": 1})
        assert out.meta.first().cloud_masked_pct == share


def test_single_dates_beside_a_pair_keep_their_own_sampling(spark, stack):
    rng = np.random.default_rng(5)
    one, two = rng.random((12, 12)), rng.random((12, 12))
    px, scenes = stack([one, two], "red")
    pair = px.drop("height", "width")
    alone = pair.where("scene_ord = 0").withColumn("frame_id", F.lit(1))
    sat = registry.satellite("sentinel-2")
    listed = pair.union(alone).select("frame_id", "scene_ord").distinct()
    plan = render.frame_plans(listed, sat, 5.0, {}, ["frame_id"], "scene_ord")
    args = (plan, sat, (24, 24), 5.0, ["red"], ["frame_id"], "scene_ord")
    got = render.on_grid({(12, 12): pair.union(alone)}, *args)
    block = to_array(got.where("frame_id = 0 and scene_ord = 0"), "red", (24, 24))
    assert np.array_equal(block, np.kron(one, np.ones((2, 2))))
    smooth = to_array(got.where("frame_id = 1"), "red", (24, 24))
    cubic = resample.resample(resample_ready(alone), ["frame_id", "scene_ord"], ["red"], 24, 24)
    assert np.allclose(smooth, to_array(cubic, "red", (24, 24)))
    with pytest.raises(registry.QueryError, match="nir"):
        render.on_grid({(12, 12): pair}, plan, sat, (24, 24), 5.0, ["nir"], ["frame_id"],
                       "scene_ord")


def resample_ready(df):
    from orbitlake.operators.stencil import sized
    return sized(df, 12, 12)
