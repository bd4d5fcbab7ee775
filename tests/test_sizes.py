"""What keeps a question in proportion to its input: the shape of plans, reads and tasks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_colours_are_counted_before_they_are_looked_up(spark):
    from checks.render_queries import colour_counts
    plan = optimised(colour_counts(spark, SMALL)).splitlines()
    assert not [line for line in plan if re.search(r"Filter .*sort_array", line)]
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line and "idx" in line)
    assert any(re.search(r"Aggregate .*idx", line) for line in plan[join + 1:])


def test_packed_median_of_any_depth(spark):
    from orbitlake.operators import merge
    nan = float("nan")
    cells = [[], [None], [3.0], [None, 4.0, 1.0], [2.0, 9.0, 4.0], [5.0, None, 1.0, 2.0, 2.5],
             [1.0, nan, 2.0]]
    rows = [(0, i, 0, v) for i, held in enumerate(cells) for v in held]
    df = spark.createDataFrame(rows, "frame_id int, row int, col int, red double")
    found = {r["row"]: r["red"] for r in
             merge.composite(df, ["red"], packed=True).collect()}
    assert found == {1: None, 2: 3.0, 3: 2.5, 4: 4.0, 5: 2.25, 6: 2.0}


@pytest.mark.parametrize("name", ["stretch_percentile", "stretch_linked", "haze", "robust_mean"])
def test_passes_of_percentiles_read_what_is_written_down(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from orbitlake.operators import quantiles
    seen, counts = [], quantiles._counts

    def watched(values, *args, **kw):
        seen.append(optimised(values))
        return counts(values, *args, **kw)
    monkeypatch.setattr(quantiles, "_counts", watched)
    entry.queries()[name](spark, SMALL)
    assert seen and not [plan for plan in seen if "parquet" in plan]


def test_small_tiles_share_a_call(spark, monkeypatch):
    """Lots give what single scenes give, tiles a scene lacks included, and far fewer groups."""
    from orbitlake.operators import registration
    rng = np.random.default_rng(5)
    big = 1 << 60                       # scenes beyond what a double holds exactly
    rows = [(f, big + s, y, x, float(v)) for f in range(2) for s in range(40)
            for (y, x), v in np.ndenumerate(rng.normal(size=(8, 16)))
            if not (s % 3 == 2 and x >= 8) and v < 1.5]
    px = spark.createDataFrame(rows, "frame_id int, scene_ord long, row int, col int, guide double")
    refs = spark.createDataFrame([(0, big), (1, big)], "frame_id int, reference long")
    run = lambda: registration.tile_shifts(px, refs, tile=8, least=12)
    together = run()
    assert together.count() == 2 * 39 * 2
    groups = re.search(r"FlatMapGroupsInPandas \[([^\]]*)\]", optimised(together)).group(1)
    assert "lot" in groups and "scene_ord" not in groups
    monkeypatch.setattr(registration, "LOT_CELLS", 1)
    key = lambda r: (r["frame_id"], r["scene_ord"], r["tx"])
    assert sorted(together.collect(), key=key) == sorted(run().collect(), key=key)
    assert together.where("tx = 1 and cells is null").count() == 2 * 13
    assert {r["scene_ord"] for r in together.collect()} == {big + s for s in range(1, 40)}


def widest(df):
    """The largest number of tasks of a plan's exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return max(map(int, re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan)),
               default=0)


@pytest.mark.parametrize("build", ["tiles", "lines"])
def test_tasks_grow_with_the_images(spark, monkeypatch, build):
    """Dense tiles and new cells are dealt by their number, not by their bytes."""
    from orbitlake.operators import resample, stencil
    monkeypatch.setattr(stencil, "TASK_CELLS", 1000, raising=False)
    for images in (10, 40):
        px = stencil.sized(spark.range(images).select(
            F.col("id").alias("frame_id"), F.lit(3).alias("row"), F.lit(4).alias("col"),
            F.lit(1.0).alias("v")), 20, 20)
        frames = px.select("frame_id", "height", "width")
        df = (stencil.pad_tiles(px, ["frame_id"], ["v"], 2, 10, frames=frames) if build == "tiles"
              else resample.resample(px, ["frame_id"], ["v"], 40, 40, "cubic"))
        cells = images * (28 * 28 if build == "tiles" else 1600)
        assert widest(df) == -(-cells // 1000)


def test_scenes_that_stay_put_are_not_filled_up(spark, image):
    """An unmoved sparse scene comes back as it is, beside a moved one that is read from all cells."""
    from orbitlake.operators import registration, stencil
    rng = np.random.default_rng(3)
    rows = [(0, s, y, x, float(v)) for s in range(2)
            for (y, x), v in np.ndenumerate(rng.normal(size=(12, 16))) if rng.random() < 0.5]
    px = stencil.sized(spark.createDataFrame(
        rows, "frame_id int, scene_ord int, row int, col int, red double"), 12, 16)
    moves = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0)],
                                  "frame_id int, scene_ord int, dy double, dx double")
    frames = stencil.sized(moves.select("frame_id", "scene_ord"), 12, 16)
    out = registration.align(px, moves, ["red"], frames=frames, tile=8).collect()
    still = sorted((r["row"], r["col"], r["red"]) for r in out if r["scene_ord"] == 0)
    assert still == sorted((y, x, v) for _, s, y, x, v in rows if s == 0)
    moved = {(r["row"], r["col"]): r["red"] for r in out if r["scene_ord"] == 1}
    assert len(moved) == 12 * 16
    assert {at: v for at, v in moved.items() if v is not None} == {
        (y + 1, x): v for _, s, y, x, v in rows if s == 1 and y < 11}


@pytest.mark.parametrize("halo, tile", [(0, 4), (2, 4), (5, 4), (3, 5)])
def test_halos_are_dealt_in_generated_code(image, halo, tile):
    """Every tile's cells and its mirrored surroundings, once each, without a lambda in the plan."""
    from orbitlake.operators import stencil
    grid = np.arange(7 * 9, dtype=float).reshape(7, 9)
    wide = stencil.pad_tiles(image(grid), ["frame_id"], ["v"], halo, tile)
    assert "lambda" not in optimised(wide)
    around = np.pad(grid, halo, mode="symmetric")
    want = {(ty, tx, y, x, around[y + halo, x + halo])
            for ty in range(-(-7 // tile)) for tx in range(-(-9 // tile))
            for y in range(max(-halo, ty * tile - halo), min(7 + halo, ty * tile + tile + halo))
            for x in range(max(-halo, tx * tile - halo), min(9 + halo, tx * tile + tile + halo))}
    got = [(r["ty"], r["tx"], r["row"], r["col"], r["v"]) for r in wide.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_filled_columns_may_be_replaced_by_medians(image):
    from orbitlake.operators import stencil
    wide = stencil.pad_tiles(image(np.ones((5, 6))), ["frame_id"], ["v"], 1, 4, fill=0.0)
    out = stencil.crop_tiles(stencil.median_filter(wide, ["frame_id"], {"v": "v"}, 3))
    assert {r["v"] for r in out.collect()} == {1.0}


def test_measures_of_several_values_share_a_tiling(image):
    from orbitlake.operators import measure
    from pyspark.sql import functions as F
    px = image(np.random.default_rng(4).normal(size=(12, 14))).withColumn("w", F.col("v") * 3)
    for measured in (measure.sharpness, measure.noise):
        both = measured(px, ["frame_id"], {"a": "v", "b": "w"}, tile=8).first()
        one = [measured(px, ["frame_id"], c, tile=8).first()[1] for c in "vw"]
        assert [both["a"], both["b"]] == pytest.approx(one)


def test_equalising_makes_no_row_for_every_level(spark, image):
    from orbitlake.operators import enhance
    plan = optimised(enhance.clahe(image(np.linspace(0, 1, 81).reshape(9, 9)), "v", tiles=3))
    assert "Window" not in plan and "Generate" not in plan


def test_equalising_frames_whose_tiles_differ_in_size(spark):
    from orbitlake.operators import enhance
    rng = np.random.default_rng(4)
    tall = {key: rng.random(shape) for key, shape in ((1, (7, 11)), (2, (5, 8)))}
    rows = [(key, *at, float(v) if v > 0.2 else None, *a.shape)
            for key, a in tall.items() for at, v in np.ndenumerate(a) if v > 0.1]
    df = spark.createDataFrame(rows, "frame_id int, row int, col int, v double, height int, width int")
    both = {(r.frame_id, r.row, r.col): r.v for r in enhance.clahe(df, "v", tiles=3).collect()}
    assert len(both) == len(rows)
    for key, a in tall.items():
        h, w = a.shape
        edges = [[int(np.floor(i * n / 3)) for i in range(3)] + [n] for n in (h, w)]
        maps, levels = np.zeros((3, 3, 256)), np.zeros(a.shape, int)
        levels[a > 0.2] = (a[a > 0.2] * 255).astype(int)
        for y, x in np.ndindex(3, 3):
            tile = levels[edges[0][y]:edges[0][y + 1], edges[1][x]:edges[1][x + 1]]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            limit = max(2.0 * tile.size / 256, 1.0)
            total = np.cumsum(np.minimum(counts, limit) + np.maximum(counts - limit, 0).sum() / 256)
            maps[y, x] = (total - total[0]) / max(total[-1] - total[0], 1e-6)
        mids = [[(e[i] + e[i + 1]) / 2 for i in range(3)] for e in edges]
        for (r, c), v in np.ndenumerate(a):
            if v > 0.1:
                along = [np.interp(c, mids[1], maps[y, :, levels[r, c]]) for y in range(3)]
                want = np.interp(r, mids[0], along) if v > 0.2 else None
                got = both[key, r, c]
                assert got is None if want is None else abs(got - want) < 1e-9


def test_dates_travel_to_their_cells_before_they_are_held(spark):
    from orbitlake.operators import merge
    df = spark.createDataFrame([(0, 0, 0, 1.0)], "frame_id int, row int, col int, red double")
    plan = optimised(merge.composite(df, ["red"], packed=True)).splitlines()
    assert "Aggregate" in plan[0] and any("RepartitionByExpression" in line for line in plan[1:])


def test_cells_that_denoising_made_are_not_made_again(spark, monkeypatch):
    from checks.plan_queries import render_enhanced
    from orbitlake.plans import render as rendering

    def never(*args, **kw):
        raise AssertionError("tiled twice")
    monkeypatch.setattr(rendering, "pad_tiles", never)
    assert render_enhanced(spark, SMALL).columns


def test_written_pictures_keep_rows_and_types(spark):
    from orbitlake.session import written
    df = spark.createDataFrame([(1, None, True), (2, float("nan"), None), (3, 0.5, False)],
                               "a int, `b c` double, d boolean")
    for some in (df, df.where("a > 9")):
        back = written(some)
        assert back.dtypes == some.dtypes and "parquet" in back.inputFiles()[0]
        assert sorted(map(str, back.collect())) == sorted(map(str, some.collect()))
