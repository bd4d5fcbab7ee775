"""Fusing several dates, all read onto one grid finer than the satellite's."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_even
from ..functions.tone import frames_wanted
from ..operators import measure, merge, registration, resample
from ..operators.keyed import attach
from ..operators.stencil import (TILE, band_means, crop_tiles, deconvolve, match_detail,
                                 pad_tiles, radius_of, sized)
from ..session import materialise

LIFT_MARGIN = 1.3


class Fusion(NamedTuple):
    picture: DataFrame      # keys, row, col, bands
    shifts: DataFrame       # keys, scene, dy, dx
    report: DataFrame       # one row per key


def fuse(stack: DataFrame, scenes: DataFrame, bands: Sequence[str], shape: tuple[int, int],
         scale: float = 2.0, resolves: float | None = None, restore: float = 0.75,
         register: bool = True, tolerance: float = 2.5, max_lift: float = 2.0,
         keys: Sequence[str] = ("frame_id",), scene: str = "scene_ord", sparse: bool = False,
         tile: int = TILE, registration_tile: int = 512) -> Fusion:
    """Register, stack, restore and report, for every frame of one size at once.

    ``scenes`` lists the keys and scenes; the lowest scene of a frame is its reference.
    ``scale`` is how many cells the satellite's sample spans, ``resolves`` how much of that the
    number of dates justifies.
    """
    keys, bands = list(keys), list(bands)
    height, width = shape
    scale = max(float(scale), 1.0)
    resolves = float(resolves) if resolves else scale
    sigma = max(0.45 * min(scale, resolves * 1.5), 0.5)
    restore = float(restore) * min(1.0, resolves / scale)
    scenes = materialise(scenes.select(*keys, scene).distinct())     # may be read off the pixels
    images = sized(scenes, height, width) if sparse else None
    frames = sized(scenes.select(*keys).distinct(), height, width) if sparse else None
    refs = scenes.groupBy(*keys).agg(F.min(scene).alias("reference"))
    # Read for the shifts, the holes' fill, the moves and the reference's own look.
    stack = materialise(stack.select(*keys, scene, "height", "width", "row", "col", *bands,
                                     registration.guide(bands).alias("guide")))

    shifts = scenes.withColumns({"dy": F.lit(0.0), "dx": F.lit(0.0)})
    if register:
        found = materialise(registration.estimate_shifts(
            stack, refs, "guide", keys, scene, 0.16 / scale, registration_tile))
        shifts = shifts.drop("dy", "dx").join(found.drop("tiles", "determined"), [*keys, scene], "left").fillna(
            0.0, ["dy", "dx"])
    aligned = materialise(registration.align(stack, shifts, bands, keys, scene, images, tile))
    packed = merge.shallow(scenes, keys)
    merged = materialise(merge.robust_mean(aligned, bands, scenes, keys, tolerance, packed))

    restored = _restored(sized(merged, height, width), bands, keys, sigma, restore, frames, tile)
    restored = materialise(restored)
    judged = _judged(restored, stack, refs, bands, keys, scene, scale, tile)
    judged = materialise(judged)

    ref_seen = resample.as_seen(judged.withColumn("v", F.col("ref")), keys, "v", scale, height,
                                width)
    seen = judged.join(ref_seen.select(*keys, "row", "col", F.col("v").alias("ref_seen")),
                       [*keys, "row", "col"])
    window = 2 * int(round(scale)) + 1
    quality = measure.sharpness(seen, keys, {"ref_sharp": "ref_seen", "out_sharp": "out"}, scale,
                                "ok", tile)
    lift = F.when((F.col("out_sharp") > 0)
                  & (F.col("out_sharp") < F.col("ref_sharp") * LIFT_MARGIN),
                  F.least(F.col("ref_sharp") * LIFT_MARGIN / F.col("out_sharp"),
                          F.lit(float(max_lift)))).otherwise(1.0)
    quality = materialise(quality.withColumn("lift", lift))

    lifted = _lifted(restored, bands, keys, quality.select(*keys, "lift"), tile)
    lifted_guide = lifted.select(*keys, "row", "col", registration.guide(bands).alias("v"))
    after = judged.join(lifted_guide, [*keys, "row", "col"])
    sharp = measure.sharpness(after, keys, "v", scale, "ok", tile)
    quality = quality.join(sharp, keys)
    quality = quality.join(measure.noise(
        judged, keys, {"ref_noise": "ref", "out_noise": "stacked"}, window, "ok", tile), keys, "left")
    span = judged.groupBy(*keys).agg((F.max("ref") - F.min("ref")).alias("ref_span"))
    quality = quality.join(span, keys)
    report = _report(quality, shifts, merged, refs, bands[0], keys, scene, scale, resolves, sigma,
                     restore, register, height * width)
    picture = lifted.select(*keys, "height", "width", "row", "col", *[
        F.when(F.col(f"{b}_ok"), F.col(b)).alias(b) for b in bands])
    return Fusion(picture, shifts, report)


def _restored(merged: DataFrame, bands, keys, sigma: float, restore: float, frames,
              tile: int) -> DataFrame:
    """Deconvolved bands, the stack they came from (``<band>_m``) and where it was measured."""
    halo = 3 * radius_of(sigma) + 1 if restore > 0 else 0
    wide = pad_tiles(merged, keys, bands, halo, tile, frames=frames,
                     fill=band_means(merged, keys, bands))
    wide = wide.withColumns({f"{b}_m": F.col(b) for b in bands})
    if restore > 0:
        wide = deconvolve(wide, keys, bands, sigma, restore)
    return crop_tiles(wide)


def _judged(restored: DataFrame, stack: DataFrame, refs: DataFrame, bands, keys, scene: str,
            scale: float, tile: int) -> DataFrame:
    """Per cell: the reference's, the stack's and the result's brightness, and ``ok``."""
    first = attach(stack, refs, keys, how="inner").where(F.col(scene) == F.col("reference"))
    first = first.select(*keys, "row", "col", F.col("guide").alias("ref"))
    any_ok = F.greatest(*[F.col(f"{b}_ok") for b in bands]) if len(bands) > 1 else F.col(
        f"{bands[0]}_ok")
    stacked = restored.select(*[F.col(f"{b}_m").alias(b) for b in bands], *keys, "row", "col",
                              "height", "width", any_ok.alias("__fused_ok"),
                              registration.guide(bands).alias("out"))
    cells = stacked.withColumn("stacked", registration.guide(bands)).drop(*bands)
    cells = cells.join(first, [*keys, "row", "col"], "left")
    cells = cells.withColumn("ok", F.col("__fused_ok") & F.col("ref").isNotNull())
    cells = materialise(cells.drop("__fused_ok"))       # read for its means and its cells
    means = cells.groupBy(*keys).agg(F.coalesce(F.avg("ref"), F.lit(0.0)).alias("__mean"))
    cells = attach(cells, means, keys)
    cells = cells.withColumn("ref", F.coalesce("ref", "__mean")).drop("__mean")
    return measure.judged_cells(cells, keys, "ok", 2 * int(round(scale)) + 2, tile)


def _lifted(restored: DataFrame, bands, keys, lifts: DataFrame, tile: int) -> DataFrame:
    flags = [f"{b}_ok" for b in bands]
    px = attach(restored, lifts, keys)
    wide = pad_tiles(px, keys, [*bands, *flags, "lift"], radius_of(0.8), tile)
    return crop_tiles(match_detail(wide, keys, bands, F.col("lift"))).drop("lift")


def _report(quality: DataFrame, shifts: DataFrame, merged: DataFrame, refs: DataFrame, band: str,
            keys, scene: str, scale: float, resolves: float, sigma: float, restore: float,
            register: bool, cells: int) -> DataFrame:
    size = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    moved = (F.greatest(F.abs("dy"), F.abs("dx")) > 1e-3) & (F.col(scene) != F.col("reference"))
    entry = F.struct(F.col(scene).alias("scene"), half_even(F.col("dy"), 3).alias("dy"),
                     half_even(F.col("dx"), 3).alias("dx"),
                     (F.col(scene) == F.col("reference")).alias("reference"))
    moves = shifts.join(refs, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("scenes"),
        F.count(F.when(moved, 1)).cast("int").alias("sub_pixel_dates"),
        half_even(F.avg(size), 3).alias("mean_shift_px"),
        half_even(F.max(size), 3).alias("max_shift_px"),
        F.sort_array(F.collect_list(entry)).alias("shifts"))
    depth = merged.groupBy(*keys).agg(
        half_even(F.sum(f"{band}_kept") / float(cells), 2).alias("samples_per_pixel"))
    wanted = frames_wanted(resolves)
    measurable = F.col("ref_noise") > F.greatest(F.lit(1e-6), F.col("ref_span") * 1e-4)
    # a frame of which no date has a row is in no depth
    return moves.join(depth, keys, "left").fillna(0.0, ["samples_per_pixel"]).join(
        quality, keys).select(
        *keys, F.lit(round(resolves, 2)).alias("scale"),
        F.lit(round(scale, 2)).alias("oversampling"), "scenes",
        F.lit(wanted).alias("frames_wanted"), (F.col("scenes") >= wanted).alias("well_supported"),
        F.lit(bool(register)).alias("registered"), "sub_pixel_dates", "mean_shift_px",
        "max_shift_px", "shifts", "samples_per_pixel", F.lit(round(restore, 2)).alias("restore"),
        half_even(F.col("lift"), 2).alias("detail_lift"),
        F.lit(round(sigma, 2)).alias("psf_sigma_px"),
        F.when(F.col("ref_sharp") > 1e-9, half_even(
            (F.col("sharpness") / F.col("ref_sharp") - 1.0) * 100.0, 1)).otherwise(0.0)
        .alias("sharpness_gain_pct"),
        F.when(measurable, half_even((1.0 - F.col("out_noise") / F.col("ref_noise")) * 100.0, 1))
        .alias("noise_drop_pct"))
