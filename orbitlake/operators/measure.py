"""Sharpness and noise of images, and the quality checks a merge reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .keyed import attach
from .quantiles import quantiles
from .stencil import (TILE, blurs, crop_tiles, erode, median_filter, pad_tiles, radius_of)


def sharpness(image: DataFrame, keys: Sequence[str], value: str | Mapping[str, str],
              scale: float = 2.0, where: str | None = None, tile: int = TILE) -> DataFrame:
    """Spread of the detail between 0.6 and ``scale`` pixels, per image (dense input).

    Several values share one tiling if ``value`` maps the names of the results to them.
    """
    wide = max(scale, 1.0)
    values = _named(value, "sharpness")
    extra = [where] if where else []
    px = pad_tiles(image, keys, [*dict.fromkeys(values.values()), *extra],
                   max(radius_of(0.6), radius_of(wide)), tile)
    px = crop_tiles(blurs(px, keys, {f"__{name}_{out}": (c, sigma) for out, c in values.items()
                                     for name, sigma in (("fine", 0.6), ("coarse", wide))}))
    detail = {out: F.col(f"__fine_{out}") - F.col(f"__coarse_{out}") for out in values}
    return px.groupBy(*keys).agg(*[
        F.stddev_pop(F.when(F.col(where), d) if where else d).alias(out)
        for out, d in detail.items()])


def noise(image: DataFrame, keys: Sequence[str], value: str | Mapping[str, str], size: int = 3,
          where: str | None = None, tile: int = TILE) -> DataFrame:
    """Robust spread of what a ``size`` x ``size`` median throws away, per image.

    Several values share one tiling if ``value`` maps the names of the results to them.
    """
    size = max(3, int(size))
    keys = list(keys)
    values = _named(value, "noise")
    extra = [where] if where else []
    px = pad_tiles(image, keys, [*dict.fromkeys(values.values()), *extra], size // 2, tile)
    px = crop_tiles(median_filter(px, keys, {f"__m_{out}": c for out, c in values.items()}, size))
    rest = {out: F.col(c) - F.col(f"__m_{out}") for out, c in values.items()}
    px = px.select(*keys, *[(F.when(F.col(where), r) if where else r).alias(out)
                            for out, r in rest.items()])
    # two percentiles read it several times, and a filter over neighbours is behind it
    px = materialise(px.dropna("all", subset=list(values)))
    middle = quantiles(px, keys, list(values), [0.5]).select(
        *keys, *[F.get(f"{out}_q", F.lit(0)).alias(f"__mid_{out}") for out in values])
    off = attach(px, middle, keys).select(*keys, *[
        F.abs(F.col(out) - F.col(f"__mid_{out}")).alias(out) for out in values])
    spread = quantiles(off, keys, list(values), [0.5])
    return spread.select(*keys, *[(F.get(f"{out}_q", F.lit(0)) * 1.4826).alias(out)
                                  for out in values])


def _named(value: str | Mapping[str, str], result: str) -> dict[str, str]:
    return {result: value} if isinstance(value, str) else dict(value)


def judged_cells(image: DataFrame, keys: Sequence[str], flag: str, steps: int,
                 tile: int = TILE) -> DataFrame:
    """``image`` with ``flag`` shrunk by ``steps`` wherever its image has a hole.

    An image valid everywhere keeps its flag, and so does one the shrinking would empty.
    """
    keys = list(keys)
    carry = [c for c in image.columns if c not in {*keys, "row", "col", "height", "width"}]
    px = image.withColumn("__kept", F.col(flag))
    px = materialise(crop_tiles(erode(pad_tiles(px, keys, [*carry, "__kept"], steps, tile), keys,
                                      "__kept", steps)))    # read for its state and its cells
    state = px.groupBy(*keys).agg(F.bool_and(flag).alias("__all"),
                                  F.bool_or("__kept").alias("__some"))
    px = attach(px, state, keys)
    return px.withColumn(flag, F.when(F.col("__all") | ~F.col("__some"), F.col(flag))
                         .otherwise(F.col("__kept"))).drop("__kept", "__all", "__some")
