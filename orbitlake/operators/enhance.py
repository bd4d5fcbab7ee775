"""Haze removal before the stretch; adaptive contrast, white balance, vibrance after it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import tone
from ..functions.numeric import clip
from ..session import materialise, written
from .keyed import attach
from .quantiles import quantiles

BINS = 256
RGB = ("r", "g", "b")


def dark_object_subtraction(df: DataFrame, bands: Sequence[str],
                            keys: Sequence[str] = ("frame_id",), percentile: float = 1.0,
                            strength: float = 1.0, method: str = "exact") -> DataFrame:
    """Subtract most of each band's darkest level, per frame; nothing goes below 0."""
    if strength <= 0:
        return df
    df = materialise(df)            # read for each pass of the floors and again for the picture
    floors = quantiles(df, keys, bands, [percentile / 100.0], method).select(
        *keys, *[F.get(f"{b}_q", F.lit(0)).alias(f"__f_{b}") for b in bands])
    lifted = attach(df, floors, keys)
    return lifted.withColumns({
        b: clip(F.col(b) - F.col(f"__f_{b}") * float(strength) * 0.98, 0.0, None)
        for b in bands}).drop(*[f"__f_{b}" for b in bands])


def white_balance(df: DataFrame, keys: Sequence[str] = ("frame_id",), strength: float = 1.0,
                  channels: Sequence[str] = RGB) -> DataFrame:
    """Grey-world balance of 0..1 channels per frame.

    The means are over the whole frame: invalid pixels count as they are drawn, and cells that
    have no row or no value are black.  The frame is ``height`` x ``width`` where those columns
    are there, else the rows.
    """
    if strength <= 0:
        return df
    df = written(df)                # read for the means and again for the picture
    whole = F.max(F.col("height").cast("long") * F.col("width")) \
        if {"height", "width"} <= set(df.columns) else F.count(F.lit(1))
    means = df.groupBy(*keys).agg(*[(F.sum(F.coalesce(F.col(c), F.lit(0.0))) / whole)
                                    .alias(f"__m_{c}") for c in channels])
    target = sum((F.col(f"__m_{c}") for c in channels[1:]), F.col(f"__m_{channels[0]}")) / 3.0
    gains = means.select(*keys, *[
        (F.lit(1.0) + (F.when(F.col(f"__m_{c}") > 1e-5, target / F.col(f"__m_{c}"))
                       .otherwise(1.0) - 1.0) * float(strength)).alias(f"__g_{c}")
        for c in channels])
    return (attach(df, gains, keys)
            .withColumns({c: clip(F.col(c) * F.col(f"__g_{c}"), 0.0, 1.0) for c in channels})
            .drop(*[f"__g_{c}" for c in channels]))


def vibrance(df: DataFrame, amount: float, channels: Sequence[str] = RGB) -> DataFrame:
    """Lift muted colours of 0..1 channels and leave saturated ones alone."""
    if amount == 0:
        return df
    rgb = [F.col(c) for c in channels]
    df = df.withColumn("__base", tone.luma(*rgb))
    df = df.withColumn("__gain", tone.vibrance_gain(*rgb, F.col("__base"), amount))
    moved = {c: clip(F.col("__base") + (F.col(c) - F.col("__base")) * F.col("__gain"), 0.0, 1.0)
             for c in channels}
    return df.withColumns(moved).drop("__base", "__gain")


# -- contrast-limited adaptive histogram equalisation --------------------------


def _edge(i: Column, size: Column, tiles: int) -> Column:
    """First row (or column) of tile ``i``; tile ``tiles`` starts at ``size``."""
    return F.when(i >= tiles, size.cast("double")).otherwise(
        F.floor(i.cast("double") * (size / F.lit(float(tiles)))).cast("double"))


def _tile_of(at: Column, size: Column, tiles: int) -> Column:
    index = F.lit(0)
    for i in range(1, tiles):
        index = index + (at >= _edge(F.lit(i), size, tiles)).cast("int")
    return index


def _centre(i: Column, size: Column, tiles: int) -> Column:
    return (_edge(i, size, tiles) + _edge(i + 1, size, tiles)) / 2.0


def _blend(tile: Column, at: Column, size: Column, tiles: int) -> tuple[Column, Column]:
    """Lower neighbour tile and the weight of the upper one, between tile centres."""
    low = F.when(at >= _centre(tile, size, tiles), tile).otherwise(tile - 1)
    inside = (low >= 0) & (low < tiles - 1)
    base = _centre(low, size, tiles)
    weight = F.when(inside, (at - base) / (_centre(low + 1, size, tiles) - base)).otherwise(0.0)
    return F.greatest(low, F.lit(0)), weight


def clahe(df: DataFrame, value: str, keys: Sequence[str] = ("frame_id",),
          clip_limit: float = 2.0, tiles: int = 8) -> DataFrame:
    """Equalise a 0..1 column within a grid of tiles, blended between tile centres.

    Histograms and clip limits are of the whole tile: cells without a row or a value count as
    black, though they stay NULL.  Counting is a map-side-combined aggregate of at most 256 rows
    per tile, whatever its size; a frame's counts become its mappings at once, and the four
    surrounding ones reach each pixel as one array through one join on (frame, tile), which spreads
    every frame over its tiles.
    """
    if clip_limit <= 0:
        return df
    keys, tiles = list(keys), max(2, min(int(tiles), 16))
    h, w = F.col("height"), F.col("width")
    df = written(df)                # read for the counts and again for the picture
    # a level that cannot be NULL gets no inferred filter, which would otherwise be pushed down and
    # drag the whole picture expression with it
    level = F.coalesce(clip(F.col(value) * (BINS - 1.0), 0.0, BINS - 1.0).cast("int"), F.lit(0))
    px = df.withColumns({"__ty": _tile_of(F.col("row"), h, tiles),
                         "__tx": _tile_of(F.col("col"), w, tiles), "__q": level})
    corners = _corners(px, keys, clip_limit, tiles)
    low_y, wy = _blend(F.col("__ty"), F.col("row"), h, tiles)
    low_x, wx = _blend(F.col("__tx"), F.col("col"), w, tiles)
    px = px.withColumns({"__y0": low_y, "__wy": wy, "__x0": low_x, "__wx": wx}).drop("__ty", "__tx")
    px = attach(px, corners, [*keys, "__y0", "__x0"], row_bytes=4 * BINS * 8 + 64)
    at = lambda corner: F.get("__map", F.col("__q") + corner * BINS)
    top = at(0) * (1.0 - F.col("__wx")) + at(1) * F.col("__wx")
    low = at(2) * (1.0 - F.col("__wx")) + at(3) * F.col("__wx")
    mixed = clip(top * (1.0 - F.col("__wy")) + low * F.col("__wy"), 0.0, 1.0)
    return px.withColumn(value, F.when(F.col(value).isNotNull(), mixed)).select(*df.columns)


def _corners(px: DataFrame, keys: list[str], clip_limit: float, tiles: int) -> DataFrame:
    """For every lower neighbour tile, ``__map``: 256 values each of its own mapping, that of the
    next tile along the row, along the column, and along both."""
    counted = px.groupBy(*keys, "__ty", "__tx", "__q").agg(
        F.count(F.lit(1)).alias("__h"), F.max("height").alias("__fh"), F.max("width").alias("__fw"))
    own = [f for f in counted.schema.fields if f.name in keys]
    schema = T.StructType([*own, T.StructField("__y0", T.IntegerType()),
                           T.StructField("__x0", T.IntegerType()),
                           T.StructField("__map", T.ArrayType(T.DoubleType()))])

    def of_frame(counts: pa.Table) -> pa.Table:
        ty, tx, q, h = (counts[c].to_numpy() for c in ("__ty", "__tx", "__q", "__h"))
        sides = [np.diff([*(np.floor(np.arange(tiles) * (size / tiles))), size]) for size in (
            int(counts[c].to_numpy().max()) for c in ("__fh", "__fw"))]
        held = np.zeros((tiles, tiles, BINS))
        held[ty, tx, q] = h
        maps = _mappings(held, np.outer(*sides).astype(np.int64), clip_limit)
        after = np.minimum(np.arange(tiles) + 1, tiles - 1)
        corners = np.stack((maps, maps[:, after], maps[after], maps[after][:, after]), axis=2)
        y0, x0 = (a.reshape(-1).astype(np.int32) for a in np.indices((tiles, tiles)))
        offsets = np.arange(0, corners.size + 1, 4 * BINS, dtype=np.int32)
        first = counts.select(keys).take(pa.array(np.zeros(len(y0), np.int64)))
        return pa.table({**{k: first[k] for k in keys}, "__y0": y0, "__x0": x0,
                         "__map": pa.ListArray.from_arrays(offsets, corners.reshape(-1))})
    return counted.groupBy(*keys).applyInArrow(of_frame, schema)


def _mappings(held: np.ndarray, cells: np.ndarray, clip_limit: float) -> np.ndarray:
    """The mapping of each tile (0..1 for each level) from its counts and its number of cells."""
    held = held.copy()
    held[..., 0] += cells - held.sum(-1)            # what a tile has no rows for is black
    limit = np.maximum(clip_limit * cells / BINS, 1.0)[..., None]
    excess = np.maximum(held - limit, 0.0).sum(-1, keepdims=True)
    total = np.cumsum(np.minimum(held, limit) + excess / BINS, axis=-1)
    first, last = total.min(-1, keepdims=True), total.max(-1, keepdims=True)
    return np.where(cells[..., None] > 0, (total - first) / np.maximum(last - first, 1e-6),
                    np.arange(BINS) / (BINS - 1.0))


def clahe_rgb(df: DataFrame, keys: Sequence[str] = ("frame_id",), clip_limit: float = 2.0,
              tiles: int = 8, strength: float = 1.0, channels: Sequence[str] = RGB) -> DataFrame:
    """Equalise brightness only: all channels are scaled by the luma's gain."""
    if clip_limit <= 0 or strength <= 0:
        return df
    r, g, b = (F.col(c) for c in channels)
    brightness = tone.luma(r, g, b)
    px = df.withColumns({"__luma": brightness, "__eq": brightness})
    px = clahe(px, "__eq", keys, clip_limit, tiles)
    mixed = F.col("__luma") * (1.0 - strength) + F.col("__eq") * strength
    gain = F.coalesce(F.when(F.col("__luma") > 1e-4, mixed / F.col("__luma")), F.lit(1.0))
    return px.withColumns({c: clip(F.col(c) * gain, 0.0, 1.0) for c in channels}).drop(
        "__luma", "__eq")
