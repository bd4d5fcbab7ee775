"""Stored numbers to physical units, cloud masking, derived bands, band alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import registry
from ..functions.tone import decibels
from .keyed import attach


def boa_offset(date: Column, applied: Column) -> Column:
    """The stored-number offset of a scene: 0 once corrected or before the change."""
    return (F.when(applied, 0)
            .when(date >= F.lit(registry.BOA_OFFSET_DATE).cast("date"), registry.BOA_OFFSET)
            .otherwise(0))


def reflectance(dn: Column, offset: Column) -> Column:
    """Stored number to reflectance; 0 means no data.  May be slightly negative."""
    return F.when(dn != 0, (dn + offset).cast("double") * F.lit(registry.REFLECTANCE_SCALE))


def to_reflectance(pixels: DataFrame, scenes: DataFrame | None, bands: dict[str, str],
                   on: Sequence[str] = ("scene_ord",)) -> DataFrame:
    """Add ``{band: dn column}`` in reflectance, with each scene's own offset.

    The offset needs ``scene_date`` and ``boa_offset_applied``.  Pixel tables that carry them
    (as partition columns they cost nothing) take no join; otherwise ``scenes`` gives them per
    ``on`` keys.  Pixels of a scene that isn't listed stay, without a value.
    """
    offset = boa_offset(F.col("scene_date"), F.col("boa_offset_applied")).alias("__offset")
    if scenes is None:
        joined = pixels.withColumn("__offset", offset)
    else:
        joined = attach(pixels, scenes.select(*on, offset), on)
    return joined.withColumns({b: reflectance(F.col(dn), F.col("__offset"))
                               for b, dn in bands.items()}).drop("__offset", *bands.values())


def to_decibels(pixels: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Add ``{band: amplitude column}`` in decibels; amplitudes of 0 and below are no data."""
    return (pixels.withColumns({b: decibels(F.col(a), registry.S1_FLOOR_DN)
                                for b, a in bands.items()}).drop(*bands.values()))


def is_cloud(scl: Column) -> Column:
    return F.coalesce(scl, F.lit(0)).isin(*registry.CLOUD_CLASSES)


def mask_clouds(pixels: DataFrame, bands: Sequence[str], scl: str = "scl") -> DataFrame:
    """NULL every band where the scene classification says cloud or cloud shadow."""
    if scl not in pixels.columns:
        return pixels
    cloudy = is_cloud(F.col(scl))
    return pixels.withColumns({b: F.when(~cloudy, F.col(b)) for b in bands})


def cloud_fraction(pixels: DataFrame, keys: Sequence[str], cells: int | None = None,
                   scl: str = "scl") -> DataFrame:
    """Share of each image's cells that is cloud; ``cells`` is the full frame size.

    Cells without a row count as clear, like class 0, when ``cells`` is given.
    """
    cloudy = F.sum(is_cloud(F.col(scl)).cast("int"))
    total = F.lit(cells) if cells else F.count(F.lit(1))
    return pixels.groupBy(*keys).agg((cloudy / total).alias("cloud_fraction"))


def multilook_ratio(pixels: DataFrame, keys: Sequence[str], first: str = "vv",
                    second: str = "vh", out: str = "vvvh",
                    looks: int = registry.RATIO_LOOKS, frames: DataFrame | None = None,
                    tile: int = 256) -> DataFrame:
    """Decibel difference averaged over a ``looks`` x ``looks`` neighbourhood.

    NULL cells do not take part and stay NULL.  The frame edge mirrors.  ``frames`` lists the
    images (keys, height, width) when ``pixels`` leaves cells out.
    """
    from .stencil import box_mean, crop_tiles, pad_tiles
    ratio = pixels.withColumn(out, F.col(first) - F.col(second))
    wide = pad_tiles(ratio, keys, [first, second, out], looks // 2, tile,
                     frames=frames)
    return crop_tiles(box_mean(wide, keys, [out], looks)).withColumn(
        out, F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.col(out)))


def align_bands(tables: dict[str, tuple[DataFrame, int]],
                on: Sequence[str] = ("frame_id", "scene_ord", "row", "col")) -> DataFrame:
    """Bring bands stored at different resolutions onto the finest grid, by position.

    ``tables`` maps a band to (its table with a ``value`` column, its cell size in fine
    cells).  A coarse band is an equi-join on the coarse cell that covers the fine one; one
    shuffle per distinct resolution, since bands that share a grid are united first.
    """
    by_step: dict[int, DataFrame] = {}
    names: dict[int, list[str]] = {}
    for band, (table, step) in tables.items():
        slim = table.select(*on, F.lit(band).alias("band"), F.col("value").cast("double"))
        by_step[step] = by_step[step].unionByName(slim) if step in by_step else slim
        names.setdefault(step, []).append(band)
    out = None
    for step in sorted(by_step):
        wide = by_step[step].groupBy(*on).agg(*[
            F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in names[step]])
        if out is None:
            out = wide
            continue
        lead = [c for c in on if c not in ("row", "col")]
        coarse = wide.withColumnsRenamed({"row": "__row", "col": "__col"})
        cond = [out[c] == coarse[c] for c in lead]
        cond += [F.floor(out["row"] / step).cast("int") == coarse["__row"],
                 F.floor(out["col"] / step).cast("int") == coarse["__col"]]
        out = out.join(coarse, cond, "left").select(
            *[out[c] for c in out.columns], *[coarse[b] for b in names[step]])
    return out
