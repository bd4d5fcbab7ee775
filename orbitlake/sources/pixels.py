"""Pixel tables: reading just the bands a question needs, and writing results.

A pixel table is Parquet partitioned by ``satellite`` and ``scene_id`` with one column per
stored band, along a curve over rows and columns inside, so that partition pruning, column pruning
and row-group statistics answer scene, band and window selections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import registry
from ..operators import units
from ..operators.layout import along_curve, curve_key

GRID = ("row", "col", "height", "width")


def read_bands(spark: SparkSession, path: str, scenes: DataFrame | None, bands: Sequence[str],
               satellite: str, scene_ids: Sequence[str] | None = None, clouds: bool = False,
               keys: Sequence[str] = ("frame_id",), frames: DataFrame | None = None,
               window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Bands in physical units (reflectance or decibels), derived bands worked out.

    Only the stored bands behind ``bands`` are read.  ``scene_ids`` and ``window`` (first and
    last row, first and last column) are pushed to the scan; ``clouds`` masks cloud classes.
    ``scenes`` is not needed when the table itself carries the scene's date and offset flag.
    """
    bands = list(dict.fromkeys(bands))
    stored = registry.stored_behind(bands, satellite)
    px = spark.read.parquet(path).where(F.col("satellite") == satellite)
    if scene_ids is not None:
        px = px.where(F.col("scene_id").isin(list(scene_ids)))
    if window is not None:
        px = px.where(F.col("row").between(window[0], window[1])
                      & F.col("col").between(window[2], window[3]))
    extra = ["scl"] if clouds and "scl" in px.columns else []
    facts = ["scene_date", "boa_offset_applied"] if scenes is None and satellite != "sentinel-1" \
        else []
    if scenes is not None and scene_ids is not None:
        scenes = scenes.where(F.col("scene_id").isin(list(scene_ids)))
    px = px.select(*keys, "scene_id", *GRID, *stored, *extra, *facts)
    px = px.withColumnsRenamed({b: f"__dn_{b}" for b in stored})
    named = {b: f"__dn_{b}" for b in stored}
    if satellite == "sentinel-1":
        px = units.to_decibels(px, named)
        if "vvvh" in bands:
            px = units.multilook_ratio(px, [*keys, "scene_id"], frames=frames)
    else:
        px = units.to_reflectance(px, scenes, named, ["scene_id"])
    if extra:
        px = units.mask_clouds(px, bands)
    return px.select(*keys, "scene_id", *GRID, *bands, *extra)


def write_pixels(pixels: DataFrame, path: str, block: int = 64,
                 group_bytes: int = 32 << 20) -> None:
    """Store raw pixels in the layout :func:`read_bands` prunes best: a folder for each scene,
    blocks of ``block`` x ``block`` cells along a curve inside, so that a window of rows and
    columns reads the row groups around it."""
    key = curve_key(F.floor(F.col("col") / block), F.floor(F.col("row") / block))
    (along_curve(pixels, key, ["satellite", "scene_id"], ["row", "col"])
     .write.partitionBy("satellite", "scene_id").option("parquet.block.size", group_bytes)
     .mode("append").parquet(path))


def output_name(satellite: Column, date: Column, what: str) -> Column:
    """``sentinel2_2024-05-04_ndvi``: satellite without its hyphen, date, index or preset."""
    return F.concat_ws("_", F.regexp_replace(satellite, "-", ""), date.cast("string"),
                       F.lit(what))


def write_index(index: DataFrame, path: str, value: str, name: str = "name") -> None:
    """Float raster rows, NaN where there is no value, one folder per output name."""
    out = index.withColumn(value, F.coalesce(F.col(value).cast("float"),
                                             F.lit(float("nan")).cast("float")))
    out.write.partitionBy(name).mode("overwrite").parquet(path)


def write_picture(picture: DataFrame, path: str, keys: Sequence[str] = ("frame_id",),
                  tile: int = 512) -> None:
    """RGBA rows, laid out by frame and tile row."""
    out = picture.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int"))
    (out.repartition(*keys, "tile_row").sortWithinPartitions(*keys, "row", "col")
     .write.partitionBy(*keys, "tile_row").mode("overwrite").parquet(path))
