"""Tables laid out along a Z-order curve, so that a box reads few row groups.

Rows near one another on the ground get near keys.  They are range-partitioned and sorted by key,
so a file, and each row group in it, covers a compact area, and the smallest and largest
coordinates that Parquet keeps for it tell a scan with a box whether to read it at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of each coordinate in a key of 62 bits.
BITS = 31
_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
          (2, 0x3333333333333333), (1, 0x5555555555555555))


def _apart(value: Column) -> Column:
    """The bits of a whole number below 2 ** 31, each followed by an empty one."""
    for shift, mask in _STEPS:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def curve_key(x: Column, y: Column) -> Column:
    """Place on the curve of two whole numbers of at most 31 bits."""
    return _apart(x.cast("long")).bitwiseOR(F.shiftleft(_apart(y.cast("long")), 1))


def ground_key(lon: Column, lat: Column, bits: int = BITS) -> Column:
    """Place on the curve of a position; positions outside the world are moved to its edge, and
    NULL ones have none."""
    size = float(1 << bits)

    def step(value: Column, low: float, span: float) -> Column:
        return F.least(F.greatest(F.floor((value - low) / span * size), F.lit(0)),
                       F.lit((1 << bits) - 1))
    return F.when(lon.isNotNull() & lat.isNotNull(),
                  curve_key(step(lon, -180.0, 360.0), step(lat, -90.0, 180.0)))


def along_curve(df: DataFrame, key: Column, lead: Sequence[str] = (),
                then: Sequence[str] = ()) -> DataFrame:
    """The rows dealt into ranges of ``lead`` and key, in their order and that of ``then`` inside.

    Ranges come from a sample of the rows, so that a crowded place takes as many tasks as it
    needs; ``then`` splits rows with equal keys.
    """
    order = [*lead, "__key", *then]
    return (df.withColumn("__key", key).repartitionByRange(*order).sortWithinPartitions(*order)
            .drop("__key"))


def write_detections(detections: DataFrame, path: str, group_bytes: int = 32 << 20) -> None:
    """Detections (``lat``, ``lon``, ``acquired``, ``window``) in the layout that an area source
    prunes best: a folder for each window, along the curve inside."""
    (along_curve(detections, ground_key(F.col("lon"), F.col("lat")), ["window"], ["acquired"])
     .write.partitionBy("window").option("parquet.block.size", group_bytes).mode("append")
     .parquet(path))
