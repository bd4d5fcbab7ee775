"""Daily cloud layers beside a scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.tone import cloud_alpha


def cloud_layer(pixels: DataFrame, sensitivity: float = 0.42) -> DataFrame:
    """Keep the picture but make everything that is not cloud transparent."""
    return pixels.withColumn("a", cloud_alpha(F.col("r"), F.col("g"), F.col("b"), sensitivity))


def match_layer(scenes: DataFrame, layer: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The layer rows of each scene's own day: an equi-join on keys and ``date``."""
    return scenes.select(*keys, "date").distinct().join(layer, [*keys, "date"])
