"""What merging a group of dates can do on a given grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import registry
from ..functions.numeric import half_even
from ..functions.tone import speckle_drop


def auto_scale(dates: Column) -> Column:
    """How much finer than the satellite this many dates can honestly resolve."""
    pick = None
    for needed, scale in registry.SUPERRES_STEPS:
        hit = dates >= needed
        pick = F.when(hit, scale) if pick is None else pick.when(hit, scale)
    return pick.otherwise(1)


def merge_plan(groups: DataFrame, superres="auto") -> DataFrame:
    """Add the merge decision to groups with ``satellite``, ``scenes``, ``ground_res_m``.

    ``superres`` is 'auto', True or None to choose from the number of dates, or a whole
    number that fixes the scale (1 leaves the picture alone).
    """
    facts = {s["key"]: s for s in registry.SATELLITES.values()}
    lookup = lambda field: F.try_element_at(F.create_map(*[
        F.lit(v) for k, s in facts.items() for v in (k, s[field])]), F.col("satellite"))
    can = lookup("can_superres")
    n = F.col("scenes")
    over = lookup("resolution") / F.greatest(F.col("ground_res_m"), F.lit(1e-6))
    if superres is None or superres is True or superres == "auto":
        supported = F.when(n > 1, auto_scale(n)).otherwise(1)
    else:
        supported = F.lit(min(max(int(superres), 1), registry.MAX_SUPERRES))
    df = groups.withColumns({"__over": over, "__can": can, "__sup": supported})
    sharpening = F.col("__can") & (n > 1) & (F.col("__sup") > 1) & (F.col("__over") > 1.2)
    df = df.withColumns({
        "sharpening": sharpening, "despeckling": ~F.col("__can") & (n > 1),
        "oversampling": half_even(F.col("__over"), 2),
        "supported": F.when(F.col("__can"), F.col("__sup")).otherwise(1)})
    return df.withColumns({
        "resolves": F.when(F.col("sharpening"), F.least("__over", F.col("__sup").cast("double")))
        .otherwise(1.0),
        "size_limited": (n >= 2) & (F.col("supported") > 1)
        & (F.col("__over") < F.col("supported")),
        "speckle_drop": F.when(F.col("despeckling"), speckle_drop(n)),
        "frames_wanted": F.greatest(F.lit(2), F.pow(F.rint("supported"), F.lit(2.0)).cast("int")),
    }).drop("__over", "__can", "__sup")


def merge_method(plan: DataFrame) -> DataFrame:
    """Which operator merges each group: fuse, mean, median, or none for a single date."""
    return plan.withColumn("method", F.when(F.col("scenes") <= 1, "single")
                           .when(F.col("sharpening"), "fuse")
                           .when(F.col("despeckling"), "mean").otherwise("median"))


def group_scenes(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return scenes.groupBy(*keys, "satellite").agg(F.count(F.lit(1)).alias("scenes"))
