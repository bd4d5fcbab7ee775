"""Merging several dates per cell: composites, their report, and the robust mean.

A stack is one row per (frame, scene, row, col).  Mean, minimum, maximum and first-valid are
algebraic and combine on the map side.  The median and the robust mean need a cell's values
together: a stack known to be shallow is packed into one small array per cell (one shuffle for
all bands); otherwise the median aggregate, which merges value counts, is used instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..registry import QueryError
from .keyed import attach
from .quantiles import quantiles

PACK_DEPTH = 128
METHODS = ("median", "mean", "max", "min", "first")


def shallow(scenes: DataFrame, keys: Sequence[str], depth: int = PACK_DEPTH) -> bool:
    """Whether no frame has more than ``depth`` dates (reads only the scene table)."""
    deepest = (scenes.groupBy(*keys).count() if keys else
               scenes.agg(F.count(F.lit(1)).alias("count"))).agg(F.max("count"))
    most = deepest.first()[0]
    return most is not None and most <= depth


def composite(pixels: DataFrame, bands: Sequence[str], method: str = "median",
              keys: Sequence[str] = ("frame_id",), order: str = "scene_ord",
              packed: bool = False) -> DataFrame:
    """One value per cell and band over all dates; NULL where no date has one."""
    cell = [*keys, "row", "col"]
    if method not in METHODS:
        raise QueryError(f"Unknown composite method {method!r}")
    if method == "median" and packed:
        return _packed_median(pixels, bands, cell)
    pick = {
        "median": lambda b: F.median(b),
        "mean": lambda b: F.avg(b),
        "max": lambda b: F.max(b),
        "min": lambda b: F.min(b),
        "first": lambda b: F.min_by(b, F.when(F.col(b).isNotNull(), F.col(order))),
    }[method]
    return pixels.groupBy(*cell).agg(*[pick(b).alias(b) for b in bands])


def _middle(ordered: Column, nulls: Column, n: Column) -> Column:
    """Median of an ascending array whose first ``nulls`` entries are NULL."""
    low = F.get(ordered, (nulls + F.floor((n - 1) / 2)).cast("int"))
    high = F.get(ordered, (nulls + F.floor(n / 2)).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _pack(pixels: DataFrame, bands: Sequence[str], cell: list[str]) -> DataFrame:
    return pixels.groupBy(*cell).agg(
        F.collect_list(F.struct(*[F.col(b).cast("double").alias(b) for b in bands])).alias("__s"),
        *[F.count(b).alias(f"__n_{b}") for b in bands])


def _packed_median(pixels: DataFrame, bands: Sequence[str], cell: list[str]) -> DataFrame:
    """The medians are results of the aggregate itself: a filter on them can't be moved below it,
    which would sort every array again for each place the filter names it.  Rows travel as they are:
    a cell's dates lie apart, so buffers made before the shuffle would hold one value each."""
    def median(b: str) -> Column:
        held = F.sort_array(F.collect_list(F.col(b).cast("double")))
        n = F.size(held)
        low, high = F.get(held, F.floor((n - 1) / 2).cast("int")), F.get(
            held, F.floor(n / 2).cast("int"))
        return (low + high) / 2         # an empty array has neither
    rows = pixels.select(*cell, *bands).repartition(*cell)
    return rows.groupBy(*cell).agg(*[median(b).alias(b) for b in bands])


def common_bands(scenes: DataFrame, keys: Sequence[str] = ("frame_id",),
                 scene: str = "scene_id", assets: str = "assets") -> DataFrame:
    """Bands that every scene of a frame offers: the only ones a merge may use."""
    offered = scenes.select(*keys, scene, F.explode_outer(F.map_keys(assets)).alias("band"))
    per_band = offered.where("band is not null").groupBy(*keys, "band").agg(F.count_distinct(scene).alias("offers"))
    total = scenes.groupBy(*keys).agg(F.count_distinct(scene).alias("scenes"))
    return (per_band.join(total, list(keys))
            .where(F.col("offers") == F.col("scenes")).select(*keys, "band"))


def composite_report(pixels: DataFrame, band: str, cells: int,
                     keys: Sequence[str] = ("frame_id",), scene: str = "scene_ord") -> DataFrame:
    """Per frame: dates, best single valid share and combined valid share, in percent."""
    valid = pixels.select(*keys, scene, "row", "col",
                          F.col(band).isNotNull().cast("int").alias("ok"))
    single = (valid.groupBy(*keys, scene).agg(F.sum("ok").alias("seen"))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("scenes"), F.max("seen").alias("best")))
    joint = (valid.groupBy(*keys, "row", "col").agg(F.max("ok").alias("ok"))
             .groupBy(*keys).agg(F.sum("ok").alias("combined")))
    share = lambda n: F.rint(F.col(n) * 100.0 / cells * 100.0) / 100.0
    return single.join(joint, list(keys)).select(
        *keys, "scenes", share("best").alias("best_single_pct"),
        share("combined").alias("combined_pct"))


def layers_valid(pixels: DataFrame, band: str, scenes: int,
                 keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Per cell: whether any date has a value and whether every one of ``scenes`` has."""
    n = F.count(band)
    return pixels.groupBy(*keys, "row", "col").agg(
        (n > 0).alias("any_valid"), (n >= scenes).alias("all_valid"))


def noise_floor(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per frame and band: 2 % of the 2-98 percentile spread of the whole stack."""
    q = quantiles(pixels, keys, bands, [0.02, 0.98])
    spread = lambda b: (F.get(f"{b}_q", F.lit(1)) - F.get(f"{b}_q", F.lit(0))) * 0.02
    return q.select(*keys, *[
        F.greatest(F.coalesce(spread(b), F.lit(0.0)), F.lit(1e-6)).alias(f"__floor_{b}")
        for b in bands])


def robust_mean(pixels: DataFrame, bands: Sequence[str], scenes: DataFrame,
                keys: Sequence[str] = ("frame_id",), tolerance: float = 2.5,
                packed: bool = False) -> DataFrame:
    """Mean of the dates that agree with the median, per cell; ``<band>_kept`` counts them.

    ``scenes`` lists each frame's dates: one date passes through, two are averaged, three or
    more are screened by the median absolute deviation.  The rule looks at how many dates the
    frame has, not at how many are valid in the cell.
    """
    cell = [*keys, "row", "col"]
    dates = scenes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__layers"))
    limits = noise_floor(pixels, bands, keys).join(dates, list(keys))
    if packed:
        return _packed_robust(attach(_pack(pixels, bands, cell), limits, keys), bands, cell,
                              tolerance)
    return _joined_robust(pixels, bands, cell, keys, limits, tolerance)


def _packed_robust(stack: DataFrame, bands, cell, tolerance) -> DataFrame:
    depth = F.size("__s")
    step = stack.select(*cell, "__layers", *[c for b in bands for c in (
        F.slice(F.sort_array(F.col(f"__s.{b}")), depth - F.col(f"__n_{b}") + 1,
                F.greatest(F.col(f"__n_{b}"), F.lit(0))).alias(f"__v_{b}"),
        F.col(f"__n_{b}"), F.col(f"__floor_{b}"))])
    zero = F.lit(0)
    step = step.withColumns({f"__med_{b}": _middle(F.col(f"__v_{b}"), zero, F.col(f"__n_{b}"))
                             for b in bands})
    step = step.withColumns({
        f"__mad_{b}": _middle(
            F.sort_array(F.transform(f"__v_{b}", _distance(F.col(f"__med_{b}")))),
            zero, F.col(f"__n_{b}")) for b in bands})
    step = step.withColumns({
        f"__keep_{b}": F.when(F.col("__layers") < 3, F.col(f"__v_{b}")).otherwise(
            F.filter(f"__v_{b}", _near(F.col(f"__med_{b}"), F.greatest(
                F.coalesce(F.col(f"__mad_{b}"), F.lit(0.0)) * 1.4826 * tolerance,
                F.col(f"__floor_{b}"))))) for b in bands})
    total = lambda b: F.aggregate(f"__keep_{b}", F.lit(0.0), lambda a, x: a + x)
    out = []
    for b in bands:
        kept = F.size(f"__keep_{b}")
        out += [F.when(kept > 0, total(b) / kept).otherwise(F.col(f"__med_{b}")).alias(b),
                kept.alias(f"{b}_kept")]
    return step.select(*cell, *out)


def _distance(centre: Column):
    return lambda v: F.abs(v - centre)


def _near(centre: Column, limit: Column):
    return lambda v: F.abs(v - centre) <= limit


def _joined_robust(pixels, bands, cell, keys, limits, tolerance) -> DataFrame:
    """The same result with mergeable aggregates only, for stacks of any depth."""
    med = pixels.groupBy(*cell).agg(*[F.median(b).alias(f"__med_{b}") for b in bands])
    seen = pixels.select(*cell, *bands).join(med, cell)
    far = seen.withColumns({f"__d_{b}": F.abs(F.col(b) - F.col(f"__med_{b}")) for b in bands})
    mad = far.groupBy(*cell).agg(*[F.median(f"__d_{b}").alias(f"__mad_{b}") for b in bands])
    ready = attach(far.join(mad, cell), limits, keys)
    aggs = []
    for b in bands:
        limit = F.greatest(F.coalesce(F.col(f"__mad_{b}"), F.lit(0.0)) * 1.4826 * tolerance,
                           F.col(f"__floor_{b}"))
        keep = (F.col("__layers") < 3) | (F.col(f"__d_{b}") <= limit)
        aggs += [F.coalesce(F.avg(F.when(keep, F.col(b))), F.max(f"__med_{b}")).alias(b),
                 F.count(F.when(keep, F.col(b))).cast("int").alias(f"{b}_kept")]
    return ready.groupBy(*cell).agg(*aggs)
