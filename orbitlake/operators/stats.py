"""Per-frame statistics and histograms of one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_even
from .keyed import attach
from .quantiles import profile


def array_stats(df: DataFrame, value: str, keys: Sequence[str] = ("frame_id",),
                method: str = "exact") -> DataFrame:
    """Count, extremes, mean, population deviation and percentiles, to four decimals.

    A key without a single value keeps ``count`` 0 and NULL for the rest.
    """
    keys = list(keys)
    marks = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    if method == "approx":
        v = F.col(value)
        found = df.groupBy(*keys).agg(
            F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.percentile_approx(v.cast("double"), list(marks.values()), 10000).alias("q"))
    else:
        found = profile(df, keys, value, list(marks.values())).withColumnRenamed("n", "count")
    return found.select(*keys, "count", *[
        half_even(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std")], *[
        half_even(F.get("q", F.lit(i)), 4).alias(m) for i, m in enumerate(marks)])


def histogram(df: DataFrame, value: str, low: float | None = None, high: float | None = None,
              keys: Sequence[str] = ("frame_id",), bins: int = 48) -> DataFrame:
    """Counts over ``bins`` equal bins of [low, high]; the last bin includes its right edge.

    Without a span each key's own smallest and largest values are the ends.  One grouped pass
    counts a key's bins and, as the bin NULL, the values outside them.
    """
    keys = list(keys)
    if (low is None) != (high is None):
        raise ValueError("give both ends of a histogram or neither")
    v = F.col(value)
    if low is None:
        df = attach(df, value_range(df, value, keys), keys)
        lo, span = F.col("low"), (F.col("high") - F.col("low")) / bins
        span = F.when(span > 0, span).otherwise(1.0 / bins)
    else:
        lo, span = F.lit(float(low)), F.lit((high - low) / bins)
    inside = v.between(lo, F.col("high")) if low is None else v.between(low, high)
    index = F.when(inside, F.least(F.floor((v - lo) / span), F.lit(bins - 1)).cast("int"))
    counts = (df.where(v.isNotNull()).select(*keys, index.alias("bin"), lo.alias("__lo"),
                                             span.alias("__span"))
              .groupBy(*keys, "bin", "__lo", "__span").agg(F.count(F.lit(1)).alias("rows")))
    # a handful of rows per key from here on
    packed = counts.groupBy(*keys, "__lo", "__span").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("bin").isNotNull(), F.struct("bin", "rows")))).alias("__rows"))
    slots = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return slots.select(
        *keys, "bin", half_even(F.col("__lo") + F.col("bin") * F.col("__span"), 4).alias("edge"),
        half_even(F.col("__span"), 5).alias("width"),
        F.coalesce(F.try_element_at("__rows", F.col("bin")), F.lit(0)).cast("long")
        .alias("pixels"))


def value_range(df: DataFrame, value: str, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """The span a histogram without a given one covers."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
