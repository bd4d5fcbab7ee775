"""Exact percentiles of keys of any size, by radix selection.

``percentile`` keeps every distinct value of a key in one task.  Here every value has a 64-bit code
that sorts as the values do.  A pass counts, for every key and column, the values by the next bits
of their codes among those that a wanted rank still hides in; the counts combine on the map side.
Running totals then tell in which count each rank falls.  Three passes read all bits, most data
need two, as a count whose smallest and largest value agree is an answer already.  Nothing of the
input is kept between passes: what is expensive to compute is for the caller to write down first
(``session.materialise``).  Interpolation is linear, as in numpy's default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .keyed import BROADCAST_BYTES

#: How far a code is shifted right for the counts of each pass: 22, 21 and 21 bits.
SHIFTS = (42, 21, 0)


def order_code(value: Column) -> Column:
    """A signed 64-bit number that sorts as the doubles do; NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"),
                     F.coalesce(value.cast("double"), F.lit(0.0))).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
              probs: Sequence[float], method: str = "exact",
              accuracy: int = 10000) -> DataFrame:
    """One row per key with ``<column>_q``: an array with one value per probability.

    The exact method runs its passes at once; ``approx`` stays lazy and reads ``df`` once.
    """
    keys, columns, probs = list(keys), list(dict.fromkeys(columns)), [float(p) for p in probs]
    if method == "approx":
        return df.groupBy(*keys).agg(*[
            F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"{c}_q")
            for c in columns])
    values = _values(df, keys, columns)
    counts = materialise(_counts(values, keys))
    return _by_key(_solved(values, counts, keys, probs), keys, columns)


def profile(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """Per key: ``n``, ``min``, ``max``, ``mean``, ``std`` (of the population) and the percentiles
    ``q`` of the values that are there.  The first pass of the percentiles gives the moments too."""
    keys, probs = list(keys), [float(p) for p in probs]
    values = _values(df, keys, [column], missing=True)
    v = F.col("v")
    counts = materialise(_counts(values, keys, F.avg(v).alias("mean"), F.var_pop(v).alias("var")))
    whole = Window.partitionBy(*keys)
    centred = counts.withColumn("__mean", F.sum(F.col("rows") * F.col("mean")).over(whole)
                                / F.sum("rows").over(whole))
    spread = F.sum(F.col("rows") * (F.col("var") + F.pow(F.col("mean") - F.col("__mean"), 2)))
    moments = centred.groupBy(*keys).agg(
        F.sum("rows").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.first("__mean").alias("mean"), F.sqrt(spread / F.sum("rows")).alias("std"))
    there = F.col("prefix").isNotNull()
    q = _solved(values.where(v.isNotNull()), counts.where(there), keys, probs)
    return moments.join(q.drop("band"), keys, "left")


def pooled_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                     probs: Sequence[float], method: str = "exact",
                     accuracy: int = 10000) -> DataFrame:
    """Percentiles of several columns taken together, as ``pool_q``."""
    pool = df.select(*keys, F.explode_outer(F.array(*[F.col(c).cast("double") for c in columns]))
                     .alias("pool"))
    return quantiles(pool, keys, ["pool"], probs, method, accuracy)


def _values(df: DataFrame, keys, columns, missing: bool = False) -> DataFrame:
    """Keys, band (the place of the column), v and code of every value, or of those that are
    there; a missing one has no code."""
    if len(columns) == 1:
        long = df.select(*keys, F.lit(0).alias("band"), F.col(columns[0]).cast("double").alias("v"))
    else:
        cells = [F.struct(F.lit(i).alias("band"), F.col(c).cast("double").alias("v"))
                 for i, c in enumerate(columns)]
        long = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    if missing:
        return long.withColumn("code", F.when(F.col("v").isNotNull(), order_code(F.col("v"))))
    return long.where(F.col("v").isNotNull()).withColumn("code", order_code(F.col("v")))


def _counts(values: DataFrame, keys, *more: Column, above: Sequence[str] = (),
            shift: int = SHIFTS[0]) -> DataFrame:
    prefix = F.shiftright("code", shift).alias("prefix")
    return values.groupBy(*keys, "band", *above, prefix).agg(
        F.count("v").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"), *more)


def _running(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts with the rows before each in code order."""
    order = Window.partitionBy(*group).orderBy("prefix")
    return counts.withColumn("before", F.sum("rows").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))


def _solved(values: DataFrame, counts: DataFrame, keys, probs) -> DataFrame:
    """Keys, band and the array q."""
    group = [*keys, "band"]
    ranked = _running(counts, group).withColumn(
        "n", F.sum("rows").over(Window.partitionBy(*group)))
    asked = []
    for i, p in enumerate(probs):
        place = F.lit(p) * (F.col("n") - 1)
        asked += [F.struct(F.lit(2 * i + side).alias("t"), r.cast("long").alias("rank"))
                  for side, r in enumerate((F.floor(place), F.ceil(place)))]
    here = (F.col("a.rank") >= F.col("before")) & (F.col("a.rank") < F.col("before")
                                                  + F.col("rows"))
    hidden = (ranked.withColumn("a", F.explode(F.array(*asked))).where(here)
              .select(*group, "n", "prefix", "lo", "hi", F.col("a.t").alias("t"),
                      (F.col("a.rank") - F.col("before")).alias("rest")))
    found = []
    open_ = ~F.col("lo").eqNullSafe(F.col("hi"))
    for above, shift in zip(SHIFTS, SHIFTS[1:]):
        hidden = materialise(hidden)
        found.append(hidden.where(~open_))
        hidden = hidden.where(open_)
        left = hidden.count()
        if not left:
            break
        hidden = _refined(values, hidden, group, keys, left, above, shift)
    else:
        found.append(hidden)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    n = F.max("n")
    answers = []
    for i, p in enumerate(probs):
        place = F.lit(p) * (n - 1)
        lo, hi = (F.max(F.when(F.col("t") == 2 * i + side, F.col("lo"))) for side in (0, 1))
        answers.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))))
    return every.groupBy(*group).agg(F.array(*answers).alias("q"))


def _refined(values: DataFrame, hidden: DataFrame, group, keys, left: int, above: int,
             shift: int) -> DataFrame:
    """The ranks within the counts of the next bits, among the values that share their prefix."""
    wanted = hidden.select(*group, F.col("prefix").alias("above")).distinct()
    if left * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    inside = values.withColumn("above", F.shiftright("code", above)).join(
        wanted, [*group, "above"])
    ranked = _running(_counts(inside, keys, above=["above"], shift=shift), [*group, "above"])
    asked = hidden.select(*group, "n", "t", "rest", F.col("prefix").alias("above"))
    if left * 64 <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    here = (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("rows"))
    return (ranked.join(asked, [*group, "above"]).where(here)
            .select(*group, "n", "prefix", "lo", "hi", "t",
                    (F.col("rest") - F.col("before")).alias("rest")))


def _by_key(solved: DataFrame, keys, columns) -> DataFrame:
    return solved.groupBy(*keys).agg(*[
        F.max(F.when(F.col("band") == i, F.col("q"))).alias(f"{c}_q")
        for i, c in enumerate(columns)])
