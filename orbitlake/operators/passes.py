"""Last and next overpass of points, measured from the passes already flown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import registry
from ..functions.numeric import half_even, micros
from .keyed import top_k
from .spatial import points_in_boxes

HOUR, DAY = 3_600_000_000, 86_400_000_000
TRACK = ["point_id", "satellite", "orbit"]


def passes_over(scenes: DataFrame, points: DataFrame) -> DataFrame:
    """Scene rows whose footprint box holds each point (``point_id``, ``lon``, ``lat``)."""
    return points_in_boxes(points, scenes, cell=1.0, small="points").drop("west", "south", "east", "north")


def recent_passes(log: DataFrame, now: str,
                  lookback_days: int = registry.LOOKBACK_DAYS) -> DataFrame:
    """Every pass within the lookback.  ``passed_at`` NULL means an unreadable time."""
    at = F.lit(now).cast("timestamp_ntz")
    return log.where((F.col("passed_at") >= at - F.expr(f"INTERVAL {lookback_days} DAYS"))
                     & (F.col("passed_at") <= at))


def newest_passes(recent: DataFrame, n: int) -> DataFrame:
    """A listing: the newest ``n`` passes per point and satellite, with their ``recency``."""
    return top_k(recent, ["point_id", "satellite"],
                 [F.col("passed_at").desc(), F.col("ordinal").desc()], n, rank="recency")


def tracks(recent: DataFrame, gap_hours: int = registry.MIN_INTERVAL_HOURS) -> DataFrame:
    """One row per point, satellite and orbit: passes, distinct passes and the shortest gap.

    A pass less than the gap after the last one kept counts as the same pass.  A missing orbit
    number is a track of its own.
    """
    keep = _kept(recent, gap_hours * HOUR)
    order = Window.partitionBy(*TRACK).orderBy("us")
    step = (F.col("us") - F.lag("us").over(order)).alias("step")
    apart = (keep.select(*TRACK, "us", step).groupBy(*TRACK)
             .agg(F.count(F.lit(1)).cast("int").alias("distinct_passes"),
                  F.max("us").alias("anchor"), F.min("step").alias("gap")))
    seen = recent.groupBy(*TRACK).agg(
        F.count(F.lit(1)).cast("int").alias("passes"),
        F.min(micros(F.col("passed_at"))).alias("first_seen"),
        F.max(micros(F.col("passed_at"))).alias("last_seen"))
    apart = apart.withColumnsRenamed({c: f"__{c}" for c in TRACK})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in TRACK]
    return seen.join(apart, same).drop(*[f"__{c}" for c in TRACK])


def _kept(recent: DataFrame, gap: int) -> DataFrame:
    """The times (``us``) that are kept of each track.

    A pass that comes a gap or more after the one before it is always kept, whatever was kept
    before: it starts an island, and only within an island does it matter which was kept last.  So
    a fold reads the different times of one island, however long its track is.
    """
    slim = recent.select(*TRACK, micros(F.col("passed_at")).alias("us")).distinct()
    order = Window.partitionBy(*TRACK).orderBy("us")
    fresh = F.coalesce(F.col("us") - F.lag("us").over(order) >= gap, F.lit(True))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = slim.withColumn("__fresh", fresh).withColumn(
        "island", F.max(F.when(F.col("__fresh"), F.col("us"))).over(upto)).drop("__fresh")
    alone = islands.groupBy(*TRACK, "island").agg(F.sort_array(F.collect_list("us")).alias("times"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"),
                     F.lit(None).cast("bigint").alias("last"))

    def fold(state: Column, at: Column) -> Column:
        far = state["last"].isNull() | (at - state["last"] >= gap)
        return F.when(far, F.struct(F.array_append(state["kept"], at).alias("kept"),
                                    at.alias("last"))).otherwise(state)
    return alone.select(*TRACK, F.explode(F.aggregate("times", start, fold, lambda s: s["kept"]))
                        .alias("us"))


def distinct_passes(recent: DataFrame) -> DataFrame:
    """The kept pass times themselves, one row each."""
    return _kept(recent, registry.MIN_INTERVAL_HOURS * HOUR).select(
        *TRACK, F.timestamp_micros("us").cast("timestamp_ntz").alias("passed_at"))


def projected(tracks_df: DataFrame, now: str) -> DataFrame:
    """Each track's period (measured or nominal) and its first pass after ``now``."""
    nominal = F.create_map(*[F.lit(v) for s in registry.SATELLITES.values()
                             for v in (s["key"], s["repeat_days"] * DAY)])
    now_us = micros(F.lit(now).cast("timestamp_ntz"))
    df = tracks_df.withColumns({
        "measured": F.col("gap").isNotNull(),
        "period": F.coalesce("gap", F.try_element_at(nominal, F.col("satellite")))})
    whole = F.pmod(now_us - F.col("anchor"), F.col("period"))
    ahead = now_us - whole + F.col("period")
    return df.withColumn("next_us", F.when(F.col("period") <= 0, F.col("anchor"))
                         .otherwise(ahead))


def intervals(recent: DataFrame, now: str) -> DataFrame:
    """Per track: period in days, whether it was measured, and the projected pass."""
    return projected(tracks(recent), now).select(
        *TRACK, "passes", "distinct_passes", "measured",
        half_even(F.col("period") / float(DAY), 2).alias("period_days"),
        F.timestamp_micros("next_us").cast("timestamp_ntz").alias("next_at"))


def next_passes(recent: DataFrame, now: str, points: DataFrame | None = None) -> DataFrame:
    """Last and next pass per point and satellite, soonest first.

    With ``points``, every point and satellite appears, those never seen with zero passes.
    """
    key = ["point_id", "satellite"]
    now_us = micros(F.lit(now).cast("timestamp_ntz"))
    soonest = projected(tracks(recent), now).groupBy(*key).agg(
        F.sum("passes").cast("int").alias("passes_seen"),
        F.count(F.lit(1)).cast("int").alias("orbits_seen"),
        F.min_by(F.struct("next_us", "orbit", "period", "measured"),
                 F.struct("next_us", "first_seen")).alias("n"))
    latest = recent.groupBy(*key).agg(F.max(F.struct("passed_at", "ordinal", "orbit")).alias(
        "l")).select(*key, F.col("l.passed_at").alias("last_at"),
                     F.col("l.orbit").alias("last_orbit"))
    out = soonest.join(latest, key).select(
        *key, "passes_seen", "orbits_seen", F.col("n.measured").alias("measured"), "last_at",
        half_even((now_us - micros(F.col("last_at"))) / float(HOUR), 1).alias("hours_ago"),
        "last_orbit", F.timestamp_micros("n.next_us").cast("timestamp_ntz").alias("next_at"),
        half_even((F.col("n.next_us") - now_us) / float(HOUR), 1).alias("hours_away"),
        F.col("n.orbit").alias("next_orbit"),
        half_even(F.col("n.period") / float(DAY), 2).alias("period_days"))
    if points is not None:
        every = points.select("point_id", F.explode_outer(F.array(*[
            F.lit(k) for k in registry.SATELLITES])).alias("satellite"))
        out = every.join(out, key, "left").fillna(0, ["passes_seen", "orbits_seen"]).fillna(
            False, ["measured"])
    return out.orderBy("point_id", F.col("hours_away").asc_nulls_last())
