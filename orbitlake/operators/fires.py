"""Questions about active-fire detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import registry
from .keyed import top_k
from .spatial import points_in_boxes


def sane_box(west: Column, south: Column, east: Column, north: Column) -> dict[str, Column]:
    """Corners in order and inside the world."""
    return {"west": F.greatest(F.least(west, east), F.lit(-180.0)),
            "south": F.greatest(F.least(south, north), F.lit(-90.0)),
            "east": F.least(F.greatest(west, east), F.lit(180.0)),
            "north": F.least(F.greatest(south, north), F.lit(90.0))}


def sane_boxes(boxes: DataFrame) -> DataFrame:
    named = [F.col(c).cast("double") for c in ("west", "south", "east", "north")]
    return boxes.withColumns(sane_box(*named))


def within_box(detections: DataFrame, west: float, south: float, east: float,
               north: float) -> DataFrame:
    """Detections in one rectangle (borders included), as predicates the scan can push down."""
    w, e = sorted((float(west), float(east)))
    s, n = sorted((float(south), float(north)))
    return detections.where(F.col("lat").between(max(s, -90.0), min(n, 90.0))
                            & F.col("lon").between(max(w, -180.0), min(e, 180.0)))


def within_hours(detections: DataFrame, now: str, hours: int) -> DataFrame:
    """Detections no older than ``hours`` at ``now`` (UTC, given by the caller)."""
    if int(hours) != hours or hours < 1:
        raise registry.QueryError(f"Hours must be a whole number from 1 on, not {hours}")
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return detections.where(F.col("acquired") >= cutoff)


def of_sensors(detections: DataFrame, sensors: Sequence[str] | None) -> DataFrame:
    known = [s for s in (sensors or registry.SENSORS) if s in registry.SENSORS]
    return detections.where(F.col("sensor").isin(known))


def active_fires(detections: DataFrame, boxes: DataFrame, now: str, hours: int = 24,
                 sensors: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Per box, the detections of the last ``hours``, newest first; with ``most`` only the
    fiercest ones, and their rank as ``fierceness``.

    ``boxes`` has ``box_id`` and four corners; ``detections`` an ``ordinal`` that settles ties.
    """
    found = _matching(detections, boxes, now, hours, sensors)
    if most is None:
        return found.orderBy("box_id", F.col("acquired").desc(), "ordinal")
    fiercest = [F.coalesce(F.col("frp"), F.lit(0.0)).desc(), F.col("ordinal")]
    kept = top_k(found, ["box_id"], fiercest, most, rank="fierceness")
    return kept.orderBy("box_id", F.col("acquired").desc(), "fierceness")


def fire_counts(detections: DataFrame, boxes: DataFrame, now: str, hours: int = 24,
                sensors: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Per box: how many detections there are, how many are returned, whether it was capped."""
    found = _matching(detections, boxes, now, hours, sensors)
    totals = found.groupBy("box_id").agg(F.count(F.lit(1)).alias("total"))
    return (boxes.select("box_id").join(totals, "box_id", "left").fillna(0, ["total"])
            .withColumn("count", F.col("total") if most is None
                        else F.least("total", F.lit(most)))
            .withColumn("capped", F.col("total") > F.col("count")))


def _matching(detections, boxes, now, hours, sensors) -> DataFrame:
    recent = within_hours(of_sensors(detections, sensors), now, hours)
    return points_in_boxes(recent, sane_boxes(boxes)).drop("west", "south", "east", "north")


def with_style(detections: DataFrame) -> DataFrame:
    """Map symbol: radius by root of power, class by power, opacity by confidence."""
    frp = F.coalesce(F.col("frp"), F.lit(0.0))
    size = F.least(F.sqrt(F.greatest(frp, F.lit(0.0)) / 120.0), F.lit(1.0))
    classes = registry.FIRE_CLASSES

    def choose(field: int) -> Column:
        pick = None
        for level in classes[:-1]:
            hit = frp > level[0]
            pick = F.when(hit, level[field]) if pick is None else pick.when(hit, level[field])
        return pick.otherwise(classes[-1][field])
    return detections.withColumns({
        "radius": F.lit(3.5) + F.lit(11.5) * size, "fill": choose(1), "edge": choose(2),
        "power_class": choose(3),
        "opacity": F.lit(0.25) + F.lit(0.5) * F.coalesce(F.col("confidence"), F.lit(0.6))})
