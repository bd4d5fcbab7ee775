"""Active-fire detection files of two sensor families to one detection table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import registry
from ..functions.numeric import blank_to_null, half_even, number

_TEXT = lambda names: ", ".join(f"{n} string" for n in names.split())
VIIRS_SCHEMA = _TEXT("country_id latitude longitude bright_ti4 scan track acq_date acq_time "
                     "satellite instrument confidence version bright_ti5 frp daynight")
MODIS_SCHEMA = _TEXT("latitude longitude brightness scan track acq_date acq_time satellite "
                     "instrument confidence version bright_t31 frp daynight")


def schema_for(sensor: str) -> str:
    return MODIS_SCHEMA if sensor == "modis" else VIIRS_SCHEMA


def read_sensor(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    """Raw text rows of one sensor's files, with its name; bad lines become NULL fields."""
    rows = (spark.read.schema(schema_for(sensor)).option("header", True)
            .option("mode", "PERMISSIVE").csv(path))
    return rows.withColumn("sensor", F.lit(sensor))


def read_detections(spark: SparkSession, paths: dict[str, str],
                    sensors: list[str] | None = None) -> DataFrame:
    """Detections of several sensors in one table; unknown sensor names are ignored."""
    wanted = [s for s in (sensors or registry.SENSORS) if s in registry.SENSORS and s in paths]
    if not wanted:
        raise registry.QueryError("No known sensor among those asked for")
    raw = None
    for sensor in wanted:
        rows = read_sensor(spark, paths[sensor], sensor)
        raw = rows if raw is None else raw.unionByName(rows, allowMissingColumns=True)
    return detections(raw)


def confidence_level(raw: Column) -> Column:
    """Word or percentage to a 0..1 level; what cannot be read counts as nominal."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return (F.when(text.isin("l", "low"), 0.25).when(text.isin("n", "nominal"), 0.65)
            .when(text.isin("h", "high"), 0.95)
            .otherwise(F.coalesce(number(text) / 100.0, F.lit(0.65))))


def confidence_label(level: Column) -> Column:
    """Every word maps into its own range, so the level alone decides."""
    return F.when(level < 0.3, "low").when(level < 0.8, "nominal").otherwise("high")


def acquired_at(date: Column, time: Column) -> Column:
    """Date and HHMM text, zero-filled, to TIMESTAMP_NTZ in UTC."""
    stamp = F.lpad(F.coalesce(blank_to_null(time), F.lit("0000")), 4, "0")
    text = F.concat(date, F.lit(" "), F.substring(stamp, 1, 2), F.lit(":"),
                    F.substring(stamp, 3, 2))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def detections(raw: DataFrame) -> DataFrame:
    """Text rows of any sensor to typed detections; rows without a position are dropped."""
    have = set(raw.columns)
    text = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    keep = [c for c in ("ordinal", "window") if c in have]
    resolution = F.create_map(*[F.lit(v) for k, (_, m) in registry.SENSORS.items()
                                for v in (k, m)])
    brightness = F.coalesce(blank_to_null(text("bright_ti4")), blank_to_null(text("brightness")))
    level = confidence_level(text("confidence"))
    out = raw.select(
        *keep, half_even(number(F.col("latitude")), 5).alias("lat"),
        half_even(number(F.col("longitude")), 5).alias("lon"),
        half_even(number(text("frp")), 2).alias("frp"),
        half_even(number(brightness), 2).alias("brightness_k"),
        half_even(level, 2).alias("confidence"), confidence_label(level).alias("confidence_label"),
        acquired_at(text("acq_date"), text("acq_time")).alias("acquired"), "sensor",
        F.try_element_at(resolution, F.col("sensor")).alias("resolution_m"),
        (F.upper(F.coalesce(text("daynight"), F.lit(""))) == "D").alias("day"))
    return out.where("lat is not null and lon is not null")


def covering_window(hours: int) -> tuple[int, str]:
    """The shortest published window that covers the hours asked for; more hours than the longest
    covers are refused, as their older rows are in no window."""
    hours = max(1, int(hours))
    for span in sorted(registry.FIRE_WINDOWS):
        if hours <= span:
            return span, registry.FIRE_WINDOWS[span]
    raise registry.QueryError(f"No published window reaches back {hours} hours: the longest has "
                              f"{max(registry.FIRE_WINDOWS)}")


def covering_window_of(hours: Column) -> Column:
    """The same choice for a column of hours; NULL where no window covers them."""
    asked, pick = F.greatest(F.lit(1), hours), F
    for span in sorted(registry.FIRE_WINDOWS):
        pick = pick.when(asked <= span, registry.FIRE_WINDOWS[span])
    return pick


def area_days(hours: int) -> int:
    """Whole days an area request must span."""
    return max(1, math.ceil(covering_window(hours)[0] / 24))


def read_area(spark: SparkSession, path: str, hours: int, west: float, south: float, east: float,
              north: float) -> DataFrame:
    """The area source: the rows of a box in the window that covers ``hours``, both as predicates
    of the scan."""
    from ..operators.fires import within_box
    return within_box(read_window(spark, path, hours), west, south, east, north)


def read_window(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """A detection table partitioned by ``window``, pruned to the one that covers ``hours``."""
    return spark.read.parquet(path).where(F.col("window") == covering_window(hours)[1])
