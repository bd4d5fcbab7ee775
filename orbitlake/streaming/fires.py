"""Detections as a file stream, and rolling activity per place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.firms import detections, schema_for


def detection_stream(spark: SparkSession, path: str, sensor: str,
                     files_per_trigger: int = 16) -> DataFrame:
    """New files of one sensor, typed exactly like the batch table."""
    raw = (spark.readStream.schema(schema_for(sensor)).option("header", True)
           .option("maxFilesPerTrigger", files_per_trigger).csv(path))
    return detections(raw.withColumn("sensor", F.lit(sensor)))


def _micros(interval: str) -> int:
    """Microseconds of an interval such as '24 hours'."""
    number, unit = interval.split()
    return int(number) * _UNITS[unit.rstrip("s")] * 1_000_000


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _activity_by_step(table: DataFrame, cell_degrees: float, step: int, span: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / cell_degrees).cast("int")
    us = F.unix_micros(F.col("acquired").cast("timestamp"))
    sums = table.where("acquired is not null").groupBy(
        (us - F.pmod(us, F.lit(step))).alias("at"), cell("lon").alias("cell_x"),
        cell("lat").alias("cell_y")).agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("top"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(span // step - 1)),
                         lambda k: F.col("at") - k.cast("long") * step)
    totals = sums.withColumn("start", F.explode(starts)).groupBy(
        "start", "cell_x", "cell_y").agg(F.sum("n").alias("detections"),
                                         F.max("top").alias("max_frp"))
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return totals.select(moment(F.col("start")).alias("window_start"),
                         moment(F.col("start") + span).alias("window_end"), "cell_x", "cell_y",
                         "detections", "max_frp")


def rolling_activity(stream: DataFrame, cell_degrees: float = 1.0, late: str = "3 hours",
                     span: str = "24 hours", every: str = "1 hour",
                     dedupe: bool = True) -> DataFrame:
    """Detections and fiercest power per place over a sliding day; an extension.

    Rows may arrive up to ``late`` behind the newest.  A detection republished within that time
    is counted once.  Works on a batch table too (pass ``dedupe=False``): there, where the step
    divides the span, rows are summed up by step first and only the sums enter each window.
    """
    if not stream.isStreaming and not dedupe and _micros(span) % _micros(every) == 0:
        step, whole = _micros(every), _micros(span)
        return _activity_by_step(stream, cell_degrees, step, whole)
    timed = stream.withColumn("at", F.col("acquired").cast("timestamp")).withWatermark("at", late)
    if dedupe:
        timed = timed.dropDuplicatesWithinWatermark(["lat", "lon", "sensor", "at"])
    cell = lambda c: F.floor(F.col(c) / cell_degrees).cast("int")
    grouped = timed.groupBy(F.window("at", span, every).alias("w"), cell("lon").alias("cell_x"),
                            cell("lat").alias("cell_y"))
    totals = grouped.agg(F.count(F.lit(1)).alias("detections"), F.max("frp").alias("max_frp"))
    return totals.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("w.end").cast("timestamp_ntz").alias("window_end"), "cell_x",
                         "cell_y", "detections", "max_frp")
