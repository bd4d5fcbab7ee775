"""Searching the scene catalogue and choosing dates from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import registry
from .keyed import attach, top_k
from .spatial import areas_meet_boxes


def _optical(satellite: Column) -> Column:
    return satellite.isin([k for k, s in registry.SATELLITES.items() if s["cloud_filter"]])


def search_days(today: str, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """First and last day of a search; left out, the year up to ``today``."""
    day = dt.date.fromisoformat(today[:10])
    return (str(start)[:10] if start else (day - dt.timedelta(days=365)).isoformat(),
            str(end)[:10] if end else day.isoformat())


def filter_scenes(scenes: DataFrame, start: str, end: str, max_cloud: float = 30.0,
                  satellites=None, when: str = "passed_at") -> DataFrame:
    """Whole days ``start`` to ``end``; strictly less cloud than ``max_cloud`` for optical.

    A missing cloud figure fails the optical test and does not matter for radar.
    """
    known = registry.satellites_among(satellites)
    first = F.lit(f"{start[:10]} 00:00:00").cast("timestamp_ntz")
    last = F.lit(f"{end[:10]} 23:59:59").cast("timestamp_ntz")
    clear = ~_optical(F.col("satellite")) | (F.col("cloud") < float(max_cloud))
    return scenes.where(F.col("satellite").isin(known) & F.col(when).between(first, last) & clear)


def best_source(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",),
                pinned: dict[str, str] | None = None) -> DataFrame:
    """Per key and satellite, only the rows of the first catalogue that has any.

    ``pinned`` names, by satellite, the one catalogue that may answer.
    """
    for key, source in (pinned or {}).items():
        scenes = scenes.where((F.col("satellite") != key) | (F.col("source") == source))
    ranks = F.create_map(*[F.lit(v) for s in registry.SATELLITES.values()
                           for i, src in enumerate(s["sources"], 1)
                           for v in (f"{s['key']}/{src}", i)])
    group = [*keys, "satellite"]
    known = scenes.withColumn("__rank", F.try_element_at(
        ranks, F.concat_ws("/", "satellite", "source"))).where("__rank is not null")
    lowest = known.groupBy(*group).agg(F.min("__rank").alias("__best"))
    return attach(known, lowest, group).where("__rank = __best").drop("__rank", "__best")


def search(scenes: DataFrame, areas: DataFrame, start: str, end: str, max_cloud: float = 30.0,
           limit: int = 60, satellites=None, when: str = "passed_at",
           pinned: dict[str, str] | None = None) -> DataFrame:
    """Scenes over every area (``aoi_id``, ``geometry`` and its bounds), newest first.

    Each area and satellite is answered by its best catalogue, at most ``limit`` scenes each;
    ``matched`` says how many there are.
    """
    group = ["aoi_id", "satellite"]
    hits = areas_meet_boxes(areas, filter_scenes(scenes, start, end, max_cloud, satellites, when))
    hits = best_source(hits, ("aoi_id",), pinned)
    newest = [F.col(when).desc(), F.col("scene_id")]
    totals = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("matched"))
    return top_k(hits, group, newest, int(limit)).join(totals, group).orderBy("aoi_id", *newest)


def get_scene(scenes: DataFrame, scene_id: str, satellite: str | None = None) -> DataFrame:
    """One scene by id; the satellite follows from the id's prefix, which prunes partitions."""
    key = satellite or ("sentinel-1" if scene_id.upper().startswith("S1")
                        else registry.DEFAULT_SATELLITE)
    found = scenes.where((F.col("satellite") == key) & (F.col("scene_id") == scene_id))
    return best_source(found, ["scene_id"])


def best_dates(scenes: DataFrame, n: int, keys: Sequence[str] = ("aoi_id",),
               when: str = "passed_at") -> DataFrame:
    """Per key and satellite the ``n`` best dates: least cloud, or most recent for radar."""
    clearest = F.when(_optical(F.col("satellite")), F.coalesce(F.col("cloud"), F.lit(100.0)))
    newest = F.when(~_optical(F.col("satellite")), F.col(when))
    order = [clearest, newest.desc(), F.col("scene_id")]
    return top_k(scenes, [*keys, "satellite"], order, n)


def clearest_scene(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Per key the single scene with least cloud; an unknown figure counts as overcast."""
    cloud = F.coalesce(F.col("cloud"), F.lit(100.0))
    return scenes.groupBy(*keys).agg(
        F.min_by("scene_id", F.struct(cloud, F.col("scene_id"))).alias("scene_id"),
        F.min(cloud).alias("cloud"))


def chosen_dates(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",),
                 when: str = "passed_at") -> DataFrame:
    """The dates each picture uses, numbered from its newest (``date``, ``nth``)."""
    order = Window.partitionBy(*keys).orderBy(F.to_date(when).desc(), "scene_id")
    return scenes.withColumns({"date": F.to_date(when), "nth": F.row_number().over(order)})


def single_satellite(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Per key the one satellite its scenes come from; mixing them is an error when read."""
    sat = F.coalesce(F.col("satellite"), F.lit(registry.DEFAULT_SATELLITE))
    found = scenes.groupBy(*keys).agg(F.min(sat).alias("__a"), F.max(sat).alias("__b"),
                                      F.count(F.lit(1)).alias("scenes"))
    mixed = F.raise_error(F.lit("One satellite at a time: the scenes of a merge are mixed"))
    return found.select(*keys, "scenes", F.when(F.col("__a") == F.col("__b"), F.col("__a"))
                        .otherwise(mixed.cast("string")).alias("satellite"))


def with_satellite(df: DataFrame, key: str = "satellite", source: str = "source") -> DataFrame:
    """Satellite facts on every row; the provider is the catalogue that answered, if known."""
    sats = registry.satellite_table(df.sparkSession).withColumnRenamed("key", "__key")
    names = F.create_map(*[F.lit(v) for pair in registry.SOURCES.items() for v in pair])
    wanted = F.coalesce(F.col(key), F.lit(registry.DEFAULT_SATELLITE))
    out = df.join(F.broadcast(sats), wanted == F.col("__key"), "left").drop("__key")
    label = F.try_element_at(names, F.col(source))
    return out.withColumn("provider", F.coalesce(label, F.col("provider")))
