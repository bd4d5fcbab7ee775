"""Adapter views: the driver tables seen as scenes, pixels, detections and passes.

Each view is one SELECT that reads the same in Spark SQL and DuckDB, so a Spark query and its
oracle start from identical rows.  Frames are 64 rows by 128 columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEIGHT, WIDTH, CELLS = 64, 128, 64 * 128
NOW = "2024-01-31 00:00:00"

OBS = """
SELECT CAST(floor(l_orderkey / 8192) AS INT) AS frame_id,
       CAST(l_linenumber AS INT) AS scene_ord,
       CAST(floor((l_orderkey % 8192) / 128) AS INT) AS row_no,
       CAST(l_orderkey % 128 AS INT) AS col,
       CAST(CASE WHEN max(l_suppkey) % 17 = 0 THEN 0 ELSE 600 + floor(max(l_extendedprice) / 20) END AS INT) AS dn_red,
       CAST(CASE WHEN max(l_suppkey) % 17 = 0 THEN 0 ELSE 1200 + max(l_quantity) * 120 END AS INT) AS dn_nir,
       CAST(500 + max(l_partkey) AS INT) AS dn_blue,
       CAST(800 + max(l_partkey) + 10 * max(l_suppkey) AS INT) AS dn_green,
       CAST(700 + floor(min(l_extendedprice) / 30) AS INT) AS dn_swir16,
       CAST(600 + (3 * max(l_partkey)) % 4000 AS INT) AS dn_swir22,
       CAST(CASE WHEN max(l_partkey) % 23 = 0 THEN 0 ELSE 50 + 10 * max(l_suppkey) END AS INT) AS amp_vv,
       CAST(20 + max(l_partkey) % 300 AS INT) AS amp_vh,
       CAST(CASE max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) WHEN 3 THEN 9 WHEN 2 THEN 5 ELSE 4 END AS INT) AS scl
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

OBS_SCENES = """
SELECT DISTINCT CAST(floor(l_orderkey / 8192) AS INT) AS frame_id,
       CAST(l_linenumber AS INT) AS scene_ord,
       DATE '2021-09-01' + CAST(30 * l_linenumber AS INT) AS scene_date,
       l_linenumber = 7 AS boa_offset_applied
FROM lineitem
"""

DETS = """
SELECT event_id AS ordinal,
       ((user_id * 37 + event_id) % 1700) / 10e0 - 85e0 AS lat,
       ((event_id * 7919) % 3600) / 10e0 - 180e0 AS lon,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS frp,
       CASE event_type WHEN 'signup' THEN 'l' WHEN 'view' THEN 'nominal' WHEN 'click' THEN 'H'
            WHEN 'error' THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) END AS confidence_raw,
       CASE event_id % 3 WHEN 0 THEN 'viirs-snpp' WHEN 1 THEN 'viirs-noaa20' ELSE 'modis' END AS sensor,
       ts AS acquired
FROM events
"""

PASS_LOG = """
SELECT user_id % 20 AS point_id,
       CASE WHEN user_id % 2 = 0 THEN 'sentinel-2' ELSE 'sentinel-1' END AS satellite,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 7 END AS orbit,
       ts AS passed_at, event_id AS ordinal
FROM events
"""

CAT = """
SELECT o_orderkey AS scene_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'sentinel-1' ELSE 'sentinel-2' END AS satellite,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'planetary-computer' ELSE 'earth-search' END AS source,
       o_orderdate AS passed_at,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) % 100 AS DOUBLE) END AS cloud,
       CAST((o_custkey * 73) % 360 - 180 AS DOUBLE) AS west,
       CAST((o_custkey * 31) % 160 - 80 AS DOUBLE) AS south,
       CAST((o_custkey * 73) % 360 - 179 AS DOUBLE) AS east,
       CAST((o_custkey * 31) % 160 - 79 AS DOUBLE) AS north
FROM orders
"""

POINTS = """
SELECT s_suppkey AS point_id,
       ((s_suppkey * 7919) % 3590) / 10e0 - 179e0 AS lon,
       ((s_suppkey * 4513) % 1590) / 10e0 - 79e0 AS lat,
       200e0 + s_nationkey * 1000e0 AS radius_m
FROM supplier
"""

_SQL = {"obs": OBS, "obs_scenes": OBS_SCENES, "dets": DETS, "pass_log": PASS_LOG, "cat": CAT,
        "points": POINTS}


def with_views(*names: str) -> str:
    """The named views as the CTE list of a DuckDB query, ``row_no`` spelt as ``row``."""
    parts = [f"{n} AS ({_SQL[n].replace('row_no', chr(34) + 'row' + chr(34)).strip()})"
             for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    sql = _SQL[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel stack, one row per (frame, scene, row, col), with the frame size as columns."""
    from orbitlake.operators.stencil import sized
    raw = _view(spark, sf_dir, "obs", "lineitem").withColumnRenamed("row_no", "row")
    return sized(raw, HEIGHT, WIDTH)


def obs_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "obs_scenes", "lineitem")


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "dets", "events")


def pass_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "pass_log", "events")


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "cat", "orders")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "points", "supplier")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and size of every image of the pixel stack."""
    from orbitlake.operators.stencil import sized
    return sized(obs_scenes(spark, sf_dir).select("frame_id", "scene_ord"), HEIGHT, WIDTH)
