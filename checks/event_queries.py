"""Detections, overpasses and the scene catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orbitlake.functions import geo
from orbitlake.functions.numeric import cloud_class
from orbitlake.operators import catalog, fires, layout, passes
from orbitlake.sources import firms, stac

from . import views
from .pixel_queries import r6, rounded

QUERIES: dict = {}
ORACLES: dict = {}
NOW = views.NOW


def query(oracle: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle is not None:
            ORACLES[name or fn.__name__] = oracle
        return fn
    return add


# -- detections -----------------------------------------------------------------

RAW = """
SELECT event_id AS ordinal, CAST(((user_id * 37 + event_id) % 1700) / 10e0 - 85e0 AS VARCHAR(40)) AS latitude,
       CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(((event_id * 7919) % 3600) / 10e0 - 180e0 AS VARCHAR(40)) END AS longitude,
       CASE WHEN event_id % 50 = 0 THEN '' ELSE CAST(value AS VARCHAR(40)) END AS frp,
       CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(300 + value / 10 AS VARCHAR(40)) END AS bright_ti4,
       CASE WHEN event_id % 3 = 2 THEN CAST(310 + value / 10 AS VARCHAR(40)) END AS brightness,
       CASE event_type WHEN 'signup' THEN 'l' WHEN 'view' THEN ' Nominal ' WHEN 'click' THEN 'H'
            WHEN 'error' THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) END AS confidence,
       substr(CAST(ts AS VARCHAR(40)), 1, 10) AS acq_date,
       CAST(CAST(substr(CAST(ts AS VARCHAR(40)), 12, 2) AS INT) * 100 + CAST(substr(CAST(ts AS VARCHAR(40)), 15, 2) AS INT) AS VARCHAR(40)) AS acq_time,
       CASE WHEN event_id % 2 = 0 THEN 'd' ELSE 'N' END AS daynight,
       CASE event_id % 3 WHEN 0 THEN 'viirs-snpp' WHEN 1 THEN 'viirs-noaa20' ELSE 'modis' END AS sensor
FROM events
"""


def raw_detections(spark, sf_dir) -> DataFrame:
    """Detections as the sensors publish them: text fields, two channel names."""
    return spark.sql(RAW.replace("VARCHAR(40)", "STRING").replace("FROM events", "FROM {events}"),
                     events=views.table(spark, sf_dir, "events"))


LEVEL = """CASE WHEN lower(trim(c)) IN ('l', 'low') THEN 0.25e0 WHEN lower(trim(c)) IN ('n', 'nominal') THEN 0.65e0
 WHEN lower(trim(c)) IN ('h', 'high') THEN 0.95e0 ELSE coalesce(TRY_CAST(trim(c) AS DOUBLE) / 100e0, 0.65e0) END"""


@query(f"""
WITH raw AS ({RAW}), t AS (SELECT *, TRY_CAST(latitude AS DOUBLE) AS la, TRY_CAST(longitude AS DOUBLE) AS lo,
  {LEVEL.replace('(c)', '(confidence)')} AS lv, lpad(acq_time, 4, '0') AS st FROM raw)
SELECT ordinal, {r6('la', 5)} AS lat, {r6('lo', 5)} AS lon, {r6('TRY_CAST(frp AS DOUBLE)', 2)} AS frp,
  {r6("TRY_CAST(coalesce(nullif(bright_ti4, ''), nullif(brightness, '')) AS DOUBLE)", 2)} AS brightness_k,
  {r6('lv', 2)} AS confidence, CASE WHEN lv < 0.3e0 THEN 'low' WHEN lv < 0.8e0 THEN 'nominal' ELSE 'high' END AS confidence_label,
  CAST(acq_date || ' ' || substr(st, 1, 2) || ':' || substr(st, 3, 2) || ':00' AS TIMESTAMP) AS acquired, sensor,
  CAST(CASE WHEN sensor = 'modis' THEN 1000 ELSE 375 END AS INT) AS resolution_m, upper(daynight) = 'D' AS day
FROM t WHERE la IS NOT NULL AND lo IS NOT NULL""")
def detections(spark, sf_dir):
    return firms.detections(raw_detections(spark, sf_dir))


@query(views.with_views("dets") + f"""
, l AS (SELECT sensor, {LEVEL.replace('(c)', "(coalesce(confidence_raw, ''))")} AS lv FROM dets),
b AS (SELECT *, CASE WHEN lv < 0.3e0 THEN 'low' WHEN lv < 0.8e0 THEN 'nominal' ELSE 'high' END AS confidence_label FROM l)
SELECT sensor, confidence_label, count(*) AS n, {r6('avg(lv)')} AS level FROM b GROUP BY ALL""")
def fire_confidence(spark, sf_dir):
    lv = firms.confidence_level(F.col("confidence_raw"))
    px = views.dets(spark, sf_dir).select("sensor", lv.alias("lv"))
    px = px.withColumn("confidence_label", firms.confidence_label(F.col("lv")))
    return rounded(px.groupBy("sensor", "confidence_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lv").alias("level")), ["level"])


@query(views.with_views("dets") + f"""
, a AS (SELECT sensor, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(acquired)) / 3600000000) AS INT) + 1 AS h FROM dets)
SELECT sensor, CASE WHEN h <= 24 THEN '24h' WHEN h <= 48 THEN '48h' WHEN h <= 168 THEN '7d' END AS "window", count(*) AS n
FROM a GROUP BY ALL""")
def fire_windows(spark, sf_dir):
    """Which published window is needed to see each detection at the fixed time."""
    now_us = F.unix_micros(F.lit(NOW).cast("timestamp"))
    age = F.floor((now_us - F.unix_micros(F.col("acquired").cast("timestamp"))) / 3600000000)
    px = views.dets(spark, sf_dir).select("sensor", firms.covering_window_of(
        age.cast("int") + 1).alias("window"))
    return px.groupBy("sensor", "window").agg(F.count(F.lit(1)).alias("n"))


@query(views.with_views("dets") + """
, s AS (SELECT ordinal, least(greatest(floor((lon + 180e0) / 360e0 * 1048576e0)::BIGINT, 0), 1048575) AS x,
 least(greatest(floor((lat + 90e0) / 180e0 * 1048576e0)::BIGINT, 0), 1048575) AS y FROM dets)
SELECT ordinal, list_sum(list_transform(range(20), lambda i: (((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1))))::BIGINT AS place
FROM s""")
def curve_places(spark, sf_dir):
    """Where each detection lies on the curve that orders stored tables."""
    return views.dets(spark, sf_dir).select(
        "ordinal", layout.ground_key(F.col("lon"), F.col("lat"), 20).alias("place"))


BOXES = """
SELECT n_nationkey AS box_id, CAST((n_nationkey * 29) % 300 - 150 AS DOUBLE) AS east,
       CAST((n_nationkey * 29) % 300 - 110 AS DOUBLE) AS west,
       CAST((n_nationkey * 17) % 120 - 80 AS DOUBLE) AS south, CAST((n_nationkey * 17) % 120 - 55 AS DOUBLE) AS north
FROM nation
"""


def boxes(spark, sf_dir) -> DataFrame:
    """Rectangles given back to front, as a map may hand them over."""
    return spark.sql(BOXES.replace("FROM nation", "FROM {nation}"),
                     nation=views.table(spark, sf_dir, "nation"))


_FIRES = views.with_views("dets") + f"""
, boxes AS ({BOXES}), sane AS (SELECT box_id, least(west, east) AS w, greatest(west, east) AS e, south AS s, north AS n FROM boxes),
hit AS (SELECT b.box_id, d.* FROM dets d JOIN sane b ON d.lat BETWEEN b.s AND b.n AND d.lon BETWEEN b.w AND b.e
        WHERE d.acquired >= TIMESTAMP '{NOW}' - INTERVAL 168 HOURS)
"""


@query(_FIRES + """
, r AS (SELECT box_id, ordinal, lat, lon, frp, sensor, acquired, CAST(row_number() OVER (PARTITION BY box_id ORDER BY coalesce(frp, 0) DESC, ordinal) AS INT) AS fierceness FROM hit)
SELECT * FROM r WHERE fierceness <= 20""", name="fires")
def active_fires(spark, sf_dir):
    out = fires.active_fires(views.dets(spark, sf_dir), boxes(spark, sf_dir), NOW, 168, most=20)
    return out.select("box_id", "ordinal", "lat", "lon", "frp", "sensor", "acquired",
                      "fierceness")


@query(_FIRES + """
, c AS (SELECT box_id, count(*) AS n FROM hit GROUP BY 1)
SELECT b.box_id, coalesce(c.n, 0) AS total, least(coalesce(c.n, 0), 20) AS count, coalesce(c.n, 0) > 20 AS capped
FROM boxes b LEFT JOIN c USING (box_id)""")
def fire_counts(spark, sf_dir):
    out = fires.fire_counts(views.dets(spark, sf_dir), boxes(spark, sf_dir), NOW, 168, most=20)
    return out.select("box_id", "total", F.col("count").cast("long").alias("count"), "capped")


@query(views.with_views("dets") + f"""
, l AS (SELECT *, {LEVEL.replace('(c)', "(coalesce(confidence_raw, ''))")} AS cf, coalesce(frp, 0) AS p FROM dets)
SELECT ordinal, {r6('3.5e0 + 11.5e0 * least(sqrt(greatest(p, 0) / 120e0), 1e0)')} AS radius,
 CASE WHEN p > 100 THEN '#fff3b0' WHEN p > 30 THEN '#ffb703' WHEN p > 10 THEN '#fb8500' ELSE '#e5383b' END AS fill,
 CASE WHEN p > 100 THEN '#ffffff' WHEN p > 30 THEN '#ffd166' WHEN p > 10 THEN '#ffa94d' ELSE '#ff6b6b' END AS edge,
 {r6('0.25e0 + 0.5e0 * cf')} AS opacity FROM l""")
def fire_styles(spark, sf_dir):
    px = views.dets(spark, sf_dir).withColumn(
        "confidence", firms.confidence_level(F.col("confidence_raw")))
    return rounded(fires.with_style(px).select("ordinal", "radius", "fill", "edge", "opacity"),
                   ["radius", "opacity"])


@query(views.with_views("dets") + """
SELECT ordinal, lat, lon FROM dets WHERE lat BETWEEN -40 AND 10 AND lon BETWEEN 100 AND 160""")
def fires_in_box(spark, sf_dir):
    out = fires.within_box(views.dets(spark, sf_dir), 160, 10, 100, -40)
    return out.select("ordinal", "lat", "lon")


# -- overpasses -----------------------------------------------------------------

_RECENT = views.with_views("pass_log").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, rec AS (SELECT * FROM pass_log WHERE passed_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 45 DAYS AND TIMESTAMP '{NOW}'),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id, satellite ORDER BY passed_at DESC, ordinal DESC) AS recency FROM rec),
tt AS (SELECT point_id, satellite, orbit, list_sort(list(epoch_us(passed_at))) AS times FROM rec GROUP BY ALL),
fold AS (SELECT point_id, satellite, orbit, times, 2 AS i, [times[1]] AS kept FROM tt
  UNION ALL SELECT point_id, satellite, orbit, times, i + 1, CASE WHEN times[i] - kept[-1] >= 43200000000 THEN list_append(kept, times[i]) ELSE kept END
  FROM fold WHERE i <= len(times)),
tr AS (SELECT point_id, satellite, orbit, times, kept FROM fold WHERE i = len(times) + 1),
gp AS (SELECT *, CASE WHEN len(kept) > 1 THEN list_min(list_transform(range(2, len(kept) + 1), lambda j: kept[j] - kept[j - 1])) END AS gap FROM tr),
pr AS (SELECT *, coalesce(gap, CASE satellite WHEN 'sentinel-2' THEN 10 ELSE 12 END * 86400000000) AS period, epoch_us(TIMESTAMP '{NOW}') AS now_us FROM gp),
nx AS (SELECT *, kept[-1] + ((now_us - kept[-1]) // period + 1) * period AS next_us FROM pr)
"""


def recent(spark, sf_dir) -> DataFrame:
    return passes.recent_passes(views.pass_log(spark, sf_dir), NOW)


@query(_RECENT + "SELECT point_id, satellite, orbit, passed_at, CAST(recency AS INT) AS recency FROM rk WHERE recency <= 100")
def passes_recent(spark, sf_dir):
    """The listing of the newest hundred passes; the limit is what is asked for."""
    return passes.newest_passes(recent(spark, sf_dir), 100).select(
        "point_id", "satellite", "orbit", "passed_at", "recency")


@query(_RECENT + "SELECT point_id, satellite, orbit, make_timestamp(unnest(kept)) AS passed_at FROM tr")
def passes_distinct(spark, sf_dir):
    return passes.distinct_passes(recent(spark, sf_dir))


@query(_RECENT + f"""
SELECT point_id, satellite, orbit, CAST(len(times) AS INT) AS passes, CAST(len(kept) AS INT) AS distinct_passes,
 gap IS NOT NULL AS measured, {r6('period / 86400000000e0', 2)} AS period_days, make_timestamp(next_us) AS next_at FROM nx""")
def passes_interval(spark, sf_dir):
    return passes.intervals(recent(spark, sf_dir), NOW)


@query(_RECENT + f"""
, so AS (SELECT *, row_number() OVER (PARTITION BY point_id, satellite ORDER BY next_us, times[1]) AS k,
  sum(len(times)) OVER (PARTITION BY point_id, satellite) AS seen, count(*) OVER (PARTITION BY point_id, satellite) AS orbits FROM nx)
SELECT s.point_id, s.satellite, CAST(seen AS INT) AS passes_seen, CAST(orbits AS INT) AS orbits_seen, s.gap IS NOT NULL AS measured,
 l.passed_at AS last_at, {r6('(now_us - epoch_us(l.passed_at)) / 3600000000e0', 1)} AS hours_ago, l.orbit AS last_orbit,
 make_timestamp(next_us) AS next_at, {r6('(next_us - now_us) / 3600000000e0', 1)} AS hours_away, s.orbit AS next_orbit,
 {r6('period / 86400000000e0', 2)} AS period_days
FROM so s JOIN rk l ON l.point_id = s.point_id AND l.satellite = s.satellite AND l.recency = 1 WHERE k = 1""")
def passes_next(spark, sf_dir):
    return passes.next_passes(recent(spark, sf_dir), NOW)


@query(views.with_views("cat", "points") + """
SELECT p.point_id, c.scene_id, c.satellite, c.passed_at FROM points p
JOIN cat c ON p.lon BETWEEN c.west AND c.east AND p.lat BETWEEN c.south AND c.north""")
def passes_over(spark, sf_dir):
    out = passes.passes_over(views.cat(spark, sf_dir), views.points(spark, sf_dir))
    return out.select("point_id", "scene_id", "satellite", "passed_at")


# -- catalogue ------------------------------------------------------------------

AREAS = """
SELECT n_nationkey AS aoi_id, CAST((n_nationkey * 53) % 300 - 150 AS DOUBLE) AS w,
       CAST((n_nationkey * 19) % 120 - 70 AS DOUBLE) AS s FROM nation
"""


def areas(spark, sf_dir) -> DataFrame:
    """Triangles of 12 by 9 degrees, one per nation, with their bounds."""
    raw = spark.sql(AREAS.replace("FROM nation", "FROM {nation}"),
                    nation=views.table(spark, sf_dir, "nation"))
    vertex = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    w, s = F.col("w"), F.col("s")
    ring = F.array(vertex(w, s), vertex(w + 12.0, s), vertex(w + 4.0, s + 9.0), vertex(w, s))
    df = raw.select("aoi_id", geo.geometry(ring).alias("geometry"))
    return df.withColumns(geo.bounds(F.col("geometry")))


def _outside(sign: str) -> str:
    """All four box corners strictly on one side of any triangle edge (separating axis)."""
    edges = [("w", "s", "w + 12", "s"), ("w + 12", "s", "w + 4", "s + 9"),
             ("w + 4", "s + 9", "w", "s")]
    tests = []
    for x1, y1, x2, y2 in edges:
        sides = [f"((({x2}) - ({x1})) * (c.{cy} - ({y1})) - (({y2}) - ({y1})) * (c.{cx} - ({x1}))) < 0"
                 for cx in ("west", "east") for cy in ("south", "north")]
        tests.append("(" + " AND ".join(sides) + ")")
    return " OR ".join(tests)


_HITS = views.with_views("cat") + f"""
, areas AS ({AREAS}),
ok AS (SELECT * FROM cat WHERE passed_at BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '2000-12-31 23:59:59'
       AND (satellite = 'sentinel-1' OR cloud < 40)),
hit AS (SELECT a.aoi_id, c.* FROM ok c JOIN areas a ON c.west <= a.w + 12 AND c.east >= a.w AND c.south <= a.s + 9 AND c.north >= a.s
        WHERE NOT ({_outside('<')})),
pri AS (SELECT *, CASE WHEN satellite = 'sentinel-1' AND source = 'planetary-computer' THEN 1 WHEN satellite = 'sentinel-1' THEN 2 ELSE 1 END AS pri FROM hit),
src AS (SELECT *, dense_rank() OVER (PARTITION BY aoi_id, satellite ORDER BY pri) AS dr FROM pri),
rk AS (SELECT *, row_number() OVER (PARTITION BY aoi_id, satellite ORDER BY passed_at DESC, scene_id) AS rn FROM src WHERE dr = 1)
"""


@query(_HITS + "SELECT aoi_id, scene_id, satellite, source, passed_at, cloud, CAST(rn AS INT) AS rank FROM rk WHERE rn <= 10")
def scene_search(spark, sf_dir):
    out = catalog.search(views.cat(spark, sf_dir), areas(spark, sf_dir), "1996-01-01",
                         "2000-12-31", 40, 10)
    return out.select("aoi_id", "scene_id", "satellite", "source", "passed_at", "cloud", "rank")


@query(_HITS + """, m AS (SELECT aoi_id, satellite, count(*) AS matched FROM src WHERE dr = 1 GROUP BY ALL)
SELECT aoi_id, satellite, scene_id, matched, CAST(rn AS INT) AS rank FROM rk JOIN m USING (aoi_id, satellite) WHERE rn <= 500""")
def scene_matched(spark, sf_dir):
    """A search beyond a catalogue's page of a hundred, with the number of scenes there are."""
    out = catalog.search(views.cat(spark, sf_dir), areas(spark, sf_dir), "1996-01-01",
                         "2000-12-31", 40, 500)
    return out.select("aoi_id", "satellite", "scene_id", "matched", "rank")


@query(_HITS + "SELECT aoi_id, satellite, source, count(*) AS scenes FROM src WHERE dr = 1 GROUP BY ALL")
def source_fallback(spark, sf_dir):
    from orbitlake.operators.spatial import areas_meet_boxes
    kept = catalog.filter_scenes(views.cat(spark, sf_dir), "1996-01-01", "2000-12-31", 40)
    hits = areas_meet_boxes(areas(spark, sf_dir), kept)
    return catalog.best_source(hits).groupBy("aoi_id", "satellite", "source").agg(
        F.count(F.lit(1)).alias("scenes"))


@query(_HITS.replace("FROM hit)", "FROM hit WHERE satellite <> 'sentinel-1' OR source = 'earth-search')", 1) + """
SELECT aoi_id, satellite, source, count(*) AS scenes FROM src WHERE dr = 1 GROUP BY ALL""")
def source_pinned(spark, sf_dir):
    """The same fallback with the radar catalogue fixed by the caller."""
    from orbitlake.operators.spatial import areas_meet_boxes
    kept = catalog.filter_scenes(views.cat(spark, sf_dir), "1996-01-01", "2000-12-31", 40)
    hits = areas_meet_boxes(areas(spark, sf_dir), kept)
    found = catalog.best_source(hits, pinned={"sentinel-1": "earth-search"})
    return found.groupBy("aoi_id", "satellite", "source").agg(F.count(F.lit(1)).alias("scenes"))


@query(views.with_views("cat") + """
SELECT west, south, satellite, scene_id, CAST(passed_at AS DATE) AS date,
 CAST(row_number() OVER (PARTITION BY west, south, satellite ORDER BY CAST(passed_at AS DATE) DESC, scene_id) AS INT) AS nth FROM cat""")
def dates_used(spark, sf_dir):
    out = catalog.chosen_dates(views.cat(spark, sf_dir), ["west", "south", "satellite"])
    return out.select("west", "south", "satellite", "scene_id", "date", "nth")


_TILE = "CAST(west AS INT) AS west, CAST(south AS INT) AS south"


@query(views.with_views("cat") + """
, r AS (SELECT west, south, satellite, scene_id, cloud, CAST(row_number() OVER (PARTITION BY west, south, satellite ORDER BY
  CASE WHEN satellite = 'sentinel-2' THEN coalesce(cloud, 100) END,
  CASE WHEN satellite = 'sentinel-1' THEN passed_at END DESC NULLS LAST, scene_id) AS INT) AS rank FROM cat)
SELECT * FROM r WHERE rank <= 6""")
def scene_best_n(spark, sf_dir):
    out = catalog.best_dates(views.cat(spark, sf_dir), 6, ["west", "south"])
    return out.select("west", "south", "satellite", "scene_id", "cloud", "rank")


@query(views.with_views("cat") + """
SELECT west, south, arg_min(scene_id, {'c': coalesce(cloud, 100), 's': scene_id}) AS scene_id, min(coalesce(cloud, 100)) AS cloud
FROM cat GROUP BY ALL""")
def clearest(spark, sf_dir):
    return catalog.clearest_scene(views.cat(spark, sf_dir), ["west", "south"])


@query(views.with_views("cat") + """
SELECT satellite, CASE WHEN coalesce(cloud, 0) < 10 THEN 'clear' WHEN coalesce(cloud, 0) < 30 THEN 'some' ELSE 'cloudy' END AS cloud_class,
 CASE source WHEN 'planetary-computer' THEN 'Microsoft Planetary Computer' ELSE 'Earth Search (AWS Open Data)' END AS provider,
 CAST(CASE satellite WHEN 'sentinel-2' THEN 10 ELSE 20 END AS INT) AS resolution, count(*) AS scenes FROM cat GROUP BY ALL""")
def satellite_facts(spark, sf_dir):
    px = catalog.with_satellite(views.cat(spark, sf_dir))
    return px.groupBy("satellite", cloud_class(F.col("cloud")).alias("cloud_class"), "provider",
                      "resolution").agg(F.count(F.lit(1)).alias("scenes"))


ITEMS = """
SELECT o_orderkey AS k, o_orderdate AS ts, o_totalprice AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN 'sentinel-1-grd' ELSE 'sentinel-2-l2a' END AS collection FROM orders
"""


def items(spark, sf_dir) -> DataFrame:
    """STAC items as JSON text, derived from the orders."""
    raw = spark.sql(ITEMS.replace("FROM orders", "FROM {orders}"),
                    orders=views.table(spark, sf_dir, "orders"))
    k, radar = F.col("k"), F.col("k") % 3 == 0
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    props = F.struct(
        F.when(k % 5 != 0, when).alias("datetime"), when.alias("start_datetime"),
        F.when(k % 4 == 0, F.lit("S9")).alias("platform"),
        F.when(~radar, F.col("price") % 100.0).alias("eo:cloud_cover"),
        F.when(radar, (k % 175).cast("int")).alias("sat:relative_orbit"),
        F.when(radar, F.lit("ascending")).alias("sat:orbit_state"),
        F.when(radar, F.lit("IW")).alias("sar:instrument_mode"),
        F.when(~radar, F.lit("31")).alias("mgrs:utm_zone"),
        F.when(~radar, F.lit("U")).alias("mgrs:latitude_band"),
        F.when(~radar, F.lit("CT")).alias("mgrs:grid_square"),
        F.when(k % 2 == 0, F.lit(True)).alias("earthsearch:boa_offset_applied"))
    link = F.concat(F.lit("s3://bucket/scene/"), k.cast("string"), F.lit(".tif"))
    https = F.struct(F.concat(F.lit("https://host/"), k.cast("string")).alias("href"))
    asset = F.struct(F.when(k % 11 != 0, link).alias("href"),
                     F.when(k % 7 == 0, F.struct(https.alias("https"))).alias("alternate"))
    body = F.struct(F.concat(F.lit("id-"), k.cast("string")).alias("id"), "collection",
                    props.alias("properties"), F.struct(asset.alias("red")).alias("assets"))
    return raw.select(F.to_json(body).alias("item"))


@query(f"""
WITH i AS ({ITEMS})
SELECT 'id-' || k AS scene_id, CASE WHEN k % 3 = 0 THEN 'sentinel-1' ELSE 'sentinel-2' END AS satellite, 'earth-search' AS source,
 ts AS datetime, CAST(ts AS DATE) AS date, CASE WHEN k % 3 <> 0 THEN {r6('price % 100', 1)} END AS cloud,
 CASE WHEN k % 4 = 0 THEN 'S9' WHEN k % 3 = 0 THEN 'Sentinel-1 A/C' ELSE 'Sentinel-2 A/B/C' END AS platform,
 CASE WHEN k % 3 <> 0 THEN '31UCT' WHEN k % 175 = 0 THEN 'IW ASC' ELSE 'IW ASC #' || (k % 175) END AS tile,
 CAST(CASE WHEN k % 3 = 0 THEN k % 175 END AS INT) AS orbit, k % 2 = 0 AS boa_offset_applied,
 CASE WHEN k % 7 = 0 THEN 'https://host/' || k ELSE 'https://bucket.s3.amazonaws.com/scene/' || k || '.tif' END AS red_href
FROM i WHERE k % 11 <> 0 OR k % 7 = 0""")
def scene_flatten(spark, sf_dir):
    flat = stac.scenes_from_items(stac.parse_items(items(spark, sf_dir)))
    return flat.select("scene_id", "satellite", "source", "datetime", "date", "cloud", "platform",
                       "tile", "orbit", "boa_offset_applied",
                       F.col("assets")["red"].alias("red_href"))


@query(views.with_views("cat") + """
SELECT west, south, satellite, count(*) AS scenes FROM cat GROUP BY ALL""")
def single_satellite(spark, sf_dir):
    """Rows that don't name their satellite count as the default one; groups mix both."""
    named = F.when((F.col("satellite") == "sentinel-1") | (F.col("scene_id") % 3 != 0),
                   F.col("satellite"))
    groups = views.cat(spark, sf_dir).withColumns({
        "radar": F.col("satellite") == "sentinel-1", "satellite": named})
    out = catalog.single_satellite(groups, ["west", "south", "radar"])
    return out.select("west", "south", "satellite", "scenes")


@query("""
WITH s AS (SELECT o_orderkey AS scene, o_custkey AS frame_id, o_orderkey % 2 = 0 AS has_nir FROM orders)
SELECT frame_id, 'red' AS band FROM s GROUP BY 1 UNION ALL SELECT frame_id, 'nir' AS band FROM s GROUP BY 1 HAVING bool_and(has_nir)""")
def common_bands(spark, sf_dir):
    """Every scene offers red, every other one near infrared as well."""
    from orbitlake.operators import merge
    link = F.lit("https://host/band")
    scenes = views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("frame_id"), F.col("o_orderkey").alias("scene_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("red"), link, F.lit("nir"), link))
        .otherwise(F.create_map(F.lit("red"), link)).alias("assets"))
    return merge.common_bands(scenes)


@query(views.with_views("cat") + """
SELECT scene_id, satellite, source, passed_at FROM cat WHERE scene_id = 4242 AND satellite = 'sentinel-1'""")
def scene_by_id(spark, sf_dir):
    scenes = views.cat(spark, sf_dir)
    found = catalog.get_scene(scenes.withColumn("scene_id", F.concat(
        F.lit("S1-"), F.col("scene_id").cast("string"))), "S1-4242")
    return found.select(F.substring("scene_id", 4, 20).cast("long").alias("scene_id"),
                        "satellite", "source", "passed_at")
