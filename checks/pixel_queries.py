"""Units, masking, indices, composites and statistics over the pixel stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitlake import materialise, registry
from orbitlake.functions.numeric import half_even
from orbitlake.functions.spectral import index_value, with_indices
from orbitlake.functions.tone import from_decibels
from orbitlake.operators import merge, stats, units

from . import views

QUERIES: dict = {}
ORACLES: dict = {}
OPTICAL = {b: f"dn_{b}" for b in ("red", "nir", "blue", "green", "swir16", "swir22")}
RADAR = {"vv": "amp_vv", "vh": "amp_vh"}
SCENE = ["frame_id", "scene_ord"]


def query(oracle: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return add


def optical(spark: SparkSession, sf_dir: str, bands, clouds: bool = False) -> DataFrame:
    px = views.obs(spark, sf_dir)
    stored = {b: OPTICAL[b] for b in bands}
    px = px.select(*SCENE, "row", "col", "height", "width", "scl", *stored.values())
    px = units.to_reflectance(px, views.obs_scenes(spark, sf_dir), stored, SCENE)
    return units.mask_clouds(px, list(bands)) if clouds else px


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.obs(spark, sf_dir).select(*SCENE, "row", "col", "height", "width",
                                         *RADAR.values())
    return units.to_decibels(px, RADAR)


def merged(spark: SparkSession, sf_dir: str, bands, method="median", clouds=True) -> DataFrame:
    px = optical(spark, sf_dir, bands, clouds)
    packed = merge.shallow(views.obs_scenes(spark, sf_dir), ["frame_id"])
    return merge.composite(px, bands, method, packed=packed)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def r6(expr: str, digits: int = 6) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def refl_cte(bands, clouds: bool = False) -> str:
    """obs joined with its scene's offset, bands in reflectance, optionally cloud-masked."""
    off = ("CASE WHEN s.boa_offset_applied THEN 0 WHEN s.scene_date >= DATE '2022-01-25' "
           "THEN -1000 ELSE 0 END")
    mask = " AND NOT o.scl IN (3, 8, 9, 10)" if clouds else ""
    cols = ", ".join(f"CASE WHEN o.dn_{b} <> 0{mask} THEN CAST(o.dn_{b} + {off} AS DOUBLE) "
                     f"* 1e-4::DOUBLE END AS {b}" for b in bands)
    return (views.with_views("obs", "obs_scenes") +
            f', px AS (SELECT o.frame_id, o.scene_ord, o."row", o.col, o.scl, {cols} FROM obs o '
            "JOIN obs_scenes s USING (frame_id, scene_ord))\n")


def db(column: str) -> str:
    return (f"CASE WHEN {column} > 0 THEN 10e0 * log10(pow(greatest(CAST({column} AS DOUBLE), "
            "1e0), 2e0)) END")


def radar_cte() -> str:
    return (views.with_views("obs") + f', px AS (SELECT frame_id, scene_ord, "row", col, '
            f"{db('amp_vv')} AS vv, {db('amp_vh')} AS vh FROM obs)\n")


ALL = tuple(OPTICAL)


@query(refl_cte(ALL) + 'SELECT frame_id, scene_ord, "row", col, '
       + ", ".join(f"{r6(b)} AS {b}" for b in ALL) + " FROM px")
def reflectance(spark, sf_dir):
    px = optical(spark, sf_dir, ALL)
    return rounded(px.select(*SCENE, "row", "col", *ALL), ALL)


@query(radar_cte() + f'SELECT frame_id, scene_ord, "row", col, {r6("vv")} AS vv, '
       f'{r6("vh")} AS vh FROM px')
def decibels(spark, sf_dir):
    px = radar(spark, sf_dir).select(*SCENE, "row", "col", "vv", "vh")
    return rounded(px, ["vv", "vh"])


@query(radar_cte() + 'SELECT frame_id, scene_ord, "row", col, '
       f'{r6("pow(10e0, vv / 10e0)", 3)} AS vv, {r6("pow(10e0, vh / 10e0)", 3)} AS vh FROM px')
def power(spark, sf_dir):
    px = radar(spark, sf_dir)
    return px.select(*SCENE, "row", "col", *[
        half_even(from_decibels(F.col(b)), 3).alias(b) for b in ("vv", "vh")])


_MIRROR = 'CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END'


@query(radar_cte() + f"""
, cells AS (SELECT DISTINCT frame_id, scene_ord, "row", col FROM px WHERE vv IS NOT NULL AND vh IS NOT NULL),
taps AS (SELECT c.*, {_MIRROR.format(i='c."row" + a.k', n=views.HEIGHT)} AS r2,
                {_MIRROR.format(i='c.col + b.k', n=views.WIDTH)} AS c2
         FROM cells c, (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b)
SELECT t.frame_id, t.scene_ord, t."row", t.col, {r6('avg(p.vv - p.vh)')} AS vvvh
FROM taps t JOIN px p ON p.frame_id = t.frame_id AND p.scene_ord = t.scene_ord
     AND p."row" = t.r2 AND p.col = t.c2
GROUP BY ALL""")
def ratio_multilook(spark, sf_dir):
    looked = units.multilook_ratio(radar(spark, sf_dir), SCENE,
                                   frames=views.images(spark, sf_dir), tile=64)
    return rounded(looked.where("vvvh is not null")
                   .select(*SCENE, "row", "col", "vvvh"), ["vvvh"])


def _index_queries() -> None:
    formulas = {
        "ndvi": "(nir - red) / nullif(nir + red, 0)",
        "ndwi": "(green - nir) / nullif(green + nir, 0)",
        "ndmi": "(nir - swir16) / nullif(nir + swir16, 0)",
        "ndbi": "(swir16 - nir) / nullif(swir16 + nir, 0)",
        "nbr": "(nir - swir22) / nullif(nir + swir22, 0)",
        "ndsi": "(green - swir16) / nullif(green + swir16, 0)",
        "evi": "2.5e0 * ((nir - red) / nullif(nir + 6e0 * red - 7.5e0 * blue + 1e0, 0))",
        "savi": "1.5e0 * ((nir - red) / nullif(nir + red + 0.5e0, 0))",
    }
    for index, formula in formulas.items():
        bands = registry.INDICES[index]["bands"]

        def run(spark, sf_dir, index=index, bands=bands):
            px = with_indices(optical(spark, sf_dir, bands), [index])
            return rounded(px.select(*SCENE, "row", "col", index), [index])

        query(refl_cte(bands) + f'SELECT frame_id, scene_ord, "row", col, {r6(formula)} '
              f"AS {index} FROM px", name=index)(run)


_index_queries()


@query(radar_cte() + f'SELECT frame_id, scene_ord, "row", col, {r6("vv - vh")} AS radar_ratio '
       "FROM px")
def radar_ratio(spark, sf_dir):
    px = with_indices(radar(spark, sf_dir), ["radar_ratio"])
    return rounded(px.select(*SCENE, "row", "col", "radar_ratio"), ["radar_ratio"])


@query(refl_cte(("nir", "swir22")) + f"""
, ix AS (SELECT frame_id, scene_ord, "row", col, (nir - swir22) / nullif(nir + swir22, 0) AS nbr FROM px)
SELECT a.frame_id, a."row", a.col, {r6('a.nbr - b.nbr')} AS dnbr
FROM ix a JOIN ix b ON a.frame_id = b.frame_id AND a."row" = b."row" AND a.col = b.col
WHERE a.scene_ord = 1 AND b.scene_ord = 2 AND a.nbr IS NOT NULL AND b.nbr IS NOT NULL""")
def dnbr(spark, sf_dir):
    from orbitlake.operators.change import index_difference
    px = with_indices(optical(spark, sf_dir, ("nir", "swir22")), ["nbr"])
    out = index_difference(px, "nbr", before=1, after=2, out="dnbr")
    return rounded(out, ["dnbr"])


@query(refl_cte(("red",), clouds=True) + f"""
SELECT frame_id, scene_ord, "row", col, {r6('red')} AS red FROM px""")
def cloud_mask(spark, sf_dir):
    px = optical(spark, sf_dir, ("red",), clouds=True)
    return rounded(px.select(*SCENE, "row", "col", "red"), ["red"])


@query(views.with_views("obs") + f"""
SELECT frame_id, scene_ord, {r6(f'sum(CASE WHEN scl IN (3,8,9,10) THEN 1 ELSE 0 END) / {views.CELLS}e0')} AS cloud_fraction,
       {r6(f'min(sum(CASE WHEN scl IN (3,8,9,10) THEN 1 ELSE 0 END)) OVER (PARTITION BY frame_id) / {views.CELLS}e0')} AS merged_fraction
FROM obs GROUP BY frame_id, scene_ord""")
def cloud_fraction(spark, sf_dir):
    per_scene = units.cloud_fraction(views.obs(spark, sf_dir), SCENE, views.CELLS)
    lowest = per_scene.groupBy("frame_id").agg(F.min("cloud_fraction").alias("merged_fraction"))
    return rounded(per_scene.join(lowest, "frame_id"), ["cloud_fraction", "merged_fraction"])


def _composite_queries() -> None:
    aggregates = {"median": "median({b})", "mean": "avg({b})", "max": "max({b})",
                  "min": "min({b})",
                  "first": "arg_min({b}, CASE WHEN {b} IS NOT NULL THEN scene_ord END)"}
    for method, agg in aggregates.items():
        def run(spark, sf_dir, method=method):
            return rounded(merged(spark, sf_dir, ALL, method), ALL)

        cols = ", ".join(f"{r6(agg.format(b=b))} AS {b}" for b in ALL)
        query(refl_cte(ALL, clouds=True) +
              f'SELECT frame_id, "row", col, {cols} FROM px GROUP BY frame_id, "row", col',
              name=f"composite_{method}")(run)


_composite_queries()


@query(refl_cte(("red",), clouds=True) + f"""
, one AS (SELECT frame_id, scene_ord, count(red) AS seen FROM px GROUP BY ALL),
cell AS (SELECT frame_id, "row", col, max(CASE WHEN red IS NOT NULL THEN 1 ELSE 0 END) AS ok FROM px GROUP BY ALL),
a AS (SELECT frame_id, count(*) AS scenes, max(seen) AS best FROM one GROUP BY 1),
b AS (SELECT frame_id, sum(ok) AS combined FROM cell GROUP BY 1)
SELECT frame_id, scenes, round_even(best * 100e0 / {views.CELLS} * 100e0, 0) / 100e0 AS best_single_pct,
       round_even(combined * 100e0 / {views.CELLS} * 100e0, 0) / 100e0 AS combined_pct
FROM a JOIN b USING (frame_id)""")
def composite_report(spark, sf_dir):
    px = optical(spark, sf_dir, ("red",), clouds=True)
    return merge.composite_report(px, "red", views.CELLS)


@query(refl_cte(("red",), clouds=True) + f"""
SELECT frame_id, "row", col, count(red) > 0 AS any_valid, count(red) >= 7 AS all_valid
FROM px GROUP BY ALL""")
def valid_union(spark, sf_dir):
    return merge.layers_valid(optical(spark, sf_dir, ("red",), clouds=True), "red", 7)


_ROBUST = ("red", "nir")


def _robust_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT frame_id, '{b}' AS band, \"row\", col, {b} AS v FROM px" for b in _ROBUST)
    return refl_cte(_ROBUST) + f"""
, long AS ({long}),
fl AS (SELECT frame_id, band, greatest(0.02e0 * (quantile_cont(v, 0.98e0) - quantile_cont(v, 0.02e0)), 1e-6::DOUBLE) AS fl
       FROM long GROUP BY ALL),
med AS (SELECT frame_id, band, "row", col, median(v) AS med FROM long GROUP BY ALL),
dev AS (SELECT l.*, m.med, abs(l.v - m.med) AS d FROM long l JOIN med m USING (frame_id, band, "row", col)),
mad AS (SELECT frame_id, band, "row", col, median(d) AS mad FROM dev GROUP BY ALL),
fin AS (SELECT d.frame_id, d.band, d."row", d.col,
               coalesce(avg(CASE WHEN d.d <= greatest(coalesce(m.mad, 0) * 1.4826e0 * 2.5e0, f.fl) THEN d.v END), max(d.med)) AS v,
               CAST(count(CASE WHEN d.d <= greatest(coalesce(m.mad, 0) * 1.4826e0 * 2.5e0, f.fl) THEN d.v END) AS INT) AS kept
        FROM dev d JOIN mad m USING (frame_id, band, "row", col) JOIN fl f USING (frame_id, band) GROUP BY ALL)
SELECT frame_id, "row", col, {r6("max(CASE WHEN band = 'red' THEN v END)")} AS red,
       max(CASE WHEN band = 'red' THEN kept END) AS red_kept,
       {r6("max(CASE WHEN band = 'nir' THEN v END)")} AS nir,
       max(CASE WHEN band = 'nir' THEN kept END) AS nir_kept
FROM fin GROUP BY ALL"""


@query(_robust_sql())
def robust_mean(spark, sf_dir):
    scenes = views.obs_scenes(spark, sf_dir)
    # Read by each pass of the noise floors and by the merge: written once, as a fusion does.
    px = materialise(optical(spark, sf_dir, _ROBUST).select("frame_id", "row", "col", *_ROBUST))
    out = merge.robust_mean(px, _ROBUST, scenes,
                            packed=merge.shallow(scenes, ["frame_id"]))
    return rounded(out, _ROBUST)


_NDVI_MEDIAN = refl_cte(("nir", "red"), clouds=True) + """
, comp AS (SELECT frame_id, "row", col, median(nir) AS nir, median(red) AS red FROM px GROUP BY ALL),
ix AS (SELECT frame_id, "row", col, (nir - red) / nullif(nir + red, 0) AS ndvi FROM comp)
"""


def median_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indices(merged(spark, sf_dir, ("nir", "red")), ["ndvi"])


def _q(p: float, value: str = "ndvi") -> str:
    return f"quantile_cont({value}, {p}::DOUBLE)"


@query(_NDVI_MEDIAN + f"""
SELECT frame_id, count(ndvi) AS count, {r6('min(ndvi)', 4)} AS min, {r6('max(ndvi)', 4)} AS max,
       {r6('avg(ndvi)', 4)} AS mean, {r6('stddev_pop(ndvi)', 4)} AS std, {r6(_q(.05), 4)} AS p5,
       {r6(_q(.25), 4)} AS p25, {r6(_q(.5), 4)} AS median, {r6(_q(.75), 4)} AS p75,
       {r6(_q(.95), 4)} AS p95
FROM ix GROUP BY frame_id""")
def index_stats(spark, sf_dir):
    return stats.array_stats(median_ndvi(spark, sf_dir), "ndvi")


@query(_NDVI_MEDIAN + f"""
, w AS (SELECT (0.9e0 - -0.2e0) / 48 AS w),
h AS (SELECT frame_id, CAST(least(floor((ndvi - -0.2e0) / w), 47) AS INT) AS bin, count(*) AS n
      FROM ix, w WHERE ndvi BETWEEN -0.2e0 AND 0.9e0 GROUP BY ALL),
f AS (SELECT DISTINCT frame_id FROM ix WHERE ndvi IS NOT NULL)
SELECT f.frame_id, CAST(b.bin AS INT) AS bin, {r6('-0.2e0 + b.bin * w', 4)} AS edge,
       0.02292e0 AS width, coalesce(h.n, 0) AS pixels
FROM f CROSS JOIN (SELECT unnest(range(48)) AS bin) b CROSS JOIN w
LEFT JOIN h ON h.frame_id = f.frame_id AND h.bin = b.bin""")
def index_histogram(spark, sf_dir):
    low, high = registry.INDICES["ndvi"]["range"]
    return stats.histogram(median_ndvi(spark, sf_dir), "ndvi", low, high)


@query(_NDVI_MEDIAN + f"""
, sp AS (SELECT frame_id, min(ndvi) AS lo, max(ndvi) AS hi, (max(ndvi) - min(ndvi)) / 48 AS w FROM ix WHERE ndvi IS NOT NULL GROUP BY 1),
h AS (SELECT frame_id, CAST(least(floor((ndvi - lo) / w), 47) AS INT) AS bin, count(*) AS n
      FROM ix JOIN sp USING (frame_id) WHERE ndvi IS NOT NULL GROUP BY ALL)
SELECT sp.frame_id, CAST(b.bin AS INT) AS bin, {r6('lo + b.bin * w', 4)} AS edge, {r6('w', 5)} AS width,
       coalesce(h.n, 0) AS pixels
FROM sp CROSS JOIN (SELECT unnest(range(48)) AS bin) b LEFT JOIN h ON h.frame_id = sp.frame_id AND h.bin = b.bin""")
def own_histogram(spark, sf_dir):
    """The histogram of each frame over its own span."""
    return stats.histogram(median_ndvi(spark, sf_dir), "ndvi")
