"""Questions that are SQL only, through the functions of the session."""

from __future__ import annotations

from orbitlake import registry
from orbitlake.functions.sql import register_functions, register_passes_over

from . import views
from .pixel_queries import r6, refl_cte


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = oracle
        return fn
    return add


_MEANS = ("ndvi", "evi", "nbr")


@query(refl_cte(("red", "nir", "blue", "swir22")) + f"""
, v AS (SELECT px.frame_id, px.scene_ord, (nir - red) / nullif(nir + red, 0) AS ndvi,
 2.5e0 * (nir - red) / nullif(nir + 6e0 * red - 7.5e0 * blue + 1e0, 0) AS evi,
 (nir - swir22) / nullif(nir + swir22, 0) AS nbr FROM px JOIN obs USING (frame_id, scene_ord, "row", col)
 WHERE coalesce(obs.scl, 0) NOT IN (3, 8, 9, 10))
SELECT frame_id, scene_ord, count(ndvi) AS n, {', '.join(f"{r6(f'avg({m})', 5)} AS {m}" for m in _MEANS)}
FROM v GROUP BY 1, 2""")
def sql_indices(spark, sf_dir):
    register_functions(spark)
    return spark.sql(f"""
        SELECT frame_id, scene_ord, count(ndvi(nir, red)) AS n,
               {', '.join(f"round(avg({call}), 5) AS {name}" for name, call in (
                   ("ndvi", "ndvi(nir, red)"), ("evi", "evi(nir, red, blue)"),
                   ("nbr", "nbr(nir, swir22)")))}
        FROM (SELECT o.frame_id, o.scene_ord, scl, {', '.join(
            f"reflectance(dn_{b}, boa_offset(scene_date, boa_offset_applied)) AS {b}"
            for b in ("red", "nir", "blue", "swir22"))}
            FROM {{obs}} o JOIN {{scenes}} s ON o.frame_id = s.frame_id AND o.scene_ord = s.scene_ord)
        WHERE NOT is_cloud(scl)
        GROUP BY frame_id, scene_ord""", obs=views.obs(spark, sf_dir),
        scenes=views.obs_scenes(spark, sf_dir))


@query(views.with_views("obs") + f"""
SELECT frame_id, scene_ord, {r6('avg((dn_nir - dn_green) / nullif(dn_nir + dn_green, 0)::DOUBLE)', 5)} AS gndvi
FROM obs GROUP BY 1, 2""")
def sql_own_index(spark, sf_dir):
    """An index that a user adds to the registry, called from SQL."""
    registry.register_index("gndvi", "try_divide(nir - green, nir + green)", ("nir", "green"),
                            (-0.2, 0.9))
    try:
        register_functions(spark, "gndvi")
    finally:
        del registry.INDICES["gndvi"]
    return spark.sql("""SELECT frame_id, scene_ord, round(avg(gndvi(dn_nir, dn_green)), 5) AS gndvi
                        FROM {obs} GROUP BY frame_id, scene_ord""", obs=views.obs(spark, sf_dir))


@query(views.with_views("cat") + """
SELECT scene_id, satellite, passed_at FROM cat
WHERE west <= -106.5 AND -106.5 <= east AND south <= -48.5 AND -48.5 <= north""")
def sql_passes_over(spark, sf_dir):
    views.cat(spark, sf_dir).createOrReplaceTempView("orbitlake_scenes")
    register_passes_over(spark, "orbitlake_scenes")
    return spark.sql("SELECT * FROM passes_over(-106.5D, -48.5D)")
