"""The pointwise functions as SQL functions of a session, so that questions can be plain SQL.

Each is a SQL expression of its arguments, which the optimizer inlines: no Python runs in a query
that calls them.  Indices come from the registry, those added by ``register_index`` too.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .. import registry
from ..registry import QueryError

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _finite(expression: str) -> str:
    """The value, or NULL where it is no finite number."""
    return (f"(SELECT CASE WHEN NOT isnan(v) AND abs(v) <> double('Infinity') THEN v END "
            f"FROM (SELECT CAST({expression} AS DOUBLE) AS v))")


def scalar_functions() -> dict[str, tuple[str, str, str]]:
    """Name -> (arguments, type, expression)."""
    out = {
        "boa_offset": ("scene_date DATE, applied BOOLEAN", "INT",
                       f"CASE WHEN applied THEN 0 WHEN scene_date >= DATE "
                       f"'{registry.BOA_OFFSET_DATE}' THEN {registry.BOA_OFFSET} ELSE 0 END"),
        "reflectance": ("dn DOUBLE, boa_offset DOUBLE", "DOUBLE",
                        f"CASE WHEN dn <> 0 THEN (dn + boa_offset) * "
                        f"{registry.REFLECTANCE_SCALE!r}D END"),
        "decibels": ("amplitude DOUBLE", "DOUBLE",
                     f"CASE WHEN amplitude > 0 THEN 10D * log10(pow(greatest(amplitude, "
                     f"double({registry.S1_FLOOR_DN})), 2D)) END"),
        "from_decibels": ("value DOUBLE", "DOUBLE", "pow(10D, value / 10D)"),
        "is_cloud": ("scl INT", "BOOLEAN", f"coalesce(scl, 0) IN "
                     f"({', '.join(map(str, sorted(registry.CLOUD_CLASSES)))})"),
        "smoothstep": ("low DOUBLE, high DOUBLE, value DOUBLE", "DOUBLE",
                       "(SELECT t * t * (3D - 2D * t) FROM (SELECT least(greatest((value - low) / "
                       "(high - low), 0D), 1D) AS t))"),
        "cloudiness": ("r DOUBLE, g DOUBLE, b DOUBLE, sensitivity DOUBLE DEFAULT 0.5", "DOUBLE",
                       "smoothstep(0.62D - 0.42D * sensitivity, 0.88D - 0.42D * sensitivity, "
                       "greatest(r, g, b) / 255D) * (1D - smoothstep(0.2D, 0.5D, CASE WHEN "
                       "greatest(r, g, b) = 0 THEN 0D ELSE (greatest(r, g, b) - least(r, g, b)) / "
                       "greatest(r, g, b) END))"),
    }
    for name, index in registry.INDICES.items():
        if not _NAME.fullmatch(name):
            raise QueryError(f"{name!r} can't be the name of a SQL function")
        out[name] = (", ".join(f"{b} DOUBLE" for b in index["bands"]), "DOUBLE",
                     _finite(index["sql"]))
    return out


def register_functions(spark: SparkSession, *names: str) -> list[str]:
    """Make the functions, or only the named ones, known to a session; their names."""
    offered = scalar_functions()
    if strangers := [n for n in names if n not in offered]:
        raise QueryError(f"no function is called {', '.join(strangers)}")
    wanted = [n for n in offered if not names or n in names]
    for name in wanted:
        arguments, kind, expression = offered[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} "
                  f"RETURN {expression}")
    return wanted


def register_passes_over(spark: SparkSession, view: str = "scenes") -> None:
    """``passes_over(lon, lat)``: the rows of a view of scenes (scene_id, satellite, passed_at,
    west, south, east, north) whose footprint box holds a point; both are predicates of the scan.
    For many points at once there is ``operators.passes.passes_over``."""
    if not _NAME.fullmatch(view):
        raise QueryError(f"{view!r} is no name of a view")
    fields = spark.table(view).schema
    kinds = ", ".join(f"{c} {fields[c].dataType.simpleString()}"
                      for c in ("scene_id", "satellite", "passed_at"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION passes_over(lon DOUBLE, lat DOUBLE) "
              f"RETURNS TABLE({kinds}) RETURN SELECT scene_id, satellite, passed_at FROM {view} "
              f"WHERE west <= passes_over.lon AND passes_over.lon <= east "
              f"AND south <= passes_over.lat AND passes_over.lat <= north")
