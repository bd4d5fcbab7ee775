"""Scene catalogues: nested STAC items to flat scene rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import registry
from ..functions.numeric import blank_to_null, half_even

ITEM_SCHEMA = """
id string, collection string, bbox array<double>,
properties struct<
  datetime: string, start_datetime: string, platform: string, `eo:cloud_cover`: double,
  `proj:epsg`: int, `sat:relative_orbit`: int, `sat:orbit_state`: string,
  `sar:instrument_mode`: string, `mgrs:utm_zone`: string, `mgrs:latitude_band`: string,
  `mgrs:grid_square`: string, `earthsearch:boa_offset_applied`: boolean,
  `view:sun_elevation`: double>,
assets map<string, struct<href: string, alternate: map<string, struct<href: string>>>>
"""


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per item from newline-delimited JSON; the schema is given, never inferred."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def parse_items(df: DataFrame, text: str = "item") -> DataFrame:
    """Items held as JSON text in a column."""
    return df.select(F.from_json(F.col(text), ITEM_SCHEMA).alias("i")).select("i.*")


def best_href(asset: Column) -> Column:
    """https, then http, then the plain link with bucket addresses rewritten to https."""
    other = lambda scheme: blank_to_null(asset["alternate"][scheme]["href"])
    plain = F.regexp_replace(asset["href"], "^s3://([^/]+)/?(.*)$",
                             "https://$1.s3.amazonaws.com/$2")
    return F.coalesce(other("https"), other("http"), blank_to_null(plain))


def tile_label(p: Column) -> Column:
    """Map square for optical scenes; mode, flight direction and orbit for radar."""
    text = lambda name: F.coalesce(p[name], F.lit(""))
    square = F.concat(text("mgrs:utm_zone"), text("mgrs:latitude_band"), text("mgrs:grid_square"))
    orbit = p["sat:relative_orbit"]
    radar = F.concat_ws(
        " ", blank_to_null(p["sar:instrument_mode"]),
        blank_to_null(F.upper(F.substring(p["sat:orbit_state"], 1, 3))),
        F.when(orbit != 0, F.concat(F.lit("#"), orbit.cast("string"))))
    return F.coalesce(blank_to_null(square), radar)


def satellite_of_collection(collection: Column) -> Column:
    """Look-up in the two-entry registry, as a constant map rather than a join."""
    pairs = [F.lit(v) for s in registry.SATELLITES.values() for v in (s["collection"], s["key"])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), collection),
                      F.lit(registry.DEFAULT_SATELLITE))


def scenes_from_items(items: DataFrame, satellite: str | None = None,
                      source: str | None = None) -> DataFrame:
    """Flat scene rows; items without a single readable asset are dropped."""
    p = F.col("properties")
    found = items.withColumn("__assets", F.map_filter(
        F.transform_values("assets", lambda _, a: best_href(a)), lambda _, h: h.isNotNull()))
    found = found.where(F.size("__assets") > 0)
    sat = F.lit(satellite) if satellite else satellite_of_collection(F.col("collection"))
    when = F.coalesce(blank_to_null(p["datetime"]), blank_to_null(p["start_datetime"]), F.lit(""))
    names = [F.lit(v) for s in registry.SATELLITES.values() for v in (s["key"], s["platform"])]
    corner = lambda i: F.get("bbox", F.lit(i))
    out = found.withColumn("satellite", sat).select(
        F.col("id").alias("scene_id"), "satellite",
        F.lit(source or registry.DEFAULT_SOURCE).alias("source"),
        when.alias("datetime_text"),
        F.try_to_timestamp(when).cast("timestamp_ntz").alias("datetime"),
        F.substring(when, 1, 10).try_cast("date").alias("date"),
        half_even(p["eo:cloud_cover"], 1).alias("cloud"),
        F.coalesce(blank_to_null(p["platform"]),
                   F.try_element_at(F.create_map(*names), F.col("satellite"))).alias("platform"),
        tile_label(p).alias("tile"), p["proj:epsg"].alias("epsg"),
        p["sat:relative_orbit"].alias("orbit"), p["sat:orbit_state"].alias("orbit_state"),
        F.coalesce(p["earthsearch:boa_offset_applied"], F.lit(False)).alias("boa_offset_applied"),
        p["view:sun_elevation"].alias("sun_elevation"),
        F.try_element_at(F.col("assets"), F.lit("thumbnail"))["href"].alias("thumbnail"),
        F.col("__assets").alias("assets"),
        corner(0).alias("west"), corner(1).alias("south"), corner(2).alias("east"),
        corner(3).alias("north"))
    return out


def with_asset_links(scenes: DataFrame, bands: list[str], satellite: str) -> DataFrame:
    """``links``: band -> address, names matched without regard to case.

    ``missing`` lists stored bands the scene does not offer; callers decide what to do.
    """
    stored = registry.stored_behind(bands, satellite)
    wanted = F.array(*[F.lit(b) for b in stored])
    lowered = F.map_from_entries(F.array_distinct(F.transform(
        F.map_entries("assets"), lambda e: F.struct(F.lower(e["key"]), e["value"]))))
    exact = F.map_filter("assets", lambda k, _: F.array_contains(wanted, k))
    rest = F.map_filter("__low", lambda k, _: F.array_contains(wanted, k)
                        & ~F.map_contains_key(exact, k))
    out = scenes.withColumn("__low", lowered).withColumn("links", F.map_concat(exact, rest))
    return out.withColumn("missing", F.array_except(wanted, F.map_keys("links"))).drop("__low")


def split_georeferenced(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable raster tiles, and those refused with the reason.

    A tile needs a coordinate system and a transform that is not the identity.
    """
    usable = F.coalesce(F.col("epsg").isNotNull() & ~F.col("identity_transform"), F.lit(False))
    reason = F.when(F.coalesce("control_points", F.lit(0)) > 0,
                    "georeferenced by ground control points").otherwise("no map projection")
    return tiles.where(usable), tiles.where(~usable).withColumn("reason", reason)
