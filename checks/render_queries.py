"""Stretches, tone curves, colour maps and enhancements over the composited stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitlake import registry
from orbitlake.functions import tone
from orbitlake.operators import enhance, merge, render
from orbitlake.operators.stencil import sized

from . import views
from .pixel_queries import (_MIRROR, median_ndvi, merged, optical, r6, radar, refl_cte, radar_cte,
                            rounded)

QUERIES: dict = {}
ORACLES: dict = {}
CELL = ["frame_id", "row", "col"]


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


TRIO = ("red", "green", "blue")


def comp_cte(bands) -> str:
    return refl_cte(bands, clouds=True) + ', comp AS (SELECT frame_id, "row", col, ' + ", ".join(
        f"median({b}) AS {b}" for b in bands) + ' FROM px GROUP BY frame_id, "row", col)\n'


def _stretch_sql(lo: str, hi: str, band: str, ceiling: float) -> str:
    return (f"coalesce(least(greatest(({band} - {lo}) / ({hi} - {lo}), 0e0), "
            f"{ceiling}::DOUBLE), 0e0)")


def _bounds_query(preset: str, mode: str, cte: str, bands):
    def run(spark, sf_dir):
        plan = render.stretch_plan(preset, {"stretch": mode})
        return render.bounds_report(merged(spark, sf_dir, tuple(dict.fromkeys(bands))), plan,
                                    digits=8)
    oracle = comp_cte(tuple(dict.fromkeys(bands))) + cte + " UNION ALL ".join(
        f"SELECT frame_id, CAST({i} AS INT) AS channel, '{b}' AS band, {r6(f'lo_{i}', 8)} AS lo, "
        f"{r6(f'hi_{i}', 8)} AS hi FROM bd" for i, b in enumerate(bands))
    return run, oracle


def _register_bounds() -> None:
    per = lambda f: ", ".join(f.format(b=b, i=i) for i, b in enumerate(TRIO))
    specs = {
        "stretch_minmax": ("true_color", "minmax", ", bd AS (SELECT frame_id, " + per(
            "min({b}) AS lo_{i}, max({b}) AS hi_{i}") + " FROM comp GROUP BY 1)\n", TRIO),
        "stretch_percentile": ("true_color", "percentile", ", bd AS (SELECT frame_id, " + per(
            "quantile_cont({b}, 0.02::DOUBLE) AS lo_{i}, quantile_cont({b}, 0.98::DOUBLE) AS hi_{i}")
            + " FROM comp GROUP BY 1)\n", TRIO),
    }
    linked = ("swir22", "swir16", "red")
    pool = " UNION ALL ".join(f"SELECT frame_id, {b} AS v FROM comp" for b in linked)
    specs["stretch_linked"] = (
        "urban", "percentile_linked", f", pool AS ({pool}), q AS (SELECT frame_id, "
        "quantile_cont(v, 0.02::DOUBLE) AS lo, quantile_cont(v, 0.98::DOUBLE) AS hi FROM pool GROUP BY 1), "
        "bd AS (SELECT frame_id, lo AS lo_0, hi AS hi_0, lo AS lo_1, hi AS hi_1, lo AS lo_2, "
        "hi AS hi_2 FROM q)\n", linked)
    for name, (preset, mode, cte, bands) in specs.items():
        QUERIES[name], ORACLES[name] = _bounds_query(preset, mode, cte, bands)


_register_bounds()


@query(comp_cte(("red",)) + f"""
SELECT frame_id, "row", col, {r6(_stretch_sql('0e0', '0.3e0', 'red', 2.2))} AS red FROM comp""")
def stretch_fixed(spark, sf_dir):
    px = merged(spark, sf_dir, ("red",))
    return rounded(px.withColumn("red", render.stretch(F.col("red"), F.lit(0.0), F.lit(0.3), 2.2)),
                   ["red"])


def tone_sql(gamma: float, knee: float = 0.72) -> str:
    """CTE from ``st`` (c0..c2 stretched) to ``tn`` (t0..t2 toned)."""
    span = 1.0 - knee
    curved = (f"CASE WHEN peak <= {knee}::DOUBLE THEN peak ELSE {knee}::DOUBLE + {span!r}::DOUBLE * "
              f"(1e0 - exp(-(peak - {knee}::DOUBLE) / {span!r}::DOUBLE)) END")
    curved = f"least(greatest({curved}, 0e0), 1e0)"
    if abs(gamma - 1.0) >= 1e-3:
        curved = f"pow({curved}, {1.0 / gamma!r}::DOUBLE)"
    toned = ", ".join(f"least(greatest(c{i} * f, 0e0), 1e0) AS t{i}" for i in range(3))
    return f""", pk AS (SELECT *, greatest(c0, c1, c2) AS peak FROM st),
fc AS (SELECT *, {curved} / greatest(peak, 1e-6::DOUBLE) AS f FROM pk),
tn AS (SELECT *, {toned} FROM fc)
"""


def rgb_sql(bands) -> str:
    ok = " AND ".join(f"{b} IS NOT NULL" for b in dict.fromkeys(bands))
    return ", ".join(f"CAST(round_even(t{i} * 255, 0) AS INT) AS {c}"
                     for i, c in enumerate("rgb")) + f", {ok} AS valid"


def true_color_cte() -> str:
    st = ", ".join(_stretch_sql("0e0", "0.3e0", b, 2.2) + f" AS c{i}"
                   for i, b in enumerate(TRIO))
    return (comp_cte(TRIO) + f", st AS (SELECT *, {st} FROM comp)\n" + tone_sql(1.15) +
            f', pic AS (SELECT frame_id, "row", col, {rgb_sql(TRIO)} FROM tn)\n')


@query(comp_cte(TRIO) + ", st AS (SELECT *, " + ", ".join(
    _stretch_sql("0e0", "0.3e0", b, 2.2) + f" AS c{i}" for i, b in enumerate(TRIO)) +
    " FROM comp)\n" + tone_sql(1.15) + f"""
SELECT frame_id, "row", col, {r6('t0')} AS r, {r6('t1')} AS g, {r6('t2')} AS b FROM tn""")
def tone_map(spark, sf_dir):
    px = merged(spark, sf_dir, TRIO)
    cs = [render.stretch(F.col(b), F.lit(0.0), F.lit(0.3), 2.2) for b in TRIO]
    px = px.withColumns({f"c{i}": c for i, c in enumerate(cs)})
    px, toned = render.tone_mapped(px, ["c0", "c1", "c2"], 1.15, 0.72)
    return rounded(px.select(*CELL, *[t.alias(n) for t, n in zip(toned, "rgb")]), list("rgb"))


@query(true_color_cte() + 'SELECT *, CASE WHEN valid THEN 255 ELSE 0 END AS a FROM pic')
def true_color(spark, sf_dir):
    return render.with_alpha(true_color_picture(spark, sf_dir))


def true_color_picture(spark, sf_dir):
    return render.render_composite(merged(spark, sf_dir, TRIO), render.stretch_plan("true_color"))


_FALSE = ("vv", "vh", "vvvh")
#: Decibels taken off the uncalibrated amplitudes, which brings them into the preset's windows.
_CALIBRATION = 58.0
_RADAR_ST = ", ".join(
    _stretch_sql(f"{lo}::DOUBLE", f"{hi}::DOUBLE", f"pow(10e0, {b} / 10e0)", 2.2) + f" AS c{i}"
    for i, (b, (lo, hi)) in enumerate(zip(_FALSE, ((0.0, 0.35), (0.0, 0.08), (1.0, 8.0)))))


@query(radar_cte() + f""", cells AS (SELECT * FROM px WHERE vv IS NOT NULL AND vh IS NOT NULL),
taps AS (SELECT c.frame_id, c.scene_ord, c."row", c.col, {_MIRROR.format(i='c."row" + a.k', n=views.HEIGHT)} AS r2,
                {_MIRROR.format(i='c.col + b.k', n=views.WIDTH)} AS c2
         FROM cells c, (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b),
look AS (SELECT t.frame_id, t.scene_ord, t."row", t.col, avg(p.vv - p.vh) AS vvvh FROM taps t JOIN px p
         ON p.frame_id = t.frame_id AND p.scene_ord = t.scene_ord AND p."row" = t.r2 AND p.col = t.c2 GROUP BY ALL),
every AS (SELECT px.*, look.vvvh FROM px LEFT JOIN look USING (frame_id, scene_ord, "row", col)),
comp AS (SELECT frame_id, "row", col, avg(vv - {_CALIBRATION}e0) AS vv, avg(vh - {_CALIBRATION}e0) AS vh, avg(vvvh) AS vvvh FROM every GROUP BY ALL),
st AS (SELECT *, {_RADAR_ST} FROM comp)
""" + tone_sql(float(registry.COMPOSITES["radar_color"][3].get("gamma", 1.0))) +
       f'SELECT frame_id, "row", col, {rgb_sql(_FALSE)} FROM tn')
def radar_color(spark, sf_dir):
    """The preset as it is: both polarisations and their multi-looked ratio, back to power."""
    from orbitlake.operators import units
    looked = units.multilook_ratio(radar(spark, sf_dir), ["frame_id", "scene_ord"],
                                   frames=views.images(spark, sf_dir), tile=64)
    looked = looked.withColumns({b: F.col(b) - _CALIBRATION for b in ("vv", "vh")})
    stored = views.obs(spark, sf_dir).select("frame_id", "scene_ord", "row", "col")
    px = stored.join(looked, ["frame_id", "scene_ord", "row", "col"], "left")
    return render.render_composite(merge.composite(px, list(_FALSE), "mean"),
                                   render.stretch_plan("radar_color"))


def _lut_sql(cmap: str) -> str:
    """The colour table of ``cmap`` as a CTE, interpolated in SQL from its control points."""
    points = registry.COLORMAPS[cmap]
    segs = []
    for (p, *c), (q, *d) in zip(points, points[1:]):
        lo, hi = f"CAST({p}::FLOAT AS DOUBLE)", f"CAST({q}::FLOAT AS DOUBLE)"
        for_channel = [f"{a}e0 + ({b - a}e0 / ({hi} - {lo})) * (t - {lo})" for a, b in zip(c, d)]
        segs.append((hi, for_channel))
    cols = []
    for k, name in enumerate("rgb"):
        cases = " ".join(f"WHEN t < {hi} THEN {exprs[k]}" for hi, exprs in segs)
        cols.append(f"CAST(floor(CASE {cases} ELSE {points[-1][k + 1]}e0 END) AS INT) AS {name}")
    return (", lut AS (SELECT idx, " + ", ".join(cols) + " FROM (SELECT CAST(i AS INT) AS idx, "
            "CAST(CAST(i / 255e0 AS FLOAT) AS DOUBLE) AS t FROM range(256) x(i)))\n")


@query(comp_cte(("nir", "red")) + _lut_sql("ndvi") + """
, ix AS (SELECT frame_id, "row", col, (nir - red) / nullif(nir + red, 0) AS ndvi FROM comp),
n AS (SELECT *, CAST(round_even(least(greatest((coalesce(ndvi, -0.2e0) - -0.2e0) / (0.9e0 - -0.2e0), 0e0), 1e0) * 255e0, 0) AS INT) AS idx FROM ix)
SELECT frame_id, "row", col, r, g, b, ndvi IS NOT NULL AS valid FROM n JOIN lut USING (idx)""")
def ndvi_colored(spark, sf_dir):
    px = median_ndvi(spark, sf_dir).select(*CELL, "ndvi")
    return render.render_index(px, "ndvi").drop("ndvi")


_HAZE = ("red", "blue")


@query(comp_cte(_HAZE) + ", fl AS (SELECT frame_id, " + ", ".join(
    f"quantile_cont({b}, 0.01::DOUBLE) AS f_{b}" for b in _HAZE) + " FROM comp GROUP BY 1)\n"
    'SELECT frame_id, "row", col, ' + ", ".join(
    r6(f"CASE WHEN {b} IS NOT NULL THEN greatest({b} - f_{b} * 0.8e0 * 0.98e0, 0e0) END") +
    f" AS {b}" for b in _HAZE) + " FROM comp JOIN fl USING (frame_id)")
def haze(spark, sf_dir):
    px = merged(spark, sf_dir, _HAZE)
    return rounded(enhance.dark_object_subtraction(px, _HAZE, strength=0.8), _HAZE)


def unit_picture(spark, sf_dir):
    """The true-colour picture as 0..1 channels, as the later corrections take it."""
    pic = true_color_picture(spark, sf_dir)
    return sized(pic.withColumns({c: F.col(c) / 255.0 for c in "rgb"}), views.HEIGHT, views.WIDTH)


UNIT = true_color_cte() + (', u AS (SELECT frame_id, "row", col, valid, r / 255e0 AS r, '
                           "g / 255e0 AS g, b / 255e0 AS b FROM pic)\n")


@query(UNIT + """
, m AS (SELECT frame_id, sum(r) / """ + f"{views.HEIGHT * views.WIDTH}e0" + """ AS mr, sum(g) / """ + f"{views.HEIGHT * views.WIDTH}e0" + """ AS mg, sum(b) / """ + f"{views.HEIGHT * views.WIDTH}e0" + """ AS mb FROM u GROUP BY 1),
t AS (SELECT *, (mr + mg + mb) / 3e0 AS t FROM m)
SELECT frame_id, "row", col, valid, """ + ", ".join(r6(
    f"least(greatest({c} * (1e0 + (CASE WHEN m{c} > 1e-5::DOUBLE THEN t / m{c} ELSE 1e0 END - 1e0) * 0.6e0), 0e0), 1e0)")
    + f" AS {c}" for c in "rgb") + " FROM u JOIN t USING (frame_id)")
def white_balance(spark, sf_dir):
    out = enhance.white_balance(unit_picture(spark, sf_dir), strength=0.6)
    return rounded(out.drop("height", "width"), list("rgb"))


@query(UNIT + """
, l AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS y FROM u),
w AS (SELECT *, 1e0 + 0.45e0 * (1e0 - least(greatest(greatest(abs(r - y), abs(g - y), abs(b - y)) * 2e0, 0e0), 1e0)) AS k FROM l)
SELECT frame_id, "row", col, valid, """ + ", ".join(
    r6(f"least(greatest(y + ({c} - y) * k, 0e0), 1e0)") + f" AS {c}" for c in "rgb") + " FROM w")
def vibrance(spark, sf_dir):
    px = unit_picture(spark, sf_dir).drop("height", "width")
    return rounded(enhance.vibrance(px, 0.45), list("rgb"))


def _clahe_sql(tiles: int = 8, clip_limit: float = 2.0) -> str:
    h, w = views.HEIGHT, views.WIDTH
    assert h % tiles == 0 and w % tiles == 0
    sh, sw = h // tiles, w // tiles

    def fraction(at: str, step: int) -> str:
        return f"least(greatest(({at} - {step / 2!r}::DOUBLE) / {step}e0, 0e0), {tiles - 1}e0)"
    return f"""
, l AS (SELECT *, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS y FROM u),
q AS (SELECT *, CAST(floor(least(greatest(y * 255e0, 0e0), 255e0)) AS INT) AS q, "row" // {sh} AS ty, col // {sw} AS tx FROM l),
h AS (SELECT frame_id, ty, tx, q, count(*) AS h FROM q GROUP BY ALL),
sl AS (SELECT f.frame_id, a.i AS ty, b.i AS tx, c.i AS q FROM (SELECT DISTINCT frame_id FROM h) f, range({tiles}) a(i), range({tiles}) b(i), range(256) c(i)),
fp AS (SELECT sl.*, coalesce(h.h, 0) AS h FROM sl LEFT JOIN h USING (frame_id, ty, tx, q)),
fu AS (SELECT * REPLACE (h + CASE WHEN q = 0 THEN {sh * sw} - sum(h) OVER (PARTITION BY frame_id, ty, tx) ELSE 0 END AS h) FROM fp),
li AS (SELECT *, sum(h) OVER t AS n, greatest({clip_limit!r}::DOUBLE * sum(h) OVER t / 256e0, 1e0) AS lim FROM fu WINDOW t AS (PARTITION BY frame_id, ty, tx)),
ex AS (SELECT *, sum(greatest(h - lim, 0e0)) OVER (PARTITION BY frame_id, ty, tx) AS ex FROM li),
cu AS (SELECT *, sum(least(CAST(h AS DOUBLE), lim) + ex / 256e0) OVER (PARTITION BY frame_id, ty, tx ORDER BY q) AS c FROM ex),
ma AS (SELECT frame_id, ty, tx, q, CASE WHEN n > 0 THEN (c - min(c) OVER t) / greatest(max(c) OVER t - min(c) OVER t, 1e-6::DOUBLE) ELSE q / 255e0 END AS m FROM cu WINDOW t AS (PARTITION BY frame_id, ty, tx)),
po AS (SELECT frame_id, "row", col, r, g, b, valid, y, q, {fraction('"row"', sh)} AS fy, {fraction('col', sw)} AS fx FROM q),
nb AS (SELECT *, CAST(floor(fy) AS INT) AS y0, CAST(floor(fx) AS INT) AS x0, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM po),
eq AS (SELECT nb.*, least(greatest((a.m * (1 - wx) + b2.m * wx) * (1 - wy) + (c.m * (1 - wx) + d.m * wx) * wy, 0e0), 1e0) AS e
  FROM nb LEFT JOIN ma a ON a.frame_id = nb.frame_id AND a.ty = y0 AND a.tx = x0 AND a.q = nb.q
  LEFT JOIN ma b2 ON b2.frame_id = nb.frame_id AND b2.ty = y0 AND b2.tx = least(x0 + 1, {tiles - 1}) AND b2.q = nb.q
  LEFT JOIN ma c ON c.frame_id = nb.frame_id AND c.ty = least(y0 + 1, {tiles - 1}) AND c.tx = x0 AND c.q = nb.q
  LEFT JOIN ma d ON d.frame_id = nb.frame_id AND d.ty = least(y0 + 1, {tiles - 1}) AND d.tx = least(x0 + 1, {tiles - 1}) AND d.q = nb.q),
gn AS (SELECT *, coalesce(CASE WHEN y > 1e-4::DOUBLE THEN (y * 0.25e0 + e * 0.75e0) / y END, 1e0) AS gain FROM eq)
"""


@query(UNIT + _clahe_sql() + 'SELECT frame_id, "row", col, valid, ' + ", ".join(
    r6(f"least(greatest({c} * gain, 0e0), 1e0)") + f" AS {c}" for c in "rgb") + " FROM gn")
def clahe(spark, sf_dir):
    out = enhance.clahe_rgb(unit_picture(spark, sf_dir), clip_limit=2.0, tiles=8, strength=0.75)
    return rounded(out.drop("height", "width"), list("rgb"))


@query(true_color_cte() + """
, v AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pic),
s AS (SELECT *, CASE WHEN hi = 0 THEN 0e0 ELSE (hi - lo) / CAST(hi AS DOUBLE) END AS sat,
  least(greatest((hi / 255e0 - (0.62e0 - 0.42e0 * 0.42e0)) / 0.26e0, 0e0), 1e0) AS tb FROM v),
k AS (SELECT *, least(greatest((sat - 0.2e0) / 0.3e0, 0e0), 1e0) AS tc FROM s),
c AS (SELECT *, tb * tb * (3 - 2 * tb) * (1 - tc * tc * (3 - 2 * tc)) AS cloudiness FROM k)
""" + f'SELECT frame_id, "row", col, {r6("cloudiness")} AS cloudiness, '
      "CAST(floor(255e0 * cloudiness + 0.5e0) AS INT) AS alpha FROM c")
def cloudiness(spark, sf_dir):
    pic = true_color_picture(spark, sf_dir)
    rgb = [F.col(c) for c in "rgb"]
    return rounded(pic.select(*CELL, tone.cloudiness(*rgb, 0.42).alias("cloudiness"),
                              tone.cloud_alpha(*rgb, 0.42).alias("alpha")), ["cloudiness"])


@query(true_color_cte() + views.with_views("obs_scenes").replace("WITH ", ", ", 1)
       .replace("obs_scenes AS", "sc AS", 1) + """
, day AS (SELECT frame_id, scene_date AS day FROM sc),
al AS (SELECT frame_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS clear FROM pic GROUP BY 1)
SELECT DISTINCT d.frame_id, d.day AS date, a.clear + lag AS clear FROM day d JOIN day e USING (frame_id) JOIN al a USING (frame_id), (SELECT unnest([0, 15, 30]) AS lag) k
WHERE e.day + CAST(lag AS INT) = d.day""")
def cloud_days(spark, sf_dir):
    """Scenes matched, by date, with a daily cloud layer that has days of its own."""
    from orbitlake.operators.clouds import match_layer
    scenes = views.obs_scenes(spark, sf_dir).select("frame_id", F.col("scene_date").alias("date"))
    clear = true_color_picture(spark, sf_dir).groupBy("frame_id").agg(
        F.sum(F.col("valid").cast("int")).alias("clear"))
    lag = F.explode(F.array(*[F.lit(n) for n in (0, 15, 30)])).alias("lag")
    layer = (scenes.select("frame_id", "date", lag).join(clear, "frame_id")
             .select("frame_id", F.date_add("date", F.col("lag")).alias("date"),
                     (F.col("clear") + F.col("lag")).alias("clear")).distinct())
    return match_layer(scenes, layer, ["frame_id"])


@query(comp_cte(("nir", "red")) + _lut_sql("ndvi") + """
, ix AS (SELECT frame_id, (nir - red) / nullif(nir + red, 0) AS ndvi FROM comp),
n AS (SELECT *, CAST(round_even(least(greatest((ndvi - -0.2e0) / (0.9e0 - -0.2e0), 0e0), 1e0) * 255e0, 0) AS INT) AS idx FROM ix WHERE ndvi IS NOT NULL)
SELECT frame_id, printf('#%02x%02x%02x', r, g, b) AS colour, count(*) AS cells FROM n JOIN lut USING (idx) GROUP BY ALL""")
def colour_counts(spark, sf_dir):
    """Cells of each colour of an index picture, looked up in the colour table by a join."""
    from orbitlake.functions.numeric import hex_colour
    px = median_ndvi(spark, sf_dir).where("ndvi is not null")
    look = render.IndexLook.of("ndvi")
    at = render.colour_index((F.col("ndvi") - look.low) / (look.high - look.low))
    table = render.colormap_table(spark, look.colormap)
    # At most 256 rows a frame meet the table, and only they are spelt out.
    counted = px.groupBy("frame_id", at.alias("idx")).agg(F.count(F.lit(1)).alias("cells"))
    return (counted.join(table, "idx")
            .groupBy("frame_id", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))
            .agg(F.sum("cells").alias("cells")))
