"""Sub-pixel alignment of dates: masked correlation and phase per tile, then a fractional move.

Cells that either date lacks take no part: the whole-cell move is where the normalised
cross-correlation over the cells known in both is highest, worked out for all moves at once from
transforms of values, squares and masks.  The rest, below a cell, comes from the phase of what both
dates know there.  A move that too few common cells support is not determinable.

The only grouped-map function of the library is here: a Fourier transform needs a tile's
pixels together.  Its groups are (frame, lot of scenes, tile): one scene and the reference, or as
many scenes of small tiles as make about :data:`LOT_CELLS` cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .keyed import attach, checked_broadcast
from .quantiles import quantiles
from .resample import kernel
from .stencil import TILE, crop_tiles, pad_tiles

MAX_SHIFT, UPSAMPLE, MIN_LEAD, GUARD = 8.0, 20, 5.0, 4
#: A move counts if this share of the best-covered move's common cells, and so many, support it.
SHARED, LEAST = 0.3, 64
#: Cells of scenes that are matched in one call, if their tiles are that small.
LOT_CELLS = 1 << 14
GUIDE_ORDER = ("red", "green", "blue", "nir", "pan", "vv")


def guide(bands: Sequence[str]) -> Column:
    """Brightness for registration: the mean of the guide bands a cell has."""
    chosen = [b for b in GUIDE_ORDER if b in bands] or list(bands)
    total, n = F.lit(0.0), F.lit(0)
    for b in chosen:
        total = total + F.coalesce(F.col(b), F.lit(0.0))
        n = n + F.col(b).isNotNull().cast("int")
    return F.try_divide(total, n)


# -- one tile, in numpy -------------------------------------------------------


def _fast(n: int) -> int:
    """The next size whose factors are 2, 3 and 5, for which transforms are quick."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


class Match(NamedTuple):
    dy: int
    dx: int
    correlation: float
    cells: int              # common cells of the two pictures at this move


def masked_match(still: np.ndarray, moving: np.ndarray, reach: int = int(MAX_SHIFT) + 1,
                 least: int = LEAST, shared: float = SHARED) -> Match | None:
    """The whole-cell move of ``moving`` with the highest masked correlation, None without one.

    Moves reach ``reach`` cells at most.  Of equal correlations (to 1e-9) the smallest move wins,
    upper and left before lower and right.
    """
    shape = tuple(_fast(n + reach) for n in still.shape)
    known = [np.isfinite(a) for a in (still, moving)]
    if min(k.sum() for k in known) < least:
        return None
    plain = [np.where(k, a - a[k].mean(), 0.0)
             for a, k in zip((still, moving), known, strict=True)]
    one, two = ([np.fft.rfft2(x, shape) for x in (k.astype(float), a, a * a)]
                for a, k in zip(plain, known, strict=True))
    lags = np.ix_(*(np.arange(-reach, reach + 1) % n for n in shape))

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums over the common cells of still(cell) and moving(cell - move), for every move."""
        return np.fft.irfft2(a * np.conj(b), shape)[lags]
    n = np.rint(over(one[0], two[0]))
    with np.errstate(invalid="ignore", divide="ignore"):
        s1, s2 = over(one[1], two[0]), over(one[0], two[1])
        spread1 = over(one[2], two[0]) - s1 * s1 / n
        spread2 = over(one[0], two[2]) - s2 * s2 / n
        floor = [1e-10 * (a * a).sum() for a in plain]
        there = ((n >= max(least, shared * n.max())) & (spread1 > floor[0])
                 & (spread2 > floor[1]))
        score = np.where(there, (over(one[1], two[1]) - s1 * s2 / n)
                         / np.sqrt(spread1 * spread2), -2.0)
    if not there.any():
        return None
    move = np.arange(-reach, reach + 1)
    far = move[:, None] ** 2 + move[None, :] ** 2
    y, x = np.unravel_index(np.argmin(np.where(score >= score.max() - 1e-9, far, far.max() + 1)),
                            far.shape)
    return Match(int(move[y]), int(move[x]), float(score[y, x]), int(n[y, x]))


def _support(known: np.ndarray, radius: int = 4) -> np.ndarray:
    """Weights that fall off towards holes and edges, so that neither is a feature: the cube of
    the known share of the cells around, under a raised cosine."""
    share = known.astype(float)
    for axis, n in enumerate(known.shape):
        total = np.cumsum(np.insert(share, 0, 0.0, axis), axis)
        upper, lower = np.minimum(np.arange(n) + radius + 1, n), np.maximum(
            np.arange(n) - radius, 0)
        share = (total.take(upper, axis) - total.take(lower, axis)) / (2 * radius + 1)
    fade_y, fade_x = (np.hanning(max(n, 2))[:n] for n in known.shape)
    return known * share ** 3 * np.outer(fade_y, fade_x)


def _tapered(body: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted deviations from the weighted mean of the known cells."""
    body = np.where(known, body, 0.0)
    total = weight.sum()
    return (body - (body * weight).sum() / total) * weight if total > 0 else body * 0.0


def _common(still: np.ndarray, moving: np.ndarray, dy: int, dx: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """The parts of both pictures that lie on one another once ``moving`` has gone by the move."""
    h, w = still.shape
    at = (slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
    of = (slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
    return still[at], moving[of]


class Shift(NamedTuple):
    dy: float
    dx: float
    lead: float             # of the phase's peak over its best rival; 0: not determinable


def tile_shift(still: np.ndarray, moving: np.ndarray, cutoff: float,
               match: Match | None = None) -> Shift:
    """The move that brings ``moving`` onto ``still``: the masked match, then the phase of what
    both know there.  Holes are those of both, so they don't move with either picture."""
    match = match or masked_match(still, moving)
    if match is None:
        return Shift(0.0, 0.0, 0.0)
    a, b = _common(still, moving, match.dy, match.dx)
    known = np.isfinite(a) & np.isfinite(b)
    weight = _support(known)
    a, b = _tapered(a, known, weight), _tapered(b, known, weight)
    if not a.any() or not b.any():
        return Shift(0.0, 0.0, 0.0)
    fy, fx = (np.fft.fftfreq(n) for n in a.shape)
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    size = np.abs(cross)
    low_pass = np.exp(-(fy[:, None] ** 2 + fx[None, :] ** 2) / (2.0 * max(cutoff, 1e-3) ** 2))
    phase = np.where(size > 1e-6 * size.max(), cross / (size + 1e-12), 0.0) * low_pass
    surface = np.abs(np.fft.ifft2(phase))
    top = np.unravel_index(np.argmax(surface), surface.shape)

    ring = [np.minimum((np.arange(n) - t) % n, (t - np.arange(n)) % n) <= GUARD
            for n, t in zip(surface.shape, top)]
    rival = np.where(np.outer(*ring), 0.0, surface).max()
    lead = surface[top] / rival if rival > 1e-12 else np.inf

    # Inverse transform evaluated only on a fine lattice around the coarse peak.
    whole = [t - n if t > n // 2 else t for t, n in zip(top, surface.shape)]
    steps = np.arange(int(np.ceil(UPSAMPLE * 1.5)))
    steps = (steps - len(steps) // 2) / UPSAMPLE
    at_y, at_x = whole[0] + steps, whole[1] + steps
    fine = np.abs(np.exp(2j * np.pi * np.outer(at_y, fy)) @ phase
                  @ np.exp(2j * np.pi * np.outer(fx, at_x)))
    i, j = np.unravel_index(np.argmax(fine), fine.shape)
    return Shift(match.dy + float(at_y[i]), match.dx + float(at_x[j]), float(lead))


def tile_shifts(stack: DataFrame, references: DataFrame, value: str = "guide",
                keys: Sequence[str] = ("frame_id",), scene: str = "scene_ord",
                cutoff: float = 0.08, tile: int = 512, least: int = LEAST,
                refine: bool = True) -> DataFrame:
    """Per tile and scene: the whole-cell match against the frame's reference scene
    (``whole_dy``, ``whole_dx``, ``correlation``, ``cells``; NULL where none is determinable) and
    the move refined below a cell (``dy``, ``dx``, ``lead``; NULL unless ``refine``).

    ``references`` has the keys and ``reference`` (a scene).  Scenes of small tiles are dealt into
    lots of about :data:`LOT_CELLS` cells, which share a call and their reference.
    """
    keys = list(keys)
    listed = stack.select(*keys, scene).distinct()
    each = max(LOT_CELLS // (tile * tile), 1)
    lots = (listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.ceil(F.col("n") / each).alias("__lots")))
    lot = F.col(scene) if each == 1 else F.pmod(F.xxhash64(F.col(scene)), F.col("__lots"))
    references = references.select(*keys, "reference").join(lots, keys)
    px = attach(stack.select(*keys, scene, "row", "col", F.col(value).cast("double").alias("v")),
                references, keys, how="inner")
    px = px.withColumns({"ty": F.floor(F.col("row") / tile).cast("int"),
                         "tx": F.floor(F.col("col") / tile).cast("int")})
    # The reference image goes to every lot of other dates of its frame, so that each (lot, tile)
    # group holds exactly the pieces it compares.
    others = checked_broadcast(listed.join(references, keys).where(
        F.col(scene) != F.col("reference")).select(*keys, scene, lot.alias("lot")))
    moving = px.where(F.col(scene) != F.col("reference")).withColumns(
        {"lot": lot, "still": F.lit(False)})
    first = px.where(F.col(scene) == F.col("reference"))
    still = first.join(others.drop(scene).distinct(), keys).withColumn("still", F.lit(True))
    # Every other date is compared on all of the reference's tiles, those it lacks included.
    asked = first.select(*keys, "ty", "tx").distinct().join(others, keys).withColumns({
        "row": F.col("ty") * tile, "col": F.col("tx") * tile, "still": F.lit(False)})
    both = moving.unionByName(still, allowMissingColumns=True).unionByName(
        asked, allowMissingColumns=True).select(
        *keys, scene, "lot", "ty", "tx", "row", "col", "v", "still")

    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    ids = [*keys, scene, "ty", "tx"]
    found = ("whole_dy int, whole_dx int, correlation double, cells int, "
             "dy double, dx double, lead double")
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ids) + ", " + found
    names = [*ids, *(part.split()[0] for part in found.split(", "))]

    def estimate(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *frame, _, ty, tx = key
        r = pdf["row"].to_numpy() - ty * tile
        c = pdf["col"].to_numpy() - tx * tile
        v, of = pdf["v"].to_numpy(dtype=float), pdf[scene].to_numpy()
        first = pdf["still"].to_numpy()
        moving = np.flatnonzero(~first)
        scenes, place = np.unique(of[moving], return_inverse=True)
        owned = np.split(moving[np.argsort(place, kind="stable")],
                         np.cumsum(np.bincount(place, minlength=len(scenes)))[:-1])
        first = np.flatnonzero(first)
        rows = []
        for found, own in zip(scenes, owned):
            used = np.concatenate([first, own])
            grids = np.full((2, r[used].max() + 1, c[used].max() + 1), np.nan)
            grids[1, r[first], c[first]] = v[first]
            there = own[~np.isnan(v[own])]
            grids[0, r[there], c[there]] = v[there]
            match = masked_match(grids[1], grids[0], least=least)
            shift = [None] * 3 if not refine else Shift(0.0, 0.0, 0.0) if match is None else \
                tile_shift(grids[1], grids[0], cutoff, match)
            rows.append([*frame, found, ty, tx, *(match or [None] * 4), *shift])
        return pd.DataFrame(rows, columns=names)

    return both.groupBy(*keys, "lot", "ty", "tx").applyInPandas(estimate, schema)


def estimate_shifts(stack: DataFrame, references: DataFrame, value: str = "guide",
                    keys: Sequence[str] = ("frame_id",), scene: str = "scene_ord",
                    cutoff: float = 0.08, tile: int = 512, least: int = LEAST) -> DataFrame:
    """Shift of every scene against its frame's reference scene.

    Each tile gives its own estimate; a scene's shift is the median of the tiles whose phase peak
    stands clear and lies within :data:`MAX_SHIFT`.  ``tiles`` counts them; without any the move is
    0 and ``determined`` is false.
    """
    keys = list(keys)
    clear = ((F.col("lead") >= MIN_LEAD) & ~F.isnan("dy") & ~F.isnan("dx")
             & (F.greatest(F.abs("dy"), F.abs("dx")) <= MAX_SHIFT))
    agreed = lambda c: F.coalesce(F.median(F.when(clear, F.col(c))), F.lit(0.0)).alias(c)
    n = F.count(F.when(clear, 1))
    return tile_shifts(stack, references, value, keys, scene, cutoff, tile, least).groupBy(
        *keys, scene).agg(agreed("dy"), agreed("dx"), n.cast("int").alias("tiles"),
                          (n > 0).alias("determined"))


def align(stack: DataFrame, shifts: DataFrame, bands: Sequence[str],
          keys: Sequence[str] = ("frame_id",), scene: str = "scene_ord",
          frames: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Move every scene by its shift: cubic for values, linear for what is missing.

    Holes enter at the scene's median; a cell with more than 0.35 of a hole in it is NULL, and
    so is one whose source lies outside the frame.  Scenes without a shift stay put: their rows
    come back as they are, and cells they leave out stay out.
    ``frames`` (keys, scene, height, width) is needed when ``stack`` leaves cells out.
    """
    image, bands = [*keys, scene], list(bands)
    still = F.greatest(F.abs("dy"), F.abs("dx")) < 1e-4
    moves = checked_broadcast(shifts.where(~still).select(
        *image, F.col("dy").alias("__dy"), F.col("dx").alias("__dx")))
    stack = stack.select(*image, "height", "width", "row", "col", *bands)
    stay = stack.join(moves, image, "left_anti")
    px = stack.join(moves, image)
    if frames is not None:
        frames = frames.join(moves.select(*image), image)
    middles = quantiles(px, image, bands, [0.5])
    middles = moves.join(middles, image, "left").select(
        *image, *[F.get(f"{b}_q", F.lit(0)).alias(b) for b in bands], "__dy", "__dx")
    wide = pad_tiles(px, image, [*bands, "__dy", "__dx"], 2, tile, "nearest", frames, middles,
                     offsets=(F.ceil("__dy"), F.ceil("__dx")))
    wide = wide.withColumns({f"__h_{b}": (~F.col(f"{b}_ok")).cast("double") for b in bands})
    for axis, d in (("row", "__dy"), ("col", "__dx")):
        wide = _moved(wide, image, bands, axis, F.ceil(d) - F.col(d))
    outside = F.lit(False)
    for axis, size, d in (("row", "height", "__dy"), ("col", "width", "__dx")):
        source = F.col(axis) - F.col(d)
        outside = outside | (source < 0) | (source > F.col(size) - 1)
    wide = wide.withColumns({b: F.when(~outside & (F.col(f"__h_{b}") <= 0.35), F.col(b))
                             for b in bands})
    return crop_tiles(wide).select(stay.columns).unionByName(stay)


def _moved(wide: DataFrame, image: list[str], bands: list[str], axis: str,
           part: Column) -> DataFrame:
    """Interpolate along one axis at the fraction ``part`` past each cell."""
    from .stencil import _across, _down, _tap
    window = _down(image) if axis == "row" else _across(image)
    wide = wide.withColumn("__t", part)
    weights = {f"__k{j}": kernel(F.col("__t") - float(j), "cubic") for j in (-1, 0, 1, 2)}
    wide = wide.withColumns(weights)
    new = {}
    for b in bands:
        new[b] = sum((_tap(F.col(b), j, window) * F.col(f"__k{j}") for j in (-1, 1, 2)),
                     F.col(b) * F.col("__k0"))
        # Two windows of context are missing only beyond the halo, where rows are dropped.
        new[f"__h_{b}"] = (F.col(f"__h_{b}") * (1.0 - F.col("__t"))
                           + _tap(F.col(f"__h_{b}"), 1, window) * F.col("__t"))
    return wide.withColumns(new).drop("__t", *weights)
