"""Hard negatives from shared lists: rows of other labels nearly as close as an anchor's positives.

Components become integers, floor(256 * x); scores are exact inner products.  Anchors are the rows
whose vec_id is divisible by EVERY.  An anchor's positives are its best POSITIVES other rows of the
same label; for each, the best NEGATIVES rows of other labels are wanted whose score lies between
LOW and HIGH percent of the positive's.

Anchors of one label are clustered by direction in tasks of bounded size.  The rows are dealt into
blocks, whatever their keys; anchors are broadcast, BROADCAST bytes at a time, and meet every block
where it lies.  For a cluster with centre c and widest angle w, a row x has the bound
|x| cos(max(0, angle(x, c) - w)) for the product with any member's direction.  A block's rows are
sorted by it once for the cluster, and every member walks that list, scoring exactly, until the
bound times its length is below its k-th best score, or below the lowest score that counts: no
later row can then enter, ties included.  Two walks are made, for the positives and, once they are
known from all blocks, for the negatives; each block returns what k rows at most.

Rows with a null vec_id, a null label, a null vector, or any null or non-finite component take no
part.  Vectors of different lengths are not compared; empty ones have score 0 with each other.
Rows with the anchor's vec_id are neither its positives nor its negatives.  Repeated rows count
each as positive or negative; equal rows with one vec_id are one anchor, unequal ones an anchor
each.  Scores beyond 64 bits are ordered exactly and returned as the nearest long.  Other columns
don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitlake.llm import shared, vectors as v

#: Which rows are anchors; positives of an anchor; negatives of a positive; per cent of its score.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
#: Anchors clustered in one task at most (about); rounds of the clustering; rows of a first step.
TOGETHER, ROUNDS, STEP = 2048, 8, 256


def _clusters(x: np.ndarray) -> np.ndarray:
    """The cluster of each row, about a root of their number of them, by direction."""
    length = np.linalg.norm(x, axis=1)
    unit = x / np.where(length > 0, length, 1)[:, None]
    k = max(1, int(np.sqrt(len(x))))
    centres = unit[np.linspace(0, len(x) - 1, k).astype(int)]
    own = np.zeros(len(x), int)
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return own


def _clustered(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "print"], ignore_index=True)
    x = np.stack(rows["x"].to_numpy()).astype(np.float64).reshape(len(rows), -1)
    return rows.assign(cluster=_clusters(x / max(1.0, np.abs(x).max(initial=0))))


class Cluster:
    """Members of one cluster: ids, prints, whole vectors, and how they bound other rows."""

    def __init__(self, ids: np.ndarray, prints: np.ndarray, label: int, q: np.ndarray,
                 limits: list | None = None):
        self.ids, self.prints, self.label, self.q = ids, prints, label, q
        self.limits = limits
        self.unit, self.length = directions(q)
        centre = self.unit.sum(0)
        size = np.linalg.norm(centre)
        self.centre = centre / size if size > 1e-9 else centre * 0
        self.wide = angles(self.unit, self.centre).max(initial=0)

    def order(self, unit: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by falling bound, and the bounds; a little is added for rounding."""
        angle = np.maximum(angles(unit, self.centre) - self.wide - 1e-6, 0)
        bound = length * np.cos(angle)
        bound += 1e-9 * length
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def directions(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; where Python integers leave no float, lengths without bound."""
    try:
        x = q.astype(np.float64)
    except OverflowError:
        return np.zeros(q.shape), np.full(len(q), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(x, axis=1)
        unit = x / np.where((length > 0) & np.isfinite(length), length, 1)[:, None]
    unit[~np.isfinite(length)] = 0
    return unit, length


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1, 1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best entries of each row of a masked array, ties to small ids."""
    there = ~np.ma.getmaskarray(scores)
    data = scores.data
    if data.dtype != object and data.shape[1] > k:
        low = np.where(there, data, np.iinfo(np.int64).min)
        there &= low >= -np.partition(-low, k - 1, 1)[:, k - 1:k]
    row, at = np.nonzero(there)
    found, own = data[row, at], ids[row, at] if ids.ndim == 2 else ids[at]
    if data.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -found[i], own[i])), int)
    else:
        order = np.lexsort((own, -found, row))
    row, own, found = row[order], own[order], found[order]
    head = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(
        np.where(head, np.arange(len(row)), 0)) if len(row) else row
    keep = place < k
    return row[keep], own[keep], found[keep]


class Lists:
    """The k best (id, score) of several askers so far."""

    def __init__(self, askers: int, k: int, dtype):
        self.k = k
        self.ids = np.zeros((askers, k), np.int64)
        self.scores = np.ma.masked_all((askers, k), dtype)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        dtype = object if object in (scores.data.dtype, self.scores.data.dtype) else np.int64
        every = np.ma.concatenate([self.scores[who].astype(dtype), scores.astype(dtype)], axis=1)
        own = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        row, found_ids, found = best(every, own, self.k)
        if dtype != self.scores.data.dtype:
            self.scores = self.scores.astype(dtype)
        self.scores[who] = np.ma.masked
        head = np.searchsorted(row, np.arange(len(who)))
        place = np.arange(len(row)) - head[row]
        self.ids[who[row], place] = found_ids
        self.scores[who[row], place] = found

    def threshold(self) -> np.ndarray:
        """The k-th best score of each asker as a float, minus infinity while there are fewer."""
        last = self.scores[:, self.k - 1]
        out = np.full(len(last), -np.inf)
        there = ~np.ma.getmaskarray(last)
        out[there] = [float(x) if abs(x) < 1 << 1000 else -np.inf for x in last.data[there]]
        return out


def walk(cluster: Cluster, ids: np.ndarray, labels: np.ndarray, q: np.ndarray,
         unit: np.ndarray, length: np.ndarray) -> tuple[Lists, np.ndarray, np.ndarray]:
    """Every member's walk along the cluster's list of these rows.

    Without limits, members ask for positives; with them, each (member, low, high) is an asker for
    negatives.  Returns the lists, the askers' members and how many rows were scored.
    """
    same = labels == cluster.label
    rows = np.flatnonzero(same if cluster.limits is None else ~same)
    if cluster.limits is None:
        member = np.arange(len(cluster.ids))
        low = np.full(len(member), -np.inf)
        lists = Lists(len(member), POSITIVES, np.int64)
    else:
        member = np.array([m for m, _, _, _ in cluster.limits], int)
        low = np.array([float(a) if abs(a) < 1 << 1000 else -np.inf
                        for _, _, a, _ in cluster.limits])
        lows = np.array([a for _, _, a, _ in cluster.limits], object)[:, None]
        highs = np.array([b for _, _, _, b in cluster.limits], object)[:, None]
        if max((abs(x) for x in (*lows.flat, *highs.flat)), default=0) < 1 << 62:
            lows, highs = lows.astype(np.int64), highs.astype(np.int64)
        lists = Lists(len(member), NEGATIVES, np.int64)
    order, bound = cluster.order(unit[rows], length[rows])
    rows = rows[order]
    at, step, scored = 0, STEP, 0
    going = np.arange(len(member))
    while at < len(rows) and len(going):
        # rounding can't make a bound too small: one part in 10^9 and one unit are added
        with np.errstate(invalid="ignore"):
            reach = bound[at] * cluster.length[member[going]]
        reach = np.where(np.isnan(reach), np.inf, reach)
        reach = reach + np.abs(reach) * 1e-9 + 1
        need = np.maximum(lists.threshold()[going], low[going])
        going = going[reach >= need]
        if not len(going):
            break
        some = rows[at:at + step]
        asked, own = np.unique(member[going], return_inverse=True)
        found = v.products(cluster.q[asked], q[some])[own]
        scored += found.size
        hidden = cluster.ids[member[going]][:, None] == ids[some][None, :]
        if cluster.limits is not None:
            hidden |= np.asarray((found < lows[going]) | (found > highs[going]), bool)
        lists.add(going, np.ma.masked_array(found, hidden), ids[some])
        at, step = at + step, step * 2
    return lists, member, np.array([scored])


def _walked(shipped, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = shipped.value
        for table in v.blocks(batches):
            ids = v.column(table, "vec_id").to_numpy()
            labels = v.column(table, "label").to_numpy()
            for at, x in v.by_length(v.column(table, "x")):
                q = v.whole(x)
                unit, length = directions(q)
                for cluster in clusters:
                    if cluster.q.shape[1] != q.shape[1]:
                        continue
                    lists, member, _ = walk(cluster, ids[at], labels[at], q, unit, length)
                    who, place = np.nonzero(~np.ma.getmaskarray(lists.scores))
                    if not len(who):
                        continue
                    scores = [int(s) for s in lists.scores.data[who, place]]
                    asker = who if cluster.limits is None else np.array(
                        [p for _, p, _, _ in cluster.limits])[who]
                    yield pa.record_batch({
                        "anchor_id": pa.array(cluster.ids[member[who]]),
                        "print": pa.array(cluster.prints[member[who]]),
                        "place": pa.array(asker.astype(np.int32)),
                        "vec_id": pa.array(lists.ids[who, place]),
                        "score": pa.array([str(s) for s in scores], pa.string()) if bits > 62
                        else pa.array(scores, pa.int64()),
                        "key": pa.array([v.sortable(s, bits) for s in scores], pa.string())
                        if bits > 62 else pa.array([None] * len(scores), pa.string())})
    return run


def _first(found: DataFrame, keys: list[str], k: int, bits: int) -> DataFrame:
    """The k best of what the blocks returned, with their rank."""
    score = F.desc("key") if bits > 62 else F.desc("score")
    order = Window.partitionBy(*keys).orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _groups(anchors: DataFrame, groups: int) -> Iterator[list[Cluster]]:
    """The clusters of each group of anchors, as many as are broadcast at once."""
    for group in range(groups):
        held = anchors.where(F.col("group") == group).toPandas()
        out = []
        for (label, _, _, _), part in held.groupby(["label", "n", "deal", "cluster"]):
            part = part.sort_values(["vec_id", "print"])
            x = np.stack(part["x"].to_numpy()).astype(np.float64).reshape(len(part), -1)
            limits = None
            if "limits" in part:
                limits = [(m, r["place"], int(r["low"]), int(r["high"]))
                          for m, found in enumerate(part["limits"]) for r in found]
            out.append(Cluster(part["vec_id"].to_numpy(), part["print"].to_numpy(), label,
                               v.whole(x), limits))
        yield out


def _over_blocks(rows: DataFrame, anchors: DataFrame, groups: int, bits: int) -> DataFrame:
    kind = "string" if bits > 62 else "long"
    out = []
    for clusters in _groups(anchors, groups):
        held = rows.sparkSession.sparkContext.broadcast(clusters)
        out.append(shared.settle(rows.mapInArrow(
            _walked(held, bits), f"anchor_id long, print long, place int, vec_id long, "
                                 f"score {kind}, key string")))
        held.unpersist()
    return reduce(DataFrame.union, out)


def _limits(score: str, percent: int, up: bool):
    """The least, or the largest, whole score that is this share of a score, as text."""
    def of(found: pd.Series) -> pd.Series:
        return found.map(lambda s: str(-(-int(s) * percent // 100) if up
                                       else int(s) * percent // 100))
    return F.pandas_udf(of, "string")(F.col(score).cast("string"))


def hard_negatives(vectors: DataFrame, every: int = EVERY, moved: int = 7) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Where vec_id is divisible by `moved`, the label counts as (label + 1) % 10.
    """
    label = vectors["label"].cast("long")
    label = F.when(vectors["vec_id"] % moved == 0, (label + 1) % 10).otherwise(label)
    rows = v.usable(vectors.where(vectors["label"].isNotNull()), label.alias("label"))
    n, bits = v.score_bits(rows)
    rows = v.in_blocks(rows, n)
    asking = (rows.where(F.col("vec_id") % every == 0)
              .withColumn("print", F.xxhash64("label", "x"))
              .dropDuplicates(["vec_id", "print"]).withColumn("n", F.size("x")))
    counts = asking.agg(F.count("*").alias("n"), F.sum(F.col("n") * 8 + 64).alias("bytes")).first()
    groups = max(1, -(-(counts["bytes"] or 0) // v.BROADCAST))
    deals = max(1, -(-counts["n"] // (groups * TOGETHER)))
    spread = F.xxhash64("vec_id", "print")
    asking = (asking.withColumn("group", F.pmod(spread, F.lit(groups)).cast("int"))
              .withColumn("deal", F.pmod(F.shiftright(spread, 20), F.lit(deals)).cast("int")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema)
    anchors = shared.settle(asking.groupBy("label", "n", "group", "deal").applyInPandas(
        _clustered, f"{schema}, cluster int"))

    key = ["anchor_id", "print"]
    positives = _first(_over_blocks(rows, anchors, groups, bits).drop("place"), key, POSITIVES, bits)
    positives = shared.settle(positives.select(
        *key, F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").cast("string").alias("positive_score")))
    limits = (positives.withColumn("low", _limits("positive_score", LOW, True))
              .withColumn("high", _limits("positive_score", HIGH, False))
              .groupBy(*key).agg(F.collect_list(F.struct("place", "low", "high")).alias("limits"))
              .withColumnRenamed("anchor_id", "vec_id"))
    found = _over_blocks(rows, anchors.join(limits, ["vec_id", "print"]), groups, bits)
    found = _first(found, [*key, "place"], NEGATIVES, bits)
    return (found.join(positives, [*key, "place"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                    _as_long("positive_score", bits).alias("positive_score"),
                    _as_long("score", bits).alias("negative_score")))


def _as_long(name: str, bits: int):
    text = F.col(name).cast("string")
    beyond = F.when(text.startswith("-"), F.lit(v.LONG[0])).otherwise(F.lit(v.LONG[1]))
    return F.coalesce(text.try_cast("long"), beyond) if bits > 62 else text.cast("long")


#: The same in DuckDB.
ORACLE = f"""
WITH t AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
        embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(
        list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM t a JOIN t b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
    SELECT * FROM s WHERE alike QUALIFY row_number() OVER (
        PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id
           ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
