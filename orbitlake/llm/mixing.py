"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The size of a text is its number of words.  Sources, in code point order and null last, weigh
1, 2, 3, 1, ... and share the words of all texts by weight; a target stops at three times its
source's own words and the excess goes to the others by weight, which ends where every source has
min(3 * own, level * weight) for one common level.

1. A source's documents are dealt by hash into blocks.  The source gives whole epochs (all its
   blocks), and of the last epoch so many permuted blocks as fit its target; the documents of one
   further block fill up what is left.  So every source meets its target to within a few words.
2. The block quotas of all sources are split exactly among the output shards by a binary tree:
   each node draws the left half's quotas from a multivariate hypergeometric distribution, and
   both halves are split further.
3. A shard gets consecutive runs of each source's permuted block sequence, so draws are disjoint;
   its rows are ordered by a hash (the local shuffle).

Everything is drawn from hashes of ids, sources and a seed: reruns agree.  Null and empty texts
have size 0 and are taken with 0 words; a source without words has target 0.  Rows with the same id
stay rows of their own.  Rows, not sources, may be many: the table of sources and their blocks (at
most BLOCKS each) is the part that single tasks see source by source, and the splitting tree sees
one number for each source.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitlake.llm import shared

#: Blocks a source is dealt into, output shards, seed, and the most a document is repeated.
BLOCKS, SHARDS, SEED, MOST = 1024, 16, 41, 3


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for first, data, offsets in shared.pieces(batch.column("text")):
            _, _, rows, _ = shared.runs(shared.SOLID, data, offsets)
            n = len(offsets) - 1
            counts[first:first + n] = np.bincount(rows, minlength=n)
        kept = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(counts)],
                                         [*(batch.schema.names[i] for i in kept), "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, print (a hash of id and text), block and size of every row."""
    text = shared.text_or_empty(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       docs["source"].cast("string").alias("source"),
                       F.xxhash64(docs["doc_id"].cast("long"), text).alias("print"),
                       text.alias("text"))
    counted = shared.over_texts(rows, _word_counts,
                                "doc_id long, source string, print long, size long")
    return counted.withColumn("block", F.pmod(F.xxhash64("print", F.lit(SEED)),
                                              F.lit(BLOCKS)).cast("int"))


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, weight and target; `per_source` has source and source_size.

    One row for each source: the level at which the uncapped sources share what the capped ones
    leave is found by running sums over the sources in order of own / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = per_source.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1))
    sofar = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(),
                           "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(sofar), F.lit(0)) * MOST
    spread = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(sofar), F.lit(0))
    # the level if all sources before this one are capped; it rises while too few are, then falls
    level = (F.sum("source_size").over(every) - capped) / spread
    return weighed.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.least((F.col("source_size") * MOST).cast("double"),
                F.max("level").over(every) * F.col("weight")).alias("target"))


def _plan(blocks: pd.DataFrame) -> pd.DataFrame:
    """For one source: its blocks in permuted order, with the epochs each is taken in.

    Of a few seeded permutations the first is used whose blocks fit the target to 0.2 %, or else
    the one that fits it best; with many blocks the first one does.
    """
    blocks = blocks.sort_values(["order", "block"]).reset_index(drop=True)
    words = blocks["words"].to_numpy(np.int64)
    own, target = int(words.sum()), float(blocks["target"].iloc[0])
    whole = int(target // own) if own else 0
    rest = target - whole * own if whole < MOST else 0.0
    draw = np.random.default_rng(int(blocks["order"].iloc[0]) & (1 << 63) - 1)
    best: tuple | None = None
    for _ in range(64):
        place, left, taken = draw.permutation(len(words)), rest, []
        for i in place.tolist():
            if 0 < words[i] <= left:
                taken.append(i)
                left -= int(words[i])
        if best is None or left < best[0]:
            best = (left, place, taken)
        if left <= 0.002 * target:
            break
    left, place, taken = best
    extra = np.zeros(len(words), np.int64)
    extra[taken] = 1
    # the smallest block not taken is opened, for its documents to fill up what is left
    closed = [i for i in place.tolist() if not extra[i] and words[i] > 0 and whole < MOST]
    fill = np.zeros(len(words))
    if closed:
        fill[min(closed, key=lambda i: words[i])] = left
    return pd.DataFrame({"source": blocks["source"], "block": blocks["block"],
                         "place": np.argsort(place), "times": whole + extra, "fill": fill})


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Which documents of an opened block fill its source up: the largest that still fits first,
    and at the end one more if that comes nearer."""
    docs = docs.sort_values(["size", "print"], ascending=[False, True])
    left, extra = float(docs["fill"].iloc[0]), []
    for size in docs["size"]:
        extra.append(1 if 0 < size <= left else 0)
        left -= size * extra[-1]
    at = [i for i, e in enumerate(extra) if not e and docs["size"].iloc[i] > 0]
    if at and docs["size"].iloc[at[-1]] - left < left:
        extra[at[-1]] = 1
    return pd.DataFrame({"row": docs["row"], "extra": extra})


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Exact quotas of each shard (lines) from each source: a tree of hypergeometric draws."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    take = int(quotas.sum()) * half // shards
    draw = np.random.default_rng([seed, shards, int(quotas.sum())])
    left = draw.multivariate_hypergeometric(quotas, take, method="marginals") \
        if len(quotas) else quotas
    return np.concatenate((split(left, half, 2 * seed),
                           split(quotas - left, shards - half, 2 * seed + 1)))


def _deal(shards: int):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last").reset_index(drop=True)
        given = split(rows["draws"].to_numpy(np.int64), shards)
        last = np.cumsum(given, axis=0)
        return pd.DataFrame([
            (rows["source"].iloc[s], d, int(last[d, s] - given[d, s]), int(last[d, s]))
            for s in range(len(rows)) for d in range(shards) if given[d, s]],
            columns=["source", "out", "first", "last"])
    return deal


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of `docs`: doc_id, print, size, source, source_size, target, taken
    (words) and outs, the output shards that take it, one for each time."""
    rows = sizes(docs)
    rows = shared.settle(rows.groupBy("source", "block", "doc_id", "print", "size")
                         .agg(F.count("*").alias("copies")))
    blocks = rows.groupBy("source", "block").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"))
    per_source = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = shared.settle(targets(per_source))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = (blocks.join(goal, same(blocks, goal))
            .select(blocks["source"], "block", "words", "target",
                    F.xxhash64(F.coalesce(blocks["source"], F.lit("")), "block", F.lit(SEED))
                    .alias("order"))
            .groupBy("source").applyInPandas(
                _plan, "source string, block int, place int, times int, fill double"))
    plan = shared.settle(plan)
    # the documents of the one opened block of each source; equal rows are told apart here
    opened = plan.where("fill > 0")
    at = F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    one = (rows.join(opened, same(rows, opened) & (rows["block"] == opened["block"]))
           .select(rows["source"], rows["block"], "doc_id", "print", "size", "fill", at)
           .withColumn("row", F.struct("doc_id", "print", F.col("pos").alias("nth"))))
    extra = one.groupBy("source", "block").applyInPandas(
        _fill, "row struct<doc_id:bigint,print:bigint,nth:int>, extra int") \
        .where("extra > 0").select("row.*")
    # block draws in order: epoch by epoch, in each the blocks by place; opened ones count as one
    drawn = F.col("times") + F.when(F.col("fill") > 0, 1).otherwise(0)
    draws = plan.where(drawn > 0).select("source", "block", "place", F.explode(
        F.sequence(F.lit(1), drawn)).alias("epoch"))
    nth = Window.partitionBy("source").orderBy("epoch", "place")
    draws = draws.withColumn("nth", F.row_number().over(nth) - 1)
    dealt = (draws.groupBy("source").agg(F.count("*").alias("draws"))
             .withColumn("all", F.lit(0)).groupBy("all")
             .applyInPandas(_deal(shards), "source string, out int, first long, last long"))
    outs = (draws.join(dealt, same(draws, dealt)
                       & (draws["nth"] >= dealt["first"]) & (draws["nth"] < dealt["last"]))
            .groupBy(draws["source"].alias("s"), draws["block"].alias("b"))
            .agg(F.sort_array(F.collect_list(F.struct("epoch", "out"))).alias("drawn")))
    of_block = plan.join(outs, F.col("source").eqNullSafe(F.col("s"))
                         & (F.col("block") == F.col("b")), "left") \
        .select("source", "block", "times", "fill",
                F.transform("drawn", lambda d: d["out"]).alias("drawn"))
    known = (of_block.select(F.col("source").alias("s"), F.col("block").alias("b"), "times",
                             "fill", "drawn")
             .join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source", "weight"))
    each = (rows.join(known, rows["source"].eqNullSafe(known["s"]) & (rows["block"] == known["b"]))
            .select("doc_id", "print", "size", "source", "source_size", "target", "times",
                    "fill", "drawn", F.posexplode(F.sequence(
                        F.lit(1).cast("long"), F.col("copies"))).alias("nth", "copy")))
    more = extra.select(F.col("doc_id").alias("d"), F.col("print").alias("p"),
                        F.col("nth").alias("k"))
    every = each.join(more, each["doc_id"].eqNullSafe(more["d"]) & (each["print"] == more["p"])
                      & (each["nth"] == more["k"]), "left")
    times = F.col("times") + F.when(F.col("p").isNotNull(), 1).otherwise(0)
    return every.select(
        "doc_id", "print", "size", "source", "source_size", "target",
        (F.col("size") * times).cast("long").alias("taken"),
        F.when(times > 0, F.slice("drawn", 1, times)).otherwise(
            F.array().cast("array<int>")).alias("outs"))


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, and the shards that take it."""
    return mixed(docs, shards).select("doc_id", "size", "source_size", "target", "taken",
                                      F.col("outs").alias("out_shards"))


def take_mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is drawn, ordered by output shard and
    hash within the tasks.

    Rows equal in id, text and source count as one row that is drawn as often as all of them.
    Rows without words are kept once each: they weigh nothing in any mix.
    """
    outs = F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.col("outs"))
    plan = (mixed(docs, shards).select(F.col("doc_id").alias("__id"), F.col("print")
                                       .alias("__print"), F.col("source").alias("__source"),
                                       F.explode(outs).alias("__out"))
            .groupBy("__id", "__print", "__source", "__out")
            .agg(F.count("*").alias("__times")))
    names = docs.columns
    rows = (docs.withColumn("__p", F.xxhash64(docs["doc_id"].cast("long"),
                                              shared.text_or_empty(docs)))
            .dropDuplicates(["doc_id", "source", "__p"]))
    joined = rows.join(plan, rows["doc_id"].cast("long").eqNullSafe(plan["__id"])
                       & (rows["__p"] == plan["__print"])
                       & rows["source"].cast("string").eqNullSafe(plan["__source"]))
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__nth")
    return (joined.select(*[rows[c] for c in names], "__p", "__out", once)
            .sortWithinPartitions("__out", F.xxhash64("__p", "__out", "__nth"))
            .drop("__p", "__out", "__nth"))
