"""Exact top-k inner products by a bit-sliced index.

Components become integers, floor(256 * x).  Rows are dealt by hash into blocks; a block keeps,
for each component and each bit of its values (two's complement), the bitmap of the rows that have
the bit.  A query's score is a sum of shifted slices: every component's slices are added for each
signed binary digit of the query's own component, by carry-save adders over whole bitmaps.  The
top rows are then selected from the most significant slice downward; when a slice would select
more rows than are wanted, the selection narrows to it, and the rows that are still tied at the
end, the boundary rows, are resolved by vec_id.  Scores are read back from the slices.

Queries are the rows whose vec_id is divisible by 50.  They are broadcast, as many at a time as
fit BROADCAST bytes, and meet every block where it lies: its index is built once for all of them.
Each block returns at most k rows a query, from which the k best are taken.

Vectors that are null or hold null or non-finite components take no part; all others do, however
large: slices are as many as the values need, and scores beyond 64 bits are ordered exactly and
returned as the nearest long.  Rows with a null vec_id are candidates of no query, as they can't
be named.  Vectors of different lengths are not compared, empty ones have score 0 with each other.
Repeated rows are candidates each; a query's own vec_id is never its candidate, and repeated query
rows are queries each under the same id, whose candidates are ranked together.  Columns other than
vec_id and embedding don't matter.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitlake.llm import shared, vectors as v

#: Neighbours of a query, every how manyth row is one; rows in a block.
K, EVERY = 5, 50
ROWS = 16384


def slices(values: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (64 rows a word) of the bits of the rows' values, lowest first; the last is the
    sign and stands for all higher bits."""
    bits = max(v.largest(values).bit_length() + 1, 2)
    padded = np.zeros(-(-len(values) // 64) * 64, values.dtype)
    padded[:len(values)] = values
    return [np.packbits((padded >> b & 1).astype(bool), bitorder="little").view(np.uint64)
            for b in range(bits)]


def digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-zero signed binary digits of a number."""
    out, shift = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((shift, sign))
            value -= sign
        value >>= 1
        shift += 1
    return out


def scores(index: list[list[np.ndarray]], query: np.ndarray, width: int, among: np.ndarray
           ) -> list[np.ndarray]:
    """The slices of the inner products with the query, `width` of them, two's complement.

    Bitmaps wait in a column for each power of two; three of one column become one there and one
    in the next, until each holds two at most, which a ripple of carries adds.
    """
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    constant = 0
    for attribute, weight in zip(index, query.tolist(), strict=True):
        top = len(attribute) - 1
        for shift, sign in digits(weight):
            # the value is the sum of its lower bits less the sign bit; x * -1 adds inverted bits
            for b, bitmap in enumerate(attribute):
                if b + shift >= width:
                    continue
                if (b == top) == (sign > 0):
                    columns[b + shift].append(~bitmap)
                    constant -= 1 << (b + shift)
                else:
                    columns[b + shift].append(bitmap)
    every = ~np.zeros_like(among)
    for p in range(width):
        if constant >> p & 1:
            columns[p].append(every)
    out = []
    for p in range(width):
        column = columns[p]
        following = columns[p + 1] if p + 1 < width else []
        at = 0
        while len(column) - at >= 3:
            a, b, c = column[at], column[at + 1], column[at + 2]
            at += 3
            half = a ^ b
            column.append(half ^ c)
            half &= c
            half |= a & b
            following.append(half)
        if len(column) - at == 2:
            a, b = column[at], column[at + 1]
            out.append(a ^ b)
            following.append(a & b)
        else:
            out.append(column[at] if len(column) > at else np.zeros_like(every))
    return out


def best(total: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely among the k best, and of the boundary rows that tie for the rest."""
    sure, tied = np.zeros_like(among), among
    signs = total[-1:]
    for level, bitmap in enumerate([*signs, *reversed(total[:-1])]):
        here = tied & ~bitmap if level == 0 else tied & bitmap
        more = sure | here
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied = here
        else:
            sure, tied = more, tied & ~here
            if n == k:
                return sure, np.zeros_like(among)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _values(total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64 if len(total) < 63 else object)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for p, bitmap in enumerate(total):
        value = (bitmap[word] >> bit & np.uint64(1)).astype(out.dtype)
        out += value * ((1 << p) if p < len(total) - 1 else -(1 << p))
    return out


def search(ids: np.ndarray, values: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int
           ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best rows of a block, whose index is built here."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    index = [slices(values[:, d]) for d in range(values.shape[1])]
    there = np.zeros(-(-len(ids) // 64) * 64, bool)
    there[:len(ids)] = True
    there = np.packbits(there, bitorder="little").view(np.uint64)
    largest = max(1, v.largest(values))
    for vec_id, q in queries:
        if len(q) != values.shape[1]:
            continue
        width = (sum(map(abs, q.tolist())) * largest).bit_length() + 2
        among = there.copy()
        for own in range(*np.searchsorted(ids, (vec_id, vec_id + 1))):
            among[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        total = scores(index, q, width, among)
        sure, tied = best(total, among, k)
        sure, tied = _rows(sure), _rows(tied)
        chosen = np.concatenate((sure, tied[:k - len(sure)]))
        yield vec_id, ids[chosen], _values(total, chosen)


def _searched(shipped, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shipped.value
        for table in v.blocks(batches, ROWS):
            every = v.column(table, "vec_id").to_numpy()
            for at, x in v.by_length(v.column(table, "x")):
                for vec_id, ids, found in search(every[at], v.whole(x), queries, k):
                    found = found.tolist()
                    yield pa.record_batch({
                        "query_id": pa.array([vec_id] * len(ids), pa.int64()),
                        "vec_id": pa.array(ids, pa.int64()),
                        "score": pa.array([v.clipped(s) for s in found], pa.int64()),
                        "key": pa.array([v.sortable(s, bits) if bits > 62 else None
                                         for s in found], pa.string())})
    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query."""
    rows = v.usable(vectors)
    n, bits = v.score_bits(rows)
    rows = v.in_blocks(rows, n, ROWS)
    asked = rows.where(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.size("x") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-size // v.BROADCAST))
    out = []
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == part).collect()
        held = rows.sparkSession.sparkContext.broadcast(
            [(r["vec_id"], v.whole(np.array(r["x"], np.float64))) for r in some])
        out.append(shared.settle(rows.mapInArrow(
            _searched(held, k, bits), "query_id long, vec_id long, score long, key string")))
        held.unpersist()
    order = Window.partitionBy("query_id").orderBy(
        F.desc("key") if bits > 62 else F.desc("score"), "vec_id")
    return (reduce(DataFrame.union, out).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


#: The same in DuckDB.
ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
        embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(
        list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
        AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
