"""What the operators on embeddings share: usable rows, exact whole-number components and inner
products, and blocks of rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared

#: Rows of a task's block; bytes of vectors that are broadcast at once.
ROWS, BROADCAST = 4096, 1 << 25
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, *more: Column) -> DataFrame:
    """vec_id, the further columns and x of the rows whose vector has finite components only."""
    x = vectors["embedding"]
    fine = F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")), F.lit(False)))
    return vectors.where(x.isNotNull() & vectors["vec_id"].isNotNull() & fine).select(
        vectors["vec_id"].cast("long").alias("vec_id"), *more, x.alias("x"))


def in_blocks(rows: DataFrame, n: int, most: int = ROWS) -> DataFrame:
    """The n rows dealt evenly into partitions of about `most`, whatever their keys, and settled."""
    return shared.settle(rows.repartition(max(1, -(-n // most))))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exactly: 64-bit integers, or Python integers where they don't suffice."""
    if np.abs(x).max(initial=0) < 2.0 ** 54:
        return np.floor(x * 256).astype(np.int64)
    flat = [int(v) * 256 if abs(v) > 2.0 ** 52 else int(np.floor(v * 256)) for v in x.flat]
    return np.array(flat, object).reshape(x.shape)


def largest(values: np.ndarray) -> int:
    return max((abs(int(values.max())), abs(int(values.min())))) if values.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exactly."""
    most = a.shape[1] * largest(a) * largest(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length in a list column."""
    column = pa.concat_arrays([column])
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy().astype(np.float64)
    lengths = np.diff(bounds)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, values[bounds[at][:, None] + np.arange(n)]


def blocks(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[pa.Table]:
    """The batches of a partition in tables of about `most` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name)
    return chunks.chunk(0) if chunks.num_chunks == 1 else pa.concat_arrays(chunks.chunks)


def sortable(score: int, bits: int) -> str:
    """Text that sorts as the numbers of at most `bits` bits do."""
    return format(score + (1 << bits), f"0{bits // 4 + 1}x")


def clipped(score: int) -> int:
    return min(max(score, LONG[0]), LONG[1])


def score_bits(rows: DataFrame) -> tuple[int, int]:
    """(rows, bits that any inner product of two rows' components fits in)."""
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size"),
                     F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))
                     .alias("most")).first()
    top = int(found["most"] or 0) * 256 + 256
    return found["n"], (max(found["size"] or 0, 1) * top * top).bit_length() + 1
