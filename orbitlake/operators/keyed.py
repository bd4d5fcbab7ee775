"""Joining per-key results back onto rows, and per-key top-k, without hot tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BROADCAST_BYTES = 32 * 1024 * 1024


def checked_broadcast(small: DataFrame, row_bytes: int = 256,
                      extra: Column | None = None) -> DataFrame:
    """``small`` materialised once, hinted for broadcast only if its counted size allows.

    ``extra`` counts the bytes of a row beyond ``row_bytes``, for rows that hold arrays.

    Beyond :data:`BROADCAST_BYTES` there is no hint, and a join with it is a shuffled equi-join
    whose hot keys adaptive execution splits.  Only the count comes to the driver.
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    more = F.lit(0) if extra is None else F.coalesce(F.sum(extra), F.lit(0))
    size = small.agg((F.count(F.lit(1)) * row_bytes + more).alias("bytes")).first()["bytes"]
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
           row_bytes: int = 256) -> DataFrame:
    """Join ``small`` (one row per key) onto ``df`` by ``keys``."""
    return df.join(checked_broadcast(small, row_bytes), list(keys), how)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          salts: int = 64, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order`` (which must be total), exactly.

    Each key is first cut to ``k`` rows within every salt, so a key holding a third of the
    table is ranked by ``salts`` tasks; the final ranking sees at most ``k * salts`` rows.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "__salt").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    first = (df.withColumn("__salt", spread)
             .withColumn("__r", F.row_number().over(inside))
             .where(F.col("__r") <= k).drop("__salt", "__r"))
    return first.withColumn(rank, F.row_number().over(overall)).where(F.col(rank) <= k)
