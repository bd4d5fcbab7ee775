"""What several corpus operators need: settled tables and vectorised text handling inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose hashes are worked out at once; bytes of rows that go to Python at once.
SLICE, BATCH = 1 << 20, 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder; lineage ends there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "/tmp/orbitlake-checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def over_texts(rows: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of BATCH bytes, however long the texts: executor and worker hold a
    batch several times over, outside the executor's heap, and Spark counts rows by default."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return rows.mapInArrow(function, schema)


def text_or_empty(df: DataFrame, name: str = "text") -> F.Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of length rows + 1) of a string or binary column; null is ''."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type)
                              or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes each; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def pieces(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts, so that work arrays stay small."""
    data, offsets = byte_column(column)
    for first, last in groups(offsets, most):
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def runs(kinds: np.ndarray, data: np.ndarray, offsets: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind other than 0 in one text: starts, ends, rows, kinds."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint8)
    kind = kinds[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    own = kind[cuts[:-1]]
    keep = own != 0
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, own[keep]


_SPACE = bytes([32, *range(9, 14)])
#: 1 for every byte that is not white space.
SOLID = np.ones(256, np.uint8)
SOLID[list(_SPACE)] = 0
#: 1 for letters, digits and bytes of other scripts, 2 for punctuation, 0 for white space.
WORDS_AND_MARKS = np.full(256, 2, np.uint8)
WORDS_AND_MARKS[list(_SPACE)] = 0
WORDS_AND_MARKS[128:] = 1
WORDS_AND_MARKS[[c for c in range(128) if chr(c).isalnum()]] = 1
#: 1 for letters, digits and bytes of other scripts only.
LETTERS = np.where(WORDS_AND_MARKS == 1, 1, 0).astype(np.uint8)
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1024)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x))))
                      for x in (_P, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes, whatever its place."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, "right")))
        base = starts[first]
        part = data[base:ends[last - 1]]
        power, inverse = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[b] - total[a]) * inverse[a]
        first = last
    return mixed(out)


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words of a row; a row of fewer words gives them all as one."""
    if not len(words):
        return words, rows
    h = np.zeros(len(words), np.uint64)
    step = np.uint64(0xA24BAED4963EE407)
    for k in range(n):
        there = np.zeros(len(words), np.uint64)
        if k < len(words):
            there[:len(words) - k] = np.where(rows[k:] == rows[:len(words) - k],
                                              words[k:], np.uint64(0))
        h = h * step + there
    head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    length = np.diff(np.append(head, len(rows)))
    place = np.arange(len(rows)) - np.repeat(head, length)
    keep = (place + n <= np.repeat(length, length)) | (place == 0)
    return mixed(h[keep]), rows[keep]
