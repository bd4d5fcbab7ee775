"""Lines that several documents share, kept once: bitmaps of the lines to keep.

A text is split at line feeds.  A line's key is the line without white space at its ends, A-Z in
lower case.  Keys of at least LEAST code points that MANY documents hold are kept only in the
largest doc_id among them, where all lines with the key stay.

Every document gives one record for each of its long keys: the key's 128-bit hash, its doc_id and
the places of its lines.  The records are range-partitioned by hash and doc_id and sorted, so that
a hash's documents stream by, the largest first.  The first document of a hash keeps its lines, the
others lose them once the MANYth document has passed.  A hash that a third of the documents hold
spreads over many ranges: only the first and last hash of each range go to the driver (two rows a
range), which tells every range how many documents of its outer hashes lie before and behind it.
What comes back for each document is a compressed bitmap of its lines, not their text.

A null or empty text is one empty line.  Rows with the same doc_id count as one document, all rows
with a null doc_id as one that is smaller than all others.  Repeated rows give equal results, texts
are read whole, columns other than doc_id and text don't matter, and an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared

#: Code points of a key that counts; documents that must hold it before it is dropped.
LEAST, MANY = 20, 3
_RECORD = "hi long, lo long, known int, doc long, print long, at array<int>"
_EDGE = ("part int, last boolean, whole boolean, hi long, lo long, docs long, "
         "known int, doc long, known_end int, doc_end long")


def _ready(docs: DataFrame) -> DataFrame:
    """doc_id, text and a fingerprint of the text that tells rows of one doc_id apart."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       shared.text_or_empty(docs).alias("text"))
    return rows.withColumn("print", F.xxhash64("text"))


def long_lines(data: np.ndarray, offsets: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row, place in its text) of the stripped lines that are long enough."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    # equal starts, of empty texts or behind a last line feed, may stand in any order
    lines = np.diff(np.searchsorted(feeds, offsets)) + 1
    rows = np.repeat(np.arange(len(lines)), lines)
    first = np.concatenate(([0], np.cumsum(lines)))
    place = np.arange(len(rows)) - first[rows]
    ends = np.where(place == lines[rows] - 1, offsets[1:][rows], 0)
    inner = np.flatnonzero(place < lines[rows] - 1)
    ends[inner] = starts[inner + 1] - 1
    solid = np.flatnonzero(shared.SOLID[data])
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    there = np.flatnonzero(b >= a)
    left, right = solid[a[there]], solid[b[there]] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    enough = points[right] - points[left] >= LEAST
    there = there[enough]
    return left[enough], right[enough], rows[there], place[there]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in shared.pieces(batch.column("text")):
            left, right, rows, place = long_lines(data, offsets)
            if not len(left):
                continue
            low = shared.LOWER[data].tobytes()
            raw = b"".join(hashlib.blake2b(low[a:b], digest_size=16).digest()
                           for a, b in zip(left.tolist(), right.tolist(), strict=True))
            keys = np.frombuffer(raw, "<i8").reshape(-1, 2)
            order = np.lexsort((place, keys[:, 1], keys[:, 0], rows))
            hi, lo, row, place = keys[order, 0], keys[order, 1], rows[order], place[order]
            heads = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1])
                                                   | (lo[1:] != lo[:-1])
                                                   | (row[1:] != row[:-1]))))
            own = batch.slice(first).take(pa.array(row[heads]))
            doc = own.column("doc_id")
            yield pa.record_batch({
                "hi": pa.array(hi[heads]), "lo": pa.array(lo[heads]),
                "known": pc.cast(pc.is_valid(doc), pa.int32()), "doc": pc.fill_null(doc, 0),
                "print": own.column("print"),
                "at": pa.ListArray.from_arrays(
                    pa.array(np.append(heads, len(place)).astype(np.int32)),
                    pa.array(place.astype(np.int32)))})


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "known", "doc")]


def _fresh(columns: list[np.ndarray], last: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row begins a hash, and whether it begins a document of its hash."""
    def differs(values: np.ndarray, before) -> np.ndarray:
        out = np.empty(len(values), bool)
        out[0] = last is None or values[0] != before
        np.not_equal(values[1:], values[:-1], out=out[1:])
        return out
    hi, lo, known, doc = (differs(v, last and last[i]) for i, v in enumerate(columns))
    key = hi | lo
    return key, key | known | doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last hash of a range with their number of documents."""
    runs: list[list] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        key, fresh = _fresh(columns, last)
        cuts = np.flatnonzero(key).tolist()
        bounds = [0, *(c for c in cuts if c), len(key)]
        # only the first two and the last run of a batch can be an edge
        for i in [*range(min(2, len(bounds) - 1)), *range(max(2, len(bounds) - 2),
                                                          len(bounds) - 1)]:
            a, b = bounds[i], bounds[i + 1]
            n, end = int(fresh[a:b].sum()), [int(c[b - 1]) for c in columns[2:]]
            if a == 0 and not key[0]:
                runs[-1][2] += n
                runs[-1][5:] = end
            else:
                if len(runs) == 2:
                    runs.pop()
                runs.append([int(columns[0][a]), int(columns[1][a]), n,
                             *(int(c[a]) for c in columns[2:]), *end])
        last = tuple(c[-1] for c in columns)
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _EDGE.split(", ")]
    rows = [(part, i > 0, len(runs) == 1, *run) for i, run in enumerate(runs)]
    kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
             pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    yield pa.record_batch({n: pa.array([r[i] for r in rows], k)
                           for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _beyond(edges: list) -> dict[int, tuple[tuple | None, int, int]]:
    """For each range: the row before it and how many documents of that row's hash came so far,
    and how many documents of its last hash are still to come."""
    first = {e["part"]: e for e in edges if not e["last"]}
    last = {e["part"]: e for e in edges if e["last"]} | {
        e["part"]: e for e in edges if e["whole"]}
    parts = sorted(first)
    before, after, out = {}, {}, {}
    held = None
    for p in parts:
        before[p] = held
        e, seen = last[p], 0
        if held and e["whole"] and (e["hi"], e["lo"]) == held[0][:2]:
            seen = held[1] - ((e["known"], e["doc"]) == held[0][2:])
        held = ((e["hi"], e["lo"], e["known_end"], e["doc_end"]), e["docs"] + seen)
    held = None
    for p in reversed(parts):
        e = last[p]
        after[p] = 0
        if held and held[:2] == (e["hi"], e["lo"]):
            after[p] = held[2] - (held[3:] == (e["known_end"], e["doc_end"]))
        e = first[p]
        seen = after[p] if e["whole"] else 0
        held = (e["hi"], e["lo"], e["docs"] + seen, e["known"], e["doc"])
    for p in parts:
        out[p] = (*(before[p] or (None, 0)), after[p])
    return out


def _dropped(beyond):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, docs, after = beyond.value.get(TaskContext.get().partitionId(), (None, 0, 0))
        waiting: list[pa.RecordBatch] = []    # rows of a hash's second document, fate unknown
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            key, fresh = _fresh(columns, last)
            nth = np.cumsum(fresh)
            run = np.cumsum(key)
            heads = np.flatnonzero(key)
            base = np.zeros(run[-1] + 1, np.int64)
            base[0] = -docs
            base[run[heads]] = nth[heads] - 1
            nth = nth - base[run]
            ends = np.append(heads[heads > 0], len(key)) - 1
            total = np.zeros(run[-1] + 1, np.int64)
            total[run[ends]] = nth[ends]
            if waiting:
                if not key[0] and total[0] >= MANY:
                    yield from waiting
                if key[0] or total[0] >= MANY or run[-1] > 0:
                    waiting = []
            go = (nth > 1) & (total[run] >= MANY)
            yield _named(batch, go)
            if total[run[-1]] < MANY:
                waiting.append(_named(batch, (nth > 1) & (run == run[-1])))
            last, docs = tuple(c[-1] for c in columns), int(nth[-1])
        if docs + after >= MANY:
            yield from waiting
    return stream


def _named(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    batch = batch.take(pa.array(np.flatnonzero(rows)))
    return pa.record_batch({
        "doc_id": pc.if_else(pc.equal(batch.column("known"), 1), batch.column("doc"),
                             pa.scalar(None, pa.int64())),
        "print": batch.column("print"), "at": batch.column("at")})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column("n_lines").to_numpy()
        values, bounds = batch.column("at").values, batch.column("at").offsets.to_numpy()
        values = values.to_numpy()
        none = batch.column("at").is_null().to_numpy(zero_copy_only=False)
        keeps, dropped = [], np.zeros(len(lines), np.int64)
        for i, n in enumerate(lines.tolist()):
            keep = np.ones(n, bool)
            if not none[i]:
                keep[values[bounds[i]:bounds[i + 1]]] = False
                dropped[i] = n - keep.sum()
            keeps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": batch.column("print"),
                               "n_lines": batch.column("n_lines"), "n_dropped": pa.array(dropped),
                               "keep": pa.array(keeps, pa.binary())})


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text), n_lines, n_dropped and keep of each document: a deflated
    bitmap with a bit for each line, lowest bit first, set where the line stays."""
    ready = _ready(docs)
    records = (ready.mapInArrow(_records, _RECORD)
               .repartitionByRange("hi", "lo", F.desc("known"), F.desc("doc"))
               .sortWithinPartitions("hi", "lo", F.desc("known"), F.desc("doc")))
    records = shared.settle(records)
    edges = records.mapInArrow(_edges, _EDGE).collect()
    beyond = docs.sparkSession.sparkContext.broadcast(_beyond(edges))
    gone = (records.mapInArrow(_dropped(beyond), "doc_id long, print long, at array<int>")
            .groupBy("doc_id", "print").agg(F.flatten(F.collect_list("at")).alias("at")))
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    every = (ready.select("doc_id", "print", lines.cast("long").alias("n_lines"))
             .groupBy("doc_id", "print").agg(F.first("n_lines").alias("n_lines")))
    return _joined(every, gone, "left").mapInArrow(
        _packed, "doc_id long, print long, n_lines long, n_dropped long, keep binary")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Equal texts of equal, perhaps null, doc_ids."""
    right = right.withColumnsRenamed({"doc_id": "same_id", "print": "same"})
    return left.join(right, left["doc_id"].eqNullSafe(right["same_id"])
                     & (left["print"] == right["same"]), how).drop("same_id", "same")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, keep, gone in zip(batch.column("text"), batch.column("keep"),
                                    batch.column("n_dropped").to_pylist(), strict=True):
            text = text.as_buffer().to_pybytes()
            out.append(hashlib.sha256(kept(text, keep.as_py()) if gone else text).hexdigest())
        yield pa.record_batch({"doc_id": batch.column("doc_id"),
                               "n_lines": batch.column("n_lines"),
                               "n_dropped": batch.column("n_dropped"),
                               "kept_sha256": pa.array(out, pa.string())})


def kept(text: bytes, keep: bytes) -> bytes:
    """The text without the lines whose bit is not set."""
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines),
                         bitorder="little")
    return b"\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [kept(text.as_buffer().to_pybytes(), keep.as_py()).decode()
               for text, keep in zip(batch.column("text"), batch.column("keep"), strict=True)]
        yield pa.record_batch({"doc_id": batch.column("doc_id"),
                               "text": pa.array(out, pa.string())})


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left of every row of `docs`."""
    return (_joined(_ready(docs), keep_bitmaps(docs), "inner").select("doc_id", "text", "keep")
            .mapInArrow(_texts, "doc_id long, text string"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of `docs`."""
    rows = _joined(_ready(docs), keep_bitmaps(docs), "inner")
    return (rows.select("doc_id", "text", "n_lines", "n_dropped", "keep")
            .mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, "
                                  "kept_sha256 string"))


#: The same in DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12)
        || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MANY})
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id < keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
              FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM k LEFT JOIN m USING (key) GROUP BY doc_id
"""
