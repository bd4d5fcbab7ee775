"""N-gram Jaccard join by MinHash banding.

Texts are compared as sets of five-word shingles (words are split at ASCII white space; a text of
one to four words is one shingle).  Equal texts form one class; two classes are linked if the
Jaccard similarity of their sets is 0.8 or more.

1. Every row gets the digest of its text and the hashes of its MinHash bands.  The number of bands
   and the rows in each follow from the recall wanted at the threshold.
2. Rows of equal texts are merged before anything is shuffled by band.  A band hash shared by
   several classes ties each of them to the least, and the components of these ties are the groups
   within which links can lie.  A group is a chain of likely links, not one bucket.
3. Texts of groups only are turned into full shingle sets.  A group is cut into blocks of bounded
   size, and each pair of blocks is one task's work: its pairs are verified on the full sets, and
   what leaves the task are counts of links and a spanning forest, never all pairs.
4. Components of the verified links are the near-duplicate classes.

Null and empty texts have no shingles: they equal each other and link to nothing else.  Rows with
the same id, repeated rows and ties are counted row by row; null ids are allowed, and a class whose
ids are all null has a null id.  Columns other than doc_id and text are not looked at.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import graph, shared

#: Words in a shingle and the similarity from which texts are linked.
WORDS, LEAST = 5, 0.8
#: Wanted chance that a pair at the threshold shares a band, and the most hash functions for it.
RECALL, HASHES = 0.9999, 128
#: Classes in a block of a group.
BLOCK = 256


def bands(least: float = LEAST, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows in each): as many rows as the hash functions allow at the wanted recall."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - least))), 1)
    for rows in range(2, hashes + 1):
        needed = math.ceil(math.log(1 - recall) / math.log1p(-least ** rows))
        if needed * rows > hashes:
            break
        best = (needed, rows)
    return best


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows, _ = shared.runs(shared.SOLID, data, offsets)
    return shared.shingles(shared.hashes(data, starts, ends), rows, WORDS)


def band_hashes(data: np.ndarray, offsets: np.ndarray, count: int, rows: int) -> np.ndarray:
    """The band hashes of each text, one line a text; texts without words get zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, count), np.uint64)
    grams, owner = _sets(data, offsets)
    if not len(grams):
        return out
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    there = owner[head]
    # 32-bit values and odd multipliers: a multiply-shift family, cheap and mixing enough
    low, high = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32)
    draw = np.random.default_rng(20240229)
    for band in range(count):
        h = np.full(len(head), np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for _ in range(rows):
            a, b, c = (np.uint64(x | 1) for x in draw.integers(1, 1 << 63, 3, np.uint64))
            value = low * a
            value += high * b
            value += c
            h = shared.mixed(h * a + np.minimum.reduceat(value, head))
        out[there, band] = h
    return out


def _sign(count: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in shared.pieces(batch.column("text")):
                n = len(offsets) - 1
                found = band_hashes(data, offsets, count, rows)
                empty = ~found.any(axis=1)
                width = np.where(empty, 0, count)
                cut = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, n),
                    "print": batch.column("print").slice(first, n),
                    "bands": pa.ListArray.from_arrays(cut, found[~empty].ravel().view(np.int64))})
    return sign


def _binary_lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * 8).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in shared.pieces(batch.column("text")):
            n = len(offsets) - 1
            grams, owner = _sets(data, offsets)
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, owner = grams[new], owner[new]
            cut = np.searchsorted(owner, np.arange(n + 1))
            yield pa.record_batch({
                "print": batch.column("print").slice(first, n),
                "grams": _binary_lists(grams, cut)})


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    def flat(sets):
        return (np.concatenate(sets) if sets else np.zeros(0, np.uint64),
                np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (a, ra), (b, rb) = flat(left), flat(right)
    common = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float32)
    ka, kb = np.isin(a, common), np.isin(b, common)
    ca, cb = np.searchsorted(common, a[ka]), np.searchsorted(common, b[kb])
    ra, rb = ra[ka], rb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    wide = 8192
    for base in range(0, len(common), wide):
        x = np.zeros((len(left), wide), np.float32)
        y = np.zeros((len(right), wide), np.float32)
        i = slice(*np.searchsorted(ca, (base, base + wide)))
        j = slice(*np.searchsorted(cb, (base, base + wide)))
        x[ra[i], ca[i] - base] = 1
        y[rb[j], cb[j] - base] = 1
        total += x @ y.T
    return total


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the classes of two blocks of a group, or within one block: for each class the
    rows linked to it, and one link for each class that a spanning forest needs."""
    one, two = int(rows["one"].iloc[0]), int(rows["two"].iloc[0])
    a = rows[rows["block"] == one].reset_index(drop=True)
    b = rows[rows["block"] == two].reset_index(drop=True) if one != two else a
    sets_a, sets_b = ([np.frombuffer(g, np.uint64) for g in x["grams"]] for x in (a, b))
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (sets_a, sets_b))
    both = _overlaps(sets_a, sets_b).astype(np.int64)
    union = size_a[:, None] + size_b[None, :] - both
    link = (union > 0) & (both * 10 >= union * round(10 * LEAST))
    if one == two:
        np.fill_diagonal(link, False)
    copies_a, copies_b = a["copies"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)
    counts = [(p, int(n)) for p, n in zip(a["print"], link @ copies_b, strict=True) if n]
    if one != two:
        counts += [(p, int(n)) for p, n in zip(b["print"], link.T @ copies_a, strict=True) if n]
    parent = list(range(len(a) + (len(b) if one != two else 0)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    prints = [*a["print"], *(b["print"] if one != two else [])]
    shift = len(a) if one != two else 0
    ties = []
    for i in range(len(a)):
        for j in np.flatnonzero(link[i]):
            x, y = root(i), root(int(j) + shift)
            if x != y:
                parent[x] = y
                ties.append((prints[i], prints[int(j) + shift]))
    return pd.DataFrame([(p, n, None) for p, n in counts] + [(p, 0, q) for p, q in ties],
                        columns=["u", "links", "v"])


def signed(docs: DataFrame) -> DataFrame:
    """One row per different text: print, its smallest doc_id, copies and bands."""
    count, rows = bands()
    text = shared.text_or_empty(docs)
    each = shared.over_texts(docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"),
                                         F.unhex(F.md5(text)).alias("print")),
                             _sign(count, rows), "doc_id long, print binary, bands array<long>")
    return each.groupBy("print").agg(F.min("doc_id").alias("first_id"),
                                     F.count("*").alias("copies"),
                                     F.first("bands").alias("bands"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per different text: print, first_id, copies, links (linked rows of other texts),
    class_print and class_id (of the text with the smallest doc_id in its near-duplicate class)."""
    texts = shared.settle(signed(docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                                             docs["text"].alias("text"))))
    tied = texts.select("print", F.explode("bands").alias("band"))
    shared_band = (tied.groupBy("band").agg(F.min("print").alias("v"), F.count("*").alias("n"))
                   .where("n > 1").drop("n"))
    ties = (tied.join(shared_band, "band").where("print != v")
            .select(F.col("print").alias("u"), "v").distinct())
    star = graph.components(ties)
    teams = star.union(star.select("v", "v").distinct()).toDF("print", "team")
    # groups as large as a block or more are cut into blocks; each two blocks meet once
    sizes = teams.groupBy("team").agg(F.count("*").alias("members"))
    member = (teams.join(sizes, "team").join(texts, "print")
              .withColumn("cut", F.ceil(F.col("members") / BLOCK).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("print"), F.col("cut")).cast("int"))
              .select("print", "team", "copies", "cut", "block"))
    text = shared.text_or_empty(docs)
    whole = (docs.select(F.unhex(F.md5(text)).alias("print"), text.alias("text"))
             .groupBy("print").agg(F.first("text").alias("text")))
    sets = shared.over_texts(whole.join(member.select("print"), "print"), _full_sets,
                             "print binary, grams binary")
    meet = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two")))
    dealt = (sets.join(member, "print").withColumn("pair", F.explode(meet))
             .select("team", "pair.one", "pair.two", "block", "print", "copies", "grams"))
    found = shared.settle(dealt.groupBy("team", "one", "two").applyInPandas(
        _verify, "u binary, links long, v binary"))
    linked = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    star = graph.components(found.where("v is not null").select("u", "v"))
    named = (texts.select("print", "first_id", "copies")
             .join(star.toDF("print", "root"), "print", "left")
             .join(linked.withColumnRenamed("u", "print"), "print", "left")
             .withColumn("root", F.coalesce("root", "print"))
             .withColumn("links", F.coalesce("links", F.lit(0))))
    least = named.groupBy("root").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "print"))
        .alias("least"))
    return (named.join(least, "root")
            .select("print", "first_id", "copies", "links",
                    F.col("least.print").alias("class_print"),
                    F.col("least.first_id").alias("class_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every row of `docs`.

    copy_id is the smallest doc_id among the rows of the same text, class_id the smallest one
    among the rows that a chain of links joins to it, n_links the number of other rows whose text
    is equal or at least 0.8 similar.
    """
    found = classes(docs)
    text = shared.text_or_empty(docs)
    rows = docs.select(docs["doc_id"], F.unhex(F.md5(text)).alias("print"))
    return (rows.join(found, "print")
            .select("doc_id", F.col("first_id").alias("copy_id"), "class_id",
                    (F.col("copies") - 1 + F.col("links")).alias("n_links")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, with its columns."""
    found = classes(docs).where("print = class_print").select(F.col("print").alias("__print"))
    names = docs.columns
    row = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"),
                   F.struct(*[docs[c] for c in names]).alias("row"))
    each = (docs.select(F.unhex(F.md5(shared.text_or_empty(docs))).alias("__print"),
                        row.alias("__row"))
            .groupBy("__print").agg(F.min("__row").alias("__row")))
    return each.join(found, "__print").select("__row.row.*")
