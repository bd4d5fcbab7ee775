"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal steps.

A text is cut into words and runs of punctuation.  A word in capitals, a number and a word that
repeats the word before it are written as one class each; everything else is itself.  The features
are the hashed tokens and hashed pairs of neighbouring tokens, each valued by its share of the
text, so the score of a text is a sparse dot product: the mean of the weights of its n-grams.

Null and empty texts have no n-grams and are scored by the intercept alone.  Long texts are read
whole.  Rows are scored one by one, so repeated rows get equal scores; an empty table gives an
empty result.  Rows of `labels` with a null id, or a quality other than 0 and 1, are left out, and
of several labels of one id the largest counts; without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import shared

#: Hash buckets of the n-grams; the last one is the intercept.
BUCKETS = 1 << 18
#: At most so many labelled texts are learnt from: those whose id hashes lowest.
SAMPLE = 4096
#: A feature's value is this many times its share of the text.
SCALE = np.float32(40.0)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 4
#: A text is kept from this score on.
KEEP = 0.7

_CAPS, _NUMBER, _SAME, _START = (np.uint64(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                                 for x in (3, 5, 7, 11))


def _inside(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the single tokens, buckets of the pairs, row of each), aligned."""
    starts, ends, rows, kinds = shared.runs(shared.WORDS_AND_MARKS, data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    h = shared.hashes(shared.LOWER[data], starts, ends)
    length = ends - starts
    word = kinds == 1
    upper = _inside((data >= 65) & (data <= 90), starts, ends)
    lower = _inside((data >= 97) & (data <= 122), starts, ends)
    digit = _inside((data >= 48) & (data <= 57), starts, ends)
    at = np.flatnonzero(word)
    same = np.zeros(len(h), bool)
    same[at[1:]] = (h[at[1:]] == h[at[:-1]]) & (rows[at[1:]] == rows[at[:-1]])
    h = np.where(word & (upper > 1) & (lower == 0), _CAPS, h)
    h = np.where(word & (digit == length), _NUMBER, h)
    h = np.where(same, _SAME, h)
    before = np.concatenate(([_START], h[:-1]))
    before[np.concatenate(([True], rows[1:] != rows[:-1]))] = _START
    pair = shared.mixed(before * np.uint64(0xA24BAED4963EE407) + h)
    shift = np.uint64(64 - 18)
    bucket = [np.minimum((x >> shift).astype(np.int64), BUCKETS - 2) for x in
              (shared.mixed(h), pair)]
    return bucket[0], bucket[1], rows


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in shared.pieces(batch.column("text")):
            one, two, rows = ngrams(data, offsets)
            n = len(offsets) - 1
            tokens = np.bincount(rows, minlength=n)
            keys, counts = np.unique(np.concatenate((rows, rows)) * BUCKETS
                                     + np.concatenate((one, two)), return_counts=True)
            row, bucket = keys // BUCKETS, keys % BUCKETS
            value = SCALE / 2 * counts.astype(np.float32) / tokens[row]
            cut = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch({
                "place": batch.column("place").slice(first, n),
                "quality": batch.column("quality").slice(first, n),
                "bucket": pa.ListArray.from_arrays(cut, bucket.astype(np.int32)),
                "value": pa.ListArray.from_arrays(cut, value.astype(np.float32))})


def _ftrl(rows: pd.DataFrame) -> pd.DataFrame:
    """Per-coordinate FTRL-proximal steps over the rows in the order of their hash."""
    rows = rows.sort_values("place", kind="stable")
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.abs(z[at]) - L1
        step = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(over > 0, -np.sign(z[at]) * over / step, 0.0)

    examples = [(np.append(b, BUCKETS - 1), np.append(v, 1.0).astype(float), y) for b, v, y in
                zip(rows["bucket"], rows["value"], rows["quality"], strict=True)]
    for _ in range(EPOCHS):
        for at, x, y in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = np.arange(BUCKETS)
    w = weights(every)
    return pd.DataFrame({"bucket": every[w != 0].astype(np.int32), "weight": w[w != 0]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights by bucket, learnt from at most `sample` rows outside the held-out quarter.

    The rows learnt from are bounded by `sample` and their features by BUCKETS, so one task can
    take the steps and the driver can hold the weights.
    """
    known = (labels.where(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1))
             .select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality"))
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
             .where(~held_out(F.col("doc_id")))
             .withColumn("place", F.xxhash64("doc_id"))
             .orderBy("place", "doc_id").limit(sample))
    texts = (docs.select(docs["doc_id"].alias("doc_id"), shared.text_or_empty(docs).alias("text"))
             .join(F.broadcast(known), "doc_id").select("place", "quality", "text"))
    rows = shared.over_texts(texts, _features, "place long, quality int, bucket array<int>, "
                                               "value array<float>").orderBy("place").limit(sample)
    found = (rows.withColumn("all", F.lit(0)).groupBy("all")
             .applyInPandas(_ftrl, "bucket int, weight double").collect())
    weights = np.zeros(BUCKETS, np.float32)
    weights[[r.bucket for r in found]] = [r.weight for r in found]
    return weights


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for first, data, offsets in shared.pieces(column):
        one, two, rows = ngrams(data, offsets)
        n = len(offsets) - 1
        tokens = np.maximum(np.bincount(rows, minlength=n), 1)
        total = np.bincount(rows, weights[one] + weights[two], minlength=n)
        dot = float(weights[-1]) + float(SCALE) / 2 * total / tokens
        out[first:first + n] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
    return out


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score",
           text: str = "text") -> DataFrame:
    """Every row of `docs` and its columns, with the score as one more column."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(_scores(batch.column(text), shipped.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, values],
                                             [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return shared.over_texts(docs, score, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    weights = fit(docs, labels, sample)
    rows = scored(docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")), weights)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their columns."""
    rows = scored(docs, fit(docs, labels, sample), "__score")
    return rows.where(F.col("__score") >= KEEP).drop("__score")
