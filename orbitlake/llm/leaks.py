"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, in small letters (ASCII).  Hashed words are weighted by
idf = ln((n + 1) / (df + 1)) over all documents, less 2.5, and half at least: words that more than a
twelfth of the documents hold weigh little, but an item of such words only is still found.  Words that stand in three words of an item aren't counted
there, or an item copied into many documents would make its own words common.

1. Benchmark items are cut into passages of at most 16 words.  Blocks of passages are spread over
   tasks; in each the TF-IDF matrix is factorised by a randomised SVD (Gaussian sketch, one power
   step, small exact SVD), which gives each block a latent space of the words that occur in it.
   The space has as many dimensions as keep ENERGY of every passage, so an exact copy scores that
   cosine at least, however many passages there are.  A block has about 384 passages (an item's
   stay together), so what is sent to all executors for it is some 384 * 16 words times 384 floats
   (9 MB); TOGETHER blocks share a pass over the documents.
2. Every document is read whole in windows of 16 words, one each 4 words.  A window whose weight
   lies almost wholly in words that no passage of the block has cannot come near one and stops
   here; the others are moved into the latent space, and passages at a cosine of 0.4 or more are
   candidates.  Rarer words beside a short passage would swamp it there, so wherever two words in a
   row (one, of a passage of one word) are a passage's, the cosine is also taken over a window laid
   on the passage as those words lie in it, of just its length.
3. Each candidate's item is compared with the words around the window: the longest common
   subsequence must hold 60 % of the item's words, or 40 % if the answer is found as well.  The
   answer is the item's last sentence (of one with three words or more), which must be there word
   by word.

Null and empty texts, and items without words, match nothing.  Rows with equal text give equal
results, each under its own doc_id; repeated rows stay repeated.  Items with the same text are
reported under each item_id.  Only doc_id, text and item_id are looked at; empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitlake.llm import shared

#: Words in a window and in a passage at most, and from one window to the next.
WINDOW, STEP = 16, 4
#: Passages in a block, blocks in a pass; the share of each passage's square that a latent space
#: keeps at least.
BLOCK, TOGETHER, ENERGY = 384, 4, 0.99
#: Least cosine of a candidate; least shares of an item's words in order, without and with answer.
COSINE, WHOLE, PART = 0.4, 0.6, 0.4
#: Bits of the buckets of the document counts; what is taken from each idf, and the least weight.
BITS, COMMON, FLOOR = 18, 2.5, 0.5
#: Bits of the buckets of three words of an item.
TRIPLES = 22
#: Fitted windows that are looked at together.
FITTED = 1 << 15

def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows, _ = shared.runs(shared.LETTERS, data, offsets)
    return starts, ends, rows, shared.hashes(shared.LOWER[data], starts, ends)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _triples(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bucket of each three words in a row, by their first; -1 where a text ends before."""
    out = np.full(len(h), -1, np.int64)
    if len(h) > 2:
        step = np.uint64(0xA24BAED4963EE407)
        three = shared.mixed((h[:-2] * step + h[1:-1]) * step + h[2:])
        inside = rows[2:] == rows[:-2]
        out[:-2][inside] = (three >> np.uint64(64 - TRIPLES)).astype(np.int64)[inside]
    return out


def _item_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in shared.pieces(batch.column("text")):
            _, _, rows, h = _words(data, offsets)
            yield pa.record_batch({"bucket": pa.array(_triples(h, rows), pa.int32())})


def _counts(seen: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each bucket among the task's, and under -1 all of them."""
        total, documents = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, data, offsets in shared.pieces(batch.column("text")):
                _, _, rows, h = _words(data, offsets)
                triple = _triples(h, rows)
                held = seen[triple] & (triple >= 0)
                free = ~held
                for k in (1, 2):
                    free[k:] &= ~held[:len(held) - k]
                keys = np.sort((rows << BITS | _bucket(h))[free])
                keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)]]
                total += np.bincount(keys & (1 << BITS) - 1, minlength=1 << BITS)
        there = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(np.append(there, -1), pa.int32()),
                               "n": pa.array(np.append(total[there], documents), pa.int64())})
    return count


def idf(docs: DataFrame, items: DataFrame) -> np.ndarray:
    """The weight of each hash bucket.  2 ** 18 counts at most reach the driver and a table of
    2 ** 22 marks is sent out, at any size of documents and items."""
    seen = np.zeros(1 << TRIPLES, bool)
    marks = (items.select(shared.text_or_empty(items).alias("text"))
             .mapInArrow(_item_triples, "bucket int").where("bucket >= 0").distinct().toPandas())
    seen[marks["bucket"].to_numpy(np.int64)] = True
    rows = (shared.over_texts(docs.select(shared.text_or_empty(docs).alias("text")),
                              _counts(seen), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    df, documents = np.zeros(1 << BITS), 0
    for bucket, n in zip(rows["bucket"].to_numpy(), rows["n"].to_numpy(), strict=True):
        if bucket < 0:
            documents = n
        else:
            df[bucket] = n
    return np.maximum(np.log((documents + 1) / (df + 1)) - COMMON, FLOOR).astype(np.float32)


def _plain(text: str | None) -> list[bytes]:
    """The words of a text as the vectorised reader cuts them."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _, _ = shared.runs(shared.LETTERS, raw, np.array([0, len(raw)]))
    low = shared.LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _answer(text: str | None) -> list[bytes]:
    """The words of the last sentence that has three or more, if it isn't the whole text."""
    sentences = [s for s in re.split(r"[.!?\n]+", text or "") if len(_plain(s)) >= 3]
    return _plain(sentences[-1]) if len(sentences) > 1 else []


def _word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    cut = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return shared.hashes(data, cut[:-1], cut[1:])


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for item, text in zip(batch["item_id"], batch["text"], strict=True):
            words = _plain(text)
            if not words:
                continue
            h = _word_hashes(words).view(np.int64).tolist()
            answer = _word_hashes(_answer(text)).view(np.int64).tolist() if _answer(text) else []
            parts = -(-len(h) // WINDOW)
            cut = [len(h) * k // parts for k in range(parts + 1)]
            out += [(item, h, answer, a, b) for a, b in zip(cut, cut[1:], strict=False)]
        yield pd.DataFrame(out, columns=["item_id", "words", "answer", "first", "last"])


def _factorise(weights: np.ndarray):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        """Randomised SVD of the block's TF-IDF matrix: latent words and latent passages."""
        sides = [np.asarray(w, np.int64)[a:b].view(np.uint64) for w, a, b in
                 zip(rows["words"], rows["first"], rows["last"], strict=True)]
        flat = np.concatenate(sides)
        vocabulary, at = np.unique(flat, return_inverse=True)
        matrix = np.zeros((len(sides), len(vocabulary)))
        np.add.at(matrix, (np.repeat(np.arange(len(sides)), [len(s) for s in sides]), at),
                  weights[_bucket(flat)])
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        sketch = np.random.default_rng(7).standard_normal(
            (len(vocabulary), min(matrix.shape) + 16))
        base, _ = np.linalg.qr(matrix @ sketch)
        base, _ = np.linalg.qr(matrix @ (matrix.T @ base))
        _, _, right = np.linalg.svd(base.T @ matrix, full_matrices=False)
        latent = matrix @ right.T
        kept = (np.cumsum(latent ** 2, axis=1) >= ENERGY).all(axis=0)
        rank = int(kept.argmax()) + 1 if kept.any() else len(right)
        right = right[:rank].astype(np.float32)
        latent = latent[:, :rank].astype(np.float32)
        return pd.DataFrame([{
            "words": vocabulary.tobytes(), "basis": np.ascontiguousarray(right.T).tobytes(),
            "passages": latent.tobytes(), "rank": right.shape[0],
            "items": rows["item_id"].tolist(),
            "firsts": rows["first"].tolist(), "lasts": rows["last"].tolist(),
            "item_words": [np.asarray(w, np.int64).tobytes() for w in rows["words"]],
            "answers": [np.asarray(w, np.int64).tobytes() for w in rows["answer"]]}])
    return block


def _common(pattern: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the pattern."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for w in text.tolist():
        mask = masks.get(w)
        if mask:
            u = row & mask
            row = (row + u | row - u) & full
    return len(pattern) - row.bit_count()


def _share(words: np.ndarray, around: np.ndarray) -> float:
    """The share of the words that some stretch of half their number more holds in order."""
    at = np.flatnonzero(np.isin(around, words))
    span, found = len(words) + len(words) // 2, 0
    ends = np.searchsorted(at, at + span)
    reached = 0
    for first, last in enumerate(ends.tolist()):
        if last > reached:          # a stretch that holds words which no earlier one held
            found = max(found, _common(words, around[at[first:last]]))
            reached = last
            if found == len(words):
                break
    return found / len(words)


def _holds(text: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words of the run stand one after another in the text."""
    if not len(run) or len(run) > len(text):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(text, len(run)) == run).all(1).any())


class _Space:
    """A block of passages, as the tasks use it."""

    def __init__(self, row) -> None:
        self.words = np.frombuffer(row["words"], np.uint64)
        self.basis = np.frombuffer(row["basis"], np.float32).reshape(len(self.words), row["rank"])
        self.passages = np.frombuffer(row["passages"], np.float32).reshape(-1, row["rank"])
        self.items = list(row["items"])
        self.item_words = [np.frombuffer(w, np.uint64) for w in row["item_words"]]
        self.answers = [np.frombuffer(w, np.uint64) for w in row["answers"]]
        # a table of a bit for each hash head: most words are told apart without a search
        self.heads = np.zeros(1 << 20, bool)
        self.heads[(self.words >> np.uint64(44)).astype(np.int64)] = True
        # each word's part in each passage, seen through the latent space; the last of no word
        self.parts = np.zeros((len(self.passages), len(self.words) + 1), np.float32)
        np.matmul(self.passages, self.basis.T, out=self.parts[:, :-1])
        # where each two words in a row, or the only one, stand in passages
        own = [np.searchsorted(self.words, w[a:b]) for w, a, b in
               zip(self.item_words, row["firsts"], row["lasts"], strict=True)]
        self.lengths = np.array([len(q) for q in own])
        keys = [self.pairs(q[:-1], q[1:]) if len(q) > 1 else -1 - q for q in own]
        counts = np.array([len(k) for k in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(own)), counts)[order]
        self.offset = np.concatenate([np.arange(n) for n in counts])[order]
        self.keys, self.begin, self.times = np.unique(
            flat[order], return_index=True, return_counts=True)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self._mark(self.keys)] = True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.words) + b

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                >> np.uint64(44)).astype(np.int64)

    def runs(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words `at` whose keys stand in passages, and the places of those keys."""
        maybe = np.flatnonzero(self.marks[self._mark(keys)])
        found = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        good = self.keys[found] == keys[maybe]
        return at[maybe[good]], found[good]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.heads[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        good = self.words[at] == h[maybe]
        out[maybe[good]] = at[good]
        return out


def _windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each window; the last one of a text ends with it."""
    head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    length = np.diff(np.append(head, len(rows)))
    count = np.maximum(0, -(-(length - WINDOW) // STEP)) + 1
    text = np.repeat(np.arange(len(head)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(nth * STEP, np.maximum(length[text] - WINDOW, 0))
    return head[text] + first, head[text] + np.minimum(first + WINDOW, length[text])


def _weighed(first: np.ndarray, last: np.ndarray, value: np.ndarray):
    """Words of each window, which of them are inside, and their weights; WINDOW columns."""
    cell = first[:, None] + np.arange(WINDOW)
    inside = cell < last[:, None]
    cell[~inside] = 0
    return cell, inside, np.where(inside, value[cell], 0)


def _norms(words: np.ndarray, inside: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norms of the windows as bags: a word that is there n times has n times its weight."""
    times = ((words[:, :, None] == words[:, None, :]) & inside[:, None, :]).sum(2)
    return np.maximum(np.sqrt((weight.astype(np.float64) ** 2 * times).sum(1)), 1e-9)


def _fitted(h: np.ndarray, rows: np.ndarray, value: np.ndarray, place: np.ndarray, space: _Space
            ) -> Iterator[tuple[int, int, int, float]]:
    """(first and last word, passage, cosine) of the candidates of windows fitted to passages."""
    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
    one = np.flatnonzero(place >= 0)
    two = one[:-1][(np.diff(one) == 1) & (rows[one[1:]] == rows[one[:-1]])]
    for at, keys in ((two, space.pairs(place[two], place[two + 1])), (one, -1 - place[one])):
        at, key = space.runs(at, keys)
        until = np.cumsum(space.times[key])
        cuts = np.searchsorted(until, np.arange(0, until[-1] if len(until) else 0, FITTED), "right")
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=False):
            if a == b:
                continue
            times = space.times[key[a:b]]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            entry = np.repeat(space.begin[key[a:b]], times) + nth
            # a copy's runs all have one start; a window is clipped to the text of its run
            start = np.repeat(at[a:b], times) - space.offset[entry] + WINDOW
            text = np.repeat(np.searchsorted(edges, at[a:b], "right") - 1, times)
            number, texts = len(space.lengths), len(edges)
            start, text = np.divmod(np.unique(
                (start * number + space.owner[entry]) * texts + text), texts)
            start, p = np.divmod(start, number)
            first = np.maximum(start - WINDOW, edges[text])
            last = np.minimum(start - WINDOW + space.lengths[p], edges[text + 1])
            cell, inside, weight = _weighed(first, last, value)
            dot = (weight * space.parts[p[:, None], place[cell]]).sum(1)
            some = np.flatnonzero(dot >= COSINE * np.sqrt((weight ** 2).sum(1)))
            cosine = dot[some] / _norms(h[cell[some]], inside[some], weight[some])
            for w in np.flatnonzero(cosine >= COSINE).tolist():
                yield int(first[some[w]]), int(last[some[w]]), int(p[some[w]]), float(cosine[w])


def _matches(h: np.ndarray, rows: np.ndarray, weights: np.ndarray, space: _Space
             ) -> list[tuple[int, int, float, float, bool]]:
    """(row, item, cosine, share of its words in order, answer found) of each match."""
    if not len(h):
        return []
    value = weights[_bucket(h)]
    square = value.astype(np.float64) ** 2
    place = space.find(h)
    total = np.concatenate(([0.0], np.cumsum(square)))
    known = np.concatenate(([0.0], np.cumsum(np.where(place >= 0, square, 0))))
    first, last = _windows(rows)
    mass, part = total[last] - total[first], known[last] - known[first]
    near = np.flatnonzero((part >= COSINE ** 2 * mass) & (part > 0))
    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}

    def compare(a: int, b: int, p: int, cosine: float) -> None:
        words = space.item_words[p]
        key = (int(rows[a]), space.items[p])
        if key in best and best[key][0] == 1.0:
            return
        spot = np.searchsorted(edges, a, "right") - 1
        low = max(int(edges[spot]), a - len(words))
        around = h[low:min(int(edges[spot + 1]), b + len(words))]
        if np.isin(words, around).sum() < PART * len(words):
            return
        share = _share(words, around)
        answer = _holds(around, space.answers[p])
        if share >= WHOLE or share >= PART and answer:
            score = (share, cosine, answer)
            best[key] = max(best.get(key, score), score)

    for candidate in _fitted(h, rows, value, place, space):
        compare(*candidate)
    for base in range(0, len(near), 256):
        some = near[base:base + 256]
        cell, inside, weight = _weighed(first[some], last[some], value)
        norm = _norms(h[cell], inside, weight)
        at = place[cell]
        weight[at < 0] = 0
        latent = (weight[:, None, :] @ space.basis[np.maximum(at, 0)])[:, 0]
        cosine = latent @ space.passages.T / norm[:, None]
        for w, p in zip(*np.nonzero(cosine >= COSINE), strict=True):
            compare(int(first[some[w]]), int(last[some[w]]), p, float(cosine[w, p]))
    return [(row, item, cos, share, answer) for (row, item), (share, cos, answer)
            in best.items()]


def _spaces(items: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row for each block; a block's size is bounded, and the blocks are used a few at once."""
    passages = items.select(items["item_id"].cast("long").alias("item_id"),
                            items["text"].cast("string").alias("text")).mapInPandas(
        _passages, "item_id long, words array<long>, answer array<long>, first int, last int")
    blocks = max(1, -(-passages.count() // BLOCK))
    # an item's passages share a block
    return (passages.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
            .groupBy("block").applyInPandas(
                _factorise(weights), "words binary, basis binary, passages binary, rank int, "
                "items array<long>, firsts array<int>, lasts array<int>, item_words array<binary>, "
                "answers array<binary>"))


def _searched(docs: DataFrame, space_rows: list, weights: np.ndarray) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(
        ([row.asDict() for row in space_rows], weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of_spaces, by_bucket = shipped.value
        spaces = [_Space(r) for r in rows_of_spaces]
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for first, data, offsets in shared.pieces(batch.column("__text")):
                _, _, rows, h = _words(data, offsets)
                for space in spaces:
                    for row, *match in _matches(h, rows, by_bucket, space):
                        out[first + row].append(dict(zip(_MATCH.names, match, strict=True)))
            kept = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(out, _ARROW)],
                [*(batch.schema.names[i] for i in kept), "__matches"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__matches", T.ArrayType(_MATCH))])
    text = shared.text_or_empty(docs)
    return shared.over_texts(docs.select("*", text.alias("__text")), search, schema)


_MATCH = (T.StructType().add("item_id", "long").add("cosine", "double").add("share", "double")
          .add("answer", "boolean"))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()),
                             ("share", pa.float64()), ("answer", pa.bool_())]))


def matched(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of `docs` and its columns, with its matches as the array __matches."""
    weights = idf(docs, items)
    found = None
    for some in batched(_spaces(items, weights).toLocalIterator(), TOGETHER):
        found = _joined(_searched(docs if found is None else found, list(some), weights))
    return _joined(_searched(docs, [], weights)) if found is None else found


def _joined(found: DataFrame) -> DataFrame:
    """The matches of the last pass put together with those of the passes before."""
    if "__before" in found.columns:
        return found.withColumn("__before", F.concat("__before", "__matches")).drop("__matches")
    return found.withColumnRenamed("__matches", "__before")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share and answer of each item found in a row of `docs`."""
    rows = matched(docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")), items)
    return rows.select("doc_id", F.explode("__before").alias("m")).select("doc_id", "m.*")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found, with their columns."""
    return matched(docs, items).where(F.size("__before") == 0).drop("__before")
