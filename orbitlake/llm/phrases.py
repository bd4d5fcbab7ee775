"""Collocations: phrases of two or three words that hold together more than their parts explain.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and pieces into words
at spaces and tabs.  Everything is counted within a language (null: 'und').

1. Words are counted by their 64-bit hashes, and the texts are written down once as blocks of one
   language each: the different hashes of a block, and which of them stands at each place, a zero
   between pieces.
2. Apriori: a phrase that occurs MANY times is made of words that do, so blocks keep only these.
   Hashed totals of their pairs and triples give upper bounds; a phrase stays a candidate only if
   the bounds of it and of the pairs inside it reach MANY.  False candidates cost time, no phrase
   is lost.
3. Candidates become double-array tries over word numbers.  In a block numpy moves the states of
   all text positions at once, one word a level, and bincounts the accepting states; the sums of all
   blocks are the exact counts.
4. A small corpus has one filter of BITS bits, which is broadcast; a few blocks are searched for
   candidates first, the others give those that are not known yet, and shards of about SHARD
   candidates are broadcast as tries, a few at a time.  A filter and shards for a larger corpus would
   grow with it, and so would the passes over its blocks.  There, neighbouring blocks make lots of
   about LOT words.  Totals are dealt by hash to classes of BITS bits, a lot is told which of its
   own bits reach MANY, counts its own candidates by a trie of its own, and its counts are dealt by
   hash and added up: two passes, whatever the size.
5. Counts of pairs meet the triples they are in by equal joins, and every language is ranked in
   salts; only what is as good as the last of the best is spelt out, by reading the texts again.

Null and empty texts have no words; texts are read whole; repeated rows count each; columns other
than text and lang don't matter; ties are ordered by the phrase's bytes, and an empty table gives
an empty result.  Different words of one language are taken to differ in their 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared
from orbitlake.operators.keyed import top_k

#: Occurrences of a candidate; percentage of them inside a longer one that drops it; length of a
#: language's list.
MANY, INSIDE, BEST = 10, 50, 2000
#: Phrases of a shard; shards broadcast at once; bits of a filter (a power of two); bytes of text in a block.
SHARD, SHARDS, BITS, BLOCK = 1 << 18, 4, 1 << 25, 1 << 20
#: Bits of a page of totals (two bytes number them); blocks are dealt to so many parts, and the
#: candidates looked for in these runs of them; candidates of earlier runs that the next one is told.
TOTALS, PARTS, RUNS, KNOWN = 1 << 16, 16, (0, 1, 4, 16), 1 << 20
#: Bits of a page of a filter; words whose counts a task puts together before it passes them on.
PAGE, HELD = 1 << 12, 1 << 19
#: Classes of phrases for each MANY * BITS words: at 32 few rare pairs share a bit with a frequent one.
CROWD = 32
#: Counts of a page of a shard's sums.
SUMS = 1 << 16
#: Words of a lot; frequent words that have a number, by which lots name them.
LOT, NAMES = 1 << 21, 1 << 20

_MARKS = np.zeros(256, np.uint8)
_MARKS[[*b".,;:!?", *range(10, 14)]] = 1
_WORDS = np.ones(256, np.uint8)
_WORDS[[32, 9, *np.flatnonzero(_MARKS)]] = 0
_STEP = np.uint64(0xA24BAED4963EE407)


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                       shared.text_or_empty(docs).alias("text"))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, lower-case bytes, offsets) of the rows of a batch, a language at a time."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        rows = batch.column("text").take(pa.array(np.flatnonzero(codes == code)))
        for _, data, offsets in shared.pieces(rows, BLOCK):
            yield lang, shared.LOWER[data], offsets


def word_runs(data: np.ndarray, offsets: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and whether a word begins another piece than the last one."""
    starts, ends, rows, _ = shared.runs(_WORDS, data, offsets)
    marks = np.cumsum(_MARKS[data])
    piece = np.stack((rows, marks[starts])) if len(starts) else np.zeros((2, 0), np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (piece[:, 1:] != piece[:, :-1]).any(0)
    return starts, ends, fresh


def word_hashes(lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    own = np.frombuffer(lang.encode(), np.uint8)
    salt = shared.hashes(own, np.zeros(1, np.int64), np.array([len(own)])) * _STEP
    h = shared.mixed(shared.hashes(data, starts, ends) ^ salt)
    return np.maximum(h, np.uint64(1))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and their counts, put together over as many slices as HELD words allow."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    n = 0

    def together() -> Iterator[pa.RecordBatch]:
        if held:
            h, counts = (np.concatenate([part[i] for part in held]) for i in (0, 1))
            h, first, own = np.unique(h, return_index=True, return_inverse=True)
            lang = pa.concat_arrays([part[2] for part in held]).take(pa.array(first))
            yield pa.record_batch({"lang": lang, "h": pa.array(h.view(np.int64)),
                                   "n": pa.array(np.bincount(own, counts).astype(np.int64))})
        held.clear()
    for batch in batches:
        for lang, data, offsets in _slices(batch):
            starts, ends, _ = word_runs(data, offsets)
            h, counts = np.unique(word_hashes(lang, data, starts, ends), return_counts=True)
            held.append((h, counts, pa.array([lang] * len(h), pa.string())))
            n += len(h)
            if n >= HELD:
                yield from together()
                n = 0
    yield from together()


def _spellings(wanted):
    """The words whose hashes may be wanted, each once a task."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.uint64)
        for batch in batches:
            for lang, data, offsets in _slices(batch):
                starts, ends, _ = word_runs(data, offsets)
                h, first = np.unique(word_hashes(lang, data, starts, ends), return_index=True)
                new = np.flatnonzero(_has(wanted.value, h) & ~np.isin(h, told))
                told = np.concatenate((told, h[new]))
                raw, at = data.tobytes(), first[new]
                words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(),
                                                           strict=True)]
                yield pa.record_batch({"h": pa.array(h[new].view(np.int64)),
                                       "word": pa.array(words, pa.string())})
    return spell


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, data, offsets in _slices(batch):
            starts, ends, fresh = word_runs(data, offsets)
            out = np.zeros(len(starts) + int(fresh.sum()), np.uint64)
            out[np.arange(len(starts)) + np.cumsum(fresh)] = word_hashes(lang, data, starts, ends)
            words, codes = np.unique(out, return_inverse=True)
            yield pa.record_batch({
                "lang": pa.array([lang], pa.string()),
                "words": pa.array([words.tobytes()], pa.binary()),
                "codes": pa.array([codes.astype(_code_type(len(words))).tobytes()], pa.binary())})


def _lots(most: int, common):
    """Blocks of the words that may be frequent, and their lots: neighbours in a task, of about
    `most` words together."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, n = TaskContext.get().partitionId() << 32, 0
        for block in _blocks(batches):
            (words, codes), = _words_of(block)
            if n and n + len(codes) > most:
                lot, n = lot + 1, 0
            n += len(codes)
            there = _has(common.value, words)
            words = np.concatenate((np.zeros(1, np.uint64), words[there]))
            codes = np.where(there, np.cumsum(there), 0).astype(_code_type(len(words)))[codes]
            yield pa.record_batch({
                "lang": block.column("lang"), "words": pa.array([words.tobytes()], pa.binary()),
                "codes": pa.array([codes.tobytes()], pa.binary()),
                "lot": pa.array([lot], pa.int64())})
    return deal


def _code_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


# --- Apriori filters ---

def _pairs_and_triples(words: np.ndarray, some: tuple[int, int]
                       ) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the pair, and of the triple, that begins at each place; 0 where there is none or
    its first word is of another class than the one asked for (class, classes)."""
    pair, triple = np.zeros_like(words), np.zeros_like(words)
    pair[:-1] = np.where((words[:-1] != 0) & (words[1:] != 0),
                         shared.mixed(words[:-1] * _STEP + words[1:]), np.uint64(0))
    triple[:-2] = np.where((pair[:-2] != 0) & (pair[1:-1] != 0),
                           shared.mixed(pair[:-2] * _STEP + pair[1:-1]), np.uint64(0))
    if some[1] > 1:
        own = (words >> np.uint64(32)) % np.uint64(some[1]) == np.uint64(some[0])
        pair, triple = np.where(own, pair, np.uint64(0)), np.where(own, triple, np.uint64(0))
    return pair, triple


def _bits(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The bit of each hash in filters of this size."""
    return (h % np.uint64(8 * len(bitmap))).astype(np.int64)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bits(h, bitmap)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (h != 0)


def _bitmap(pages: DataFrame, page: int = PAGE) -> np.ndarray:
    """The filter whose pages are given, as bytes: at most BITS / 8 of them come to the driver."""
    out = np.zeros((-(-BITS // page), page // 8), np.uint8)
    for row in pages.toLocalIterator():
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _word_pages(words: DataFrame) -> DataFrame:
    # BITS is a power of two, so the sign of a hash doesn't change its remainder
    bit = F.pmod("h", F.lit(BITS).cast("long"))
    return (words.select((bit / PAGE).cast("int").alias("page"), (bit % PAGE).cast("int")
                         .alias("bit")).groupBy("page").agg(F.collect_set("bit").alias("bits"))
            .mapInArrow(_paged, "page int, bits binary"))


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bits in batch.column("bits"):
            page = np.zeros(PAGE, bool)
            page[bits.values.to_numpy()] = True
            out.append(np.packbits(page, bitorder="little").tobytes())
        yield pa.record_batch({"page": batch.column("page"), "bits": pa.array(out, pa.binary())})


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different words of each block, and which of them stands at each place."""
    for block, codes in zip(batch.column("words"), batch.column("codes"), strict=True):
        words = np.frombuffer(block.as_buffer(), np.uint64)
        yield words, np.frombuffer(codes.as_buffer(), _code_type(len(words)))


def _bounds(filters, some: tuple[int, int], level: int):
    """Totals by bit of a task's pairs, or of its triples whose pairs may be frequent: a byte for
    each bit, which stops at 255, in pages that tell those above 0."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, pairs = filters.value
        totals = np.zeros(8 * len(common), np.uint8)
        for batch in batches:
            for words, codes in _words_of(batch):
                words = np.where(_has(common, words), words, np.uint64(0))[codes]
                pair, triple = _pairs_and_triples(words, some)
                h = pair[pair != 0] if level == 2 else triple[_both(pairs, pair) & (triple != 0)]
                bit, n = np.unique(_bits(h, common), return_counts=True)
                totals[bit] = np.minimum(totals[bit] + n, 255)
        pages = totals.reshape(-1, min(TOTALS, len(totals)))
        there = np.flatnonzero(pages.any(1))
        for some_pages in np.array_split(there, -(-len(there) // 64) or 1):
            yield pa.record_batch({
                "page": pa.array(some_pages.astype(np.int32)),
                "totals": pa.array([_sparse(pages[p]) for p in some_pages.tolist()], pa.binary())})
    return count


def _sparse(totals: np.ndarray) -> bytes:
    """Totals of a page, few of them above 0: the zeros before each of these, as low and as high
    bytes, and the totals themselves; deflated."""
    at = np.flatnonzero(totals)
    zeros = np.diff(at, prepend=-1) - 1
    return zlib.compress(np.stack((zeros & 255, zeros >> 8, totals[at])).astype(np.uint8)
                         .tobytes(), 1)


def _spread(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and totals of a page."""
    low, high, totals = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1) \
        .astype(np.int64)
    return np.cumsum(low + (high << 8) + 1) - 1, totals


def _summed(many: int, page: int):
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(page, np.int64)
        for packed in rows["totals"]:
            at, own = _spread(packed)
            total[at] += own
        return pd.DataFrame({"page": [rows["page"].iloc[0]],
                             "bits": [np.packbits(total >= many, bitorder="little").tobytes()]})
    return add


def _both(pairs: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Where a triple's first pair may be frequent, and its second if it is of the same class."""
    two = _has(pairs, pair)
    two[:-1] &= two[1:] | (pair[1:] == 0)
    return two


def _known(found: DataFrame | None, count: int) -> np.ndarray:
    """Hash and words of at most about KNOWN candidates, by hash."""
    if not count:
        return np.zeros((4, 0), np.uint64)
    share = F.pmod(F.xxhash64("h3", "h2", "h1"), F.lit(-(-count // KNOWN))) == 0
    rows = found.where(share).select("h1", "h2", "h3").toArrow()
    one, two, three = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2", "h3"))
    pair = shared.mixed(one * _STEP + two)
    h = np.where(three == 0, pair, shared.mixed(pair * _STEP + shared.mixed(two * _STEP + three)))
    return np.stack((h, one, two, three))[:, np.argsort(h)]


def _new(known: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Which columns (hash and words) of `phrases` are not among the known ones."""
    if not known.shape[1]:
        return np.ones(phrases.shape[1], bool)
    at = np.minimum(np.searchsorted(known[0], phrases[0]), known.shape[1] - 1)
    return (known[:, at] != phrases).any(0)


def _bounded(words: np.ndarray, pair: np.ndarray, triple: np.ndarray, pairs: np.ndarray,
             triples: np.ndarray) -> Iterator[np.ndarray]:
    """Hash and words of the different pairs, then triples, of a block that may be frequent."""
    two = _has(pairs, pair)
    three = _has(triples, triple) & _both(pairs, pair)
    for h, there, n in ((pair, two, 2), (triple, three, 3)):
        at = np.flatnonzero(there)
        at = at[np.unique(h[at], return_index=True)[1]]
        last = words[at + 2] if n == 3 else np.zeros(len(at), np.uint64)
        yield np.stack((h[at], words[at], words[at + 1], last))


def _candidates(filters, some: tuple[int, int], told):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, pairs, triples = filters.value
        known = told.value
        for batch in batches:
            for lang, (words, codes) in zip(batch.column("lang").to_pylist(), _words_of(batch),
                                            strict=True):
                words = np.where(_has(common, words), words, np.uint64(0))[codes]
                for phrases in _bounded(words, *_pairs_and_triples(words, some), pairs, triples):
                    phrases = phrases[:, _new(known, phrases)].view(np.int64)
                    yield pa.record_batch({
                        "lang": pa.array([lang] * phrases.shape[1], pa.string()), **{
                            name: pa.array(x) for name, x in
                            zip(("h1", "h2", "h3"), phrases[1:], strict=True)}})
    return find


def _found(blocks: DataFrame, filters, some: tuple[int, int]) -> tuple[DataFrame, int]:
    """The candidates of a class, and how many they are.  A frequent phrase is in many tasks, and
    each would pass it on: so a few of the blocks are read first, and the others give only what
    these have not."""
    context = blocks.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("codes"), F.lit(PARTS))
    found, count = None, 0
    for first, last in zip(RUNS, RUNS[1:], strict=False):
        told = context.broadcast(_known(found, count))
        more = shared.settle(blocks.where((part >= first) & (part < last)).mapInArrow(
            _candidates(filters, some, told), "lang string, h1 long, h2 long, h3 long").distinct())
        told.unpersist()
        if found is not None:
            # those that the run was not told may be there twice
            more = found.union(more) if count <= KNOWN else \
                shared.settle(found.union(more).distinct())
        found, count = more, more.count()
    return found, count


# --- tries ---

class Trie:
    """A double-array trie: the child of state s by digit c is t = base[s] + c if check[t] == s.

    Words are numbered by the order of their hashes and take two digits each, so that no state has
    more than about a root of their number of children.  State 0 is the root, slots without a
    state have check -1.
    """

    def __init__(self, symbols: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.symbols, self.base, self.check = symbols, base, check
        self.radix = radix(len(symbols))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The number of each word; -1 for words that have none."""
        at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where(self.symbols[at] == words, at, -1)

    def _digit(self, states: np.ndarray, digits: np.ndarray) -> np.ndarray:
        to = self.base[states] + digits
        good = (states >= 0) & (digits >= 0) & (to >= 0) & (to < len(self.check))
        to = np.where(good, to, 0)
        return np.where(good & (self.check[to] == states), to, -1)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states behind the next words; -1 where there is none."""
        between = self._digit(states, np.where(codes >= 0, codes // self.radix, -1))
        return self._digit(between, codes % self.radix)


def radix(symbols: int) -> int:
    return max(1, int(np.ceil(np.sqrt(symbols))))


def build(phrases: np.ndarray) -> tuple[Trie, np.ndarray]:
    """The trie of different rows of up to three word hashes (0 behind the last), and the state
    that accepts each row."""
    symbols = np.unique(phrases[phrases != 0])
    wide = radix(len(symbols))
    codes = np.where(phrases == 0, -1, np.searchsorted(symbols, phrases)).astype(np.int64)
    digits = np.stack([np.where(codes < 0, -1, d) for d in (codes // wide, codes % wide)],
                      axis=2).reshape(len(codes), -1)
    # nodes of each level: different prefixes, named by (parent, digit)
    node = np.zeros(len(phrases), np.int64)
    parents, labels, total = [np.array([-1])], [np.array([0])], 1
    for level in range(digits.shape[1]):
        there = np.flatnonzero(digits[:, level] >= 0)
        name, own = np.unique(node[there] * wide + digits[there, level], return_inverse=True)
        node[there] = total + own
        parents.append(name // wide)
        labels.append(name % wide)
        total += len(name)
    parent, label = np.concatenate(parents), np.concatenate(labels)
    order = np.argsort(parent[1:], kind="stable") + 1
    heads, first, n = np.unique(parent[order], return_index=True, return_counts=True)
    slot, base_of = np.zeros(total, np.int64), np.zeros(total, np.int64)
    taken = _places(heads, first, n, order, label, slot, base_of, wide)
    # only children fill what is left free
    alone = np.flatnonzero(n == 1)
    kids = order[first[alone]]
    free = np.flatnonzero(~taken)[:len(kids)]
    free = np.concatenate((free, len(taken) + np.arange(len(kids) - len(free))))
    slot[kids] = free
    base_of[heads[alone]] = slot[kids] - label[kids]
    size = int(slot.max()) + 1
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent[1:]]
    return Trie(symbols, base, check), slot[node]


def _places(heads, first, n, order, label, slot, base_of, wide: int) -> np.ndarray:
    """Slots for the children of all states with several, the most first: the first base of a
    stretch at which all of them are free.  A stretch without one is left behind for good."""
    stretch = 4 * wide + 64
    taken = np.zeros(max(4 * stretch, 2 * len(slot)), bool)
    taken[0] = True
    low, last = 1, 0
    for i in np.argsort(-n, kind="stable").tolist():
        if n[i] == 1:
            break
        if n[i] != last and n[i] < 8:
            low = 1     # few children find room between those of larger states
        last = n[i]
        kids = order[first[i]:first[i] + n[i]]
        digits = label[kids]
        while True:
            if low + stretch + wide > len(taken):
                taken = np.concatenate((taken, np.zeros(len(taken), bool)))
            blocked = taken[low + digits[0]:low + digits[0] + stretch].copy()
            for d in digits[1:].tolist():
                blocked |= taken[low + d:low + d + stretch]
            at = int(blocked.argmin())
            if not blocked[at]:
                break
            low += stretch
        base_of[heads[i]] = low + at
        slot[kids] = low + at + digits
        taken[slot[kids]] = True
    return taken


_SHARD = ("shard int, symbols binary, base binary, checks binary, phrases binary, "
          "accepts binary, langs array<string>")
_SUMS = "shard int, first int, n int, sums binary"
_FOUND = "lang string, h1 long, h2 long, h3 long, first long, last long, a long"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The trie of a shard's phrases and of each of their words alone, whose counts it gives too."""
    phrases = rows[["h1", "h2", "h3"]].to_numpy(np.int64).view(np.uint64)
    words = np.unique(phrases[phrases != 0])
    alone = np.zeros((len(words), 3), np.uint64)
    alone[:, 0] = words
    trie, accepts = build(np.concatenate((phrases, alone)))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "langs": [rows["lang"].tolist()], **{
        name: [np.ascontiguousarray(x).tobytes()] for name, x in (
            ("symbols", trie.symbols), ("base", trie.base), ("checks", trie.check),
            ("phrases", phrases), ("accepts", accepts.astype(np.int32)))}})


def _counted(tries):
    """Occurrences of the accepting states of each shard, in a task's whole partition."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(Trie(*(np.frombuffer(r[c], t) for c, t in (
            ("symbols", np.uint64), ("base", np.int32), ("checks", np.int32)))), r)
            for r in tries.value]
        sums = [np.zeros(len(trie.check), np.int64) for trie, _ in ready]
        held: list[list[np.ndarray]] = [[] for _ in ready]

        def add(i: int, at_least: int) -> None:
            """Counts what is held once there is so much of it that it is worth a pass over all."""
            if sum(map(len, held[i])) >= max(at_least, 1):
                sums[i] += np.bincount(np.concatenate(held[i]), minlength=len(sums[i]))
                held[i].clear()
        for batch in batches:
            for different, own in _words_of(batch):
                for i, (trie, _) in enumerate(ready):
                    codes = trie.codes(different)[own]
                    at = np.flatnonzero(codes >= 0)
                    states = np.zeros(len(at), np.int64)
                    for _ in range(3):
                        inside = at < len(codes)
                        states = trie.step(states[inside], codes[at[inside]])
                        at = at[inside][states >= 0]
                        states = states[states >= 0]
                        held[i].append(states.astype(np.int32))
                        at = at + 1
                    add(i, len(sums[i]))
        for i, (_, r) in enumerate(ready):
            add(i, 1)
            n = sums[i][np.frombuffer(r["accepts"], np.int32)]
            firsts = range(0, len(n), SUMS)
            pages = [n[first:first + SUMS] for first in firsts]
            yield pa.record_batch({
                "shard": pa.array(np.full(len(pages), r["shard"], np.int32)),
                "first": pa.array(firsts, pa.int32()),
                "n": pa.array([len(page) for page in pages], pa.int32()),
                "sums": pa.array([_packed(page) for page in pages], pa.binary())})
    return count


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """A page's counts over all tasks."""
    total = np.zeros(rows["n"].iloc[0], np.int64)
    for packed in rows["sums"]:
        total += _unpacked(packed, len(total))
    return rows.head(1).assign(sums=[_packed(total)])


def _packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small or 0: a byte each, 255 for those that follow in full; deflated."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + counts[small == 255].astype(np.int64).tobytes(), 1)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=n)
    return counts


def _told(rows: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
    """A shard's phrases with their counts and those of their first and last words."""
    r = tries.iloc[0]
    phrases = np.frombuffer(r["phrases"], np.uint64).reshape(-1, 3)
    words = np.unique(phrases[phrases != 0])
    total = np.zeros(len(phrases) + len(words), np.int64)
    for first, n, packed in zip(rows["first"], rows["n"], rows["sums"], strict=True):
        total[first:first + n] = _unpacked(packed, n)
    a, f = total[:len(phrases)], total[len(phrases):]
    last = np.where(phrases[:, 2] != 0, phrases[:, 2], phrases[:, 1])
    keep = np.flatnonzero(a >= MANY)
    h = phrases[keep].view(np.int64)
    return pd.DataFrame({
        "lang": np.asarray(r["langs"], object)[keep], "h1": h[:, 0], "h2": h[:, 1],
        "h3": h[:, 2], "first": f[np.searchsorted(words, phrases[keep, 0])],
        "last": f[np.searchsorted(words, last[keep])], "a": a[keep]})


def phrase_counts(blocks: DataFrame, words: DataFrame, common: np.ndarray, total: int
                  ) -> DataFrame:
    """lang, h1, h2, h3 (0 for pairs), the counts of the first and the last word, and a, of all
    phrases of at least MANY occurrences, `total` words being in the texts.  Where one filter
    would be crowded, every lot of blocks has filters and a trie of its own."""
    classes = max(1, -(-CROWD * total // (MANY * BITS)))
    if classes == 1:
        return _class_counts(blocks, common, (0, 1))
    return _lot_counts(blocks, words, classes)


def _class_counts(blocks: DataFrame, common: np.ndarray, some: tuple[int, int]) -> DataFrame:
    context = blocks.sparkSession.sparkContext
    filters = [common, np.zeros(0, np.uint8)]
    size = min(TOTALS, BITS)
    for level in (2, 3):
        held = context.broadcast((common, filters[1]))
        pages = (blocks.mapInArrow(_bounds(held, some, level), "page int, totals binary")
                 .groupBy("page").applyInPandas(_summed(MANY, size), "page int, bits binary"))
        filters[level - 1:] = [_bitmap(shared.settle(pages), size)]
        held.unpersist()
    held = context.broadcast(tuple(filters))
    found, count = _found(blocks, held, some)
    held.unpersist()
    shards = -(-count // SHARD)
    if not shards:
        return blocks.limit(0).select(*(F.lit(None).cast(t.split()[1]).alias(t.split()[0])
                                        for t in _FOUND.split(", ")))
    tries = shared.settle(found.withColumn("shard", F.pmod(
        F.xxhash64("h1", "h2", "h3"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(_built, _SHARD))
    counts = []
    for first in range(0, shards, SHARDS):
        some_tries = tries.where(F.col("shard").between(first, first + SHARDS - 1))
        part = some_tries.select("shard", "symbols", "base", "checks", "accepts").collect()
        held = context.broadcast([{k: bytes(x) if isinstance(x, bytearray) else x
                                   for k, x in r.asDict().items()} for r in part])
        sums = (blocks.mapInArrow(_counted(held), _SUMS).groupBy("shard", "first")
                .applyInPandas(_added, _SUMS))
        counts.append(shared.settle(sums.groupBy("shard").cogroup(
            some_tries.select(F.col("shard").alias("own"), "phrases", "langs").groupBy("own"))
            .applyInPandas(_told, _FOUND)))
        held.unpersist()
    return reduce(DataFrame.union, counts)


# --- lots ---

_BOUNDS = "lot long, class int, n int, totals binary"
_REACHED = "lot long, class int, bits binary"
_PARTS = "shard int, n int, codes binary, others binary, sums binary"


def _lot_counts(blocks: DataFrame, words: DataFrame, classes: int) -> DataFrame:
    """phrase_counts of a large corpus.  What is counted goes to the totals of its class and what
    may be frequent is told to the lot that asked, so that however many lots and phrases there
    are, the blocks are read twice, and no task or broadcast holds more."""
    names = blocks.sparkSession.sparkContext.broadcast(_names(words))
    reached = (blocks.mapInArrow(_lot_bounds(classes, BITS), _BOUNDS)
               .groupBy("class").applyInPandas(_reached(MANY, BITS), _REACHED))
    parts = (blocks.groupBy("lot").cogroup(reached.groupBy("lot"))
             .applyInPandas(_lot_counted(classes, BITS, names), _PARTS))
    sums = shared.settle(parts.groupBy("shard").applyInPandas(
        _merged(MANY, names), "h1 long, h2 long, h3 long, a long"))
    names.unpersist()
    first = words.select("lang", F.col("h").alias("h1"), F.col("f").alias("first"))
    last = words.select(F.col("h").alias("end"), F.col("f").alias("last"))
    end = F.when(F.col("h3") != 0, F.col("h3")).otherwise(F.col("h2"))
    return shared.settle(sums.join(first, "h1").withColumn("end", end).join(last, "end")
                         .select(*(t.split()[0] for t in _FOUND.split(", "))))


def _names(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of at most NAMES of the most frequent words, in order, and their numbers from 1, the
    most frequent first."""
    size = F.floor(F.log2("f")).cast("int")
    total, least = 0, 64
    for row in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        total += row["count"]
        if total > NAMES:
            break
        least = row["size"]
    rows = words.where(size >= least).select("h", "f").toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    number = np.empty(len(h), np.uint32)
    number[np.lexsort((h, -rows["f"].to_numpy()))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], number[order]


def _named(words: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers of words: 0 where there is none, one more than there are names for those without."""
    h, number = names
    if not len(h):
        return (words != 0).astype(np.uint32)
    at = np.minimum(np.searchsorted(h, words), len(h) - 1)
    return np.where(words == 0, 0, np.where(h[at] == words, number[at], len(h) + 1)).astype("<u4")


def _coded(codes: np.ndarray, phrases: np.ndarray, names: int) -> tuple[bytes, bytes]:
    """Phrases as their words' numbers, a plane for each byte, and the hashes of words without."""
    planes = codes.view(np.uint8).reshape(-1, 12).T
    return (pa.compress(planes.tobytes(), "zstd", asbytes=True),
            phrases[codes > names].tobytes())


def _decoded(packed: bytes, others: bytes, n: int, names: tuple[np.ndarray, np.ndarray]
             ) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 12 * n, "zstd"), np.uint8).reshape(12, n)
    codes = np.ascontiguousarray(planes.T).view("<u4")
    h, number = names
    words = np.zeros(len(h) + 2, np.uint64)
    words[number] = h
    phrases = words[codes]
    phrases[codes > len(h)] = np.frombuffer(others, np.uint64)
    return phrases


def _phrases_of(words: np.ndarray, codes: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, and hashes of the pairs and triples that begin there."""
    words = words[codes]
    return words, *_pairs_and_triples(words, (0, 1))


def _totals_of(lot: list[tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int, bits: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of a lot's phrases, in order, how often each, and where each class of them begins: first
    the classes of pairs, then those of triples, of `bits` bits each."""
    span = np.uint64(classes * bits)
    bit, n = np.unique(np.concatenate([h[h != 0] % span + np.uint64(level) * span
                                       for _, *hashes in lot for level, h in enumerate(hashes)]),
                       return_counts=True)
    return bit, n, np.searchsorted(bit, np.arange(2 * classes + 1, dtype=np.uint64)
                                   * np.uint64(bits))


def _lot_bounds(classes: int, bits: int):
    """Totals by bit of the phrases of each lot, a row for each class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list = []
        own = None

        def told() -> Iterator[pa.RecordBatch]:
            bit, n, cuts = _totals_of(lot, classes, bits)
            lot.clear()
            there = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch({
                "lot": pa.array(np.full(len(there), own, np.int64)),
                "class": pa.array(there.astype(np.int32)),
                "n": pa.array(np.diff(cuts)[there].astype(np.int32)),
                "totals": pa.array([_gaps(bit[a:b] - np.uint64(c * bits), n[a:b]) for c, a, b in
                                    zip(there.tolist(), cuts[there], cuts[there + 1],
                                        strict=True)], pa.binary())})
        for batch in batches:
            for other, block in zip(batch.column("lot").to_pylist(), _words_of(batch),
                                    strict=True):
                if lot and other != own:
                    yield from told()
                own = other
                lot.append(_phrases_of(*block))
        if lot:
            yield from told()
    return count


def _gaps(bits: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending bits as the steps between them, a plane for each byte, and counts up to 255."""
    steps = np.diff(bits.astype(np.int64), prepend=-1).astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.concatenate((steps.T, np.minimum(n, 255).astype(np.uint8)[None]))
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _ungapped(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, 5 * n, "zstd"), np.uint8).reshape(5, n)
    steps = np.ascontiguousarray(planes[:4].T).view("<u4")[:, 0]
    return np.cumsum(steps, dtype=np.int64) - 1, planes[4]


def _reached(many: int, bits: int):
    """Which of the bits that each lot told of a class have totals of at least `many` in all lots."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(bits, np.uint8)
        for packed, n in zip(rows["totals"], rows["n"], strict=True):
            at, own = _ungapped(packed, n)
            before = total[at]
            total[at] = before + np.minimum(own, 255 - before)
        total = total >= many
        return rows[["lot", "class"]].assign(bits=[
            np.packbits(total[_ungapped(packed, n)[0]]).tobytes()
            for packed, n in zip(rows["totals"], rows["n"], strict=True)])
    return add


def _lot_counted(classes: int, bits: int, names):
    """Occurrences in a lot of what may be frequent in all of them, counted by a trie of the lot."""
    def count(blocks: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        batch = pa.record_batch({c: pa.array(blocks[c], pa.binary()) for c in ("words", "codes")})
        lot = [_phrases_of(*block) for block in _words_of(batch)]
        bit, _, cuts = _totals_of(lot, classes, bits)
        filters = np.zeros((2, bits), bool)
        for c, flags in zip(reached["class"], reached["bits"], strict=True):
            own = bit[cuts[c]:cuts[c + 1]]
            own = own[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(own)).view(bool)]
            filters[c // classes][(own % np.uint64(bits)).astype(np.int64)] = True
        filters = np.packbits(filters, axis=1, bitorder="little")
        phrases = np.concatenate([p for block in lot for p in _bounded(*block, *filters)], axis=1)
        del lot, filters
        phrases = phrases[:, np.unique(phrases[0], return_index=True)[1]]
        if not phrases.shape[1]:
            return pd.DataFrame({c.split()[0]: [] for c in _PARTS.split(", ")})
        rows = np.ascontiguousarray(phrases[1:].T)
        trie, accepts = build(rows)
        pages, = _counted(SimpleNamespace(value=[{
            "shard": 0, "symbols": trie.symbols, "base": trie.base, "checks": trie.check,
            "accepts": accepts.astype(np.int32)}]))(iter([batch]))
        sums = np.concatenate([_unpacked(packed, own) for packed, own in zip(
            pages.column("sums").to_pylist(), pages.column("n").to_pylist(), strict=True)])
        shard = (phrases[0] >> np.uint64(32)) % np.uint64(2 * classes)
        # neighbours that begin with the same or a like number deflate well
        codes = _named(trie.symbols, names.value)[np.searchsorted(trie.symbols, rows)]
        codes[rows == 0] = 0
        order = np.lexsort((codes[:, 0], shard))
        some, first = np.unique(shard[order], return_index=True)
        parts = np.split(order, first[1:])
        coded = [_coded(codes[part], rows[part], len(names.value[0])) for part in parts]
        return pd.DataFrame({"shard": some.astype(np.int32), "n": [len(part) for part in parts],
                             "codes": [c for c, _ in coded], "others": [o for _, o in coded],
                             "sums": [_packed(sums[part]) for part in parts]})
    return count


def _merged(many: int, names):
    """The phrases of a shard with at least `many` occurrences in all lots."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        phrases = np.concatenate([_decoded(packed, others, n, names.value).view(np.int64)
                                  for packed, others, n in zip(rows["codes"], rows["others"],
                                                               rows["n"], strict=True)])
        sums = np.concatenate([_unpacked(packed, n) for packed, n in
                               zip(rows["sums"], rows["n"], strict=True)])
        order = np.lexsort(phrases.T)
        phrases = phrases[order]
        first = np.flatnonzero(np.append(True, (phrases[1:] != phrases[:-1]).any(1)))
        a = np.add.reduceat(sums[order], first)
        h = phrases[first[a >= many]]
        return pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "h3": h[:, 2], "a": a[a >= many]})
    return add


# --- ranking ---

def collocations(docs: DataFrame, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `best` phrases of each language."""
    ready = _ready(docs)
    words = shared.settle(ready.mapInArrow(_word_counts, "lang string, h long, n long")
                          .groupBy("lang", "h").agg(F.sum("n").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = words.where(F.col("f") >= MANY)
    common = _bitmap(_word_pages(words))
    held = docs.sparkSession.sparkContext.broadcast(common)
    blocks = shared.settle(ready.mapInArrow(
        _lots(LOT, held), "lang string, words binary, codes binary, lot long"))
    held.unpersist()
    scored = shared.settle(_scored(phrase_counts(blocks, words, common, total)))
    # what is as good as the last of the best gets its words, which settle ties
    order = [F.desc("score"), F.desc("a")]
    least = (top_k(scored, ["lang"], [*order, F.asc("h1"), F.asc("h2"), F.asc("h3")], best)
             .groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least")))
    good = shared.settle(scored.join(F.broadcast(least), "lang")
                         .where(F.struct("score", "a") >= F.col("least")).drop("least"))
    ranked = top_k(_spelt(good, ready), ["lang"], [*order, F.asc("phrase")], best)
    return (ranked.join(F.broadcast(sizes), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    "score"))


def _spelt(found: DataFrame, ready: DataFrame) -> DataFrame:
    """Phrases in words.  Only hashes are counted and shuffled before; the few words that are wanted
    are read off the texts again, through a filter that has any number of them."""
    keys = ("h1", "h2", "h3")
    wanted = found.select(F.explode(F.array(*keys)).alias("h")).where("h != 0").distinct()
    held = found.sparkSession.sparkContext.broadcast(_bitmap(_word_pages(wanted)))
    words = shared.settle(ready.mapInArrow(_spellings(held), "h long, word string")
                          .groupBy("h").agg(F.min("word").alias("word")))
    held.unpersist()
    for key in keys:
        found = found.join(words.select(F.col("h").alias(key), F.col("word").alias(f"{key}_word")),
                           key, "left")
    # a pair's third word is null, which is left out
    return found.withColumn("phrase", F.concat_ws(" ", "h1_word", "h2_word", "h3_word"))


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates that no longer one takes in, with the parts of their lowest-scoring cut."""
    key = ["lang", "h1", "h2", "h3", "a"]
    pairs, triples = counts.where("h3 = 0"), counts.where("h3 != 0")

    def cut(k: int, left: str, right: str) -> Column:
        return F.struct(F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    longer = (triples.select("h1", "h2", "a")
              .union(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
              .groupBy("h1", "h2").agg(F.max("a").alias("longer")))
    two = (pairs.join(longer, ["h1", "h2"], "left")
           .where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
           .select(*key, F.array(cut(1, "first", "last")).alias("cuts")))
    head = pairs.select("h1", "h2", F.col("a").alias("head"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("tail"))
    three = (triples.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"])
             .select(*key, F.array(cut(1, "first", "tail"), cut(2, "head", "last")).alias("cuts")))
    # squares of counts and their products pass 64 bits: whole decimal numbers are exact
    lowest = F.array_min(F.transform("cuts", lambda c: F.struct(
        F.call_function("div", F.col("a").cast("decimal(18,0)") * F.col("a")
                        * F.lit(1_000_000).cast("decimal(7,0)"),
                        c["l"].cast("decimal(18,0)") * c["r"]).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    return (two.union(three).withColumn("cut", lowest)
            .select(*key, F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                    F.col("cut.score").alias("score")))


#: The same in DuckDB.
ORACLE = f"""
WITH p AS (
    SELECT lang, piece, unnest(range(len(piece))) + 1 AS i FROM (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
                  coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents))),
w AS (SELECT lang, piece[i] AS w1, piece[i + 1] AS w2, piece[i + 2] AS w3 FROM p),
f1 AS (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL
       HAVING f >= {MANY}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
    SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
    FROM f2 LEFT JOIN inside i ON i.lang = f2.lang AND i.w1 = f2.w1 AND i.w2 = f2.w2
    JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    WHERE f2.f >= {MANY} AND (i.longer IS NULL OR 100 * i.longer < {INSIDE} * f2.f)
    UNION ALL
    SELECT f3.lang, concat_ws(' ', f3.w1, f3.w2, f3.w3), f3.f, x.f, y.f, 1
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
    JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
    UNION ALL
    SELECT f3.lang, concat_ws(' ', f3.w1, f3.w2, f3.w3), f3.f, x.f, y.f, 2
    FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2
    JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b WHERE cut = 1)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {BEST}
"""
