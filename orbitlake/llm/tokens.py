"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary is compiled into two deterministic machines.

* The splitter finds where pieces (words with their leading space, numbers, marks, white space,
  English contractions) begin.  Its decisions look one character back and at most three ahead, so
  all of a batch is decided at once; special strings are pieces of one token each.
* The counter reads a piece byte by byte.  A prefix of a piece has one BPE encoding; its last token
  t is the only one for which the encoding of what precedes ends in a token that t may follow (two
  tokens may follow each other if BPE of both together gives both back).  A state is therefore the
  set of token beginnings still open, each with the token before it, and every transition is
  annotated with the change of the token count.  States are made when a text first reaches them
  and kept in a dense table; a table of more than MOST_STATES is begun anew, which costs time but
  changes no count.  All pieces of a batch advance together, a byte at a time.

A text longer than CHUNK is cut into chunks wherever it may be.  White space after another
character always begins a piece, so from the first such cut on a chunk's result doesn't depend on
the state it is entered in: its state map is the text before that cut, the count between its first
and its last cut, and the text after.  Maps compose associatively, by counting what meets in the
middle, and are folded pairwise, level by level.

Null and empty texts have no tokens.  Rows are counted one by one, so repeated rows and ties need
nothing; columns other than doc_id and text are not looked at; an empty table gives an empty
result.  Texts are never cut short.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitlake.llm import shared

#: Bytes of a text from which it is cut into chunks, states kept, tokens a text may have.
CHUNK, MOST_STATES, LIMIT = 1 << 16, 300_000, 1024

_OTHER_SPACE, _SPACE, _LETTER, _NUMBER, _MARK = range(5)
#: White space besides the space, as Unicode lists it (fixed values).
_SPACES = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
           0x205F, 0x3000]
#: Pieces of their own after an apostrophe that begins a piece (fixed values).
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, _MARK, np.uint8)
    for code in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            kinds[code] = _LETTER
        elif major == "N":
            kinds[code] = _NUMBER
    kinds[_SPACES] = _OTHER_SPACE
    kinds[32] = _SPACE
    return kinds


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Compiled:
    """The machines of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.tokens = {raw(t): i for t, i in read["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.tokens.items()}
        self.ranks = {}
        for rank, merge in enumerate(read["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[raw(a), raw(b)] = rank
        self.special = [t["content"].encode() for t in read.get("added_tokens", [])]
        self.kinds = _classes()
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, number in self.tokens.items():
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                node = self.trie[node][b]
            self.ends[node] = number
        self.follows: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.known = {self.states[0]: 0}
        # only bytes that were met have a column of the tables
        self.column = np.full(256, -1, np.int32)
        self.next = np.full((1024, 0), -1, np.int32)
        self.gain = np.zeros((1024, 0), np.int8)

    def merged(self, text: bytes) -> list[bytes]:
        """BPE of a short text, merge by merge."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.ranks.get((a, b), sys.maxsize), i)
                      for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == sys.maxsize:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, before: int, token: int) -> bool:
        pair = before, token
        if pair not in self.follows:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            a, b = self.bytes[before], self.bytes[token]
            self.follows[pair] = self.merged(a + b) == [a, b]
        return self.follows[pair]

    def _step(self, state: int, byte: int) -> None:
        """Makes the transition of a state: the beginnings that the byte continues, and the one
        new beginning behind the token that now is the last."""
        still, last = [], None
        for node, before, count in self.states[state]:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.ends[node]
            if token is not None and last is None and (
                    before < 0 or self._may_follow(before, token)):
                last = token, count + 1
            if self.trie[node]:
                still.append((node, before, count))
        token, gain = last
        made = ((0, token, 0), *((n, t, c - gain) for n, t, c in still))
        number = self.known.get(made)
        if number is None:
            number = self.known[made] = len(self.states)
            self.states.append(made)
            if number == len(self.next):
                more = (len(self.next) // 2, self.next.shape[1])
                self.next = np.concatenate((self.next, np.full(more, -1, np.int32)))
                self.gain = np.concatenate((self.gain, np.zeros(more, np.int8)))
        self.next[state, self.column[byte]] = number
        self.gain[state, self.column[byte]] = gain

    def _columns(self, data: np.ndarray) -> None:
        """Gives bytes not met before a column."""
        met = np.flatnonzero(np.bincount(data, minlength=256))
        new = met[self.column[met] < 0]
        if len(new):
            width = self.next.shape[1]
            self.column[new] = np.arange(width, width + len(new))
            more = (len(self.next), len(new))
            self.next = np.concatenate((self.next, np.full(more, -1, np.int32)), axis=1)
            self.gain = np.concatenate((self.gain, np.zeros(more, np.int8)), axis=1)

    def _advance(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = self.column[read]
        after = self.next[states, column]
        new = np.flatnonzero(after < 0)
        if len(new):
            for key in np.unique(states[new].astype(np.int64) << 8 | read[new]).tolist():
                self._step(key >> 8, key & 255)
            after = self.next[states, column]
        return after, self.gain[states, column]

    def count_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        if len(self.states) > MOST_STATES:
            self._restart()
        self._columns(data)
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        counts = np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int32)
        longest = int(length[0]) if len(length) else 0
        shorter = np.searchsorted(-length, -np.arange(longest), "left")
        at = 0
        while at < longest:
            live = int(shorter[at])
            if live < 8 and at >= 64:
                break
            state[:live], gain = self._advance(state[:live], data[starts[:live] + at])
            counts[:live] += gain
            at += 1
        for i in range(int(shorter[at]) if at < longest else 0):     # the few very long pieces
            now, total = int(state[i]), 0
            for b in data[starts[i] + at:starts[i] + length[i]].tolist():
                column = self.column[b]
                if self.next[now, column] < 0:
                    self._step(now, b)
                total += int(self.gain[now, column])
                now = int(self.next[now, column])
            counts[i] += total
        out = np.empty(len(order), np.int64)
        out[order] = counts
        return out

    def _starts(self, kind: np.ndarray, code: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where pieces begin; edge marks the first characters of texts and after specials."""
        n = len(kind)
        before = np.concatenate(([_MARK], kind[:-1]))
        space, spaced = kind <= _SPACE, before <= _SPACE
        last = np.concatenate((space[1:] & ~edge[1:], [True]))      # more white space follows
        ends = np.concatenate((edge[1:], [True]))
        start = np.where(space, ~spaced | ~(last | ends),
                         (before != kind) & (before != _SPACE))
        start |= edge
        tick = np.flatnonzero((code == 39) & start & (edge | (before == _LETTER)
                                                      | (before == _NUMBER)
                                                      | (before == _OTHER_SPACE)))
        padded = np.concatenate((code, np.zeros(3, code.dtype)))
        for ending in _ENDINGS:
            here = np.ones(len(tick), bool)
            for k, b in enumerate(ending, 1):
                inside = tick + k < n
                here &= inside & (padded[np.minimum(tick + k, n)] == b)
                here[inside] &= ~edge[tick[inside] + k]
            found = tick[here]
            start[found + 1] = False
            after = found + 1 + len(ending)
            start[after[after < n]] = True
            tick = tick[~here]
        return start

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, np.int64)
        cuts, specials, whole = [offsets], [], data.tobytes()
        for special in self.special:
            at = whole.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(special) <= offsets[row + 1]:
                    specials.append((at, at + len(special), row))
                    at = whole.find(special, at + len(special))
                else:
                    at = whole.find(special, at + 1)
        if specials:
            cuts.append(np.array([x for s in specials for x in s[:2]], np.int64))
        first = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        hard = np.zeros(len(data) + 1, bool)
        hard[np.concatenate(cuts)] = True
        start = self._starts(self.kinds[code], code, hard[first])
        starts = first[start]
        ends = np.append(starts[1:], len(data))
        owner = np.searchsorted(offsets, starts, "right") - 1
        plain = np.ones(len(starts), bool)
        total = np.zeros(rows, np.int64)
        for a, b, row in specials:
            plain[np.searchsorted(starts, a):np.searchsorted(starts, b)] = False
            total[row] += 1
        counts = self.count_pieces(data, starts[plain], ends[plain])
        return total + np.bincount(owner[plain], counts, rows).astype(np.int64)

    def count_all(self, texts: list[bytes]) -> list[int]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        return self.count(data, offsets).tolist()

    def chunk_map(self, chunk: bytes) -> tuple[bytes, int | None, bytes]:
        """The state map of a chunk: what precedes its first cut, the count between its first and
        last cut, and what follows; without any cut the first part is all of it."""
        raw = np.frombuffer(chunk, np.uint8)
        # cuts at ASCII white space behind a byte that belongs to no white space
        space = (raw == 32) | (raw == 10)
        solid = (raw > 32) & (raw < 127)
        at = np.flatnonzero(space[1:] & solid[:-1]) + 1
        if not len(at):
            return chunk, None, b""
        a, b = int(at[0]), int(at[-1])
        return chunk[:a], self.count_all([chunk[a:b]])[0], chunk[b:]

    def composed(self, maps: list[tuple[bytes, int | None, bytes]]
                 ) -> list[tuple[bytes, int | None, bytes]]:
        """Neighbouring maps put together, two by two."""
        out = []
        for one, two in zip(maps[::2], maps[1::2], strict=False):
            if one[1] is None:
                out.append((one[0] + two[0], two[1], two[2]))
            elif two[1] is None:
                out.append((one[0], one[1], one[2] + two[0]))
            else:
                middle = self.count_all([one[2] + two[0]])[0]
                out.append((one[0], one[1] + middle + two[1], two[2]))
        return out + maps[len(maps) // 2 * 2:]

    def count_long(self, text: bytes) -> int:
        maps = []
        at = 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:     # not inside a character
                end += 1
            maps.append(self.chunk_map(text[at:end]))
            at = end
        while len(maps) > 1:
            maps = self.composed(maps)
        head, inner, tail = maps[0]
        return sum(self.count_all([head, tail])) + (inner or 0)


_compiled: dict[str, Compiled] = {}


def _machine(path: str) -> Compiled:
    """The worker's machines; what they have learnt serves its later batches too."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def _path(vocabulary: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(_path(vocabulary))
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            tokens = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in shared.pieces(batch.column("text")):
                n = len(offsets) - 1
                length = np.diff(offsets)
                size[first:first + n] = length
                long = np.flatnonzero(length > CHUNK)
                keep = np.ones(len(data), bool)
                for i in long:
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    tokens[first + i] = machine.count_long(data[a:b].tobytes())
                    keep[a:b] = False
                if len(long):
                    data, length = data[keep], np.where(length > CHUNK, 0, length)
                    offsets = np.concatenate(([0], np.cumsum(length)))
                tokens[first:first + n] += machine.count(data, offsets)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(size),
                "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       shared.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
