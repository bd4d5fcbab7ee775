"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (which trigrams every
match must hold, in conjunctions and alternatives); small and capital letters are one.  Every batch
of texts gets an inverted index of the trigrams that any query names: for each the sorted list of
the texts that hold it.  Queries are answered by intersecting and uniting these lists, and only
the texts that remain are verified with the expression itself, whole.  A rule without mandatory
trigrams (a run of hexadecimal digits) scans every text.

Matches are the leftmost ones that don't overlap, kind by kind; a match that fails its check is
dropped and not tried again.  The base kinds are assign, access and hex; the further kinds are
reported besides, where no base match overlaps them.

Null and empty texts have no matches.  Texts are read whole, rows one by one: repeated rows give
equal results, ties and other columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitlake.llm import shared
from orbitlake.llm.spans import apart, written

#: The longest list of alternatives that a part of an expression is spelled out to.
MOST_STRINGS = 32


class Rule:
    """A kind of secret: expression, least length of the part that counts, and that part."""

    def __init__(self, kind: str, pattern: str, least: int = 0, group: int = 0) -> None:
        self.kind, self.least, self.group = kind, least, group
        self.regex = re.compile(pattern)
        self.query = trigram_query(pattern)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), self.kind) for m in self.regex.finditer(text)
                if m.end(self.group) - m.start(self.group) >= self.least]


# --- trigram queries: None (anything), ("all", parts), ("any", parts) or a trigram ---

def _both(*parts):
    parts = [p for p in parts if p is not None]
    flat = list(dict.fromkeys(x for p in parts for x in (
        p[1] if isinstance(p, tuple) and p[0] == "all" else (p,))))
    return None if not flat else flat[0] if len(flat) == 1 else ("all", tuple(flat))


def _either(*parts):
    if any(p is None for p in parts):
        return None
    flat = list(dict.fromkeys(parts))
    return flat[0] if len(flat) == 1 else ("any", tuple(flat))


def _of_strings(strings: set[str]):
    """What a text must hold that contains one of the strings."""
    return _either(*[_both(*[s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _letters(items) -> set[str] | None:
    """The characters of a class, in small letters, if they are few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the part can be, or None if unknown; what else it demands).

    Known strings of neighbours are joined; where that ends, their trigrams are demanded.
    """
    known: set[str] | None = {""}
    demands: list = []
    exact = True

    def close() -> None:
        nonlocal known, exact
        demands.append(_of_strings(known))
        known, exact = {""}, False

    for kind, value in nodes:
        strings: set[str] | None = None
        demand = None
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = _letters(value)
        elif kind is op.SUBPATTERN:
            strings, demand = _walk(value[3])
        elif kind is op.BRANCH:
            sides = [_walk(side) for side in value[1]]
            if all(s is not None for s, _ in sides):
                strings = set().union(*[s for s, _ in sides])
            else:
                demand = _either(*[_both(_of_strings(s) if s is not None else None, d)
                                   for s, d in sides])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            part, inner_demand = _walk(inner)
            if part is not None and high == 1 and low == 0:
                strings = part | {""}
            elif part is not None and low == high and low <= 4:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in part}
            elif low:
                demand = _both(_of_strings(part) if part is not None else None, inner_demand)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if strings is None or len(known) * len(strings) > MOST_STRINGS:
            close()
            if strings is None:
                demands.append(demand)
                continue
        known = {a + b for a in known for b in strings}
    if exact:
        return known, None
    return None, _both(*demands, _of_strings(known))


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression; None if no trigram is mandatory."""
    known, demand = _walk(parser.parse(pattern))
    return _of_strings(known) if known is not None else demand


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


#: Base kinds in the order of ties, then further ones.
BASE = (
    Rule("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]"
         r"|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
         r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


class Index:
    """Postings of the wanted trigrams over the texts of a batch."""

    def __init__(self, wanted: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.full(1 << 21, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 14 | b << 7 | c] = i

    def build(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        low = shared.LOWER[data]
        code = (low & 127).astype(np.int32)
        key = code[:-2] << 14 | code[1:-1] << 7 | code[2:] if len(code) > 2 else code[:0]
        number = self.table[key]
        at = np.flatnonzero(number >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        # a trigram is ASCII and lies in one text
        good = (at + 2 < offsets[row + 1]) & (low[at] < 128) & (low[at + 1] < 128) \
            & (low[at + 2] < 128)
        pair = np.unique(number[at[good]].astype(np.int64) * len(offsets) + row[good])
        cut = np.searchsorted(pair, np.arange(len(self.number) + 1) * len(offsets))
        return [pair[a:b] % len(offsets) for a, b in zip(cut, cut[1:], strict=False)]

    def answer(self, query, postings: list[np.ndarray]) -> np.ndarray:
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = sorted((self.answer(q, postings) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "all" \
                else np.union1d(out, part)
        return out


def secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, further: tuple[Rule, ...] = FURTHER
            ) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans of every row of `docs`."""
    rules = (*base, *further)
    wanted = sorted(set().union(*[trigrams_of(r.query) for r in rules]))
    order = {r.kind: i for i, r in enumerate(rules)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wanted)
        for batch in batches:
            out = [written([], order, [])] * batch.num_rows
            counts = np.zeros((len(base), batch.num_rows), np.int64)
            for first, data, offsets in shared.pieces(batch.column("text")):
                postings = index.build(data, offsets)
                texts: dict[int, str] = {}
                found: dict[int, tuple[list, list]] = {}
                for place, rule in enumerate(rules):
                    rows = index.answer(rule.query, postings) if rule.query is not None \
                        else np.arange(len(offsets) - 1)
                    for row in rows.tolist():
                        if row not in texts:
                            texts[row] = data[offsets[row]:offsets[row + 1]].tobytes().decode()
                        spans = rule.spans(texts[row])
                        if spans:
                            found.setdefault(row, ([], []))[place >= len(base)].extend(spans)
                            if place < len(base):
                                counts[place, first + row] = len(spans)
                for row, (own, more) in found.items():
                    out[first + row] = written(own, order, apart(more, own))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{f"n_{r.kind}": pa.array(c) for r, c in zip(base, counts, strict=True)},
                "base_sha256": pa.array([x for x, _ in out], pa.string()),
                "spans": pa.array([x for _, x in out], pa.string())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       shared.text_or_empty(docs).alias("text"))
    schema = ", ".join(f"n_{r.kind} long" for r in base)
    return rows.mapInArrow(scan, f"doc_id long, {schema}, base_sha256 string, spans string")
