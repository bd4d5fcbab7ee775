"""Personal data by a semi-Markov conditional random field over the base patterns.

Four kinds are looked for: email, ip, card and phone.  The base spans are the leftmost
non-overlapping matches of fixed patterns, kind by kind; a match that fails its check (parts over
255, digits, Luhn) is dropped and not tried again.

The field works on zones: neighbouring words that hold a digit or an @.  A zone is cut into tokens
(runs of digits, runs of letters, single marks), and every candidate segment of at most LONGEST
tokens gets features of the whole span (its shape, digits, check sums, borders).  A dynamic
programme over the tokens chooses boundaries and kinds together, the segments being bounded; its
weights are trained by the gradient of the segmental likelihood on at most SAMPLE zones, labelled
by the base patterns, with national forms of phone numbers added to the examples.  The segments
that it finds besides, where no base span overlaps, are added; base spans always stay.

Null and empty texts have no spans.  Texts are read whole, rows one by one: repeated rows give
equal results, ties and other columns don't matter, and an empty table gives an empty result (and
nothing to learn: then the field adds nothing).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared
from orbitlake.llm.spans import Span, apart, written

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Tokens of a segment at most; zones learnt from, their length, passes and step of the training.
LONGEST, SAMPLE, ZONE, PASSES, STEP = 24, 1500, 300, 6, 0.3
#: Digits that a segment without an address can have: those of the longest card number.
MOST_DIGITS = 19

# The published patterns; possessive forms and look-behinds only spare searches that must fail.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGERS = np.zeros(256, bool)
_TRIGGERS[[*b"0123456789@+"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # behind a match the local part may begin at once, elsewhere only where a run begins
        m = (_EMAIL.match(text, at) if at else None) or _EMAIL_AT.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


# --- the field ---

# Begins where a word does and never goes back, so that every character is read twice at most.
_ZONE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: First characters of the tokens that an address has before and behind its @, that a number has,
#: and that it may begin with.
_LOCAL, _DOMAIN = _LETTERS | set("._%+-"), _LETTERS | set(".-")
_NUMBERS, _LEADING = frozenset("0123456789 ().+-"), frozenset("0123456789+(")
_MAY = {"ip": re.compile(r"[0-9]+(?:\.[0-9]+)+"),
        "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
        "phone": re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")}


def zones(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of the zones, each with a character before and after it."""
    for m in _ZONE.finditer(text):
        a, b = max(0, m.start() - 1), min(len(text), m.end() + 1)
        yield a, text[a:b]


def _class(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.isalpha() else "_" if not c or c.isspace() else c


@lru_cache(1 << 15)
def features(kind: str, span: str, before: str, after: str) -> tuple[str, ...]:
    digits = _digits(span)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", span))[:24]
    facts = [f"n{len(digits)}" if kind != "email" else f"dots{min(span.count('.'), 3)}",
             f"shape{shape}" if kind != "email" else f"tail{'.' in span.partition('@')[2]}",
             f"left{_class(before)}", f"right{_class(after)}", "is"]
    if kind == "card":
        facts.append(f"luhn{14 <= len(digits) <= 19 and luhn(digits)}")
    if kind == "ip":
        parts = span.split(".")
        facts.append(f"parts{len(parts)}{all(len(p) < 4 and int(p) < 256 for p in parts)}")
    if kind == "phone":
        facts.append(f"plus{span[0] == '+'}{10 <= len(digits) <= 15}")
    return tuple(f"{kind}:{x}" for x in facts)


def segments(zone: str) -> tuple[list[int], list[tuple[int, int, str, tuple[str, ...]]]]:
    """Token borders of a zone and its candidate segments (first and last border, kind, features).
    """
    border = [m.start() for m in _TOKEN.finditer(zone)] + [len(zone)]
    heads = [zone[b] for b in border[:-1]]
    spans: list[tuple[int, int, int, str]] = []
    for at in [t for t, c in enumerate(heads) if c == "@"]:
        for i in range(at - 1, max(at - LONGEST, -1), -1):
            if heads[i] not in _LOCAL:
                break
            for j in range(at + 2, min(i + LONGEST, len(heads)) + 1):
                if heads[j - 1] not in _DOMAIN:
                    break
                if heads[j - 1].isalnum():
                    spans.append((i, j, 0, "email"))
    bounded = "@" not in zone
    for i in [t for t, c in enumerate(heads) if c in _LEADING]:
        digits = 0
        for j in range(i + 1, min(i + LONGEST, len(heads)) + 1):
            if heads[j - 1] not in _NUMBERS:
                break
            if not heads[j - 1].isdigit():
                continue
            digits += border[j] - border[j - 1]
            if bounded and digits > MOST_DIGITS:
                break
            span = zone[border[i]:border[j]]
            spans += [(i, j, n, kind) for n, kind in enumerate(KINDS)
                      if n and _MAY[kind].fullmatch(span)]
    out = []
    for i, j, _, kind in sorted(spans):
        before = zone[border[i] - 1:border[i]] if border[i] else ""
        out.append((i, j, kind, features(kind, zone[border[i]:border[j]], before,
                                         zone[border[j]:border[j] + 1])))
    return border, out


def decode(zone: str, weights: dict[str, float]) -> list[Span]:
    """The best segmentation: single tokens outside, segments of positive gain inside."""
    border, found = segments(zone)
    if not found:
        return []
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, names in found:
        score = sum(weights.get(n, 0.0) for n in names)
        if score > 0:
            ending.setdefault(j, []).append((i, kind, score))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for j in range(1, len(border)):
        choice = (best[j - 1][0], j - 1, "")
        for i, kind, score in ending.get(j, ()):
            if best[i][0] + score > choice[0]:
                choice = (best[i][0] + score, i, kind)
        best.append(choice)
    out, j = [], len(border) - 1
    while j:
        _, i, kind = best[j]
        if kind:
            out.append((border[i], border[j], kind))
        j = i
    return out[::-1]


def _examples(zone: str, gold: list[Span]) -> list[tuple[str, list[Span]]]:
    """The zone, and for one that is a phone number its national form too."""
    out = [(zone, gold)]
    for a, b, kind in gold:
        plain = re.sub(r"^\+[0-9]{1,3}[ .-]", "", zone[a:b])
        if kind == "phone" and len(gold) == 1 and plain != zone[a:b] and plain[0] == "(":
            out.append((zone[:a] + plain + zone[b:], [(a, a + len(plain), kind)]))
    return out


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Gradient steps on the segmental log-likelihood (forward and backward sums over segments).
    """
    names: dict[str, int] = {}
    ready = []
    for zone in rows.sort_values("place")["zone"]:
        gold: list[Span] = []
        for span in sorted(base_spans(zone), key=lambda s: (s[0], ORDER[s[2]])):
            if not gold or span[0] >= gold[-1][1]:
                gold.append(span)
        for text, spans in _examples(zone, gold):
            border, found = segments(text)
            if not found:
                continue
            wanted = {(a, b, k) for a, b, k in spans}
            ready.append((len(border) - 1, [
                (i, j, np.array([names.setdefault(n, len(names)) for n in facts]),
                 (border[i], border[j], kind) in wanted) for i, j, kind, facts in found]))
    w = np.zeros(len(names))
    g2 = np.full(len(names), 1e-6)
    for _ in range(PASSES):
        for n, found in ready:
            score = [float(w[f].sum()) for _, _, f, _ in found]
            ends: list[list[int]] = [[] for _ in range(n + 1)]
            begins: list[list[int]] = [[] for _ in range(n + 1)]
            for s, (i, j, _, _) in enumerate(found):
                ends[j].append(s)
                begins[i].append(s)
            ahead, back = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(
                    ahead[found[s][0]] + score[s] for s in ends[j])])
            for i in range(n - 1, -1, -1):
                back[i] = np.logaddexp.reduce([back[i + 1], *(
                    back[found[s][1]] + score[s] for s in begins[i])])
            for s, (i, j, facts, gold) in enumerate(found):
                p = np.exp(ahead[i] + score[s] + back[j] - ahead[n])
                step = float(gold) - p
                if abs(step) > 1e-3:
                    g2[facts] += step * step
                    w[facts] += STEP * step / np.sqrt(g2[facts]) - 1e-4 * w[facts]
    return pd.DataFrame({"name": list(names), "weight": w})


def _rows_with_triggers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_TRIGGERS[data])))
    return np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]])


def _zone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, data, offsets in shared.pieces(batch.column("text")):
            for row in _rows_with_triggers(data, offsets).tolist():
                text = data[offsets[row]:offsets[row + 1]].tobytes().decode()
                out += [z for _, z in zones(text) if len(z) <= ZONE]
        yield pa.record_batch({"zone": pa.array(out, pa.string())})


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights learnt from at most `sample` different zones: those whose text hashes lowest."""
    rows = (docs.select(shared.text_or_empty(docs).alias("text"))
            .mapInArrow(_zone_rows, "zone string").distinct()
            .withColumn("place", F.xxhash64("zone")).orderBy("place", "zone").limit(sample))
    found = (rows.withColumn("all", F.lit(0)).groupBy("all")
             .applyInPandas(_train, "name string, weight double").collect())
    return {r["name"]: r["weight"] for r in found}


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans of every row of `docs`."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        for batch in batches:
            out = [written([], ORDER, [])] * batch.num_rows
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            for first, data, offsets in shared.pieces(batch.column("text")):
                for row in _rows_with_triggers(data, offsets).tolist():
                    text = data[offsets[row]:offsets[row + 1]].tobytes().decode()
                    base = base_spans(text)
                    more = [(start + a, start + b, kind) for start, zone in zones(text)
                            for a, b, kind in decode(zone, weights)]
                    for _, _, kind in base:
                        counts[ORDER[kind], first + row] += 1
                    out[first + row] = written(base, ORDER, apart(more, base))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts, strict=True)},
                "base_sha256": pa.array([x for x, _ in out], pa.string()),
                "spans": pa.array([x for _, x in out], pa.string())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       shared.text_or_empty(docs).alias("text"))
    schema = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(scan, f"doc_id long, {schema}, base_sha256 string, spans string")
