"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: the path of every element (names with their classes, ids and roles) and,
below its path, every block of text.  Over all pages of a host, tokens with the same occurrence
vector (the same number of occurrences on the same pages) form an equivalence class; the vectors
are compared by commutative fingerprints, sums over the pages, so no page set is ever held.  The
classes whose tokens stand exactly once on at least nine tenths of a host's pages (of five pages
or more) can be in its frame.  A second pass lays them into each other: the root is the class on
most pages (of those the largest); a class's tokens have one order, and those of another class lie
in one slot of the root, between the same two of its tokens.  A token that keeps neither on nine
tenths of its pages leaves its class; the rest are the frame.  Paths of the frame nest by their
prefixes into the template; text of the frame is part of it, inside articles too.  What pages put
between template tokens are slots, and a block of text belongs to the slot of the longest template
path above it.

The slots of the article are extracted.  Every article element is weighed by its free text, what
the frame doesn't have; those of at least half the largest's weight are the article.  If a host's
template leaves over FAR times as much free text outside, as where a story stands in plain elements
and only its teasers are articles, that text is the article instead.  Without article elements, a
main element's text counts, without that the body's.  Text outside article elements is narrowed
down to the innermost container that holds DENSE of it, so that a sidebar without a telling name
stays out.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left
out: elements of these names, elements with the attribute hidden or aria-hidden="true", and
elements whose class, id or role has such a word; within an article element only if it has no other
word that tells anything (`related-work` and `share-price` are parts of a story).  No word sets html,
body, main and article apart.  Text of the frame is left out, unless it is all that there is
(copies of one page).  A host of fewer pages has no frame, so its pages' own paths are the template.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one space in page order.  Inline elements don't break a block.  Broken markup: end tags without
a start are ignored, open elements end with their parent or the page, a reference or tag cut off
at the end of the page is text or ends there.

Null and empty pages have an empty text.  Repeated rows are pages of their own and give equal
texts; null urls are one host of their own; columns other than page_id, url and html are not looked
at; an empty table gives an empty result.  Pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared

#: Pages of a host that make a frame, and the share of them that hold its tokens.
LEAST, SHARE = 5, 0.9
#: Free text outside articles, against the largest of them, that is the story instead; share of the
#: text outside articles that the innermost container with the story holds.
FAR, DENSE = 2, 0.8
#: Bytes of all frames that may be broadcast; parts that a host's pages are dealt into beyond.
BROADCAST, SALTS = 16 << 20, 16

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
#: Elements by their part in a page (fixed values).
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template xmp iframe".split())
_INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark
q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr""".split())
_APART = set("""nav header footer aside form script style noscript template button select option
textarea input iframe object embed svg canvas dialog menu head title datalist fieldset""".split())
_APART_WORDS = set("""ad ads advert advertisement adsense adsbygoogle banner sponsor sponsored promo
cookie cookies consent notice popup modal newsletter subscribe sidebar nav navbar navigation menu
breadcrumb breadcrumbs footer header masthead comment comments respond disqus related share sharing
social pagination pager login signup search widget toolbar alert complementary contentinfo
form""".split())
#: Words that tell nothing of an element's part in an article.
_NEUTRAL = set("""area bar block bottom box button buttons container content group icon icons inner
item items left link links list main outer panel right section slot thread top unit wrapper
""".split())
#: Elements that hold blocks of text, and may hold a story.
_CONTAINERS = set("html body main article section div center table tbody tr td".split())
#: Elements that hold an article: no word sets them apart.
_WHOLE = set("html body main article".split())
#: Open elements that a start tag ends (fixed values).
_ENDED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def _described(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element as a step of a path, and whether it stands apart from an article, or from what
    is around it inside of one."""
    words: list[str] = []
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes or ""):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    for key in ("class", "id", "role"):
        words += re.findall(r"[a-z]+|[0-9]+", re.sub(
            r"([a-z])([A-Z])", r"\1 \2", given.get(key, "")).lower())
    step = f"{name}.{'.'.join(words)}" if words else name
    hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
    telling = {w for w in words if w not in _NEUTRAL and not w.isdigit()}
    apart = bool(telling) and telling <= _APART_WORDS if inside else bool(telling & _APART_WORDS)
    return step, hidden or name in _APART or name not in _WHOLE and apart


def blocks(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(path, kind, apart, text) of the page's tokens in order; elements have the empty text.

    kind is the nearest of article, main and body that a token lies in.
    """
    stack: list[tuple[str, str, bool, str]] = [("", "", False, "")]   # name, path, apart, kind
    held: list[str] = []
    under = stack[0]
    at = 0

    def closed() -> list[tuple[str, str, bool, str]]:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        return [(under[1], under[3], under[2], text)] if text else []

    while True:
        m = _MARKUP.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            if not held:
                under = stack[-1]
            held.append(text)
        if m is None:
            yield from closed()
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name == "wbr" or name in _INLINE and not (
                m[3] and _described(name, m[3], stack[-1][3] == "article")[1]):
            if name in _INLINE and m[1] and any(x[0] == name for x in stack):
                yield from closed()
                while stack.pop()[0] != name:
                    pass
            continue
        yield from closed()
        if m[1]:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        while stack[-1][0] in _ENDED_BY.get(name, ()):
            stack.pop()
        _, path, outer, kind = stack[-1]
        step, apart = _described(name, m[3], kind == "article")
        if name in ("article", "main", "body") or "main" in step.split(".")[1:] and kind == "body":
            own = name if name in ("article", "body") else "main"
            kind = "article" if kind == "article" else own
        made = (name, f"{path}>{step}", outer or apart, kind)
        yield made[1], kind, made[2], ""
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in _VOID and not m[3].endswith("/"):
            stack.append(made)


def _token(path: str, text: str) -> str:
    """An element's path, or a text's path and digest."""
    return f"{path}\n{hashlib.blake2b(text.encode(), digest_size=12).hexdigest()}" \
        if text else path


def extracted(page: str, frame: set[str] | None) -> str:
    """The text of the article's slots of a page, given the tokens of its host's frame."""
    stories: dict[int, list[tuple[bool, str]]] = {}
    others: dict[str, list[tuple[str, bool, str]]] = {}
    begun = 0
    for path, kind, apart, text in blocks(page):
        if not text:
            above, _, step = path.rpartition(">")
            begun += step.partition(".")[0] == "article" and ">article" not in above
        elif not apart:
            fixed = frame is not None and _token(path, text) in frame
            if kind == "article":
                stories.setdefault(begun, []).append((fixed, text))
            else:
                others.setdefault(kind if path else "", []).append(
                    (_slot(path, frame), fixed, text))
    weights = {i: sum(len(t) for fixed, t in story if not fixed) for i, story in stories.items()}
    most = max(weights.values(), default=0)
    if stories:
        story = [x for i, x in stories.items() if 2 * weights[i] >= most]
        if frame is None or not others:
            return _free([pair for part in story for pair in part])
    outside = _densest(next((others[k] for k in ("main", "body", "") if k in others), []))
    if stories and FAR * most >= sum(len(t) for fixed, t in outside if not fixed):
        return _free([pair for part in story for pair in part])
    return _free(outside)


def _free(story: list[tuple[bool, str]]) -> str:
    """What the frame doesn't have, or all if it has everything."""
    return " ".join([t for fixed, t in story if not fixed] or [t for _, t in story])


def _slot(path: str, frame: set[str] | None) -> str:
    """The longest path of the host's template above a text; its own path without a template."""
    while frame is not None and path and path not in frame:
        path = path.rpartition(">")[0]
    return path


def _densest(texts: list[tuple[str, bool, str]]) -> list[tuple[bool, str]]:
    """The texts of the slots in the innermost container that holds DENSE of what is free."""
    steps = [slot.split(">")[1:] for slot, _, _ in texts]
    free = [0 if fixed else len(text) for _, fixed, text in texts]
    chosen, depth = list(range(len(texts))), 0
    while True:
        sums: Counter = Counter()
        for i in chosen:
            if len(steps[i]) > depth and steps[i][depth].partition(".")[0] in _CONTAINERS:
                sums[steps[i][depth]] += free[i]
        best, most = max(sums.items(), key=lambda x: x[1], default=("", 0))
        if not most or most < DENSE * sum(free[i] for i in chosen):
            return [texts[i][1:] for i in chosen]
        chosen = [i for i in chosen if steps[i][depth:depth + 1] == [best]]
        depth += 1


def host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: dict[tuple, list] = {}
        for where, mark, page in zip(batch["host"], batch["mark"], batch["html"], strict=True):
            own: dict[str, int] = {}
            first: dict[str, int] = {}
            for i, (path, _, apart, text) in enumerate(blocks(page)):
                if text and apart:
                    continue        # never extracted
                token = _token(path, text)
                own[token] = own.get(token, 0) + 1
                first.setdefault(token, i)
            for token, n in own.items():
                sums = out.setdefault((where, token), [0, 0, 0, 0, 0])
                sums[0] += 1
                sums[1] += n
                sums[2] += n * (mark & 0x3FFFFFFF)
                sums[3] += n * (mark >> 32 & 0x3FFFFFFF)
                sums[4] += first[token]
        yield pd.DataFrame([(w, t, *s) for (w, t), s in out.items()],
                           columns=["host", "token", "pages", "times", "one", "two", "at"])


def _read(pages: DataFrame) -> DataFrame:
    url = pages["url"].cast("string")
    return pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"),
                        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
                        host(url).alias("host"))


def classes(pages: DataFrame) -> DataFrame:
    """The tokens that can be in each host's frame: host, token, pages, of_pages, with `one` and
    `two` the fingerprint of the occurrence vector, the same for the tokens of a class, and `at`,
    the sum of their places, which orders them."""
    read = _read(pages)
    marked = read.select("host", F.xxhash64("page_id", "url").alias("mark"), "html")
    tokens = marked.mapInPandas(_tokens, "host string, token string, pages long, times long, "
                                         "one long, two long, at long")
    summed = tokens.groupBy("host", "token").agg(
        *[F.sum(c).alias(c) for c in ("pages", "times", "one", "two", "at")])
    hosts = read.groupBy("host").agg(F.count("*").alias("of_pages"))
    frame = (F.col("of_pages") >= LEAST) & (F.col("times") == F.col("pages")) & (
        F.col("pages") >= SHARE * F.col("of_pages"))
    # what is on fewer pages than any frame needs never meets its host
    some = summed.where((F.col("times") == F.col("pages")) & (F.col("pages") >= SHARE * LEAST))
    return some.join(hosts, "host").where(frame)


def _in_order(ranks: list[int]) -> set[int]:
    """The ranks in a longest increasing subsequence."""
    ends: list[int] = []
    before: dict[int, int] = {}
    for x in ranks:
        k = bisect_left(ends, x)
        before[x] = ends[k - 1] if k else -1
        ends[k:k + 1] = [x]
    out, x = set(), ends[-1] if ends else -1
    while x >= 0:
        out.add(x)
        x = before[x]
    return out


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token of a host's classes stands in which slot of the root, in order."""
    known: dict[str, dict[str, tuple[int, int]]] = {}
    for batch in batches:
        out: Counter = Counter()
        for where, members, page in zip(batch.column("host").to_pylist(), batch.column("classes"),
                                        batch.column("html").to_pylist(), strict=True):
            if where not in known:
                known[where] = {t: (c, rank) for c, tokens in enumerate(members.as_py())
                                for rank, t in enumerate(tokens)}
            classes_of = known[where]
            met: dict[str, tuple[int, int]] = {}
            for path, _, apart, text in blocks(page):
                if not (text and apart):
                    token = _token(path, text)
                    if token in classes_of:
                        met.setdefault(token, classes_of[token])
            ranks: dict[int, list[int]] = {}
            for c, rank in met.values():
                ranks.setdefault(c, []).append(rank)
            kept = {c: _in_order(x) for c, x in ranks.items()}
            slot = 0
            for token, (c, rank) in met.items():
                if rank not in kept[c]:
                    continue
                if c == 0:
                    slot = rank + 1
                out[where, token, slot] += 1
        yield pa.record_batch({
            "host": pa.array([k[0] for k in out], pa.string()),
            "token": pa.array([k[1] for k in out], pa.string()),
            "slot": pa.array([k[2] for k in out], pa.int32()),
            "n": pa.array(list(out.values()), pa.int64())})


def _with_hosts(pages: DataFrame, frames: DataFrame, column: str, how: str) -> DataFrame:
    """The pages with their host's row of `frames`, which are sent to all executors if they measure
    BROADCAST bytes or less together; larger ones meet their pages by a join on host and a salt,
    which deals out a host of very many pages."""
    tokens = F.flatten(column) if column == "classes" else F.col(column)
    size = frames.agg(F.sum(F.length(F.array_join(tokens, " ")) + 64)).first()[0] or 0
    rows = _read(pages)
    if size <= BROADCAST:
        return rows.join(F.broadcast(frames), "host", how)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    spread = frames.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, ["host", "salt"], how)


def templates(pages: DataFrame) -> DataFrame:
    """host and tokens, its frame: no more tokens than a page has over SHARE."""
    # the tokens of equal occurrence vectors in their order, a host's root class first
    member = F.struct("at", "token")
    grouped = classes(pages).groupBy("host", "pages", "one", "two").agg(
        F.sort_array(F.collect_list(member)).alias("members"))
    ranked = F.struct((-F.col("pages")).alias("a"), (-F.size("members")).alias("b"), "one", "two",
                      F.transform("members", lambda m: m["token"]).alias("tokens"))
    nested = shared.settle(grouped.groupBy("host").agg(F.transform(
        F.sort_array(F.collect_list(ranked)), lambda c: c["tokens"]).alias("classes"),
        F.map_from_entries(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(
            m["token"].alias("token"), F.col("pages").alias("pages")))))).alias("pages")))
    placed = (_with_hosts(pages, nested.select("host", "classes"), "classes", "inner")
              .select("host", "html", "classes")
              .mapInArrow(_placed, "host string, token string, slot int, n long")
              .groupBy("host", "token", "slot").agg(F.sum("n").alias("n"))
              .groupBy("host", "token").agg(F.max("n").alias("n")))
    support = nested.select("host", F.explode("pages").alias("token", "pages"))
    return (placed.join(support, ["host", "token"]).where(F.col("n") >= SHARE * F.col("pages"))
            .groupBy("host").agg(F.collect_set("token").alias("tokens")))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frames: dict[str, set[str] | None] = {}
        out = []
        for where, tokens, page in zip(batch.column("host").to_pylist(), batch.column("tokens"),
                                       batch.column("html").to_pylist(), strict=True):
            if where not in frames:
                known = tokens.as_py()
                frames[where] = None if known is None else set(known)
            out.append(extracted(page, frames[where]))
        yield pa.record_batch({
            "page_id": batch.column("page_id"), "url": batch.column("url"),
            "text": pa.array(out, pa.string()),
            "n_chars": pa.array([len(t) for t in out], pa.int64())})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    joined = _with_hosts(pages, shared.settle(templates(pages)), "tokens", "left")
    return joined.select("page_id", "url", "host", "html", "tokens").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long")
