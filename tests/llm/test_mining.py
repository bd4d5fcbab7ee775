"""Shared lines, collocations and hard negatives against plain re-statements."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from checks.compare import _rows, duck
from orbitlake.llm import lines, negatives, phrases, queries
from tests.llm.conftest import LONG, ODD, SF


@pytest.mark.parametrize("name", ["op4_topk", "op11_negatives", "op12_phrases", "op13_lines"])
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck(SF).execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, rel.fetchall())


# --- lines ---

def key_of(line):
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def plain_lines(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if len(holders[key_of(x)]) < 3
                or max(holders[key_of(x)]) == (-1 if doc is None else doc)]
        out.append((doc, len(every), len(every) - len(stay), "\n".join(stay)))
    return out


def line_texts(n, seed):
    draw = random.Random(seed)
    pool = [f"shared line number {i} with some words" for i in range(12)]
    pool += ["short", "", "   ", "Ärger über den Fluß", "ä" * 19, "ä" * 20, "x" * 20]
    rows = []
    for i in range(n):
        own = [draw.choice([*pool, f"  {draw.choice(pool).upper()}\t", f"own {i} {draw.random()}"])
               for _ in range(draw.randint(0, 12))]
        if draw.random() < 0.7:
            own.insert(draw.randint(0, len(own)), "The very common line of them all.")
        rows.append((draw.choice([i, i, None, 7]), "\n".join(own)))
    return rows


def digested(rows):
    return sorted(((d, n, gone, hashlib.sha256(t.encode()).hexdigest())
                   for d, n, gone, t in plain_lines(rows)), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_equal_a_plain_pass(spark, docs, parts):
    rows = line_texts(300, 1) + line_texts(40, 2) + [(5, None), (6, ""), (7, "\n\n"), (8, LONG)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [tuple(r) for r in lines.line_report(docs(rows, clash=True)).collect()]
        texts = [tuple(r) for r in lines.without_shared_lines(docs(rows)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(found, key=repr) == digested(rows)
    assert Counter(texts) == Counter((d, t) for d, _, _, t in plain_lines(rows))


def test_a_hot_line_spreads_over_ranges(spark, docs):
    rows = [(i, f"own line of document {i} {'y' * 20}\nthe line that everybody holds")
            for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = (lines._ready(docs(rows)).mapInArrow(lines._records, lines._RECORD)
                   .repartitionByRange(16, "hi", "lo", "known", "doc"))
        sizes = [n for n in records.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    found = lines.line_report(docs(rows)).where("n_dropped > 0").count()
    assert found == 3999


def test_line_cases(docs):
    found = [tuple(r) for r in lines.line_report(docs(ODD, clash=True)).collect()]
    assert sorted(found, key=repr) == digested(ODD)
    assert lines.line_report(docs(ODD).limit(0)).count() == 0
    bits = {r.doc_id: r for r in lines.keep_bitmaps(docs([(i, "a\n" + "b" * 30) for i in
                                                          range(3)])).collect()}
    assert [bits[i].n_dropped for i in range(3)] == [1, 1, 0]
    assert lines.kept(b"a\n" + b"b" * 30, bits[0].keep) == b"a"


# --- phrases ---

def plain_phrases(rows, best=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] by exact integers."""
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        scored = []
        for p, a in held.items():
            if any(100 * b >= 50 * a for q, b in held.items() if len(q) > len(p)
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]],
                                         f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def phrase_rows(seed):
    draw = random.Random(seed)
    words = ["the", "The", "a", "of", "Köln", "漢字", "x-ray", "(b)"] + [f"w{i}" for i in range(9)]
    rows = []
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "\t ", ", ", ".", "\n", " \v"])
                       for _ in range(draw.randint(0, 30)))
        rows.append((text, draw.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("new york " * 40, "fr"), (LONG, "la"),
                   ("the the " * 50, "en")]


@pytest.fixture
def texts(spark):
    return lambda rows: spark.createDataFrame(
        [(i, *r, 0, 1, "z") for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, n long, h long, word string")


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n",
                                              "score").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_phrases_equal_plain_counts(texts, seed):
    rows = phrase_rows(seed)
    assert as_rows(phrases.collocations(texts(rows))) == plain_phrases(rows)
    assert as_rows(phrases.collocations(texts(rows), 3)) == plain_phrases(rows, 3)


def test_counts_travel_as_deflated_pages(spark, texts, monkeypatch):
    """Counts beyond a byte, pages of few of them: nothing is lost, and a task sends a row a page."""
    n = np.array([0, 1, 254, 255, 256, 0, 1 << 40])
    assert phrases._unpacked(phrases._packed(n), len(n)).tolist() == n.tolist()
    monkeypatch.setattr(phrases, "SUMS", 3)
    rows = [("a b c d. " * 20 + "a b", "en")] * 30 + [("x y, b c", None)] * 12
    assert as_rows(phrases.collocations(texts(rows))) == plain_phrases(rows)


def test_phrases_over_many_shards(texts, monkeypatch):
    """Shards of few phrases, filters that let nearly everything pass: the same counts."""
    monkeypatch.setattr(phrases, "SHARD", 40)
    monkeypatch.setattr(phrases, "SHARDS", 2)
    monkeypatch.setattr(phrases, "BITS", 1 << 12)
    draw = random.Random(9)
    rows = phrase_rows(2) + [(" ".join(draw.choice("abcdef") for _ in range(400)), "en")
                             for _ in range(4)]
    assert sum(len(r[2].split()) == 3 for r in plain_phrases(rows)) > 20
    assert as_rows(phrases.collocations(texts(rows))) == plain_phrases(rows)


def test_the_blocks_are_read_as_often_however_large_the_corpus(spark, texts, monkeypatch):
    """Filters of few bits stand for a large corpus: more classes of phrases, not more passes."""
    draw = random.Random(3)
    rows = phrase_rows(5) + [(" ".join(draw.choice("abcdef") for _ in range(400)), "en")
                             for _ in range(40)]
    want, jobs = plain_phrases(rows), []
    monkeypatch.setattr(phrases, "LOT", 700, raising=False)
    for bits in (1 << 14, 1 << 12):
        monkeypatch.setattr(phrases, "BITS", bits)
        spark.sparkContext.setJobGroup(f"phrases {bits}", "")
        assert as_rows(phrases.collocations(texts(rows))) == want
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"phrases {bits}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 5 and abs(jobs[1] - jobs[0]) < 5


def test_totals_of_lots_add_up_by_bit():
    """Counts beyond a byte stop at 255; a lot is told which of its own bits have enough."""
    bits = 1 << 20
    draw = np.random.default_rng(0)
    told, total = [], np.zeros(bits, np.int64)
    for lot in range(3):
        at = np.unique(np.append(draw.integers(0, bits, 900), [0, 7, bits - 1]))
        n = draw.integers(1, 6, len(at))
        n[at == 7] = 200
        total[at] += n
        packed = phrases._gaps(at.astype(np.uint64), n)
        assert [x.tolist() for x in phrases._ungapped(packed, len(at))] == [at.tolist(), n.tolist()]
        told.append((lot, 4, len(at), packed, at))
    rows = pd.DataFrame([r[:4] for r in told], columns=["lot", "class", "n", "totals"])
    out = phrases._reached(10, bits)(rows)
    assert out["lot"].tolist() == [0, 1, 2]
    for flags, (*_, at) in zip(out["bits"], told, strict=True):
        reached = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(at)).astype(bool)
        assert (reached == (total[at] >= 10)).all() and 0 < reached.sum() < len(at)


def test_lots_name_words_by_number(spark, monkeypatch):
    """The most frequent words have numbers, the others travel as hashes, and none is lost."""
    words = spark.createDataFrame([("en", h, f) for h, f in [(-5, 900), (7, 40), (8, 1000), (9, 10),
                                                             (3, 11)]], "lang string, h long, f long")
    phrase = np.array([[8, 9, 0], [8, 8, 8], [3, 7, 8], [9, 3, 7]], np.uint64)
    phrase[2, 1] = np.uint64(2 ** 64 - 5)
    for most, known in ((1 << 20, 5), (3, 3), (1, 0)):
        monkeypatch.setattr(phrases, "NAMES", most)
        names = phrases._names(words)
        assert len(names[0]) == known and sorted(names[1].tolist()) == [*range(1, known + 1)]
        codes = phrases._named(phrase, names)
        assert known == 0 or codes[0].tolist() == [1, 4 if known == 3 else 5, 0]
        packed, others = phrases._coded(codes, phrase, known)
        assert len(others) == 8 * (codes > known).sum()
        assert (phrases._decoded(packed, others, 4, names) == phrase).all()


def test_totals_travel_without_their_zeros():
    """Few totals of a page: little more than a byte each travels, whatever the gaps."""
    page = np.zeros(phrases.TOTALS, np.uint8)
    page[[0, 1, 300, len(page) - 1]] = [1, 255, 7, 9]
    for totals in (page, page[:4096], np.zeros(8, np.uint8), np.full(8, 3, np.uint8)):
        at, own = phrases._spread(phrases._sparse(totals))
        assert at.tolist() == np.flatnonzero(totals).tolist()
        assert own.tolist() == totals[totals > 0].tolist()
    some = np.random.default_rng(1).random(phrases.TOTALS) < 0.01
    assert len(phrases._sparse(some.astype(np.uint8))) < 1.6 * some.sum()


def test_known_candidates_are_not_passed_on_again(spark, texts, monkeypatch):
    rows = phrase_rows(4)
    blocks = spark.createDataFrame(
        [tuple(b.to_pylist()[0].values()) for b in phrases._blocks(iter([
            pa.RecordBatch.from_pylist([{"lang": lang or "und", "text": text or ""}
                                        for text, lang in rows])]))],
        "lang string, words binary, codes binary")
    every = SimpleNamespace(value=[np.full(512, 255, np.uint8)] * 3)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in blocks.collect()])

    def given(known):
        return [r for b in phrases._candidates(every, (0, 1), SimpleNamespace(value=known))(
            iter([batch])) for r in b.to_pylist()]
    first = given(np.zeros((4, 0), np.uint64))
    found = spark.createDataFrame([tuple(r.values()) for r in first],
                                  "lang string, h1 long, h2 long, h3 long")
    assert len(first) > 100 and not given(phrases._known(found, len(first)))
    # runs of blocks, of which the next one is told all or a part
    for known in (1 << 20, 5):
        monkeypatch.setattr(phrases, "KNOWN", known)
        held = spark.sparkContext.broadcast(every.value)
        all_found, count = phrases._found(blocks, held, (0, 1))
        got = [tuple(r) for r in all_found.collect()]
        assert count == len(got) == len(set(got))
        assert set(got) == {tuple(r.values()) for r in first}


def test_blocks_hold_codes_and_counts_hold_hashes(texts, monkeypatch):
    """A repeated word costs a block two bytes, words are counted and shuffled without their letters,
    and blocks of more words than two bytes tell apart are read as well."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": "one two one two. " * 500}])
    block, = phrases._blocks(iter([batch]))
    assert sum(len(block[c][0].as_py()) for c in ("words", "codes")) < 4 * 2000
    (words, codes), = phrases._words_of(block)
    assert len(words) == 3 and np.bincount(codes).tolist() == [500, 1000, 1000]
    counts, = phrases._word_counts(iter([batch]))
    assert counts.schema.names == ["lang", "h", "n"]
    many = pa.RecordBatch.from_pylist([{"lang": "en", "text": " ".join(map(str, range(70000)))}])
    (words, codes), = phrases._words_of(next(phrases._blocks(iter([many]))))
    assert len(words) == 70001 and codes.dtype == np.uint32 and len(np.unique(codes)) == 70001


def test_phrase_cases(texts):
    assert phrases.collocations(texts([]).limit(0)).count() == 0
    assert phrases.collocations(texts([("lonely words only", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, 2, 0, 5_000_000_000, 4_000_000_001, 4_000_000_000)],
        "lang string, h1 long, h2 long, h3 long, first long, last long, a long")
    score = phrases._scored(counts).first()["score"]
    assert score == 10 ** 6 * 4_000_000_000 ** 2 // (5_000_000_000 * 4_000_000_001)


@pytest.mark.parametrize("seed", range(3))
def test_trie_accepts_its_phrases_only(seed):
    draw = np.random.default_rng(seed)
    words = draw.integers(1, 1 << 63, 60).astype(np.uint64)
    rows = np.unique(words[draw.integers(0, 60, (500, 3))], axis=0)
    rows[::3, 2] = 0
    rows = np.unique(rows, axis=0)
    trie, accepting = phrases.build(rows)
    assert len(set(accepting.tolist())) == len(rows)
    for row, state in zip(rows, accepting, strict=True):
        at = np.zeros(1, np.int64)
        for word in row[row != 0]:
            at = trie.step(at, trie.codes(np.array([word], np.uint64)))
        assert at[0] == state
    have = {tuple(r[:n]) for r in rows.tolist() for n in (1, 2, 3) if r[n - 1]}
    for a, b, c in words[draw.integers(0, 60, (500, 3))].tolist():
        at = np.zeros(1, np.int64)
        for n, word in enumerate((a, b, c), 1):
            at = trie.step(at, trie.codes(np.array([word], np.uint64)))
            assert (at[0] >= 0) == ((a, b, c)[:n] in have)
            if at[0] < 0:
                break


# --- hard negatives ---

def plain_negatives(rows):
    """{(anchor, positive, rank): (negative, positive score, negative score)}."""
    use = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(
                c is None or not np.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        use.append((vec_id, [int(Fraction(float(np.float32(c))) * 256 // 1) for c in x], label))
    out = []
    for a, q, label in {(a, tuple(q), label) for a, q, label in use if a % 50 == 0}:
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), k, other)
                  for k, p, other in use if k != a and len(p) == len(q)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            found = sorted(s for s in scored if s[2] != label
                           and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            clip = [max(min(-x, 2 ** 63 - 1), -2 ** 63) for x in (ps, *(s[0] for s in found))]
            out += [(a, p, i + 1, k, clip[0], clip[i + 1]) for i, (_, k, _) in enumerate(found)]
    return sorted(out)


def vector_rows(seed, n=900, d=6, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, d))
    return [(i, [float(c) for c in centres[i % 12] + spread * draw.normal(size=d)],
             int(draw.integers(0, 10))) for i in draw.permutation(n).tolist()]


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>,"
                                  " label int, score int, place int")
    return sorted(tuple(r) for r in negatives.hard_negatives(frame).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_negatives_equal_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives.v, "ROWS", 200)
    rows = vector_rows(seed)
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(negatives.v, "BROADCAST", 600)
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    rows = vector_rows(3, 400)
    assert mined(spark, rows) == plain_negatives(rows)


def test_negative_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [(k, [1.0, 0.5], k % 3) for k in range(0, 400, 5)]
    rows = [*same, *same[:9], (1, None, 2), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1),
            (4, [None, 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0, 0.5], None), (8, [], 1),
            (9, [], 2), (500, [], 1), (11, [0.9, 0.4], 5), (12, [0.0, 0.0], 0),
            (13, [-1.0, -0.5], 7), (450, [-3.0, 1.0], 0), (550, [0.0, 0.0], 1)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, rows[:0]) == []


@pytest.mark.parametrize("large", [1e6, 1e15, 3e38])
def test_negatives_of_large_components(spark, large):
    rows = [(k, [large * (1 - k / 1000), float(k)], k % 2) for k in range(0, 250, 10)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_walks_end_early():
    draw = np.random.default_rng(5)
    centre = np.zeros(16)
    centre[0] = 1
    q = np.floor(256 * (centre + 0.05 * draw.normal(size=(30, 16)))).astype(np.int64)
    rows = np.floor(256 * np.vstack([centre + 0.05 * draw.normal(size=(500, 16)),
                                     0.6 * draw.normal(size=(20000, 16))])).astype(np.int64)
    cluster = negatives.Cluster(np.arange(30) - 100, np.zeros(30, int), 1, q)
    ids = np.arange(len(rows))
    lists, _, scored = negatives.walk(cluster, ids, np.ones(len(rows), int), rows,
                                      *negatives.directions(rows))
    assert scored[0] < 0.2 * len(rows) * len(q)
    for m in range(30):
        s = rows @ q[m]
        assert lists.ids[m].tolist() == np.lexsort((ids, -s))[:5].tolist()
