"""Quality, near copies, leaks, mixing, sharding, top-k and the pipeline."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from orbitlake.llm import graph, leaks, mixing, near, quality, sharding, shared, topk
from tests.llm.conftest import ODD, SF


# --- near copies ---

def brute_links(rows):
    """(links, class id) of each row, in the order of the rows."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or x and y and \
                    10 * len(x & y) >= 8 * len(x | y):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[root(i)] = min(ids.get(root(i), key), key)
    return [(links[i], ids.get(root(i))) for i in range(len(rows))]


def copies(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(draw.choice([3, 6, 40, 120]))]
        for k in range(draw.choice([1, 1, 2, 4])):
            own = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                own[draw.randrange(len(own))] = f"v{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    return rows


def test_near_copies_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)       # groups of more than one block
    rows = copies(60, 3) + [(500 + i, "one long text of near copies " * 3
                             + " ".join(f"x{j}" for j in range(60)) + f" end{i}")
                            for i in range(15)] + ODD
    found = near.near_duplicates(docs(rows, clash=True)).collect()
    want = brute_links(rows)
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in found) == Counter(
        (k, n, c) for (k, _), (n, c) in zip(rows, want, strict=True))


def test_near_copies_of_the_tables(sample):
    frame = sample("documents")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_links, r.class_id) for r in near.near_duplicates(frame).collect()}
    assert found == {k: w for (k, _), w in zip(rows, brute_links(rows), strict=True)}


def test_one_of_each_group_stays(docs):
    rows = [(k + 100, t) for k, t in copies(25, 9)] + ODD
    frame = docs(rows, clash=True)
    kept = near.keep_one(frame)
    assert kept.columns == frame.columns
    classes = {c for _, c in brute_links(rows)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(classes)
    assert near.keep_one(docs([])).count() == 0 == near.near_duplicates(docs([])).count()


def test_bands_reach_the_recall():
    count, rows = near.bands()
    assert count * rows <= near.HASHES
    assert 1 - (1 - near.LEAST ** rows) ** count >= near.RECALL


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200), (7, 3)]
    found = graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r.u, r.v) for r in found} == {(i, 0) for i in range(1, 31)} | {(101, 100), (102, 100)}


# --- quality ---

def test_held_out_accuracy(sample):
    frame, labels = sample("documents"), sample("labels")
    rows = quality.quality(frame, labels).join(labels, "doc_id").toPandas()
    for row in rows.itertuples():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert row.predicted == (row.score >= 0.7) and 0 <= row.score <= 1
    unseen = rows[rows.held_out]
    assert (unseen.predicted == unseen.quality).mean() >= 0.95


def test_quality_cases(docs, spark, sample):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, 1), (None, 1, 0), (8, None, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality.quality(docs(ODD, clash=True), labels).collect()
    assert len(found) == len(ODD)
    assert len({r.score for r in found if r.doc_id in (None, 1, 2, 3)}) == 1
    assert quality.quality(docs([]), labels).count() == 0
    blind = quality.quality(docs(ODD), labels.limit(0)).collect()
    assert {r.score for r in blind} == {0.5}
    kept = quality.keep_good(sample("documents"), sample("labels"))
    assert kept.columns == sample("documents").columns


# --- leaks ---

ITEMS = [(1, "Which river runs through the old town of Varnholm? The answer is the quiet Selde."),
         (2, "Seventeen copper kettles stood along the northern wall while nine porters counted "
             "their lamps. They found eleven lamps missing."),
         (3, ""), (4, None)]


def _padding(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou")
                            for _ in range(draw.randint(2, 4))) for _ in range(n))


def test_leaks(docs, spark):
    whole = ITEMS[1][1]
    words = whole.split()
    changed = " ".join("other" if i in (2, 8, 11) else w for i, w in enumerate(words))
    rows = [(i, _padding(300, i)) for i in range(40)]
    rows += [(50, _padding(90, 91) + " " + whole + " " + _padding(120, 92)),
             (51, _padding(33, 93) + " " + changed.upper() + " " + _padding(5, 94)),
             (52, whole), (53, ITEMS[0][1].replace(" ", "\n")),
             (54, " ".join(words[:5]) + " " + _padding(200, 95)),
             (55, "Seventeen copper pots stood by the northern gate while nine boys counted all "
                  "lamps. They found eleven lamps missing.")] + ODD
    rows += [(60 + i, _padding(100, 200 + i) + " " + ITEMS[0][1] + " " + _padding(60, 300 + i))
             for i in range(25)]                 # one item in a third of the rows
    items = spark.createDataFrame([(*i, 1, "x") for i in ITEMS],
                                  "item_id long, text string, doc_id long, words string")
    frame = docs(rows, clash=True)
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(frame, items).collect()}
    assert found == {(50, 2), (51, 2), (52, 2), (53, 1), (55, 2),
                     *((60 + i, 1) for i in range(25))}
    kept = leaks.keep_clean(frame, items)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        k for k, _ in rows if k not in (50, 51, 52, 53, 55, *range(60, 85)))
    assert leaks.leaks(docs([]), items).count() == 0
    assert leaks.leaks(frame, items.limit(0)).count() == 0


def test_leaks_of_the_tables(sample):
    frame, items = sample("documents"), sample("benchmark")
    flat = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    texts = [(r.doc_id, flat(r.text)) for r in frame.collect()]
    want = {(k, i.item_id) for i in items.collect() for k, t in texts if flat(i.text) in t}
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(frame, items).collect()}
    assert want <= found


def _space(texts, weights):
    hashed = [leaks._word_hashes(leaks._plain(t)).view(np.int64) for t in texts]
    rows = pd.DataFrame({"item_id": range(len(texts)), "words": hashed, "answer": [[]] * len(texts),
                         "first": 0, "last": [len(h) for h in hashed]})
    return leaks._Space(leaks._factorise(weights)(rows).iloc[0])


def _matched(text, space, weights):
    h = leaks._word_hashes(leaks._plain(text))
    return {m[1]: m for m in leaks._matches(h, np.zeros(len(h), np.int64), weights, space)}


def test_every_passage_of_a_full_block_is_found():
    draw = random.Random(3)
    words = _padding(4000, 4).split()
    texts = [" ".join(draw.sample(words, 16)) for _ in range(1024)]
    weights = np.full(1 << leaks.BITS, 3, np.float32)
    space = _space(texts, weights)
    assert (np.linalg.norm(space.passages, axis=1) ** 2 > 0.98).all()
    for i in range(0, 1024, 8):
        found = _matched(f"{_padding(20, i)} {texts[i]} {_padding(20, -i)}", space, weights)
        assert i in found and found[i][3] == 1


def test_short_verbatim_items_among_rare_words():
    draw = random.Random(5)
    words = _padding(900, 6).split()
    texts = [" ".join(draw.sample(words, n)) for n in (1, 2, 3, *range(4, 17)) for _ in range(20)]
    weights = np.full(1 << leaks.BITS, 9, np.float32)
    common = leaks._word_hashes([w.encode() for w in words])
    weights[leaks._bucket(common)] = draw.choices((leaks.FLOOR, 1, 4), k=len(common))
    space = _space(texts, weights)
    for i, text in enumerate(texts):
        found = _matched(f"{_padding(30, i)} {text} {_padding(30, -i - 1)}", space, weights)
        assert i in found and found[i][3] == 1, text


def test_fitted_windows_end_with_their_text():
    weights = np.full(1 << leaks.BITS, 3, np.float32)
    space = _space(["one two three four five six", "lone"], weights)
    texts = ["two three four five six", "five six one two", "three four", "lone one", "two", "lone"]
    h = np.concatenate([leaks._word_hashes(leaks._plain(t)) for t in texts])
    rows = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    found = {m[:2]: m[3] for m in leaks._matches(h, rows, weights, space)}
    assert set(found) == {(0, 0), (3, 1), (5, 1)} and found[0, 0] == 5 / 6


def test_longest_common_subsequence():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = (draw.integers(0, 6, draw.integers(1, 30)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(
                    table[i, j + 1], table[i + 1, j])
        assert leaks._common(a, b) == table[-1, -1]


# --- mixing ---

def plain_targets(own):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    total = sum(own.values())
    goal = {s: Fraction(total * w, sum(weight.values())) for s, w in weight.items()}
    while excess := sum(max(0, goal[s] - 3 * own[s]) for s in own):
        goal = {s: min(goal[s], Fraction(3 * own[s])) for s in own}
        free = sum(weight[s] for s in own if goal[s] < 3 * own[s])
        if excess < Fraction(1, 10**9):
            break
        goal = {s: g + excess * weight[s] / free if g < 3 * own[s] else g
                for s, g in goal.items()}
    return goal


def test_mix(docs):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(1, 40), draw.choice(["a", "b", "b", "b", "c", None, "z"]))
            for i in range(900)] + [(1000, "tiny", "y")] + [(*r, "odd") for r in ODD]
    rows += [(2000, "again and again", "b")] * 50
    frame = docs(rows, clash=True)
    found = mixing.mix(frame).toPandas()
    again = mixing.mix(frame.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, found[key].values.tolist())) == sorted(
        map(repr, again[key].values.tolist()))
    assert len(found) == len(rows)
    own, size = Counter(), Counter()
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        own[source] += n
        size[n] += 1
    assert Counter(found["size"]) == size
    goal = plain_targets(own)
    assert (found.taken <= 3 * found["size"]).all()
    assert (found.out_shards.map(len) * found["size"] == found.taken).all()
    by_size = found.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert np.allclose(sorted(set(by_size.target)), sorted({float(goal[s]) for s in own}))
    for row in by_size.itertuples():
        # a source that is one text can't be split
        assert abs(row.taken - row.target) <= (
            150_000 if row.Index > 200_000 else max(3, 0.01 * row.target))


def test_split_is_exact():
    quotas = np.array([7, 0, 40, 3, 1000])
    given = mixing.split(quotas, 13)
    assert (given.sum(axis=0) == quotas).all() and given.shape == (13, 5)
    assert set(np.diff(np.sort(given.sum(axis=1)))[[0, -1]]) <= {0, 1}
    assert (given == mixing.split(quotas, 13)).all()


def test_take_mix(docs):
    rows = [(i, "w " * (i % 17 + 1), "ab"[i % 2]) for i in range(300)] + [(None, None, None)]
    frame = docs(rows, clash=True)
    taken = mixing.take_mix(frame)
    assert taken.columns == frame.columns
    times = Counter(r.doc_id for r in taken.collect())
    plan = {r.doc_id: len(r.out_shards) or int(r.size == 0)
            for r in mixing.mix(frame).collect()}
    assert times == Counter({k: n for k, n in plan.items() if n})
    assert mixing.take_mix(docs([])).count() == 0 == mixing.mix(docs([])).count()


# --- sharding ---

def plain_shard(key, of):
    import hashlib
    import math
    node = sharding.ROOT
    while node in of:
        node = min(of[node], key=lambda c: -math.log((int(hashlib.md5(
            f"{key}/{c[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48) / c[1])[0]
    return int(node[1:])


def test_shards(docs):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + ODD + [(9000, "hot")] * 200
    found = sharding.sharded(docs(rows, clash=True)).toPandas()
    assert len(found) == len(rows) and set(found.law) == {"key"}
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    moved = found[found.shard != found.grown_shard]
    assert set(moved.grown_shard) == {40} and 0.01 < len(moved) / len(found) < 0.05
    of = sharding.tree(40)
    text = dict(rows)
    for r in found[found.doc_id < 200].itertuples():
        assert r.shard == plain_shard(int(r.doc_id), of)
        if r.doc_id > 10:
            raw = text[r.doc_id].encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    kept = sharding.with_shards(docs(rows, clash=True)).toPandas()
    assert dict(zip(map(str, kept.doc_id), kept.shard, strict=True)) == dict(
        zip(map(str, found.doc_id), found.shard, strict=True))
    assert sharding.sharded(docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 7, 40, 44])
def test_growth_moves_rows_only_into_the_new_shard(n):
    small, large = sharding.tree(n), sharding.tree(n + 1)
    if n >= sharding.PLANNED:
        assert all(plain_shard(k, large) in (plain_shard(k, small), n) for k in range(800))
    assert {plain_shard(k, small) for k in range(2000)} == set(range(n))


def test_weights_confine_movement():
    racks = {f"r{i}.{j}": {f"s{4 * i + 2 * j + k}": 1.0 for k in range(2)}
             for i in range(3) for j in range(2)}
    before = sharding.weighted(racks)
    racks["r1.0"]["s4"] = 2.0
    after = sharding.weighted(racks)
    for key in range(1500):
        a, b = plain_shard(key, before), plain_shard(key, after)
        assert a == b or b in range(4, 8)        # only region 1 gained weight


# --- top-k ---

def test_top_k_equals_products(spark, sample):
    frame = sample("embeddings")
    rows = {r.vec_id: np.floor(np.array(r.embedding, float) * 256).astype(int)
            for r in frame.collect()}
    found = topk.top_k(frame).toPandas()
    for q, own in found.groupby("query_id"):
        best = sorted((-int(v @ rows[q]), k) for k, v in rows.items() if k != q)[:5]
        own = own.sort_values("rank")
        assert list(zip(-own.score, own.vec_id, strict=True)) == best
    assert set(found.query_id) == {k for k in rows if k % 50 == 0}


def exactly(vector):
    return [int(Fraction(float(np.float32(x))) * 256 // 1) for x in vector]


def ranked(rows, query, most=2 ** 63 - 1):
    """The five best of {id: vectors} for a query id by Python integers."""
    own = exactly(next(x for k, x in rows if k == query))
    best = sorted((-sum(a * b for a, b in zip(own, exactly(x), strict=True)), k)
                  for k, x in rows if k != query and len(x) == len(own))[:5]
    return [(min(max(-s, -most - 1), most), k) for s, k in best]


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (50, [0.1, 0.1]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None),
            (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0]),
            (None, [1.0, 1.0]), (9, [-1.0, 0.3]), (1, [1.0, -0.5]), (10, [0.0, 0.0]),
            (11, [-0.001, 0.9]), (100, []), (13, [])]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows],
                                  "vec_id long, embedding array<float>, score int, rank int, "
                                  "q string")
    good = [(k, x) for k, x in rows if k in (0, 50, 1, 2, 7, 9, 10, 11, 100, 13)]
    found = topk.top_k(frame).collect()
    for q in (0, 50, 100):
        got = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [x[1:] for x in got] == ranked(good, q)
    assert topk.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("large", [7e4, 2e6, 1e15, 1e30])
def test_top_k_of_large_components(spark, large):
    rows = [(0, [1.0, 0.0]), (1, [large, 0.0]), (2, [0.5, 0.0]), (3, [-large, 1.0]),
            (4, [large * 2, 1.0]), (50, [large, -large]), (5, [large * 2, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(frame).collect()
    for q in (0, 50):
        got = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [x[1:] for x in got] == ranked(rows, q)


@pytest.mark.parametrize("seed", range(4))
def test_bit_slices(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(-200, 200, (130, 9))
    query = draw.integers(-300, 300, 9)
    index = [topk.slices(values[:, d]) for d in range(9)]
    total = topk.scores(index, query, 24, np.zeros(3, np.uint64))
    assert (topk._values(total, np.arange(130)) == values @ query).all()


# --- the pipeline ---

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    names = docs.columns
    before = docs.toPandas()
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps[name] = docs.toPandas()
        if name != "sharding":
            assert docs.columns == names
    good = steps["quality classifier"]
    known = good[good.doc_id.isin(labels.index)]
    assert labels[known.doc_id].mean() > 0.97
    assert labels[labels == 1].index.isin(good.doc_id).mean() > 0.97
    rows = list(zip(good.doc_id, good.text, strict=True))
    assert set(steps["near copies"].doc_id) == {c for _, c in brute_links(rows)}
    clean = steps["benchmark decontamination"]
    assert 0 < len(clean) <= len(steps["near copies"]) <= len(good) <= len(before)
    mix = steps["source mixing"]
    assert set(mix.doc_id) <= set(clean.doc_id) and mix.doc_id.value_counts().max() <= 3
    last = steps["sharding"]
    assert len(last) == len(mix) and last.shard.between(0, 39).all()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(whole.doc_id, whole.shard, strict=True)) == Counter(
        zip(last.doc_id, last.shard, strict=True))
    assert isinstance(before, pd.DataFrame)


# --- memory of a task ---

def test_texts_reach_python_in_batches_of_bytes(spark, docs, sample):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    frame = docs([(i, "word " * 60_000) for i in range(40)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes])})
    try:
        found = [r.n for r in shared.over_texts(frame, sizes, "n long").collect()]
        assert sum(found) >= 40 * 300_000 and max(found) <= shared.BATCH + 300_100
        items = sample("benchmark")
        for step in (lambda d: quality.scored(d, np.zeros(quality.BUCKETS, np.float32)),
                     near.signed, lambda d: leaks.idf(d, items), mixing.sizes):
            spark.conf.unset(name)
            step(frame.limit(1))
            assert spark.conf.get(name) == str(shared.BATCH)
    finally:
        spark.conf.set(name, before)
