"""N-gram join and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest

from ridgeline.llm import embedding_dedup, ngram_join
from tests.llm import frames


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def smallest(ids, links):
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                moved = True
    return least


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return {i: len(s) for i, s in sets}, smallest([i for i, _ in sets], links)


def corpus(seed, families=12, copies=30):
    """Families of near copies of many sizes and degrees, with passages shared across families."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, number = [], 0
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 5, 8, 20, 60, 150)))]
        if f % 3 == 0:
            base = base + passage
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((number, " ".join(own)))
            number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_components(spark, seed, k, percent):
    rows = corpus(seed)
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    sizes, least = brute(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == least


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_every_close_pair_shares_a_signature(percent):
    """The prefixes' guarantee, for any classes: frequent, rare or lone by chance."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(2, 80))
        base = rng.choice(10_000, n + 20, replace=False).astype(np.int64) * 7919
        x, y = np.sort(base[:n]), np.sort(np.concatenate([base[int(rng.integers(0, max(1, n // 6))) : n], base[n : n + int(rng.integers(0, max(1, n // 6)))]]))
        shared = len(np.intersect1d(x, y))
        if not shared or 100 * shared < percent * (len(x) + len(y) - shared) or np.array_equal(x, y) or min(len(x), len(y)) < 2:
            continue
        share = rng.random()
        frequent = lambda s, p=share: (s // 7919 * 2654435761 % 1000) < 1000 * p
        both = np.intersect1d(x, y)
        found = []
        for s in (x, y):
            often = frequent(s)
            several = np.isin(s, both) | often
            rare, _, pairs = ngram_join.signatures(len(s), s[several], often[several], percent)
            found.append(set(rare.tolist()) | {("pair", p) for p in pairs.tolist()})
        assert found[0] & found[1]


@pytest.mark.parametrize("bits, chunk", [(6, 1), (12, 1), (18, 1 << 20)])
def test_classes_are_exact(spark, monkeypatch, bits, chunk):
    """Small chunks and many buckets: which tokens are lone, rare or frequent is what counting says."""
    monkeypatch.setattr(ngram_join, "LEAST_BITS", bits)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = [*corpus(7, 30, 60), (-1, " ".join(f"v{k % 400}" for k in range(6000))), (-2, None), (-3, "")]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3).sortWithinPartitions("id")
    got = {r.id: r for r in ngram_join.describe(frame, 4, 85).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    counts = {}
    for s in sets.values():
        for token in s:
            counts[token] = counts.get(token, 0) + 1
    assert set(got) == set(sets)
    for i, s in sets.items():
        lone, frequent = sum(counts[t] == 1 for t in s), sum(counts[t] >= ngram_join.FREQUENT for t in s)
        assert (got[i].n, got[i].lone) == (len(s), lone)
        assert got[i].open == (len(s) > 0 and lone <= len(s) - -(-85 * len(s) // 100))
        assert not got[i].open or got[i].odd == len(s) - frequent
        assert got[i].tokens is None or len(got[i].tokens) // 8 == len(s) - lone


def test_small_families_of_a_list_share_tiles(spark, monkeypatch):
    """Very many short documents of common words: lists of many families, none of which is one component."""
    rng = random.Random(3)
    rows = [(k, " ".join(sorted(rng.sample("abcdefghijklmnop", 9)))) for k in range(700)]
    got = {r.doc_id: r for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 75).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute(rows, 1, 75)[1]


def test_rows_that_share_an_id(spark):
    one, two, three = "a b c d e f g h", "p q r s t u v w", "k l m n o k l m"
    rows = [(5, one, "x", 1), (5, two, "x", 1), (4, one + " i", "x", 1), (6, two, "x", 1), (7, three, "x", 1), (7, None, "x", 1), (None, three, "x", 1), (None, one, "x", 1), (None, None, "x", 1), (9, "z", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(frame, 1, 80).select("doc_id", "n_shingles", "component_id").collect() if r.doc_id is not None)
    assert [g[1:] for g in got] == [(4, 9, 4), (5, 8, 4), (5, 8, 4), (6, 8, 4), (7, 0, 7), (7, 5, 7), (9, 1, 9)]
    lost = sorted((r.n_shingles, r.component_id) for r in ngram_join.link(frame, 1, 80).where("doc_id is null").collect() if r.n_shingles)
    assert lost == [(5, 7), (8, 4)]


def test_keys_of_any_type(spark):
    rows = corpus(4, 6, 12)
    plain = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    frame = spark.createDataFrame(rows, "i long, text string").selectExpr("struct(lpad(string(i), 6, '0') as a, i as b) as k", "text")
    got = {r.k.b: (r.n_shingles, r.component_id.b) for r in ngram_join.link(frame, 4, 85, key="k").collect()}
    assert got == {r.doc_id: (r.n_shingles, r.component_id) for r in plain}


def test_settings_stay(spark):
    before = {k: v for k, v in spark.conf.getAll.items() if "arrow" in k}
    ngram_join.link(frames.docs(spark), 5, 80).count()
    assert before == {k: v for k, v in spark.conf.getAll.items() if "arrow" in k}


def test_odd_documents(spark):
    got = {}
    for r in ngram_join.link(frames.docs(spark), 5, 80).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got[1] == got[2] == {(16, 1)} and got[4] == {(0, 4)} and got[5] == {(0, 5)} and got[6] == {(0, 6)}
    assert got[9] == {(1, 9)} and got[10] == {(1, 9)} and {c for _, c in got[8]} == {7}
    assert ngram_join.link(frames.empty(spark)).count() == 0


def test_token_matrix_in_slices(monkeypatch):
    monkeypatch.setattr(ngram_join, "MATRIX", 64)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.int64) for n in (5, 80, 200, 1, 120)]
    pack = lambda some: (np.array([len(s) for s in some]), np.concatenate(some))
    got = ngram_join._overlaps(pack(sets[:3]), pack(sets[2:]))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(400):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((k, [float(x) for x in v * rng.choice([1.0, 3.0])], int(rng.integers(0, 3))))
    rows += [(1000 + k, *rows[0][1:]) for k in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 16, None), (2004, [None] * 16, 1), (2005, [1.0, 2.0], 1), (2006, [], 1), (2007, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.link(frame, tile=64).collect()}
    usable = [(i, np.array(v, float), label) for i, v, label in rows if i < 2000 or i == 2005]
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(i, j) for n, (i, a, x) in enumerate(usable) for j, b, y in usable[n + 1 :] if x == y and len(a) == len(b) and cosine(a, b) >= 0.93]
    least = smallest([r[0] for r in rows], links)
    counts = {r[0]: 0 for r in rows}
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    assert {i: r.component_id for i, r in got.items()} == least
    assert {i: r.n_links for i, r in got.items()} == counts
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert embedding_dedup.link(frame.where("false")).count() == 0


def test_error_bound_is_rigorous():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    raw = rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 24)))
    raw[100:] = raw[:100] + rng.normal(size=(100, 24)) * 0.3
    table = pa.table({"label": [1] * 200, "dim": pa.array([24] * 200, pa.int32()), "tile": [0] * 200, "class": list(range(200)), "copies": [1] * 200, "raw": [r.tobytes() for r in raw]})
    built = embedding_dedup._build(table)
    tile = embedding_dedup._Tile(24, *(built[n][0] for n in ("classes", "copies", "q", "stats")))
    x = np.frombuffer(built["raw"][0].as_buffer(), float).reshape(-1, 24)
    exact = x @ x.T
    left = 0
    for t in (0.2, 0.9, 0.93, 0.99):
        sure, open_pairs = embedding_dedup.screen(tile, tile, t)
        assert not (sure & open_pairs).any() and open_pairs.sum() < 4000
        left += open_pairs.sum()
        assert ((sure | embedding_dedup.settle(x, x, open_pairs, t)) == (exact >= t)).all()
    assert left > 0


def test_vectors_that_share_an_id(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, x, 1), (5, y, 1), (6, [1.0, 0.1, 0.0], 1), (7, [0.1, 1.0, 0.0], 1), (6, None, 1), (8, None, 1), (8, [0.0], 1), (None, y, 1), (None, [0.0, 0.0, 1.0], 1), (None, None, None), (9, [1e200, 0.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 3, 4, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, rep int, tile int")
    got = sorted(embedding_dedup.link(frame).select("vec_id", "n_links", "component_id", "kept").collect(), key=str)
    have = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], key=str)
    want = [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (6, 0, 5, False), (7, 2, 5, False), (8, 0, 8, True), (8, 0, 8, True), (9, 0, 9, True), (None, 2, 5, False), (None, 0, None, True), (None, 0, None, True)]
    assert have == sorted(want, key=str)
