import random

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, components, documents
from tidegraph.llm import shingles, simhash


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n=5):
    """Plainly, as tuples of words."""
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similar(a, b, least=0.8):
    common = len(a & b)
    return common >= least * (len(a) + len(b) - common)


def test_hashes_of_words_and_shingles(monkeypatch):
    texts = [r[1] for r in documents()] + ["x", "A b  C\td\x0be\x0cf", "é" * 3000 + " b", "a" * 5000 + "\n" + "b" * 300, "one two three four", "one two three four five"]
    for block in (1 << 20, 64):
        monkeypatch.setattr(shingles, "BLOCK", block)
        h, n = shingles.word_hashes(shingles.lowered(texts))
        assert n.tolist() == [len(words_of(t)) for t in texts]
        flat = [w for t in texts for w in words_of(t)]
        names = {}
        assert all(names.setdefault(w, x) == x for w, x in zip(flat, h.tolist(), strict=True))
        assert len(set(names.values())) == len(names)
        s, m = shingles.shingle_sets(texts)
        assert m.tolist() == [len(shingle_set(t)) for t in texts]
        parts = np.split(s, np.cumsum(m)[:-1])
        assert all((np.diff(p.astype(float)) >= 0).all() for p in parts)
        for i in range(0, len(texts), 3):
            for j in range(0, len(texts), 5):
                assert len(np.intersect1d(parts[i], parts[j])) == len(shingle_set(texts[i]) & shingle_set(texts[j]))


def test_set_fingerprints():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 2, 5, 300, 0, 7)]
    for block in (1 << 17, 4):
        got = shingles.set_fingerprints(np.concatenate(sets), np.array([len(x) for x in sets]), block)
        for x, f in zip(sets, got.tolist(), strict=True):
            assert f == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(x))


def test_near_copies_are_dropped(spark, docs, none):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(20)]
    rows = []
    for i, words in enumerate(base):
        for j in range(4):
            w = list(words)
            for p in rng.sample(range(200), j):
                w[p] = f"new{rng.randint(0, 10**6)}"
            rows.append((i * 10 + j, " ".join(w), "en", "a", 1, 1, 1.0, 1, "", 1))
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = simhash.without_near_copies(table)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [i * 10 for i in range(20)]
    kept = [r["doc_id"] for r in simhash.without_near_copies(docs).collect()]
    assert len(kept) == len(set(kept))
    assert {0, 1, 7} <= set(kept)
    assert not {121, 122, 124} & set(kept)  # blank like null; copies
    upper = documents()[125][1]  # only A-Z are lower-cased
    assert (125 in kept) == (upper.encode().lower() != documents()[0][1].encode().lower())
    assert simhash.without_near_copies(none).count() == 0


@pytest.mark.parametrize("limits", [{}, {"TILE_SETS": 9, "FINE": 1, "SMALL": 4}, {"TILE_SHINGLES": 900}])
def test_clusters_lose_no_near_copy(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(14):  # orders of the same words: near fingerprints, no common shingles; each in three near copies
        rng.shuffle(words)
        for j in range(3):
            w = list(words)
            for p in rng.sample(range(300), j * (i % 3)):
                w[p] = f"new{i}{j}"
            rows.append((len(rows), " ".join(w), "en", "a", 1, 1, 1.0, 1, "", 1))
    rng.shuffle(rows)
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = components(sets, lambda a, b: similar(sets[a], sets[b]))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == root
    assert len(set(root.values())) < len(rows)


@pytest.mark.parametrize("limits", [{}, {"SAMPLED": 1, "SEEN": 3}, {"SAMPLED": 1, "SEEN": 2, "HOT": 50, "CHUNK": 700, "BUCKET": 300}, {"TEXTS": 3}])
def test_near_copies_of_far_fingerprints(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(shingles, name, value)
    rng = random.Random(12)
    line = [f"licence{i}" for i in range(12)]
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 400))] + line * (i % 2) for i in range(40)]
    texts = []
    for i, w in enumerate(base):
        n = len(w)
        edited = list(w)
        for p in rng.sample(range(n), n // 60):
            edited[p] = f"new{i}"
        texts += [w, w + base[i - 1][: n // 8], w[: n - n // 7], w[n // 9 :], edited, w + base[i - 2][: n // 3]]  # the last is under 0.8
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000, "one two three"), (1001, ""), (1002, None), (1003, "One  two three")]
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    prints = {i: int(shingles.set_fingerprints(*shingles.distinct(*shingles.word_hashes(shingles.lowered([t]))))[0]) for i, t in rows}
    linked = lambda a, b: similar(sets[a], sets[b])
    want = components(sets, linked)
    assert want != components(sets, lambda a, b: linked(a, b) and (prints[a] ^ prints[b]).bit_count() <= 4)  # links that fingerprints alone lose
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (1, long), (1, "other words here altogether"), (2, long + " tail"), (None, "no id one two"), (None, "no id one two"), (None, long), (3, "alone")]
    out = sorted((r["doc_id"] is None, r["doc_id"], r["text"][:9]) for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert out == [(False, 1, "other wor"), (False, 1, "w0 w1 w2 "), (False, 3, "alone"), (True, None, "no id one")]


@pytest.mark.parametrize("first", [None, 25])
def test_shingle_links_against_brute_force(first):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(30 if i % 3 else 12, rng.integers(0, 14))).astype(np.int64) + i % 4 * 5 for i in range(70)]

    def linked(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        across = first is None or a < first <= b
        return across and common >= 0.5 * (len(sets[a]) + len(sets[b]) - common)

    want = components(range(70), linked)
    for block, columns in ((512, 8192), (8, 4), (25, 3)):
        got = simhash.shingle_links(sets, 0.5, first, block, columns)
        assert got.tolist() == [want[i] for i in range(70)]
    assert len(simhash.shingle_links([], 0.5)) == 0


