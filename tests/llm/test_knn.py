import math

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import knn

SCHEMA = "chunk_id string, upsert_no bigint, vector array<float>, vid string, lo string, similarity string"


def planted(n, seed, dims=16, groups=40):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    for i in range(groups):  # close pairs and triples
        for j in range(1, 3):
            x[i * 3 + j] = x[i * 3] * g.uniform(0.5, 3) + g.normal(size=dims) * 0.05
    return x.astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.minimum(1, np.round(u @ u.T, 12))
    np.fill_diagonal(s, -2)
    top = {}
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))
        top[ids[i]] = {ids[j] for j in order[:k] if j != i and s[i, j] >= least}
    return top


def frame(spark, ids, x):
    return spark.createDataFrame([(i, n, [float(v) for v in row], "q", "q", "q") for n, (i, row) in enumerate(zip(ids, x))], SCHEMA)


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id_a, set()).add(r.id_b)
    return out


@pytest.mark.parametrize("block", [None, 8])
def test_against_brute_force(spark, monkeypatch, block):
    if block:  # every bucket of a few members takes the way of the crowded ones
        monkeypatch.setattr(knn, "BLOCK", block)
    x = planted(400, 1)
    if block:
        x[200:260] = x[200] + np.random.default_rng(2).normal(size=(60, 16)).astype(np.float32) * 0.02
    ids = [f"c{i:04d}" for i in range(len(x))]
    got = lists(knn.similar_vectors(frame(spark, ids, x), "chunk_id", "vector", "upsert_no", 0.95, dims=16, k=5))
    want = brute(ids, x, 5, 0.95)
    hit = sum(len(want[i] & got.get(i, set())) for i in ids)
    assert hit >= 0.97 * sum(map(len, want.values()))
    assert sum(len(got[i] - want[i]) for i in got) <= 0.03 * sum(map(len, want.values()))


def test_recall_of_neighbours_at_the_threshold(spark):
    """The least similar pairs that count are found in nine of ten cases."""
    g = np.random.default_rng(5)
    a = g.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = g.normal(size=(300, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.955 * a + (1 - 0.955**2) ** 0.5 * o
    x = np.concatenate([a, b]).astype(np.float32)
    ids = [f"c{i:04d}" for i in range(600)]
    got = lists(knn.similar_vectors(frame(spark, ids, x), "chunk_id", "vector", "upsert_no", 0.95))
    assert sum(ids[i + 300] in got.get(ids[i], ()) for i in range(300)) >= 0.9 * 300


@pytest.mark.parametrize("n", [10**5, 10**6, 10**7])
def test_recall_at_the_threshold_stays_as_the_table_grows(spark, monkeypatch, n):
    """With as many hash functions as n vectors have, the least similar pairs are still found."""
    monkeypatch.setattr(knn, "log", lambda _: math.log(n))
    g = np.random.default_rng(6)
    a, o = g.normal(size=(2, 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    x = np.concatenate([a, 0.9501 * a + (1 - 0.9501**2) ** 0.5 * o]).astype(np.float32)
    ids = [f"c{i:04d}" for i in range(2000)]
    got = lists(knn.similar_vectors(frame(spark, ids, x), "chunk_id", "vector", "upsert_no", 0.95))
    hit = sum(ids[i + 1000] in got.get(ids[i], ()) for i in range(1000))
    print(f"n {n}: {hit} of 1000")
    assert hit >= 0.98 * 1000


def test_copies_versions_and_unusable_vectors(spark, rows):
    v = [1.0] + [0.0] * 15
    nan, inf = float("nan"), float("inf")
    data = [(f"k{i:02d}", 1, v, "", "", "") for i in range(30)]
    data += [(f"k{i:02d}", 1, v, "", "", "") for i in range(30)]  # repeated rows
    data += [("old", 1, v, "", "", ""), ("old", 2, None, "", "", "")]
    data += [("n", 1, [nan] + v[1:], "", "", ""), ("i", 1, [inf] + v[1:], "", "", ""), ("z", 1, [0.0] * 16, "", "", ""), ("s", 1, [1.0], "", "", ""), ("e", 1, [], "", "", "")]
    data += [("x", 1, [None] + v[1:], "", "", ""), (None, 1, v, "", "", ""), ("neg", 1, [-1.0] + [-0.0] * 15, "", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = knn.similar_vectors(df, "chunk_id", "vector", "upsert_no", 0.95, dims=16, k=3)
    assert lists(got) == {f"k{i:02d}": {f"k{j:02d}" for j in range(5) if j != i and j < (3 if i > 2 else 4)} for i in range(4)}
    assert rows(knn.mutual_pairs(got)) == [(f"k{i:02d}", f"k{j:02d}") for i in range(4) for j in range(i + 1, 4)]
    classes = rows(knn.vector_classes(df, "chunk_id", "vector", "upsert_no", dims=16))
    assert classes == sorted([(f"k{i:02d}", "k00", 30) for i in range(30)] + [("neg", "neg", 1)])


def clustered(n, seed, dims=64):
    """Vectors of topics, whose tenth neighbours lie at cosines of about 0.6."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(n // 25, dims))[g.integers(n // 25, size=n)] + 0.8 * g.normal(size=(n, dims))
    return x.astype(np.float32)


@pytest.mark.parametrize("n", [None, 10**6, 10**7])
def test_lists_without_a_least_similarity(spark, monkeypatch, n):
    """Nine of ten of the ten nearest are found, with the family of a table of n rows, too."""
    if n:
        fit = knn.fit_family
        monkeypatch.setattr(knn, "fit_family", lambda near, far, dims, rows, probes, recall, seed: fit(near, far, dims, n, probes, recall, seed))
    x = clustered(3000, 3)
    ids = [f"c{i:04d}" for i in range(len(x))]
    df = frame(spark, ids, x)
    got = knn.topk_by_hash(df, df.where("upsert_no % 10 = 0").select("chunk_id"), "chunk_id", "vector", "upsert_no").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in range(0, len(x), 10):
        sim = u @ u[i]
        sim[i] = -2
        mine = sorted((r.place, r.id_b, r.similarity) for r in got if r.id_a == ids[i])
        assert len(mine) <= 10 and [p for p, _, _ in mine] == list(range(1, len(mine) + 1))
        assert all(s == pytest.approx(sim[int(b[1:])], abs=1e-11) for _, b, s in mine)
        hit += len({ids[j] for j in np.argsort(-sim)[:10]} & {b for _, b, _ in mine})
    print(n, hit / 3000)
    assert hit >= 0.9 * 3000


def test_lists_of_few_rows_copies_and_dirt(spark, rows):
    v, w = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    data = [(f"k{i:02d}", 1, v, "", "", "") for i in range(30)] * 2 + [("far", 1, w, "", "", ""), ("bad", 1, None, "", "", ""), (None, 1, v, "", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = knn.topk_by_hash(df, df.where("chunk_id in ('k00', 'k05', 'bad')").select("chunk_id"), "chunk_id", "vector", "upsert_no", k=3, dims=16)
    assert rows(got, "id_a", "id_b", "place") == [("k00", f"k{j:02d}", j) for j in (1, 2, 3)] + [("k05", f"k{j:02d}", j + 1) for j in (0, 1, 2)]
    assert rows(knn.topk_by_hash(df.limit(0), df.select("chunk_id"), "chunk_id", "vector", "upsert_no", dims=16)) == []


def test_empty(spark, rows):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(knn.similar_vectors(df, "chunk_id", "vector", "upsert_no", 0.95)) == []


def test_probe_sets():
    sets = knn.probe_sets(4, 12)
    assert sets[0] == (0,) and len(set(sets)) == 12
    assert all(len({min(x, 7 - x) for x in s}) == len(s) for s in sets)


def test_visited_buckets_are_those_of_neighbouring_cells():
    h = knn.Hasher(8, 1, 4, 1.0, 6, 3)
    x = knn._unit(pd.Series(list(np.random.default_rng(0).normal(size=(50, 8)))))
    keys = h.buckets(x, True)
    assert keys.shape == (50, 7)
    assert (keys[:, :1] == h.buckets(x, False)).all()
    assert all(len(set(k)) == 7 for k in keys.tolist())


def test_configuration(spark):
    with pytest.raises(ValueError):
        knn.similar_vectors(spark.createDataFrame([], SCHEMA), "chunk_id", "vector", "upsert_no", 0.95, k=0)
