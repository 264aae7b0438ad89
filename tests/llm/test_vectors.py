"""Vector search and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from mandatewatch.llm import adaptive_scan, cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, score string, ids int"


def clustered(n=700, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.2, 0.8], n)[:, None]
    x[50:80] = x[50]  # copies
    x[90] = 2 * x[91]
    return x.astype("f4")


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered()
    rows = [(k * 5, [float(v) for v in row], 1, "s", 1) for k, row in enumerate(x)]
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15], [1.0, 2.0]]
    rows += [(10_000 + 50 * k, v, 1, "s", 1) for k, v in enumerate(bad)]
    rows += [rows[7], (None, rows[3][1], 1, "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), x


def brute(x):
    u = x.astype("f8")
    u /= np.sqrt((u * u).sum(1))[:, None]
    return u @ u.T


def test_search_in_every_list_is_exact(vectors):
    df, x = vectors
    found = adaptive_scan.search(df, df.filter("vec_id % 50 = 0"), 5, probed_share=1.0).collect()
    cos, got = brute(x), {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {k * 5 for k in range(0, 700, 10)}
    hits = 0
    for q, ranked in got.items():
        row = cos[q // 5].copy()
        row[q // 5] = -2
        want = np.lexsort((np.arange(700), -np.round(row, 12)))[:5]
        assert sorted(ranked) == [1, 2, 3, 4, 5]
        assert [s for _, s in sorted(ranked.values(), key=lambda v: -v[1])] == [ranked[k][1] for k in range(1, 6)]
        assert all(abs(s - cos[q // 5, v // 5]) < 1e-12 for v, s in ranked.values())
        hits += len({v for v, _ in ranked.values()} & {int(w) * 5 for w in want})
    assert hits >= 0.97 * 5 * len(got)
    # Copies of a vector come by their ids.
    assert [got[250][k][0] for k in range(1, 6)] == [255, 260, 265, 270, 275]


def test_search_recall_with_probing(vectors):
    df, x = vectors
    found = adaptive_scan.search(df, df.filter("vec_id % 50 = 0"), 5).collect()
    cos, hits = brute(x), 0
    for q in range(0, 700, 10):
        row = cos[q].copy()
        row[q] = -2
        own = {r.vec_id // 5 for r in found if r.query_id == q * 5}
        hits += sum(row[v] >= np.sort(row)[-5] - 1e-12 for v in own)
    assert hits >= 0.9 * 350


def test_search_small_and_empty(spark, vectors):
    df, _ = vectors
    three = df.filter("vec_id in (0, 5, 10)")
    assert adaptive_scan.search(three, three.filter("vec_id = 0"), 5).count() == 2
    assert adaptive_scan.search(df.limit(0), df.limit(0), 5).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 32))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    for q, kept in zip(rows[:40], adaptive_scan.scan(rows[:40], rows, np.ones((40, 500), bool), 6), strict=True):
        assert len(kept) < 60
        assert set(np.argsort(-(rows @ q))[:6].tolist()) <= set(kept.tolist())


def brute_links(x, cosine):
    hits = brute(x) >= cosine
    np.fill_diagonal(hits, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(v, label[h].min()) if (h := np.flatnonzero(hits[k])).size else v for k, v in enumerate(label)])
        if (new == label).all():
            return hits.sum(1), label
        label = new


@pytest.mark.parametrize(("leaf", "cosine"), [(4096, 0.95), (40, 0.95), (40, 0.7), (16, 0.999)])
def test_cover_tree_finds_exactly_the_pairs(vectors, monkeypatch, leaf, cosine):
    df, x = vectors
    monkeypatch.setattr(cover_tree, "LEAF_POINTS", leaf)
    monkeypatch.setattr(cover_tree, "BALL_POINTS", 8)
    got = cover_tree.near_duplicates(df, cosine).collect()
    assert len(got) == 709
    n, label = brute_links(x, cosine)
    n = n.copy()
    twice = 7  # its row stands twice, so its neighbours and itself have a link more
    near = np.flatnonzero(brute(x)[twice] >= cosine)
    n[near] += 1
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (None, None, None)
        elif r.vec_id >= 10_000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            k = r.vec_id // 5
            assert (r.n_links, r.component_id, r.kept) == (n[k], label[k] * 5, label[k] == k), r


def test_spanning_stars_connect_what_the_matrix_does():
    rng = np.random.default_rng(5)
    hits = rng.random((30, 40)) < 0.04
    edges = cover_tree.spanning_stars(hits)
    assert len(edges) < 70
    parent = list(range(70))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b, column in edges:
        parent[find(a)] = find(b + 30 if column else b)
    for a, b in np.argwhere(hits).tolist():
        assert find(a) == find(b + 30)


def test_empty_vectors(vectors):
    df, _ = vectors
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0
    only_bad = df.filter("vec_id >= 10000")
    assert cover_tree.near_duplicates(only_bad).filter("kept").count() == 7
    assert math.isclose(adaptive_scan.rotation(8)[0] @ adaptive_scan.rotation(8)[0], 1)


def test_every_length_takes_part(spark):
    """Two vector lengths, each searched and linked among itself."""
    long, short = clustered(300, 16, 5), clustered(120, 6, 6)
    rows = [(10 * k, [float(v) for v in x], 1, "s", 1) for k, x in enumerate(long)] + [(10 * k + 5, [float(v) for v in x], 1, "s", 1) for k, x in enumerate(short)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.vec_id: r for r in cover_tree.near_duplicates(df, 0.95).collect()}
    for x, at in ((long, 0), (short, 5)):
        n, label = brute_links(x, 0.95)
        assert all((got[10 * k + at].n_links, got[10 * k + at].component_id) == (n[k], 10 * label[k] + at) for k in range(len(x)))
    found = {}
    for r in adaptive_scan.search(df, df.filter("vec_id % 50 in (0, 5)"), 5, probed_share=1.0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {r[0] for r in rows if r[0] % 50 in (0, 5)}
    for q, hits in found.items():
        x, at = (short, 5) if q % 10 else (long, 0)
        assert sorted(rank for rank, _, _ in hits) == [1, 2, 3, 4, 5] and all(v % 10 == at and v != q for _, v, _ in hits)
        cos = brute(x)[q // 10]
        assert all(abs(s - cos[v // 10]) < 1e-12 for _, v, s in hits)
