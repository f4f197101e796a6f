"""Block reductions and cells of near rows against brute force."""
import numpy as np
import pytest

from drydock.operators import blocks, vectors

RND = np.random.default_rng(5)


def frame(spark, x, labels=None):
    lab = labels if labels is not None else [0] * len(x)
    return spark.createDataFrame([(i, list(map(float, v)), None if l is None else int(l)) for i, (v, l) in enumerate(zip(x, lab))], "vec_id long, embedding array<double>, label int").repartition(3)


def clustered(n=600, centres=12, width=5):
    c = RND.normal(size=(centres, width)) * 10
    return c[np.arange(n) % centres] + RND.normal(size=(n, width)) * 0.3


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks of 50 rows, so that every path meets several."""
    monkeypatch.setattr(blocks.met, "__defaults__", (50, None))


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def brute_dbscan(x, eps, least):
    near = (dist(x) <= eps) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) + 1 >= least
    lab = {i: i for i in np.flatnonzero(core)}
    while True:
        new = {i: min([lab[i], *(lab[j] for j in np.flatnonzero(near[i] & core))]) for i in lab}
        if new == lab:
            break
        lab = new
    return [lab[i] if i in lab else min((lab[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]


def test_fixture_of_a_line(spark):
    d = frame(spark, [[v] for v in (0, 1, 2, 10, 11, 12, 50)])
    assert {r["vec_id"]: r["cluster"] for r in vectors.dbscan(d, 1.0, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    assert tuple(vectors.noise(vectors.dbscan(d, 1.0, 2)).first()) == (1, 2)


@pytest.mark.parametrize("eps,least", [(0.6, 4), (0.9, 3), (12.0, 5)])
def test_dbscan(spark, eps, least):
    """Noise, borders and links across blocks and cells."""
    x = np.concatenate([clustered(), RND.uniform(-20, 20, (40, 5))])
    d = frame(spark, x)
    assert [r["cluster"] for r in sorted(vectors.dbscan(d, eps, least).collect())] == brute_dbscan(x, eps, least)


@pytest.mark.parametrize("eps,least", [(0.6, 4), (0.9, 3), (12.0, 5), (0.6, 1)])
def test_core_and_noise_from_parts(spark, monkeypatch, eps, least):
    """Core rows that a part of the table shows, and noise without clusters, are those of the whole."""
    monkeypatch.setattr(blocks, "FIRST", 20)
    x = np.concatenate([clustered(), RND.uniform(-20, 20, (40, 5))])
    d = frame(spark, x)
    core = (dist(x) <= eps).sum(1) >= least
    assert [r["core"] for r in sorted(vectors.core_points(d, eps, least).collect())] == core.tolist()
    want = [i for i, c in enumerate(brute_dbscan(x, eps, least)) if c == -1]
    assert sorted(r["vec_id"] for r in vectors.noise_rows(d, eps, least).collect()) == want


def test_core_rows_of_dense_tables_compare_few_pairs(spark, monkeypatch):
    """Where near rows are many, pairs grow with the rows and not with their square; no link is made for noise."""
    x = RND.normal(size=(900, 4))
    d, seen, made = frame(spark, x), [], blocks.met
    monkeypatch.setattr(blocks, "FIRST", 60)
    monkeypatch.setattr(blocks, "met", lambda l, r, *a, **k: seen.append(l.count() * r.count()) or made(l, r, *a, **k))
    assert all(r["core"] for r in vectors.core_points(d, 6.0, 4).collect()) and sum(seen) < 0.15 * len(x) ** 2
    monkeypatch.setattr(blocks, "core_links", None)
    assert vectors.noise_rows(d, 6.0, 4).isEmpty()


def test_cells_compare_few_pairs(spark):
    rows = blocks.rows_of(frame(spark, x := clustered()))
    assert blocks.compared(rows, rows, 0.5) < 0.3 * len(x) ** 2
    n = {r["vec_id"]: r["n"] for r in blocks.neighbours(frame(spark, x), 0.5).collect()}
    assert n == {i: int(v) - 1 for i, v in enumerate((dist(x) <= 0.5).sum(1))}


def test_forest_connects_what_the_pairs_do():
    for _ in range(50):
        near = RND.random((RND.integers(1, 12), RND.integers(1, 12))) < 0.15
        ia, ib = np.arange(near.shape[0]), 100 + np.arange(near.shape[1])
        def parts(links):
            top = {}
            find = lambda v: v if top.setdefault(v, v) == v else find(top[v])
            for a, b in links:
                top[find(a)] = find(b)
            return {frozenset(w for w in top if find(w) == find(v)) for v in list(top)}
        links = blocks.forest(near, ia, ib)
        assert parts([p for p in links if p[0] != p[1]]) == parts([(int(ia[i]), int(ib[j])) for i, j in zip(*np.nonzero(near))]) and len(links) <= sum(near.shape)


def test_silhouette_medoids_and_least(spark):
    x, lab = clustered(230, 4), [i % 4 if i else None for i in range(230)]
    lab[1] = 9  # a label of one row
    d, D = frame(spark, x, lab), dist(x)
    key = np.array([-1 if l is None else l for l in lab])
    s = []
    for i in range(len(x)):
        means = {k: D[i][(key == k) & (np.arange(len(x)) != i)] for k in set(key)}
        own, out = means[key[i]], min(v.mean() for k, v in means.items() if k != key[i] and len(v))
        s.append((out - own.mean()) / max(out, own.mean()) if len(own) else 0)
    assert vectors.silhouette(d).first()[0] == pytest.approx(np.mean(s))
    want = {k: min(np.flatnonzero(key == k), key=lambda i: (round(D[i][(key == k) & (np.arange(len(x)) != i)].mean(), 9), i)) for k in range(4)}
    assert {r["label"]: r["vec_id"] for r in vectors.medoids(d).collect()} == want
    got = {r["vec_id"]: r["dist"] for r in vectors.k_distance(d, 4).collect()}
    assert got == pytest.approx({i: np.sort(D[i])[3] for i in range(len(x))})


def test_nothing_and_one_row(spark):
    one = frame(spark, [[1.0]])
    none = one.limit(0)
    assert vectors.dbscan(none, 1.0, 2).isEmpty() and vectors.k_distance(one, 4).isEmpty() and vectors.medoids(one).isEmpty()
    assert [tuple(r) for r in vectors.dbscan(one, 1.0, 1).collect()] == [(0, 0)] and vectors.silhouette(one).first()[0] is None
