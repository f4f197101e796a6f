"""Pairs of cells that summaries rule out: none that a result needs, most of them on clustered rows."""
import numpy as np

from drydock.llm import knn

RND = np.random.default_rng(2)


def test_cells_are_ruled_out_rightly():
    """No row of a cell that is out of reach of a query cell attains the floor of any of its queries."""
    for _ in range(30):
        P = RND.normal(size=(8, 4)) * 10
        x = P[RND.integers(0, 8, 200)] + RND.normal(size=(200, 4)) * RND.uniform(0.1, 4)
        q = P[RND.integers(0, 8, 30)] + RND.normal(size=(30, 4)) * 0.5
        near = lambda m: ((m[:, None] - P) ** 2).sum(2).argmin(1)
        cx, cq = near(x), near(q)
        far = lambda m, c: float(np.sqrt(((m - P[c]) ** 2).sum(1)).max())
        data = {c: (far(x[cx == c], c), float(np.sqrt((x[cx == c] ** 2).sum(1)).max())) for c in set(cx.tolist())}
        radius = {c: far(q[cq == c], c) for c in set(cq.tolist())}
        s = q @ x.T
        floor = {c: float(np.sort(s[cq == c], axis=1)[:, -3].min()) for c in radius}
        reach, cells = knn.reachable(P, data, radius, floor), sorted(radius)
        for i, j in zip(*np.nonzero(s >= np.array([floor[c] for c in cq])[:, None])):
            assert cells.index(cq[i]) in reach[cx[j]]


def test_clustered_cells_are_left_whole(spark):
    """On tight clusters that point apart most pairs of cells go by their summaries, and the result is exact."""
    c = RND.normal(size=(40, 16))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    e = c[np.arange(2000) % 40] + RND.normal(size=(2000, 16)) * 0.01
    seen = []
    real = knn.reachable
    knn.reachable = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        got = knn.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<double>"))
    finally:
        knn.reachable = real
    s = np.floor(e * 256)
    want = set()
    for i in range(0, 2000, 50):
        best = sorted((-int(s[i] @ s[j]), j) for j in range(2000) if j != i)[:5]
        want |= {(i, r, j, -v) for r, (v, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    pairs = sum(len(v) for v in seen[0].values())
    assert pairs < 0.5 * len(seen[0]) * len({x for v in seen[0].values() for x in v.tolist()})
