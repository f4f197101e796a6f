"""Exact top-k inner products by a Voronoi kNN join.

Vectors that are null or hold null or non-finite components take no part, nor do rows of a
null vec_id; vectors shorter than the longest (an empty one too) count as filled up with zeros,
so the inner product runs over the common components; ties go to the smaller vec_id; repeated
rows are candidates each by itself; rows of one query id are ranked together, as in the SQL; an
empty table gives no rows; further columns are not read.

Queries are grouped by the cell of their nearest pivot. For a cell of pivot p whose queries lie
within R of p, any row x has p.x - R|x| <= q.x <= p.x + R|x|: the (k+1)-th largest lower bound of
rows of different ids is a floor for the k-th score of every query of the cell. Data are grouped by
the cell of their nearest pivot as well: a summary of each data cell (radius, greatest norm) bounds what any
row of it can score, so pairs of cells that cannot reach the floor go whole; in the others only rows whose own
upper bound reaches it travel.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, Window as W

from .common import written

PAIR = "query_id long, vec_id long, score long"


def quantised(vectors, scale=256):
    """vec_id, v array<long> = floor(scale * x) of the finite vectors, filled up to one length."""
    e = F.col("embedding")
    ok = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    low, high = good.agg(F.min(F.size(e)), F.max(F.size(e))).first()
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    if low != high:
        v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(high) - F.size(e)))
    return good.select("vec_id", v.alias("v"))


def _matrix(col):
    n = len(col)
    return col.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n and not col.offset else np.array(col.to_pylist(), np.float64).reshape(n, -1)


def assigned(d, pivots):
    """Adds the nearest pivot, the distance to it and the norm."""
    P = np.array(pivots, np.float64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            sq = (m * m).sum(1)
            dist = np.maximum(sq[:, None] - 2 * m @ P.T + (P * P).sum(1), 0)
            c = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(c, pa.int32()), pa.array(np.sqrt(dist[np.arange(len(c)), c])), pa.array(np.sqrt(sq))], names=["vec_id", "v", "cell", "r", "norm"])

    return d.mapInArrow(run, "vec_id long, v array<long>, cell int, r double, norm double")


def floors(d, P, radius, k):
    """cell -> a score that k rows of another id than the query's reach, whichever of its queries."""
    cells = sorted(radius)
    own, reach = P[cells], np.array([radius[c] for c in cells])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").to_numpy()
            low = _matrix(b.column("v")) @ own.T - b.column("norm").to_numpy()[:, None] * reach
            rows = []
            for j, c in enumerate(cells):
                found = {}
                for i in np.argsort(-low[:, j], kind="stable").tolist():
                    found.setdefault(ids[i], low[i, j])
                    if len(found) > k:
                        break
                rows += [(c, int(i), x) for i, x in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.float64()))], names=["cell", "vec_id", "low"])

    best = d.select("vec_id", "v", "norm").mapInArrow(run, "cell int, vec_id long, low double").groupBy("cell", "vec_id").agg(F.max("low").alias("low"))
    rank = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("low")))
    got = best.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("cell").agg(F.min("low").alias("low"), F.count("low").alias("n")).collect()
    return {r["cell"]: r["low"] if r["n"] > k else -np.inf for r in got}  # k + 1 ids: the query's own may be one


def reachable(P, data, radius, floor):
    """Data cell -> the query cells that some row of it may be among the best of, from summaries alone.

    data: cell -> (radius, greatest norm) of its rows. For x within r of its pivot P and q within R of p,
    q.x <= p.x + R|x| <= p.P + |p| r + R|x|.
    """
    cells = sorted(radius)
    own, reach = P[cells], np.array([radius[c] for c in cells])
    least = np.array([floor.get(c, -np.inf) for c in cells])
    norm, out = np.sqrt((own * own).sum(1)), {}
    for c, (r, n) in data.items():
        mid, wide = own @ P[c], norm * r + reach * n
        out[c] = np.flatnonzero(mid + wide >= _below(least) - 1e-9 * (np.abs(mid) + wide))
    return out


def _below(least):
    """A floor lowered by what rounding may cost."""
    return least - 1e-6 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))


def routed(d, P, radius, floor, group, reach_of=None):
    """Adds the groups of queries that a row may be among the best of: cells of queries that its own cell cannot
    reach are passed over whole, the rest decided row by row."""
    cells, at = sorted(radius), sorted(set(group.values()))
    own, reach = P[cells], np.array([radius[c] for c in cells])
    least = _below(np.array([floor.get(c, -np.inf) for c in cells]))
    member = np.array([[group[c] == g for g in at] for c in cells])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, norm, cell = _matrix(b.column("v")), b.column("norm").to_numpy(), b.column("cell").to_numpy()
            groups = [[]] * len(m)
            for c in np.unique(cell).tolist():
                row, to = np.flatnonzero(cell == c), np.arange(len(cells)) if reach_of is None else reach_of[c]
                if len(to):
                    high = m[row] @ own[to].T + norm[row, None] * reach[to]
                    for i, need in zip(row.tolist(), (high >= least[to]) @ member[to]):
                        groups[i] = [at[j] for j in np.flatnonzero(need)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(groups, pa.list_(pa.int32()))], names=["vec_id", "v", "groups"])

    return d.select("vec_id", "v", "norm", "cell").mapInArrow(run, "vec_id long, v array<long>, groups array<int>")


def top_k(vectors, k=5, every=50, n_pivots=None, queries_per_group=1024, rows_per_task=20_000):
    """query_id, rank, vec_id, score: the k best rows for each query (vec_id divisible by `every`).

    Pivots are the n_pivots rows of least hash (a quarter of the root of the number of rows, 64
    to 1024): they steer the work, never the result.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if vectors.isEmpty():
        return none
    q0 = quantised(vectors)
    n_pivots = n_pivots or int(min(1024, max(64, vectors.count() ** 0.5 / 4)))
    pivots = [r["v"] for r in q0.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).collect()]
    if not pivots:
        return none
    d = written(assigned(q0, pivots), "cells")
    P = np.array(pivots, np.float64).reshape(len(pivots), -1)
    is_q = F.col("vec_id") % every == 0
    s = {r["cell"]: r for r in d.where(is_q).groupBy("cell").agg(F.count(F.lit(1)).alias("nq"), F.max("r").alias("qr"), F.max("norm").alias("qn")).collect()}
    if not s:
        return none
    group, size = {}, {}  # cells of queries side by side until a group is full; a hot cell is cut into blocks
    g = 0
    for c in sorted(s, key=lambda c: tuple(P[c])):
        if size.get(g, 0) and size[g] + s[c]["nq"] > queries_per_group:
            g += 1
        group[c], size[g] = g, size.get(g, 0) + s[c]["nq"]
    radius = {c: r["qr"] for c, r in s.items()}
    floor = floors(d, P, radius, k)
    # a summary for each cell of data, no more than pivots: pairs of cells go first, rows after
    data = {r["cell"]: (r["r"], r["n"]) for r in d.groupBy("cell").agg(F.max("r").alias("r"), F.max("norm").alias("n")).collect()}
    rows = written(routed(d, P, radius, floor, group, reachable(P, data, radius, floor)), "routed")
    n = {r["g"]: r["n"] for r in rows.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = [(g, -(-size[g] // queries_per_group), max(1, -(-n.get(g, 0) // rows_per_task))) for g in size]
    # at most one row for each pivot, so the routing tables may be broadcast
    plan = F.broadcast(spark.createDataFrame(cut, "g int, blocks int, salts int"))
    homes = F.broadcast(spark.createDataFrame([(c, g) for c, g in group.items()], "cell int, g int"))
    h = F.abs(F.hash("vec_id", "v") % 2**30)
    data = rows.select("vec_id", "v", F.explode("groups").alias("g")).join(plan, "g").select("vec_id", "v", "g", (h % F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    qs = d.where(is_q).join(homes, "cell").join(plan, "g").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"), "g", (h % F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    bound = max(r["qn"] or 0 for r in s.values()) * (d.agg(F.max("norm")).first()[0] or 0)

    def solve(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        kind = np.float64 if bound < 2**52 else object  # float64 products are exact below 2^53
        a, b = (np.array(x.to_pylist(), kind).reshape(x.length() if hasattr(x, "length") else len(x), -1) for x in (left["qv"], right["v"]))
        qi, vi, out = left["qid"].to_numpy(), right["vec_id"].to_numpy(), []
        order = np.argsort(vi, kind="stable")
        b, vi = b[order], vi[order]
        for i in range(0, len(a), 256):
            for q, row in zip(qi[i:i + 256], a[i:i + 256] @ b.T):
                row[vi == q] = -np.inf if kind is np.float64 else -10**30
                top = np.argsort(-row, kind="stable")[:k] if len(row) <= 4 * k else None
                if top is None:
                    t = np.partition(row, len(row) - k)[len(row) - k]
                    c = np.flatnonzero(row >= t)
                    top = c[np.argsort(-row[c], kind="stable")][:k]
                out += [(q, vi[j], int(row[j])) for j in top if vi[j] != q]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    near = qs.groupBy("g", "block", "salt").cogroup(data.groupBy("g", "block", "salt")).applyInArrow(solve, PAIR)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
