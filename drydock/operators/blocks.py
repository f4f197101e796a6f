"""Distances between rows in blocks that reduce: what leaves a task is a row for each row, not for each pair.

Rows are (vec_id, e array<double>, tag long). Blocks hold `size` rows at most in the mean, so memory is bounded
whatever the number of rows, and of a block of pairs only the sums, the k least or the links that hold it together
are returned.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from drydock.functions.storage import cut

#: Rows of a block: a sixteenth of the table within these bounds, so small tables keep many tasks and large ones few copies of a row.
SIZE, MOST, NEAR = 2000, 16000, 8000
#: Rows of the first part of a table that all others meet where a few near rows are enough.
FIRST = 8000
#: Rows that are compared with a block at once.
CHUNK = 256


def rows_of(vec, tag=None):
    """The form that blocks read; null tags are -1."""
    t = F.coalesce(F.col(tag).cast("long"), F.lit(-1)) if tag else F.lit(0).cast("long")
    kind = vec.schema["embedding"].dataType.elementType.typeName()  # floats travel as they are, and are doubles where they are compared
    e = F.col("embedding") if kind == "float" else F.transform("embedding", lambda x: x.cast("double"))
    return vec.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), t.alias("tag"))


def matrix(column):
    """The rows of a list column as one matrix of doubles, without Python objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _exactly(x, y, i, j):
    """Distances of pairs of rows, differences taken first."""
    out = np.empty(len(i))
    for k in range(0, len(i), 32768):
        out[k:k + 32768] = np.sqrt(((y[j[k:k + 32768]] - x[i[k:k + 32768]]) ** 2).sum(1))
    return out


def distances(x, y, eps=None):
    """A generator of (first row, distances of the next CHUNK rows of x to all of y) by one matrix product each.

    Where a product loses digits (near rows, what is not finite, and distances at eps) differences are taken first.
    """
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    for k in range(0, len(x), CHUNK):
        part = x[k:k + CHUNK]
        scale = nx[k:k + CHUNK, None] + ny[None]
        d = scale - 2 * (part @ y.T)
        doubt = ~(d >= 1e-4 * scale)
        if eps is not None:
            doubt |= np.abs(d - eps * eps) <= 1e-10 * (scale + eps * eps)
        i, j = np.nonzero(doubt)
        d = np.sqrt(np.maximum(d, 0))
        d[i, j] = _exactly(part, y, i, j)
        yield k, d


def met(left, right, schema, reduce, size=None, by=None, *, most=MOST, same=False):
    """reduce(left table, right table, both) -> rows of `schema`, for all pairs of blocks of two tables (of the same `by`).

    Each side is dealt into blocks by a hash of the id; every left row meets every right row once. With `same`, for two
    readings of one table, only one of two blocks' meetings takes place, and `both` says that it stands for both ways.
    """
    keys = [by] if by else []
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    if by:
        numbers = count(left, "na").join(count(right, "nb"), by)
        l, r = left.join(numbers, by), right.join(numbers, by)
    else:
        na, nb = left.count(), right.count()
        l, r = (d.withColumn("na", F.lit(na)).withColumn("nb", F.lit(nb)) for d in (left, right))
    held = lambda c: F.lit(float(size)) if size else F.least(F.greatest(F.col(c) / 16, F.lit(float(SIZE))), F.lit(float(most)))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / held(c)).cast("int"), F.lit(1))
    own = lambda c: F.pmod(F.xxhash64("vec_id"), blocks(c)).cast("int")
    every = lambda c, lo=F.lit(0): F.explode(F.sequence(lo, blocks(c) - 1))
    l = l.withColumn("i", own("na")).withColumn("j", every("nb", F.col("i")) if same else every("nb")).drop("na", "nb")
    r = r.withColumn("j", own("nb")).withColumn("i", F.explode(F.sequence(F.lit(0), "j")) if same else every("na")).drop("na", "nb")
    rename = lambda d: d.select(*[F.col(c).alias(f"{c}_") for c in d.columns])
    on = [*keys, "i", "j"]

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_pylist([], schema=arrow)
        both = same and a["i"][0].as_py() != a["j"][0].as_py()
        return reduce(a, b.rename_columns([c[:-1] for c in b.column_names]), both).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return l.groupBy(*on).cogroup(rename(r).groupBy(*[f"{c}_" for c in on])).applyInArrow(run, schema)


def _equal(ids, other):
    """Places of equal ids of two arrays, as (places in the one, places in the other)."""
    return np.nonzero(ids[:, None] == other[None])


def label_sums(vec, tag, by=None):
    """a, tag, n, total: for each row the number of other rows of each tag and the sum of their distances (of its own
    tag alone with by = 'tag')."""
    rows = rows_of(vec, tag)

    def reduce(a, b, both):
        def sides(t):
            tags = t["tag"].to_numpy()
            order = np.argsort(tags, kind="stable")
            kinds, starts = np.unique(tags[order], return_index=True)
            return matrix(t["e"])[order], t["vec_id"].to_numpy()[order], tags[order], kinds, starts
        x, ia, ta, ka, sa = sides(a)
        y, ib, tb, kb, sb = sides(b)
        n, total = np.tile(np.diff(np.append(sb, len(y))), (len(x), 1)), np.zeros((len(x), len(kb)))
        back = np.zeros((len(ka), len(y)))
        for k, d in distances(x, y):
            if not both:  # one block with itself: a row is not its own neighbour
                i, j = _equal(ia[k:k + CHUNK], ib)
                d[i, j] = 0
                np.subtract.at(n, (k + i, np.searchsorted(kb, tb[j])), 1)
            total[k:k + CHUNK] = np.add.reduceat(d, sb, axis=1)
            if both:
                own, starts = np.unique(ta[k:k + CHUNK], return_index=True)
                back[np.searchsorted(ka, own)] += np.add.reduceat(d, starts, axis=0)
        def table(ids, kinds, n, total):
            on = n.ravel() > 0
            return pa.table({"a": np.repeat(ids, len(kinds))[on], "tag": np.tile(kinds, len(ids))[on], "n": n.ravel()[on], "total": total.ravel()[on]})
        got = table(ia, kb, n, total)
        return pa.concat_tables([got, table(ib, ka, np.tile(np.diff(np.append(sa, len(x))), (len(y), 1)), back.T)]) if both else got

    got = met(rows, rows, "a long, tag long, n long, total double", reduce, by=by, same=True)
    return got.groupBy("a", "tag").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _smallest(d, k):
    """The k least of each row of a matrix, which it may change; NaN after numbers."""
    if k > 8 or d.shape[1] <= k or np.isnan(d).any():
        return np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
    out, rows = np.empty((len(d), k)), np.arange(len(d))
    for c in range(k):
        at = d.argmin(1)
        out[:, c] = d[rows, at]
        d[rows, at] = np.inf
    return out


def least(vec, k):
    """a, dists: the k least distances of each row to others, ascending (all, if fewer)."""
    rows = rows_of(vec)

    def reduce(a, b, both):
        x, y, ids, ib = matrix(a["e"]), matrix(b["e"]), a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        best, back = [], None
        for i, d in distances(x, y):
            if both:
                down = _smallest(np.ascontiguousarray(d.T), k)
                back = down if back is None else _smallest(np.concatenate([back, down], axis=1), k)
                best += _smallest(d, k).tolist()
                continue
            p, q = _equal(ids[i:i + CHUNK], ib)
            same = np.zeros(d.shape, bool)
            same[p, q] = True
            d[same] = np.inf
            found, others = _smallest(d, k), d.shape[1] - same.sum(1)
            best += [f[:n].tolist() for f, n in zip(found, others)]
        out = pa.table({"a": ids, "dists": pa.array(best, pa.list_(pa.float64()))})
        return pa.concat_tables([out, pa.table({"a": ib, "dists": pa.array(back.tolist(), pa.list_(pa.float64()))})]) if both else out

    got = met(rows, rows, "a long, dists array<double>", reduce, same=True)
    return got.groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("dists"))), 1, k).alias("dists"))


def cells(left, right, eps, pivots=64):
    """left and right dealt to cells so that rows within eps of each other share one, with what that costs.

    Some right rows, the least by a hash of their id, are pivots (a bounded sample); a right row lies in the cell of its
    nearest pivot. A left row goes to each cell that can hold a row within eps: by the triangle inequality one whose
    pivot is at most 2 eps farther than the nearest, and at most eps beyond the cell's radius.
    """
    from pyspark.sql.types import StructType

    at = right.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    p = np.array([r["e"] for r in at], float)

    def dealt(rows, own, radius=None):
        slack = eps * (1 + 1e-9) + 1e-9

        def run(batches):
            for b in batches:
                x = matrix(b.column("e"))
                d = np.concatenate([d for _, d in distances(x, p)]) if len(x) else np.zeros((0, len(p)))
                home = d.argmin(1) if len(x) else np.zeros(0, int)
                hit = np.zeros(d.shape, bool)
                hit[np.arange(len(x)), home] = True
                if not own:
                    hit = (d <= d.min(1, keepdims=True) + 2 * slack) & (d <= radius + slack)
                row, cell = np.nonzero(hit)
                t = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell.astype(np.int64)), pa.array(d[row, cell])], names=[*b.schema.names, "cell", "far"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("cell", "long").add("far", "double"))

    r = dealt(right, True)
    radius = np.full(len(p), -np.inf)
    for row in r.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot
        radius[row["cell"]] = row["far"]
    return dealt(left, False, radius).drop("far"), r.drop("far")


def _near(eps, reduce):
    """reduce(left, right, near, both) as `met` calls it, with the boolean matrix of the pairs of other ids within eps."""
    def run(a, b, both):
        x, y = matrix(a["e"]), matrix(b["e"])
        near = np.zeros((len(x), len(y)), bool)
        for k, d in distances(x, y, eps):
            near[k:k + CHUNK] = d <= eps
        if not both:
            near &= a["vec_id"].to_numpy()[:, None] != b["vec_id"].to_numpy()[None]
        return reduce(a, b, near, both)
    return run


def within(left, right, eps, schema, reduce, pivots=64, same=False):
    """met over the cells of rows that may lie within eps; reduce(left, right, near, both) gets a boolean matrix as well.

    Where cells rule out less than half of the pairs, all blocks meet instead: rows then travel less, and of one table
    with itself (`same`) each pair is compared once.
    """
    if right.isEmpty():
        return left.sparkSession.createDataFrame([], schema)

    run = _near(eps, reduce)
    l, r = cells(left, right, eps, pivots)
    if 2 * _pairs(l, r) >= left.count() * right.count():
        return met(left, right, schema, run, most=NEAR, same=same)
    return met(cut(l), cut(r), schema, run, most=NEAR, by="cell")


def _pairs(l, r):
    n = l.groupBy("cell").count().join(r.groupBy("cell").agg(F.count(F.lit(1)).alias("own")), "cell")
    return n.agg(F.sum(F.col("count") * F.col("own"))).first()[0] or 0


def compared(left, right, eps, pivots=64):
    """Pairs that `within` compares: over the cells, the rows on one side times those on the other."""
    l, r = cells(left, right, eps, pivots)
    return _pairs(l, r)


def neighbours(vec, eps, pivots=64):
    """vec_id, n: the other rows within eps."""
    rows = rows_of(vec)
    counts = lambda t, n: pa.table({"vec_id": t["vec_id"], "n": n})
    reduce = lambda a, b, near, both: pa.concat_tables([counts(a, near.sum(1)), *([counts(b, near.sum(0))] if both else [])])
    got = within(rows, rows, eps, "vec_id long, n long", reduce, pivots, same=True)
    return vec.select("vec_id").join(got.groupBy("vec_id").agg(F.sum("n").alias("n")), "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"))


def at_least(vec, eps, k, first=None):
    """vec_id, on: whether k or more other rows lie within eps.

    Rows meet a part of the table first, `first` rows or so by a hash of the id, then of those with fewer than k near rows
    there each a part that is larger; who has k of them needs no more. Those left meet all rows, so the answer is exact.
    """
    rows, size = rows_of(vec), first or FIRST
    total, todo = rows.count(), rows
    reduce = lambda a, b, near, both: pa.table({"vec_id": a["vec_id"], "n": near.sum(1)})
    share = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(2**30))
    found = lambda n: n.groupBy("vec_id").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("vec_id")
    while 4 * size < total:
        some = rows.where(share < int(2**30 * size / total))
        sure = cut(found(met(todo, some, "vec_id long, n long", _near(eps, reduce), most=NEAR)))
        todo, size = cut(todo.join(sure, "vec_id", "left_anti")), 16 * size
        if todo.isEmpty():
            break
    left = todo.count() if todo is not rows else total
    if 2 * left > total:  # of one table with itself each pair is compared once
        sure = neighbours(vec, eps).where(F.col("n") >= k).select("vec_id").distinct()
        return vec.select("vec_id").join(sure.withColumn("on", F.lit(True)), "vec_id", "left").select("vec_id", F.coalesce("on", F.lit(k <= 0)).alias("on"))
    few = todo.select("vec_id").distinct()
    if left:
        few = few.join(found(within(todo, rows, eps, "vec_id long, n long", reduce)), "vec_id", "left_anti")
    few = cut(few.withColumn("few", F.lit(True)))
    return vec.select("vec_id").join(few, "vec_id", "left").select("vec_id", (F.col("few").isNull() | F.lit(k <= 0)).alias("on"))


def forest(near, ia, ib):
    """Links (a, b) that connect what a block's near pairs connect: at most one for each of its rows."""
    none = np.int32(len(ib))
    top, low = np.full(len(ia), none), np.arange(len(ib), dtype=np.int32)
    falls = near.any()
    while falls:  # labels fall along the pairs of the block until none does
        falls = False
        for k in range(0, len(ia), CHUNK):
            part = near[k:k + CHUNK]
            new = np.where(part, low[None], none).min(1)
            down = np.minimum(low, np.where(part, new[:, None], none).min(0))
            falls |= bool((new != top[k:k + CHUNK]).any() or (down != low).any())
            top[k:k + CHUNK], low = new, down
    on, hit = near.any(1), near.any(0)
    return np.stack([np.concatenate([ia[on], ib[hit]]), np.concatenate([ib[top[on]], ib[low[hit]]])], 1)


def core_links(core, eps, pivots=64):
    """a, b: links between core rows within eps that connect the same rows as all such pairs do."""
    rows = rows_of(core)

    def reduce(a, b, near, both):
        x, y = forest(near, a["vec_id"].to_numpy(), b["vec_id"].to_numpy()).T
        return pa.table({"a": x[x != y], "b": y[x != y]})

    return within(rows, rows, eps, "a long, b long", reduce, pivots, same=True).distinct()


def least_tag(rest, core, eps, pivots=64):
    """vec_id, tag: for each row of rest(vec_id, e, tag) the least tag of the core rows within eps."""
    def reduce(a, b, near, both):
        tags = b["tag"].to_numpy()
        on = near.any(1)
        return pa.table({"vec_id": a["vec_id"].to_numpy()[on], "tag": [tags[n].min() for n in near[on]]})

    return within(rest, core, eps, "vec_id long, tag long", reduce, pivots).groupBy("vec_id").agg(F.min("tag").alias("tag"))
