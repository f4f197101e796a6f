"""A stored index of texts: hashed word counts in cells around pivots, searched exactly, grown by batches.

A text becomes counts of its words by a hash (features), without a model. Each row lies in the cell of the pivot
at the least angle; a cell's summary holds the least and greatest angle of its rows. A search
rules out whole cells by the triangle inequality for angles and compares rows in what is left.
"""
import numpy as np
from pyspark.sql import functions as F, Window as W

from drydock.functions.storage import cut, spread

from . import blocks

WIDTH = 64
#: Pivots of an index: the summaries of their cells are what a search broadcasts.
CELLS = 256
#: Angles this near count as equal, as acos is inexact near 1 and scores are compared to nine places.
SLACK = 1e-4
ROWS = "id long, counts array<int>, norm double, cell int, angle double"


def words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def features(text, width=WIDTH, most=None):
    """Counts of the words of a text (of the first `most`, where the encoder has a limit) by the md5 of each, `width` of them."""
    w = F.slice(words(text), 1, most) if most else words(text)
    at = F.transform(w, lambda x: (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % width).cast("int"))
    counted = lambda at: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(at, lambda a: a == k)))
    return F.get(F.transform(F.array(at), counted), F.lit(0))  # words are hashed once, not once for each place


def entity_text(name, description):
    return F.concat_ws(" ", name, F.coalesce(description, F.lit("")))


def image_text(name, tag, packages):
    """`name:tag package ...`, what an image is encoded by."""
    return F.concat_ws(" ", F.concat_ws(":", name, tag), F.array_join(packages, " "))


def encoded(texts, width=WIDTH, most=None):
    """texts(id, text) -> id, counts, norm; texts without words have norm 0 and are found by no search."""
    c = spread(texts.select("id", "text")).select(F.col("id").cast("long").alias("id"), features(F.col("text"), width, most).alias("counts"))
    return c.withColumn("norm", F.sqrt(F.aggregate("counts", F.lit(0).cast("double"), lambda s, x: s + x * x)))


def _placed(rows, pivots):
    """rows(id, counts, norm) with the cell of their nearest pivot and the angle to it."""
    p = np.array(pivots, float)
    p /= np.linalg.norm(p, axis=1, keepdims=True)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = np.asarray(b.column("counts").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            cos = np.clip((x / b.column("norm").to_numpy()[:, None]) @ p.T, -1, 1) if b.num_rows else np.zeros((0, len(p)))
            at = cos.argmax(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(np.arccos(cos[np.arange(len(at)), at]))], names=["id", "counts", "norm", "cell", "angle"])

    return rows.select("id", "counts", "norm").mapInArrow(run, ROWS)


def _stored(rows, path, mode):
    """A folder for each cell, which a search can leave unread; ranges keep files few and part a large cell."""
    rows.repartitionByRange("cell", "id").write.partitionBy("cell").mode(mode).parquet(f"{path}/rows")


def build(texts, path, width=WIDTH, pivots=CELLS, most=None):
    """Writes a new index of texts(id, text) under `path`; pivots are distinct vectors, the least by a hash of their id (a bounded sample)."""
    rows = cut(encoded(texts, width, most).where("norm > 0"))
    chosen = rows.groupBy("counts").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(pivots)
    table = [(i, r["counts"]) for i, r in enumerate(chosen.collect())]
    spark = texts.sparkSession
    spark.createDataFrame(table, "cell int, counts array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    if table:
        _stored(_placed(rows, [c for _, c in table]), path, "overwrite")
    else:
        spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{path}/rows")
    return path


def grow(texts, path, width=WIDTH, most=None):
    """Takes further texts(id, text) into an index: only they are encoded and placed. Ids that it holds stay as they are."""
    spark = texts.sparkSession
    pivots = [r["counts"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()]
    if not pivots:
        return build(texts, path, width, most=most)
    new = cut(encoded(texts, width, most).where("norm > 0").join(rows_of(spark, path).select("id"), "id", "left_anti"))
    _stored(_placed(new, pivots), path, "append")
    return path


def rows_of(spark, path):
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def summaries(spark, path):
    """cell, pivot, n, low, high: the rows of each cell and their least and greatest angle, read without the vectors."""
    s = rows_of(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return s.join(spark.read.parquet(f"{path}/pivots").withColumnRenamed("counts", "pivot"), "cell")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)


def _angle(cos):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def classes(spark, path, k):
    """cell, vec_id, counts, norm, ids: the rows of an index by their vector, vec_id the least id and ids the k least of each."""
    first = W.partitionBy("cell", "counts").orderBy("id")
    few = rows_of(spark, path).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return few.groupBy("cell", "counts").agg(F.min("id").alias("vec_id"), F.first("norm").alias("norm"), F.array_sort(F.collect_list("id")).alias("ids"))


def _nearest(asked, known, k):
    """query_id, id, cos: of known classes in the cells of asked(vec_id, counts, norm, cell) enough to hold the k rows of greatest
    rounded cosine, ties to smaller ids; compared in blocks, of which a query takes 3 k classes at most.

    Scores of nine places: those above the k-th of a block are fewer than k, and of those equal to it, or one unit below where
    the two roundings may part, the k least ids do. Products of counts are whole numbers, so nothing is lost in a matrix.
    """
    import pyarrow as pa

    def reduce(a, b, both):
        x, y = blocks.matrix(a["counts"]), blocks.matrix(b["counts"])
        ids, nb, qn, qi = b["vec_id"].to_numpy(), b["norm"].to_numpy(), a["norm"].to_numpy(), a["vec_id"].to_numpy()
        order = np.argsort(ids)
        y, nb = y[order], nb[order]
        q, at, dots = [], [], []
        for lo in range(0, len(x), 256):
            dot = x[lo:lo + 256] @ y.T
            score = np.floor(dot / (qn[lo:lo + 256, None] * nb[None]) * 1e9 + 0.5)
            level = np.partition(score, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else score.min(1)
            for i in range(len(dot)):
                above = np.flatnonzero(score[i] > level[i])
                hit = np.concatenate([above, *(np.flatnonzero(score[i] == level[i] - d)[:k] for d in (0, 1))])
                q.append(np.full(len(hit), qi[lo + i]))
                at.append(hit)
                dots.append(dot[i, hit])
        at = np.concatenate(at)
        took = b.select(["ids", "norm"]).take(pa.array(order[at]))
        return pa.table({"query_id": np.concatenate(q), "ids": took["ids"], "norm": took["norm"], "dot": np.concatenate(dots).astype(np.int64)})

    got = blocks.met(asked, known, "query_id long, ids array<long>, norm double, dot long", reduce, by="cell")
    asks = asked.select(F.col("vec_id").alias("query_id"), F.col("norm").alias("q_norm")).distinct()
    cos = F.col("dot") / (F.col("q_norm") * F.col("norm"))
    return got.join(asks, "query_id").select("query_id", F.explode("ids").alias("id"), cos.alias("cos"))


def candidates(spark, path, queries, k, known=None):
    """query_id, counts, norm, cell: the cells that may hold one of the k nearest rows of each query(id, counts, norm).

    The rows of the cells of the nearest pivots, as many as hold k, give an angle that the k-th neighbour cannot
    exceed; a cell whose nearest row must lie beyond it goes. Summaries are a row for each pivot, CELLS at most, and broadcast.
    """
    known = classes(spark, path, k) if known is None else known
    q = queries.where("norm > 0").select(F.col("id").alias("query_id"), "counts", "norm")
    p_norm = F.sqrt(F.aggregate("pivot", F.lit(0).cast("double"), lambda s, x: s + x * x))
    each = spread(q).join(F.broadcast(summaries(spark, path)), F.lit(True))
    each = each.withColumn("to", _angle(dot(F.col("counts"), F.col("pivot")) / (F.col("norm") * p_norm)))
    best = F.greatest(F.lit(0.0), F.col("to") - F.col("high"), F.col("low") - F.col("to"))
    near = W.partitionBy("query_id").orderBy("to", "cell").rowsBetween(W.unboundedPreceding, 0)
    each = cut(each.withColumn("best", best).withColumn("ahead", F.sum("n").over(near) - F.col("n")).drop("pivot"))
    first = each.where(F.col("ahead") < k).select(F.col("query_id").alias("vec_id"), "counts", "norm", "cell")
    cos = _nearest(first, known, k)
    kth = cos.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cos"), "id"))).where(F.col("rank") == k)
    floor = kth.select("query_id", _angle(F.col("cos")).alias("floor"))
    return each.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("best") <= F.col("floor") + SLACK)).select("query_id", "counts", "norm", "cell")


def search(spark, path, queries, k=5, itself=True):
    """query_id, rank, id, score: the k rows of greatest cosine for each of queries(id, text), ties to smaller ids.

    queries is a stated set of distinct ids; with itself = False a row of the query's own id takes no part. Equal vectors, of
    queries and of rows, are compared once.
    """
    q = cut(encoded(queries, *([len(r["counts"])] if (r := spark.read.parquet(f"{path}/pivots").first()) else [])))
    most = k if itself else k + 1
    known, asked = cut(classes(spark, path, most)), cut(q.where("norm > 0").groupBy("counts").agg(F.min("id").alias("id"), F.first("norm").alias("norm")))
    hit = candidates(spark, path, asked, most, known).withColumnRenamed("query_id", "vec_id")
    found = _nearest(hit, known, most).withColumn("score", F.round("cos", 9)).withColumnRenamed("query_id", "asked")
    best = W.partitionBy("asked").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("asked", "id", "score")
    own = q.where("norm > 0").select(F.col("id").alias("query_id"), "counts").join(asked.select("counts", F.col("id").alias("asked")), "counts").select("query_id", "asked")
    pair = own.join(found, "asked")
    pair = pair if itself else pair.where("id <> query_id")
    top = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pair.select("query_id", "id", "score").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
