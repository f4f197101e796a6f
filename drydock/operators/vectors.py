"""Vector and clustering operators over vec(vec_id, embedding, label)."""
import numpy as np
from pyspark.sql import functions as F

from drydock.functions.storage import cut

from . import blocks


def _d(c):
    return F.transform(c, lambda x: x.cast("double"))


def dot(a, b):
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def most_similar(vec, query, k=5):
    """The k rows of greatest cosine with `query` (a list), ties to the smaller vec_id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vec.select("vec_id", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def best_base_image(images, required, k=1):
    """images(name, tag, size, packages, similarity) -> the k of greatest similarity * coverage / (size + 1)
    for a list of required packages; coverage is 1 where nothing is required, ties go by name and tag."""
    need = F.array(*[F.lit(p) for p in sorted(set(required))]).cast("array<string>")
    cover = 1 - F.size(F.array_except(need, "packages")) / F.lit(max(1, len(set(required))))
    score = F.col("similarity") * cover / (F.col("size") + 1)
    return images.select("name", "tag", score.alias("score")).orderBy(F.desc("score"), "name", "tag").limit(k)


def dims(vec, *keep):
    return vec.select(*keep, F.posexplode(_d(F.col("embedding"))).alias("dim", "x"))


def mean_vectors(vec, by="label"):
    """by, dim, mean: one row for each component."""
    return dims(vec, by).groupBy(by, "dim").agg(F.avg("x").alias("mean"))


def normalised(vec):
    e = _d(F.col("embedding"))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vec.withColumn("embedding", F.when(norm > 0, F.transform(e, lambda x: x / norm)).otherwise(e))


def covariance(vec, among):
    """i, j, cov (sample) of the components `among`."""
    e = _d(F.col("embedding"))
    pairs = [(i, j) for i in among for j in among if i <= j]
    row = vec.agg(*[F.covar_samp(F.get(e, F.lit(i)), F.get(e, F.lit(j))).alias(f"c_{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("cov")) for i, j in pairs])).alias("r")).select("r.*")


def calinski_harabasz(vec, by="label"):
    """One row ch: (trace B / trace W) * (n - k) / (k - 1), from traces alone."""
    d = dims(vec, "vec_id", by)
    per = d.groupBy(by, "dim").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    all_ = d.groupBy("dim").agg(F.avg("x").alias("mean"))
    t = per.join(all_, "dim").agg(F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.countDistinct(by).alias("k"))
    n = vec.agg(F.count(F.lit(1)).alias("n"))
    return t.join(n).select((F.col("b") / F.col("w") * (F.col("n") - F.col("k")) / (F.col("k") - 1)).alias("ch"))


def silhouette(vec, by="label"):
    """One row silhouette: the mean over rows of (b - a) / max(a, b), Euclidean; a lone row counts 0.

    Labels are numbers; a null one is a label as well.
    """
    lab = vec.select(F.col("vec_id").alias("a"), F.coalesce(F.col(by).cast("long"), F.lit(-1)).alias("lab"))
    m = F.col("total") / F.col("n")
    d = blocks.label_sums(vec, by).join(lab, "a").groupBy("a").agg(F.min(F.when(F.col("tag") != F.col("lab"), m)).alias("out"), F.max(F.when(F.col("tag") == F.col("lab"), m)).alias("own"))
    s = F.when(F.col("own").isNull() | F.col("out").isNull(), F.lit(0.0)).otherwise((F.col("out") - F.col("own")) / F.greatest("out", "own"))
    return d.agg(F.avg(s).alias("silhouette"))


def k_distance(vec, k=4):
    """vec_id, dist: the distance to the k-th neighbour, the row itself counting as the first."""
    return blocks.least(vec, k - 1).where(F.size("dists") == k - 1).select(F.col("a").alias("vec_id"), F.get("dists", F.lit(k - 2)).alias("dist"))


def medoids(vec, by="label"):
    """by, vec_id: the row of least mean distance to the others of its group; a group of one row has none."""
    m = blocks.label_sums(vec.where(F.col(by).isNotNull()), by, by="tag").select("a", "tag", F.round(F.col("total") / F.col("n"), 9).alias("m"))
    return m.groupBy(F.col("tag").cast(vec.schema[by].dataType).alias(by)).agg(F.min_by("a", F.struct("m", "a")).alias("vec_id"))


def core_points(vec, eps, least):
    """vec_id, core: whether at least `least` rows (itself one) lie within eps."""
    return blocks.at_least(vec, eps, least - 1).select("vec_id", F.col("on").alias("core"))


def connected(nodes, links):
    """vec_id, c: the least vec_id that links(a, b) reach from each of nodes(vec_id), by joins with path halving."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = nodes.select("vec_id", F.col("vec_id").alias("c"))
    while True:
        low = both.join(lab.withColumnRenamed("vec_id", "b"), "b").groupBy(F.col("a").alias("vec_id")).agg(F.min("c").alias("m"))
        step = lab.join(low, "vec_id", "left").select("vec_id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        up = lab.select(F.col("vec_id").alias("c"), F.col("c").alias("top"))
        step = cut(step.join(up, "c").select("vec_id", "old", F.col("top").alias("c")))
        if step.where("old <> c").isEmpty():
            return lab
        lab = step.select("vec_id", "c")


def dbscan(vec, eps, least):
    """vec_id, cluster: the smallest core id of the cluster, -1 for noise; a border row takes the
    least cluster of the cores near it. Three passes over cells of near rows: counts, links of cores, borders."""
    core = cut(vec.join(core_points(vec, eps, least).where("core"), "vec_id", "left_semi").select("vec_id", "embedding"))
    lab = connected(core, blocks.core_links(core, eps))
    named = cut(core.join(lab, "vec_id"))
    rest = vec.join(core, "vec_id", "left_anti")
    edge = blocks.least_tag(blocks.rows_of(rest), blocks.rows_of(named, "c"), eps)
    got = lab.select("vec_id", F.col("c").alias("cluster")).unionByName(edge.select("vec_id", F.col("tag").alias("cluster")))
    return vec.select("vec_id").join(got, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def noise(clusters):
    """One row noise, clusters: the rows of cluster -1 and the number of other clusters."""
    return clusters.agg(F.count_if(F.col("cluster") == -1).alias("noise"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))


def noise_rows(vec, eps, least):
    """vec_id of the rows of no cluster: not core and no core row within eps. Clusters are not made: no links, no labels."""
    core = cut(core_points(vec, eps, least).where("core").select("vec_id").distinct())
    rest = cut(vec.join(core, "vec_id", "left_anti").select("vec_id", "embedding"))
    edge = blocks.least_tag(blocks.rows_of(rest), blocks.rows_of(vec.join(core, "vec_id", "left_semi")), eps)
    return rest.select("vec_id").join(edge, "vec_id", "left_anti")


def whitened(vec, keep):
    """Embeddings as (x - mean) U / sqrt(s), the first `keep` components, of length 1.

    Mean and covariance are one aggregate over all rows (D^2 numbers reach the driver).
    """
    import pandas as pd

    width = vec.select(F.max(F.size("embedding"))).first()[0] or 0

    def moments(batches):
        n, s, p = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:  # a task sends its sums once
            m = np.array(b["embedding"].tolist(), float).reshape(-1, width)
            n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    rows = vec.select("embedding").mapInPandas(moments, "n long, s array<double>, p array<double>")
    summed = rows.select("n", F.posexplode(F.concat("s", "p")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    n, flat = summed[0]["n"], np.array([r["x"] for r in summed])
    mean = flat[:width] / n
    cov = (flat[width:].reshape(width, width) - n * np.outer(mean, mean)) / (n - 1)
    u, s, _ = np.linalg.svd(cov)
    w = (u / np.sqrt(np.maximum(s, 1e-12)))[:, :keep]

    def apply(batches):
        for b in batches:
            y = (np.array(b["embedding"].tolist(), float).reshape(-1, width) - mean) @ w
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": y.tolist()})

    return vec.select("vec_id", "embedding").mapInPandas(apply, "vec_id long, embedding array<double>")


#: Poolings of layers (array of layers, each an array of token vectors), by name.
POOLINGS = {
    "first_last_avg": lambda h: (h[1].mean(0) + h[-1].mean(0)) / 2, "last_avg": lambda h: h[-1].mean(0),
    "last2avg": lambda h: np.concatenate(h[-2:]).mean(0), "last3avg": lambda h: np.concatenate(h[-3:]).mean(0), "cls": lambda h: h[-1][0],
}


def encoded(texts, encode, pooling="last_avg"):
    """texts(id, text) -> id, embedding; encode(list of texts) gives the layers of each (layers, tokens, width)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            layers = encode(b["text"].fillna("").tolist())
            yield pd.DataFrame({"id": b["id"], "embedding": [POOLINGS[pooling](np.asarray(h, float)).tolist() for h in layers]})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<double>")


def kmeans_sweep(vec, ks=range(2, 21), seed=42):
    """k, ch, silhouette for a KMeans of each k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = cut(vec).withColumn("features", array_to_vector(_d(F.col("embedding"))))
    out = None
    for k in ks:
        got = KMeans(k=k, seed=seed).fit(x).transform(x).withColumnRenamed("prediction", "cluster")
        row = calinski_harabasz(got, "cluster").join(silhouette(got, "cluster")).select(F.lit(k).alias("k"), "ch", "silhouette")
        out = row if out is None else out.unionByName(row)
    return out
