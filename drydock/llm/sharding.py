"""K-d tree sharding: distributed weighted medians along the widest metadata dimension.

Law `bytes`: sizes near equal. The dimensions are size, n_chars, lang and source (texts by a
hash); rows of equal metadata are split by a hash of doc_id and text, so a hot group spreads, and
equal texts may stand in several shards: the law asks for equal sizes, and a group of copies may
be larger than a shard. Null text has size 8 and crc 0; null metadata counts as empty or 0; null
and repeated doc_ids get a place each, rows equal in all of this stay side by side; ties in
slots may fall either way; texts of any length are measured whole; empty tables give no rows;
columns of further names are not read.
"""
from pyspark.sql import functions as F, Window as W

from .common import written

BINS = 1024
#: Dimensions scaled to [0, 1) from metadata; a column that docs lack leaves its dimension flat.
DIMS = {
    "d_size": "least(log2(size) / 40, 0.999)", "d_chars": "least(log2(greatest(cast(n_chars AS double), 0) + 2) / 40, 0.999)",
    "d_lang": "pmod(xxhash64(lang), 1048576) / 1048576D", "d_source": "pmod(xxhash64(source), 1048576) / 1048576D",
}
#: Rows of equal metadata are parted by a hash of their doc_id and text within this share of a dimension.
TIE = 1e-4


def looked_up(d, rows, names):
    """d joined with a table of at most one row per node (so at most `shards` rows, broadcast)."""
    t = d.sparkSession.createDataFrame(rows, "node int, " + names)
    return d.join(F.broadcast(t), "node", "left")


def along(dim="dim"):
    return F.coalesce(*[F.when(F.col(dim) == k, F.col(k)) for k in DIMS])


def cuts(d, work, rounds=4):
    """node -> (dimension, threshold) so that the left share of bytes lies below it."""
    ext = {r["node"]: r for r in d.where(F.col("node").isin(list(work))).groupBy("node").agg(F.sum("size").alias("w"), *[f(k).alias(f"{k}_{n}") for k in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    work = {n: v for n, v in work.items() if n in ext}
    dim = {n: max(DIMS, key=lambda k: (ext[n][f"{k}_hi"] - ext[n][f"{k}_lo"], k)) for n in work}
    span = {n: [ext[n][dim[n] + "_lo"], ext[n][dim[n] + "_hi"] + 1e-9] for n in work}
    want = {n: ext[n]["w"] * (v // 2) / v for n, v in work.items()}
    below, over = dict.fromkeys(work, 0), {}
    for _ in range(rounds if work else 0):  # each round narrows every node's threshold BINS-fold
        x = looked_up(d, [(n, dim[n], *span[n]) for n in work], "dim string, lo double, hi double").withColumn("v", along())
        b = F.least(F.floor((F.col("v") - F.col("lo")) * BINS / (F.col("hi") - F.col("lo"))), F.lit(BINS - 1))
        hist = x.where("v >= lo AND v < hi").groupBy("node", b.alias("b")).agg(F.sum("size").alias("w")).collect()
        for n in work:
            acc, width = below[n], (span[n][1] - span[n][0]) / BINS
            for r in sorted((r for r in hist if r["node"] == n), key=lambda r: r["b"]):
                if acc + r["w"] > want[n]:
                    span[n] = [span[n][0] + width * r["b"], span[n][0] + width * (r["b"] + 1)]
                    over[n] = acc + r["w"]
                    break
                acc += r["w"]
            below[n] = acc
    return {n: (dim[n], span[n][0] if want[n] - below[n] <= over.get(n, below[n]) - want[n] else span[n][1]) for n in work}


def sharded(docs, shards=24, rows_per_slot_group=50_000):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    have = {c: docs[c] if c in docs.columns else F.lit(None) for c in ("lang", "source", "n_chars")}
    d = docs.select("doc_id", F.coalesce(have["lang"].cast("string"), F.lit("")).alias("lang"), F.coalesce(have["source"].cast("string"), F.lit("")).alias("source"), F.coalesce(have["n_chars"].try_cast("double"), F.lit(0.0)).alias("n_chars"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "lang", "source"), F.lit(2**30)) / 2**30 * TIE
    d = d.withColumns({k: F.expr(e) + tie for k, e in DIMS.items()}).drop("lang", "source", "n_chars")
    d = written(d, "narrow").withColumn("node", F.lit(0))
    todo = {0: shards}  # first shard of the node -> its number of leaves
    while todo:
        at = cuts(d, todo)
        if not at:
            break
        x = looked_up(d, [(n, dim, v, todo[n] // 2) for n, (dim, v) in at.items()], "dim string, cut double, step int")
        node = F.col("node") + F.when(along() >= F.col("cut"), F.col("step")).otherwise(0)
        d = written(x.select("doc_id", "size", "text_crc32", *DIMS, node.alias("node")), "narrow")
        todo = {n: k for m in at for n, k in ((m, todo[m] // 2), (m + todo[m] // 2, todo[m] - todo[m] // 2)) if k > 1}
    d = d.withColumn("shard", F.col("node").cast("int"))
    sizes = d.groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    groups = max(1, -(-sizes // (shards * rows_per_slot_group)) * 8)
    d = d.withColumn("g", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)))
    base = d.groupBy("shard", "g").count().withColumn("base", F.sum("count").over(W.partitionBy("shard").orderBy("g")) - F.col("count")).select("shard", "g", "base")
    d = d.join(base, ["shard", "g"]).withColumn("slot", F.col("base") + F.row_number().over(W.partitionBy("shard", "g").orderBy("doc_id", "text_crc32")) - 1)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
