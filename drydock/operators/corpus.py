"""Token corpora: counts, chunks, masks, splits, vocabularies and word vectors."""
from pyspark.sql import functions as F

from drydock.functions.prefix import running_sums
from drydock.functions.storage import cut


def tokens(text):
    """The blank-separated tokens of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def lines(df, key="doc_id", text="text"):
    """key, pos, line: lines of a text that hold more than blanks."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).where(F.trim("line") != "")


def fitted(array, length, pad="<pad>"):
    """An array cut or padded to one length."""
    return F.concat(F.slice(array, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(array), F.lit(0))))


def united(**corpora):
    """The rows of several corpora with `corpus`, the name of the one they come from; columns that one lacks are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("corpus", F.lit(k)) for k, d in corpora.items()])


def token_counts(docs):
    """token, n over all documents."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs, size):
    """The `size` most frequent tokens, ties by token."""
    return token_counts(docs).orderBy(F.desc("n"), "token").limit(size)


def length_percentiles(docs, ps=(0.75, 0.8, 0.9)):
    """p, tokens: exact interpolated percentiles of tokens per document."""
    n = docs.select(F.size(tokens(F.col("text"))).alias("n"))
    return n.agg(F.percentile("n", F.array(*map(F.lit, ps))).alias("q")).select(F.posexplode("q").alias("i", "tokens")).select(F.get(F.array(*map(F.lit, ps)), F.col("i")).alias("p"), "tokens")


def chunks(docs, length, by="source", order="doc_id"):
    """by, chunk, items: the texts of a group one after another, cut into blocks; the rest of a group goes.

    Rows are numbered once, so null and repeated ids keep their tokens; nulls come first and ties stand in the
    table's order. Offsets are running sums of counts, and each text leaves as its pieces of blocks: a block
    is the largest thing that meets in one place.
    """
    d = cut(docs.select(F.col(by).alias("grp"), F.col(order).alias("ord"), "text", F.monotonically_increasing_id().alias("row")))
    size = d.select("grp", "ord", "row", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    start = running_sums(size, ["grp"], ["ord", "row"], "n").where("n > 0").select("row", F.col("before").alias("start"))
    t = d.join(start, "row").select("grp", "start", tokens(F.col("text")).alias("t"))
    block = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.size("t") - 1) / length)))
    at = F.greatest(F.col("chunk") * length - F.col("start"), F.lit(0))
    till = F.least((F.col("chunk") + 1) * length - F.col("start"), F.size("t").cast("long"))
    piece = t.withColumn("chunk", block).select("grp", "chunk", F.struct((F.col("start") + at).alias("at"), F.slice("t", (at + 1).cast("int"), (till - at).cast("int")).alias("p")).alias("x"))
    got = piece.groupBy("grp", "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"])).alias("items"))
    return got.where(F.size("items") == length).select(F.col("grp").alias(by), "chunk", "items")


def uniform(*key):
    """A number of [0, 1) that hangs on the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def masked(docs, share=0.15, mask="<mask>"):
    """doc_id, items: tokens with a share of them masked, by a number of document and place."""
    hit = lambda t, i: uniform(F.col("doc_id").cast("string"), i.cast("string")) < share
    return docs.select("doc_id", F.transform(tokens(F.col("text")), lambda t, i: F.when(hit(t, i), F.lit(mask)).otherwise(t)).alias("items"))


def split(docs, key="doc_id", share=0.8):
    """docs with `part`: train for a share of the keys by their hash, eval for the rest."""
    return docs.withColumn("part", F.when(uniform(F.col(key).cast("string")) < share, "train").otherwise("eval"))


def shuffled(docs, seed=42):
    return docs.orderBy(F.rand(seed))


def capped(docs, n, key="doc_id"):
    """The sample cap as the caller asks for it: the n smallest keys."""
    return docs.orderBy(key).limit(n)


def masked_accuracy(pred):
    """pred(label, predicted, loss) -> accuracy over labels other than -100, perplexity (infinite on overflow)."""
    p = F.exp(F.avg("loss"))
    return pred.agg(F.avg(F.when(F.col("label") != -100, (F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"), F.coalesce(p, F.lit(float("inf"))).alias("perplexity"))


def word_vectors(seqs, size=50, window=5, least=1, seed=42):
    """seqs(id, tokens) -> id, vector: the mean of the tokens' vectors, null where there is none."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol="tokens", outputCol="v").fit(seqs)
    return model.transform(seqs).select("id", F.when(F.size("tokens") > 0, vector_to_array("v")).alias("vector"))


def merges(words, n):
    """words(word) -> rank, a, b: the first n byte-pair merges of a vocabulary, ties by pair.

    Each round counts adjacent pairs of the distinct words, weighted by frequency: one aggregate.
    """
    w = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("word <> ''").select(F.filter(F.split("word", ""), lambda c: c != "").alias("s"), "n")
    out = []
    for rank in range(n):
        pair = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))
        top = w.where(F.size("s") > 1).select(F.explode(pair).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(1).collect()
        if not top:
            break
        a, b = top[0]["p"]["a"], top[0]["p"]["b"]
        out.append((rank, a, b, top[0]["n"]))
        joined = F.aggregate("s", F.array().cast("array<string>"), lambda acc, x: F.when((F.element_at(F.concat(F.array(F.lit("")), acc), -1) == a) & (x == b), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x))))
        w = cut(w.select(joined.alias("s"), "n")) if rank % 50 == 49 else w.select(joined.alias("s"), "n")
    return words.sparkSession.createDataFrame(out, "rank int, a string, b string, n long")


def hand_features(docs, size=50):
    """doc_id, features: mean vector of first words, the share of instructions, mean vector of packages."""
    inst = lines(docs).where(~F.ltrim("line").startswith("#")).select("doc_id", "pos", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("word"), F.when(F.col("line").contains("install"), F.regexp_extract_all(F.substring_index("line", "install", -1), F.lit(r"\b\w+\b"), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("pkgs"))
    per = inst.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pkgs"))), lambda x: x["pkgs"])).alias("pkgs"))
    total = per.agg(F.sum(F.size("words")).alias("total"))
    a = word_vectors(per.select(F.col("doc_id").alias("id"), F.col("words").alias("tokens")), size).withColumnRenamed("vector", "va")
    b = word_vectors(per.select(F.col("doc_id").alias("id"), F.col("pkgs").alias("tokens")), size).withColumnRenamed("vector", "vb")
    zero = F.array_repeat(F.lit(0.0), size)
    rows = per.join(a, per["doc_id"] == a["id"]).drop("id").join(b, per["doc_id"] == b["id"]).drop("id").join(F.broadcast(total))
    return rows.select("doc_id", F.concat(F.coalesce("va", zero), F.array(F.size("words") / F.col("total")), F.coalesce("vb", zero)).alias("features"))
