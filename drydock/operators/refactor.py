"""Build files as instruction rows: parsing, extraction, unification, repair, retrieval texts."""
from pyspark.sql import functions as F, Window as W

from drydock.functions.prefix import running_sums
from drydock.functions.storage import cut

#: Rewrites of commands, in order (fixed values: patterns and replacements must match).
REWRITES = [
    (r"apt\s+install", "apt-get install -y"),
    (r"apt-get\s+install(?!\s+-y)", "apt-get install -y"),
    (r"wget\s+([^\s]+)\s+-O\s+([^\s]+)", "curl -L $1 -o $2"),
    (r"chmod\s+[0-7]{3,4}\s+([^\s]+)", "chmod 755 $1"),
    (r"tar\s+-xzvf", "tar -xzf"),
    (r"unzip\s+([^\s]+)\s+-d\s+([^\s]+)", "tar -xzf $1 -C $2"),
]
#: Lint rules and what they ask for (fixed values).
LINT = {
    "DL3000": "WORKDIR should use absolute paths - add '/' prefix to path",
    "DL3004": "Do not use sudo - replace with gosu",
    "DL3020": "Use COPY instead of ADD for files/directories",
    "DL3021": "COPY with more than 2 arguments requires last argument to end with /",
    "DL4004": "Multiple ENTRYPOINT instructions - only the last one will take effect",
}


def instructions(docs, key="doc_id"):
    """key, pos, type, content: `KEYWORD rest` of each line that is neither blank nor a comment."""
    line = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    return line.where("line <> '' AND NOT startswith(line, '#')").select(key, "pos", F.upper(F.regexp_extract("line", r"^(\S+)", 1)).alias("type"), F.regexp_extract("line", r"^\S+\s*(.*)$", 1).alias("content"))


def entities(docs):
    """doc_id, entities: `image:x` of FROM x:y lines and `package:p` of what follows apt-get install in RUN
    lines (all further words of the line, the two usual flags apart), sorted."""
    line = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l")).withColumn("l", F.trim("l"))
    image = F.when(F.col("l").startswith("FROM"), F.array(F.concat(F.lit("image:"), F.regexp_extract("l", r"^FROM\s+([^\s:]+)", 1))))
    words = F.filter(F.split(F.regexp_extract("l", r"apt-get install\s+(.*)$", 1), r"\s+"), lambda w: ~w.isin("", "-y", "--no-install-recommends"))
    package = F.when(F.col("l").startswith("RUN") & F.col("l").contains("apt-get install"), F.transform(words, lambda w: F.concat(F.lit("package:"), w)))
    return line.select("doc_id", F.explode(F.coalesce(image, package, F.array().cast("array<string>"))).alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_set("e")).alias("entities"))


def required_packages(instr):
    """doc_id, packages: lower-cased words after the first install or add of each RUN, as a sorted set."""
    w = F.filter(F.split(F.lower("content"), r"\s+"), lambda x: x != "")
    at = F.expr("array_min(filter(array(array_position(w, 'install'), array_position(w, 'add')), x -> x > 0))")
    got = instr.where("type = 'RUN'").select("doc_id", w.alias("w")).withColumn("at", at).where("at IS NOT NULL")
    return got.select("doc_id", F.explode(F.expr("slice(w, int(at) + 1, size(w))")).alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("packages"))


def features(docs):
    """doc_id, keywords, n, packages of build texts: first words, their number, words after the last install."""
    i = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "l")).where("trim(l) <> '' AND NOT startswith(trim(l), '#')")
    pk = F.when(F.col("l").contains("install"), F.regexp_extract_all(F.substring_index("l", "install", -1), F.lit(r"\b\w+\b"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    x = i.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.regexp_extract("l", r"^\s*(\S+)", 1).alias("k"), pk.alias("p")))).alias("x"))
    return x.select("doc_id", F.transform("x", lambda r: r["k"]).alias("keywords"), F.size("x").alias("n"), F.flatten(F.transform("x", lambda r: r["p"])).alias("packages"))


def unified(kind, content, standards=None):
    """Column of the content of an instruction after the rewrites and the standards of its commands.

    standards: command -> {preferred_name, parameter_order}. Only RUN changes; null stays null.
    """
    text = content
    for pattern, by in REWRITES:
        text = F.regexp_replace(text, pattern, by)
    def command(c):
        w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
        name, out = F.get(w, F.lit(0)), F.array_join(w, " ")
        for known, rule in (standards or {}).items():
            order, rest = rule.get("parameter_order", []), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
            first = F.filter(F.array(*[F.when(F.array_contains(rest, p), F.lit(p)) for p in order] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
            # of a parameter that stands twice only its first occurrence moves
            left = F.filter(rest, lambda x, i: ~F.array_contains(first, x) | (F.array_position(rest, x) != i + 1))
            out = F.when(name == known, F.array_join(F.concat(F.array(F.lit(rule.get("preferred_name", known))), first, left), " ")).otherwise(out)
        return out
    parts = F.filter(F.split(text, "&&"), lambda c: F.trim(c) != "")
    return F.when(kind == "RUN", F.array_join(F.transform(parts, command), " && ")).otherwise(content)


def merged_runs(instr, key="doc_id"):
    """Consecutive RUN rows of a document as one, joined by &&, with the clean-up of package lists after installs."""
    w = W.partitionBy(key).orderBy("pos")
    new = F.when((F.col("type") == "RUN") & (F.lag("type").over(w) == "RUN"), 0).otherwise(1)
    isle = instr.withColumn("new", new).withColumn("isle", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    got = isle.groupBy(key, "isle").agg(F.min("pos").alias("pos"), F.first("type").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " && ").alias("content"))
    c, run = F.col("content"), F.col("type") == "RUN"
    installs = c.contains("apt-get install") | c.contains("apk add")
    clean = F.when(run & installs & c.contains("apt-get"), F.concat(c, F.lit(" && rm -rf /var/lib/apt/lists/*"))).when(run & installs, F.concat(c, F.lit(" && rm -rf /var/cache/apk/*"))).otherwise(c)
    return got.select(key, "pos", "type", clean.alias("content"))


def shares(instr, threshold=0.0):
    """type, content, share: of the instructions of a type, `threshold` at least."""
    n = instr.groupBy("type", "content").agg(F.count(F.lit(1)).alias("n"))
    # a type is a key of few values: its total is an aggregate of its own, not a window over all its texts
    total = instr.groupBy(F.col("type").alias("t")).agg(F.count(F.lit(1)).alias("total"))
    share = F.col("n") / F.col("total")
    return n.join(total, F.col("type").eqNullSafe(F.col("t"))).withColumn("share", share).where(F.col("share") >= threshold).select("type", "content", "share")


def bags(texts):
    """content, bag: the words of each text with their counts, sorted: its sparse count vector."""
    w = texts.select("content", F.filter(F.split("content", r"\s+"), lambda x: x != "").alias("w"))
    return w.select("content", F.transform(F.array_sort(F.array_distinct("w")), lambda x: F.struct(x.alias("word"), F.size(F.filter("w", lambda y: y == x)).alias("n"))).alias("bag"))


def _squared(a, b):
    """Squared Euclidean distance of two bags (map columns)."""
    words = F.array_union(F.map_keys(a), F.map_keys(b))
    gap = lambda w: F.coalesce(F.try_element_at(a, w), F.lit(0)) - F.coalesce(F.try_element_at(b, w), F.lit(0))
    return F.aggregate(F.transform(words, lambda w: gap(w) * gap(w)), F.lit(0), lambda s, x: s + x)


def bag_pairs(bag, eps):
    """a, b: the ids of other bags within Euclidean distance eps of each of bag(id, bag).

    Bags that near differ in eps^2 words at most, so of each the eps^2 + 1 rarest (word, count) elements find all
    partners by an inverted index, but for bags that short altogether: those meet under an element of their own.
    """
    most = int(eps * eps)
    each = bag.select("id", F.explode("bag").alias("x"))
    rare = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    order = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("df", "x"))), 1, most + 1), lambda r: r["x"])
    heads = each.join(rare, "x").groupBy("id").agg(order.alias("xs")).select("id", F.explode("xs").alias("x"))
    short = bag.where(F.size("bag") <= most).select("id", F.struct(F.lit("").alias("word"), F.lit(0).alias("n")).alias("x"))
    heads = heads.unionByName(short)
    pair = heads.select(F.col("id").alias("a"), "x").join(heads.select(F.col("id").alias("b"), "x"), "x").where("a <> b").select("a", "b").distinct()
    of = lambda c: bag.select(F.col("id").alias(c), F.map_from_entries("bag").alias(f"m_{c}"))
    return pair.join(of("a"), "a").join(of("b"), "b").where(_squared(F.col("m_a"), F.col("m_b")) <= eps * eps).select("a", "b")


def run_clusters(texts, eps=0.5, least=5):
    """content, n, share, cluster, center: texts(content) clustered by their words (DBSCAN over count vectors).

    Equal bags of words are one point with a weight: copies cost nothing. cluster is the least content among its core
    bags, null for noise; center the content of least mean distance to the texts of its cluster, ties to the
    least; share is of all texts. Empty and null contents are the bag of no words.
    """
    from . import vectors

    known = texts.select(F.coalesce("content", F.lit("")).alias("content"))
    counted = cut(bags(known.groupBy("content").agg(F.count(F.lit(1)).alias("n"))).join(known.groupBy("content").agg(F.count(F.lit(1)).alias("n")), "content"))
    total = known.count()
    point = cut(counted.groupBy("bag").agg(F.min("content").alias("id"), F.sum("n").alias("weight")))
    near = cut(bag_pairs(point, eps))
    weight = point.select(F.col("id").alias("b"), "weight")
    around = near.join(weight, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("w"))
    core = cut(point.join(around, "id", "left").where(F.col("weight") + F.coalesce("w", F.lit(0)) >= least).select(F.col("id").alias("vec_id")))
    link = near.join(core.withColumnRenamed("vec_id", "a"), "a", "left_semi").join(core.withColumnRenamed("vec_id", "b"), "b", "left_semi")
    lab = cut(vectors.connected(core, link).withColumnRenamed("c", "cluster"))
    edge = near.join(lab.withColumnRenamed("vec_id", "b"), "b").groupBy(F.col("a").alias("vec_id")).agg(F.min("cluster").alias("cluster")).join(core, "vec_id", "left_anti")
    member = cut(point.join(lab.unionByName(edge).withColumnRenamed("vec_id", "id"), "id").select("id", "bag", "weight", "cluster"))
    center = _centers(member)
    got = counted.join(point.select("id", F.col("bag").alias("same")), F.col("bag") == F.col("same")).join(member.select("id", "cluster"), "id", "left").join(center, "cluster", "left")
    return got.select("content", "n", (F.col("n") / F.lit(total)).alias("share"), "cluster", "center")


def _centers(member):
    """cluster, center of member(id, bag, weight, cluster): sums of distances leave each pair of blocks, not pairs."""
    import numpy as np
    import pyarrow as pa

    from . import blocks

    rows = member.select(F.xxhash64("id").alias("vec_id"), "id", "bag", "weight", F.col("cluster").alias("tag"))

    def reduce(a, b, both):
        bags_ = [[{x["word"]: x["n"] for x in bag} for bag in t["bag"].to_pylist()] for t in (a, b)]
        words = {w: i for i, w in enumerate(sorted({w for side in bags_ for m in side for w in m}))}
        x, y = (np.zeros((len(side), len(words))) for side in bags_)
        for m, side in zip((x, y), bags_):
            for i, bag in enumerate(side):
                for w, n in bag.items():
                    m[i, words[w]] = n
        weight = b["weight"].to_numpy()
        return pa.table({"cluster": a["tag"], "id": a["id"], "total": pa.array(np.concatenate([(d * weight).sum(1) for _, d in blocks.distances(x, y)]))})

    got = blocks.met(rows, rows, "cluster string, id string, total double", reduce, 500, "tag").groupBy("cluster", "id").agg(F.round(F.sum("total"), 9).alias("total"))
    return got.groupBy("cluster").agg(F.min_by("id", F.struct("total", "id")).alias("center"))


def rendered(instr, key="doc_id"):
    """key, text: the instructions of a document in their order."""
    return instr.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "content"))), lambda x: F.concat_ws(" ", x["type"], x["content"])), "\n").alias("text"))


def refactored(docs, standards=None, base_images=None):
    """The whole refactoring: parse, replace the base image (doc_id, name), unify, merge, render.

    A document without instructions keeps its text. Rows are numbered once: rows of a null or repeated doc_id
    stay documents of their own.
    """
    d = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    i = instructions(d, "_row")
    if base_images is not None:
        first = i.where("type = 'FROM'").groupBy("_row").agg(F.min("pos").alias("pos")).join(d.select("_row", "doc_id"), "_row").join(base_images.select("doc_id", "name"), "doc_id").select("_row", "pos", "name")
        i = i.join(first, ["_row", "pos"], "left").select("_row", "pos", "type", F.coalesce("name", "content").alias("content"))
    i = i.withColumn("content", unified(F.col("type"), F.col("content"), standards))
    new = rendered(merged_runs(i, "_row"), "_row").withColumnRenamed("text", "_new")
    return d.join(new, "_row", "left").withColumn("text", F.coalesce("_new", "text")).select(*docs.columns)


def lint_repaired(docs, findings):
    """docs(doc_id, text) with the lines that findings(doc_id, message) name repaired: DL3000, DL3020."""
    rule = findings.select("doc_id", F.regexp_extract("message", r"(DL\d+)", 1).alias("rule")).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    has = lambda r: F.coalesce(F.array_contains("rules", r), F.lit(False))
    def fix(l):
        path = F.trim(F.regexp_extract(l, r"WORKDIR(.*)$", 1))
        work = F.when(has("DL3000") & F.trim(l).startswith("WORKDIR") & ~path.startswith("/"), F.concat(F.lit("WORKDIR /"), path)).otherwise(l)
        return F.when(has("DL3020") & F.trim(l).startswith("ADD"), F.replace(work, F.lit("ADD"), F.lit("COPY"))).otherwise(work)
    return docs.join(rule, "doc_id", "left").withColumn("text", F.array_join(F.transform(F.split("text", "\n"), fix), "\n")).drop("rules")


def scored(candidates):
    """candidates(entities, conflicts, ...) with score: entities less twice the conflicts; null arrays count as empty."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return candidates.withColumn("score", size("entities") - 2 * size("conflicts"))


def ranked(candidates):
    """candidates(grp, pos, entities, conflicts) with score and rank within their group, ties by pos.

    A rank is a running count over ranges of the order, so a group of any size lies over many tasks.
    """
    s = scored(candidates)
    s = s.withColumn("_none", F.col("score").isNull()).withColumn("_less", -F.col("score")).withColumn("_one", F.lit(1).cast("long"))
    r = running_sums(s, ["grp"], ["_none", "_less", "pos"], "_one")
    return r.withColumn("rank", (F.col("before") + 1).cast("int")).drop("_none", "_less", "_one", "before")


def contexts(docs, rules):
    """doc_id, context: the texts of rules(keyword, context) whose keyword a document holds, each once.

    rules is a table of the caller's own constants; it is checked to be small before it is broadcast.
    """
    rows = rules.select("keyword", "context").collect() if rules.count() <= 10_000 else None
    if rows is None:
        raise ValueError("a rule table of more than 10,000 rows is no list of constants")
    held = F.filter(F.array(*[F.when(F.contains("text", F.lit(r["keyword"])), F.lit(r["context"])) for r in rows]), lambda x: x.isNotNull())
    return docs.select("doc_id", F.array_join(F.array_distinct(held), "\n").alias("context"))


def prompts(requests, docs_context, knowledge):
    """requests(doc_id, text) -> doc_id, prompt: the request with its knowledge text and its command hints."""
    r = requests.join(knowledge, "doc_id", "left").join(docs_context, "doc_id", "left")
    return r.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("Requirement:\n"), requests["text"]), F.concat(F.lit("Knowledge:\n"), F.nullif("knowledge", F.lit(""))), F.concat(F.lit("Hints:\n"), F.nullif("context", F.lit("")))).alias("prompt"))


def completed(prompt_rows, complete):
    """doc_id, completion by a callable of the caller's own (list of prompts -> list of texts); off by default."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "completion": complete(b["prompt"].tolist())})

    return prompt_rows.select("doc_id", "prompt").mapInPandas(run, "doc_id long, completion string")


def candidates(completions):
    """doc_id, pos, text: the alternatives of a completion, a JSON list of texts or else its paragraphs."""
    parsed = F.from_json("completion", "array<string>")
    parts = F.when(parsed.isNotNull() & ~F.exists(parsed, lambda x: x.isNull()), parsed).otherwise(F.filter(F.split("completion", r"\n\s*\n"), lambda x: F.trim(x) != ""))
    return completions.select("doc_id", F.posexplode(parts).alias("pos", "text"))


def build_repaired(docs, build, repair):
    """docs(doc_id, text): build(text) -> (ok, log) and repair(text, log) -> text, by callables of the caller's own."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                ok, log = build(t)
                out.append(t if ok else repair(t, log))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string")
