"""Property graph operators: vertices(id, label, name, props) and edges(src, dst, type, props)."""
from functools import reduce

from pyspark.sql import functions as F

from drydock.functions.storage import cut, spread


def vertices(*parts):
    """MERGE of nodes: parts are (DataFrame, label, id column, name column); one row for each id."""
    rows = [d.select(F.col(i).cast("string").alias("id"), F.lit(label).alias("label"), F.col(n).alias("name")) for d, label, i, n in parts]
    return reduce(lambda a, b: a.unionByName(b), rows).where("id IS NOT NULL").groupBy("id", "label").agg(F.min("name").alias("name"))


def edges(*parts):
    """MERGE of edges: parts are (DataFrame, type, src column, dst column[, props map]); properties unite."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = [p[0].select(F.col(p[2]).cast("string").alias("src"), F.col(p[3]).cast("string").alias("dst"), F.lit(p[1]).alias("type"), (p[4] if len(p) > 4 else none).alias("props")) for p in parts]
    all_ = reduce(lambda a, b: a.unionByName(b), rows).where("src IS NOT NULL AND dst IS NOT NULL")
    entries = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_entries("props")))))
    return all_.groupBy("src", "dst", "type").agg(entries.alias("e")).select("src", "dst", "type", F.aggregate("e", none, lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))).alias("props"))


def assembled(parents, relations, deps, conflicts):
    """The graph of a corpus: vertices Image, Package and Command, edges BASED_ON, INSTALLS, USES, DEPENDS_ON
    (type, confidence) and CONFLICTS_WITH.

    parents(image, parent), relations(image, used_pkgs, install_pkgs), deps(pkg1, pkg2, type, confidence),
    conflicts(pkg1, pkg2). Ids are `label:name`; packages of a conflict that nothing installs or names stay out.
    """
    parents, relations, deps = cut(parents), cut(relations), cut(deps)  # vertices and edges read each several times
    name = lambda label, c: F.concat(F.lit(label + ":"), F.col(c))
    uses, installs = relations.select("image", F.explode("used_pkgs").alias("n")), relations.select("image", F.explode("install_pkgs").alias("n"))
    images = reduce(lambda a, b: a.unionByName(b), [parents.select(F.col("image").alias("n")), parents.select(F.col("parent").alias("n")), relations.select(F.col("image").alias("n"))])
    packages = reduce(lambda a, b: a.unionByName(b), [installs.select("n"), deps.select(F.col("pkg1").alias("n")), deps.select(F.col("pkg2").alias("n"))])
    v = vertices(*[(d.distinct().withColumn("id", name(label, "n")), label, "id", "n") for d, label in ((images, "Image"), (packages, "Package"), (uses.select("n"), "Command"))])
    ends = lambda d, la, a, lb, b: d.withColumn("src", name(la, a)).withColumn("dst", name(lb, b))
    props = F.map_from_arrays(F.array(F.lit("type"), F.lit("confidence")), F.array(F.col("type").cast("string"), F.col("confidence").cast("string")))
    seen = v.where("label = 'Package'").select(F.col("name").alias("n"))
    both = conflicts.join(seen.withColumnRenamed("n", "pkg1"), "pkg1", "left_semi").join(seen.withColumnRenamed("n", "pkg2"), "pkg2", "left_semi")
    e = edges((ends(parents, "Image", "image", "Image", "parent"), "BASED_ON", "src", "dst"), (ends(installs, "Image", "image", "Package", "n"), "INSTALLS", "src", "dst"), (ends(uses, "Image", "image", "Command", "n"), "USES", "src", "dst"), (ends(deps, "Package", "pkg1", "Package", "pkg2"), "DEPENDS_ON", "src", "dst", props), (ends(both, "Package", "pkg1", "Package", "pkg2"), "CONFLICTS_WITH", "src", "dst"))
    return v, e


def endpoints(e, v):
    """Edges with the names of both ends; edges to what is no vertex go."""
    s, d = v.select(F.col("id").alias("src"), F.col("name").alias("src_name")), v.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return e.join(s, "src").join(d, "dst").select("src_name", "type", "dst_name")


def neighbours(e, v, ids, kind=None):
    """Vertices that an edge (of one type, if given) leads to from the ids: src, type and the vertex."""
    on = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    on = on.where(F.col("type") == kind) if kind else on
    return on.select("src", "type", F.col("dst").alias("id")).join(v, "id")


def entity(v, value):
    return v.where(F.col("id") == value)


def k_hop(e, roots, depth=2):
    """id, depth: what edges reach from roots(id) in at most `depth` steps, at the least depth.

    A frontier and a set of those seen; each step joins the frontier alone with the edges.
    """
    step = e.select("src", "dst").distinct()
    seen = roots.select("id", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        if k > 2:  # a short way is one plan; a longer one starts anew at each step
            front, seen = cut(front), cut(seen)
            if front.isEmpty():
                break
        front = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(k).alias("depth")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(front)
    return seen


def subgraph(e, v, roots, depth=2):
    """The vertices that k_hop reaches and the edges that leave those above the last depth."""
    hop = k_hop(e, roots, depth)
    return v.join(hop, "id"), e.join(hop.where(F.col("depth") < depth).select(F.col("id").alias("src")), "src", "left_semi")


def in_degree(e):
    """dst, n: how many edges lead to each node that one leads to."""
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def reached(e, roots, depth=2):
    """grp, id, depth: k_hop for the roots(grp, id) of many groups at once, each group with what it has seen itself."""
    step = e.select("src", "dst").distinct()
    seen = roots.select("grp", "id", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        if k > 2:
            front, seen = cut(front), cut(seen)
        on = (F.col("grp") == F.col("g")) & (F.col("to") == F.col("i"))
        new = front.join(step, F.col("id") == F.col("src")).select("grp", F.col("dst").alias("to")).distinct().join(seen.select(F.col("grp").alias("g"), F.col("id").alias("i")), on, "left_anti")
        front = new.select("grp", F.col("to").alias("id"), F.lit(k).alias("depth"))
        seen = seen.unionByName(front)
    return seen


def clarified(candidates, conflicts, e, depth=2):
    """The answer to each request: candidates(grp, pos, text) of build texts -> their ranking (grp, pos, score, rank) and,
    for the best of each, the nodes (grp, id, depth) that edges reach from what it names.

    A candidate scores its entities less twice those in conflicts(src, dst) with another of its own.
    """
    from . import refactor, relations

    c = cut(spread(candidates).select("grp", "pos", F.concat_ws(":", F.col("grp").cast("string"), F.col("pos").cast("string")).alias("doc_id"), "text"))
    named = cut(c.select("grp", "pos", "doc_id").join(refactor.entities(c.select("doc_id", "text")), "doc_id", "left"))
    against = relations.conflicts(conflicts, named.select(F.col("doc_id").alias("grp"), F.explode("entities").alias("id"))).groupBy(F.col("grp").alias("doc_id")).agg(F.collect_list("src").alias("conflicts"))
    order = cut(refactor.ranked(named.join(against, "doc_id", "left")))
    roots = order.where("rank = 1").select("grp", F.explode("entities").alias("id"))
    return order.select("grp", "pos", "score", "rank"), reached(e, roots, depth)


def levels(e):
    """id, level: length of the longest path of edges (src depends on dst) below each node; rows of a
    cycle have none. A level is final once all that a node depends on has one; there are as many rounds as levels."""
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    done = nodes.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(0))
    while True:
        known = e.join(done.withColumnRenamed("id", "dst"), "dst", "left").groupBy("src").agg(F.max("level").alias("top"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        new = cut(known.where("all").select(F.col("src").alias("id"), (F.col("top") + 1).alias("level")).join(done.select("id"), "id", "left_anti"))
        if new.isEmpty():
            break
        done = done.unionByName(new)
    return done


#: Words for the relations that a text of a subgraph names (fixed values).
PHRASES = {"DEPENDS_ON": "depends on", "REQUIRES": "requires", "CONFLICTS_WITH": "conflicts with"}
#: Headings of the lists by entity type (fixed values).
HEADINGS = {"Image": "Base Images", "Package": "Required Packages", "Command": "Common Commands"}


def as_text(v, e, group):
    """One text for each group: lists of names by type, then a line for each known relation."""
    lists = [F.when(F.count(F.when(F.col("label") == k, 1)) > 0, F.concat(F.lit(f"{h}: "), F.array_join(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("name")))), ", "))).alias(k) for k, h in HEADINGS.items()]
    heads = v.groupBy(group).agg(*lists).select(group, F.concat_ws("\n", *HEADINGS).alias("head"))
    said = F.coalesce(*[F.when(F.col("type") == k, F.lit(p)) for k, p in PHRASES.items()])
    named = e.where(said.isNotNull()).join(v.select(group, F.col("id").alias("src"), F.col("name").alias("a")), [group, "src"]).join(v.select(group, F.col("id").alias("dst"), F.col("name").alias("b")), [group, "dst"])
    tails = named.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "a", said, "b"))), "\n").alias("tail"))
    return heads.join(tails, group, "left").select(group, F.concat_ws("\n", F.nullif("head", F.lit("")), "tail").alias("text"))


def graphviz(e):
    """Lines of a dot graph, one for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return e.select(F.concat(q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line"))
