"""Steps that grew with more than their input: what they must not hold, join or send."""
import json

from pyspark.sql import functions as F

from drydock.operators import tree


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark, n=300):
    t = lambda k: {"type": "A", "children": [{"type": "B", "value": f"v{k}", "children": []}, {"type": "C", "value": "", "children": [{"type": "D", "value": k, "children": []}]}]}
    bad = [("x", "no tree"), ("y", None), (None, json.dumps(t(1)))]
    return spark.createDataFrame([(str(k), json.dumps(t(k))) for k in range(n)] + bad, "file_sha string, ast string")


def test_nodes_by_columns_are_the_rows_of_trees(spark, monkeypatch):
    d = docs(spark)
    monkeypatch.setattr(tree, "HELD", 7)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(tree.nodes(d)) == key(tree.good(tree.mapped_trees(d, tree._rows, tree.NODE)))


def test_rendering_joins_nothing_and_trees_are_spread(spark):
    n = tree.nodes(docs(spark))
    got = tree.rendering(n)
    assert "Join" not in plan(got)  # a small estimate of a grown table was sent to the driver as a broadcast
    assert n.rdd.getNumPartitions() >= 8 and tree.nodes(docs(spark).coalesce(1)).rdd.getNumPartitions() >= 8
    assert got.where((F.col("file_sha") == "3") & (F.size("root_ord") == 0)).first()["text"] == "A B v3 C D 3"


def test_nearest_keeps_ties_to_smaller_ids_and_copies(spark, tmp_path):
    from drydock.operators import entity_index as E
    texts = [(k, ["a b", "a b c", "d e", "f"][k % 4] if k % 3 else f"w{k % 11} a b") for k in range(400)]
    d = spark.createDataFrame(texts, "id long, text string")
    path = E.build(d, str(tmp_path / "index"), pivots=8)
    q = d.where("id % 20 = 0")
    got = [tuple(r) for r in E.search(spark, path, q, 5, itself=False).orderBy("query_id", "rank").collect()]
    e = {r["id"]: (r["counts"], r["norm"]) for r in E.encoded(d).collect()}
    score = lambda a, b: round(sum(x * y for x, y in zip(e[a][0], e[b][0])) / (e[a][1] * e[b][1]), 9)
    want = [(a, n + 1, b, -s) for a in range(0, 400, 20) for n, (s, b) in enumerate(sorted((-score(a, b), b) for b in e if b != a)[:5])]
    assert got == want
    # what a search compares are vectors, not rows: 400 rows have few
    assert E.classes(spark, path, 6).count() == len({tuple(c) for c, _ in e.values()})
    assert max(len(r["ids"]) for r in E.classes(spark, path, 6).collect()) == 6


def test_symbols_make_their_node_table_once(spark):
    from drydock.operators import symbols
    t = {"type": "F", "children": [{"type": "DOCKER-ENV", "children": [{"type": "DOCKER-NAME", "value": "A", "children": []}, {"type": "DOCKER-LITERAL", "value": "x", "children": []}]}, {"type": "DOCKER-PATH", "value": "$A/$B", "children": []}]}
    d = spark.createDataFrame([("f", json.dumps(t))], "file_sha string, ast string")
    got = symbols.substituted(tree.nodes(d))
    assert "MapInArrow" not in plan(got)  # trees were parsed anew for each of six readings
    assert got.where("type = 'DOCKER-PATH'").first()["value"] == "x/$B"


def test_distances_by_products_are_those_by_differences():
    import numpy as np
    from drydock.operators import blocks
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 16))
    y = np.concatenate([x[:40], x[40:80] + 1e-9, r.normal(size=(300, 16)), [[np.inf] * 16, [np.nan] * 16]])
    with np.errstate(all="ignore"):
        want = np.sqrt(((y[None] - x[:, None]) ** 2).sum(2))
        got = np.concatenate([d for _, d in blocks.distances(x, y)])
        eps = float(want[5, 100])
        at = np.concatenate([d for _, d in blocks.distances(x, y, eps)])
    assert np.allclose(got, want, rtol=1e-9, atol=0, equal_nan=True) and got[5, 5] == 0
    assert ((at <= eps) == (want <= eps)).all()  # a row exactly at eps included


def test_blocks_of_one_table_meet_once_and_rows_without_structure_leave_cells(spark, monkeypatch):
    import numpy as np
    from drydock.operators import blocks, vectors
    r = np.random.default_rng(5)
    x = r.normal(size=(230, 24))
    d = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(blocks.met, "__defaults__", (60, None))
    seen = []
    monkeypatch.setattr(blocks, "met", lambda *a, f=blocks.met, **k: seen.append(k) or f(*a, **k))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    eps = float(np.quantile(far, 0.1))
    n = {a["vec_id"]: a["n"] for a in blocks.neighbours(d, eps).collect()}
    assert n == {i: int((far[i] <= eps).sum()) - 1 for i in range(230)}
    assert seen[-1]["same"]  # all blocks, each two once, as cells rule nothing out
    assert vectors.dbscan(d, eps, 4).count() == 230 and abs(vectors.silhouette(d).first()[0]) < 1


def test_ranks_of_a_large_group_lie_over_tasks(spark):
    from drydock.operators import refactor
    c = spark.range(3000).select(F.lit("g").alias("grp"), "id", (F.col("id") * 7 % 3000).alias("pos"), F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda x: x.cast("string")).alias("entities"), F.array().cast("array<string>").alias("conflicts"))
    r = refactor.ranked(c)
    got = [(x["pos"], x["rank"]) for x in r.collect()]
    want = sorted((-(i % 5 + 1), i * 7 % 3000) for i in range(3000))
    assert sorted(got, key=lambda x: x[1]) == [(p, n + 1) for n, (_, p) in enumerate(want)]
    windows = [l for l in plan(r).splitlines() if "windowspecdefinition" in l]
    assert windows and not any("pos#" in l for l in windows)  # a window by the group had all its rows in one task


def test_dependency_tables_read_nodes_by_number_and_send_nothing_to_the_driver(spark):
    from drydock.operators import buildgraph
    from drydock.sources import rules
    from .test_buildgraph import APT, COPY, FROM, MKDIR, RUN, TAR
    from .test_operators import lit
    d = spark.createDataFrame([("f", json.dumps(lit("DOCKER-FILE", None, FROM("one"), APT("p"), MKDIR("a"), TAR("a"), RUN(), COPY("a", stage="one"))))], "file_sha string, ast string")
    n = tree.numbered(d)
    assert "ord" not in n.columns
    # what stands where was joined back by places, and each reading parsed and dealt the trees again
    assert plan(buildgraph.touched(n, rules.file_rules(spark))).count("MapInArrow") == 1
    assert "array<int>" not in str(buildgraph.commands(n).schema.simpleString())
    names = spark.createDataFrame([("tar", "SC-TAR", "SC-TAR")], "command string, prefix string, name string")
    t = buildgraph.dependency_table(n, rules.install_rules(spark), rules.file_rules(spark), names)
    assert [r["cmd_dep"] for r in t.orderBy("cmdid").collect()] == [[], [0], [0], [0, 2], [1, 3], [4]]
    # all tables here are small, as those of well packed files look: none may go to the driver for that
    assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()


def test_an_assembled_graph_makes_its_parts_once(spark):
    from drydock.operators import graph, relations
    r = spark.range(40).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file_sha"), (F.col("id") % 2).cast("string").alias("image"), F.when(F.col("id") % 5 == 0, "install").when(F.col("id") % 5 < 4, "used").alias("kind"), F.when(F.col("id") < 38, (F.col("id") % 7).cast("string")).alias("name"))
    of = relations.image_relations(r)
    assert "array_except" not in plan(of)  # arrays for each file and image
    want = {}
    for file in {(x["file_sha"], x["image"]) for x in r.collect()}:
        got = {k: {x["name"] for x in r.collect() if (x["file_sha"], x["image"]) == file and x["kind"] == k and x["name"]} for k in ("used", "install")}
        u, i = want.setdefault(file[1], (set(), set()))
        u |= got["used"] - got["install"]
        i |= got["install"]
    assert {x["image"]: (set(x["used_pkgs"]), set(x["install_pkgs"])) for x in of.collect()} == want
    parents, apart = spark.createDataFrame([("0", "1")], "image string, parent string"), spark.createDataFrame([("1", "2")], "pkg1 string, pkg2 string")
    items = r.select("image", F.col("name").alias("pkg"))
    v, e = graph.assembled(parents, of, relations.dependencies(items, apart), apart)
    assert "Range" not in plan(v) + plan(e) and e.where("type = 'CONFLICTS_WITH'").count() == 1


def test_reordering_is_one_aggregate_over_bounded_tasks(spark):
    from drydock.functions.storage import parted
    from drydock.operators import buildgraph
    assert parted(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 101
    t = spark.createDataFrame([("f", 0, []), ("f", 1, [0]), ("f", 2, [1]), ("f", 3, [0]), (None, 0, [])], "file_sha string, cmdid int, cmd_dep array<int>")
    got = buildgraph.reordered(t)
    assert "Window" not in plan(got) and "Join" not in plan(got)  # a window and a join sorted the table three times
    assert [tuple(x) for x in got.orderBy("place").collect()] == [("f", 0, [], 0, 0), ("f", 1, [0], 1, 1), ("f", 3, [0], 1, 2), ("f", 2, [1], 2, 3)]
    more = buildgraph.reordered(t.withColumn("x", F.lit("y"))).orderBy("place").collect()
    assert [(x["cmdid"], x["x"], x["place"]) for x in more] == [(0, "y", 0), (1, "y", 1), (3, "y", 2), (2, "y", 3)]
