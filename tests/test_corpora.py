"""Prefix trees by batches, RUN clusters, the assembled graph and its sink."""
import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drydock.operators import graph, mining, refactor
from drydock.sources import files
from drydock.streaming.incremental import PatternStore

from .test_operators import rows

U, D, UPD, INST, CURL, VIM = "FROM ubuntu", "FROM debian", "RUN apt-get update", "RUN apt-get install", "RUN apt-get install curl", "RUN apt-get install vim"
FIRST = [[U, UPD, INST], [D, UPD, INST], [U, CURL, INST], [D, UPD, CURL, VIM]]


def test_incremental_itemsets_of_the_fixture(spark, tmp_path):
    """9 itemsets and 12 rules, then 16 and 27 (15 distinct) after the second batch."""
    store = PatternStore(spark, str(tmp_path / "tree"))
    tx = lambda data: spark.createDataFrame(list(enumerate(data)), "tx_id long, items array<string>")
    tree = mining.grown_tree(store, tx(FIRST), 0.5, version=1)
    sets = mining.tree_itemsets(tree)
    want = {(INST,), (INST, U), (INST, U, CURL), (UPD,), (UPD, D), (UPD, D, CURL), (UPD, INST), (UPD, INST, D), (UPD, INST, U)}
    assert Counter(tuple(r["itemset"]) for r in sets.collect()) == Counter(tuple(sorted(s)) for s in want)
    assert {tuple(r["path"]): r["n"] for r in tree.collect()}[(UPD,)] == 3
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): (round(r["support"], 4), r["confidence"], round(r["lift"], 4)) for r in mining.rules(sets).collect()}
    assert len(got) == 12 and got[(D,), (UPD,)] == (0.3333, 1.0, 1.5) and got[tuple(sorted((CURL, INST))), (U,)] == (0.1111, 1.0, 3.0) and got[(UPD,), (D,)] == (0.3333, 0.5, 1.5)
    after = mining.updated_sets(sets, mining.grown_tree(store, tx([[U, VIM, UPD]]), 0.5, version=2))
    assert after.count() == 16
    again = mining.grown_tree(store, tx([[U, VIM, UPD]]), 0.5, version=2)  # a repeated batch is void
    assert {tuple(r["path"]): r["n"] for r in again.collect()}[(U,)] == 1
    found = [(tuple(r["antecedent"]), tuple(r["consequent"])) for r in mining.rules(after).collect()]
    assert (len(found), len(set(found))) == (27, 15)
    with pytest.raises(ValueError):
        mining.rules(spark.createDataFrame([(list("abcdefghijklmnopqrstu"),)], "itemset array<string>"))


def brute_clusters(texts, eps, least):
    n = Counter(t or "" for t in texts)
    bag = {c: Counter(c.split()) for c in n}
    d = lambda a, b: math.sqrt(sum((bag[a][w] - bag[b][w]) ** 2 for w in set(bag[a]) | set(bag[b])))
    near = {a: [b for b in n if d(a, b) <= eps] for a in n}
    core = [a for a in n if sum(n[b] for b in near[a]) >= least]
    lab = {a: a for a in core}
    for _ in range(len(core)):
        lab = {a: min(lab[b] for b in near[a] if b in lab) for a in lab}
    lab |= {a: min(lab[b] for b in near[a] if b in core) for a in n if a not in lab and any(b in core for b in near[a])}
    center = {c: min((round(sum(n[m] * d(a, m) for m in lab if lab[m] == c), 9), a) for a in lab if lab[a] == c)[1] for c in set(lab.values())}
    return {(c, k, lab.get(c), center.get(lab.get(c))) for c, k in n.items()}


@pytest.mark.parametrize("eps,least", [(0.5, 3), (1.0, 4), (1.5, 4), (2.1, 6)])
def test_run_clusters(spark, eps, least):
    words = ["a", "b", "c", "d", "e"]
    texts = [" ".join(w) for k in (1, 2, 3) for w in itertools.islice(itertools.product(words, repeat=k), 0, 60, 3)] + ["a b c"] * 4 + ["c b a", None, "", " ", "a a a a a b", "x y z"]
    got = refactor.run_clusters(spark.createDataFrame([(t,) for t in texts], "content string"), eps, least).collect()
    # of equal bags the least content stands for all
    want = brute_clusters(texts, eps, least)
    same = lambda c: tuple(sorted((c or "").split())) if c is not None else None
    assert {(r["content"], r["n"], same(r["cluster"]), r["center"] is None) for r in got} == {(c, k, same(l), z is None) for c, k, l, z in want}
    assert sum(r["share"] for r in got) == pytest.approx(1.0)


def test_graph_of_a_corpus(spark, tmp_path):
    f = spark.createDataFrame
    parents = f([("app", "ubuntu"), ("app", "ubuntu")], "image string, parent string")
    rel = f([("app", ["curl"], ["numpy", "theano"]), ("none", [], [])], "image string, used_pkgs array<string>, install_pkgs array<string>")
    deps = f([("keras", "numpy", "implicit", 0.5)], "pkg1 string, pkg2 string, type string, confidence double")
    v, e = graph.assembled(parents, rel, deps, f([("numpy", "theano"), ("numpy", "gone")], "pkg1 string, pkg2 string"))
    assert {r["id"] for r in v.collect()} == {"Image:app", "Image:ubuntu", "Image:none", "Package:numpy", "Package:theano", "Package:keras", "Command:curl"}
    got = {(r["src"], r["dst"], r["type"]): r["props"] for r in e.collect()}
    assert set(got) == {("Image:app", "Image:ubuntu", "BASED_ON"), ("Image:app", "Package:numpy", "INSTALLS"), ("Image:app", "Package:theano", "INSTALLS"), ("Image:app", "Command:curl", "USES"), ("Package:keras", "Package:numpy", "DEPENDS_ON"), ("Package:numpy", "Package:theano", "CONFLICTS_WITH")}
    assert got["Package:keras", "Package:numpy", "DEPENDS_ON"] == {"type": "implicit", "confidence": "0.5"}

    path = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        files.read_graph(spark, path)
    assert files.replace_graph(v, e, path) == 1 and files.replace_graph(v, e.where("type <> 'USES'"), path) == 2
    (tmp_path / "g" / "v9").mkdir()  # what a lost writer left is no version
    assert [d.count() for d in files.read_graph(spark, path)] == [7, 5]
    with pytest.raises(ValueError, match="no vertex: Command:curl"):
        files.replace_graph(v.where("label <> 'Command'"), e, path)
    with pytest.raises(ValueError, match="repeated"):
        files.replace_graph(v.unionByName(v), e, path)
    assert [d.count() for d in files.read_graph(spark, path)] == [7, 5] and files.replace_graph(v, e, path) > 9
    assert not (tmp_path / "g" / "v9").exists()


def test_sent_graphs(spark, tmp_path):
    """Each task connects and merges rows of one label or type at a time, vertices before edges."""
    f = spark.createDataFrame
    v, e = graph.assembled(f([("a", "b"), ("c", "b")], "image string, parent string"), f([("a", ["x"], [])], "image string, used_pkgs array<string>, install_pkgs array<string>"), f([], "pkg1 string, pkg2 string, type string, confidence double"), f([], "pkg1 string, pkg2 string"))
    out = str(tmp_path)

    def connect():
        import json
        import uuid
        return lambda kind, rows: open(f"{out}/{kind.replace(':', '-')}-{uuid.uuid4().hex}", "w").write(json.dumps(rows))

    files.send_graph(v, e, connect, rows=1)
    import json
    got = Counter(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() for _ in json.loads(p.read_text()))
    assert got == {"vertex-Image": 3, "vertex-Command": 1, "edge-BASED_ON": 2, "edge-USES": 1}


def test_reordered(spark):
    """Nothing stands before what it depends on; instructions of one level keep their order."""
    from drydock.operators import buildgraph
    t = spark.createDataFrame([("f", 0, []), ("f", 1, [0]), ("f", 2, [1]), ("f", 3, [0]), ("f", 4, [2, 3]), ("g", 0, None), ("g", 1, [])], "file_sha string, cmdid int, cmd_dep array<int>")
    assert sorted(rows(buildgraph.reordered(t).select("file_sha", "place", "cmdid", "level"))) == [("f", 0, 0, 0), ("f", 1, 1, 1), ("f", 2, 3, 1), ("f", 3, 2, 2), ("f", 4, 4, 3), ("g", 0, 0, 0), ("g", 1, 1, 0)]


def test_clarified(spark):
    """Two requests: conflicts cost twice, ties keep their order, a candidate that names nothing counts 0, cycles end."""
    f = spark.createDataFrame
    c = f([(1, 0, "FROM a:1\nRUN apt-get install -y x y"), (1, 1, "FROM a\nRUN apt-get install z"), (1, 2, None), (2, 0, ""), (2, 1, "no build file")], "grp int, pos int, text string")
    ranking, nodes = graph.clarified(c, f([("package:x", "package:y"), ("package:y", "package:z")], "src string, dst string"), f([("package:z", "package:q"), ("package:q", "package:z"), ("package:q", "image:s"), ("image:s", "image:t")], "src string, dst string"), 2)
    assert rows(ranking) == [(1, 0, 1, 2), (1, 1, 2, 1), (1, 2, 0, 3), (2, 0, 0, 1), (2, 1, 0, 2)]
    assert rows(nodes) == [(1, "image:a", 0), (1, "image:s", 2), (1, "package:q", 1), (1, "package:z", 0)]
