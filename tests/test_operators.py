"""Operators on fixtures with results worked out by hand."""
import json
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from drydock.operators import corpus, graph, mining, refactor, relations, shell, tree, vectors
from drydock.sources import files
from drydock.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()))


def lit(kind, value=None, *children):
    return {"type": kind, **({"value": value} if value is not None else {}), "children": list(children)}


def test_image_references(spark):
    cases = [
        ([("NAME", "ubuntu")], "ubuntu:latest"), ([("NAME", "ubuntu"), ("TAG", "20.04")], "ubuntu:20.04"), ([("NAME", "a"), ("REPO", "r")], "r/a:latest"),
        ([("NAME", "passenger-ruby21"), ("REPO", "phusion"), ("TAG", None)], "phusion/passenger-ruby21:latest"), ([("NAME", "a"), ("REPO", "r"), ("TAG", "1")], "r/a:1"), ([("NAME", "a"), ("ALIAS", "b")], "a"), ([], None),
    ]
    d = spark.createDataFrame([(i, [(f"DOCKER-IMAGE-{k}", v) for k, v in c]) for i, (c, _) in enumerate(cases)], "i int, c array<struct<type:string,value:string>>")
    assert rows(d.select("i", relations.from_reference("c"))) == [(i, w) for i, (_, w) in enumerate(cases)]


def test_interpolation(spark):
    cases = [("${V}", {"V": "1"}, "1"), ("$A/x", {"A": "p"}, "p/x"), ("${NOPE}-z", {}, "${NOPE}-z"), ("$A$B", {"A": "1", "B": "2"}, "12"), ("$AB", {"A": "1"}, "$AB"), ("$A", {"A": "$1\\"}, "$1\\"), (None, {"A": "1"}, None)]
    d = spark.createDataFrame([(i, v, e) for i, (v, e, _) in enumerate(cases)], "i int, v string, e map<string,string>")
    assert rows(d.select("i", tree.interpolated(F.col("v"), F.col("e")))) == [(i, w) for i, (*_, w) in enumerate(cases)]


def test_image_relations(spark):
    uses = [("1", "ubuntu", "used", "apt-get"), ("1", "ubuntu", "used", "curl"), ("1", "ubuntu", "install", "curl"), ("2", "ubuntu", "used", "curl"), ("2", "ubuntu", "used", "tar"), ("2", "ubuntu", "install", "gcc"), ("3", "empty", "used", None)]
    got = {r["image"]: r for r in relations.image_relations(spark.createDataFrame(uses, "file_sha string, image string, kind string, name string")).collect()}
    assert got["ubuntu"]["used_pkgs"] == ["apt-get", "curl", "tar"] and got["ubuntu"]["install_pkgs"] == ["curl", "gcc"] and got["empty"]["used_pkgs"] == []


def test_dependencies_of_packages(spark):
    items = spark.createDataFrame([(i, p) for i, ps in (("i1", "abc"), ("i2", "ab"), ("i3", "ad"), ("i4", "b"), ("i4", "b")) for p in ps], "image string, pkg string")
    assert rows(relations.frequency(items)) == [("a", 3), ("b", 3), ("c", 1), ("d", 1)] and rows(relations.cooccurrence(items)) == [("a", "b", 2)]
    assert [(a, b, round(s, 4)) for a, b, s in rows(relations.implicit_dependencies(items))] == [("a", "b", 0.6667), ("b", "a", 0.6667)]
    known = spark.createDataFrame([("a", "b"), ("a", "zz")], "pkg1 string, pkg2 string")
    assert [r[:3] for r in rows(relations.dependencies(items, known))] == [("a", "b", "explicit"), ("b", "a", "implicit")]
    assert files.known_pairs(spark, files.KNOWN_CONFLICTS).count() == 2


U, D, UPD, INST, CURL = "FROM ubuntu", "FROM debian", "RUN apt-get update", "RUN apt-get install", "RUN apt-get install curl"


def test_prefix_itemsets_and_rules(spark):
    """Frequent items alone, sorted by frequency; rules over the multiset of itemsets."""
    tx = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["b", "a"]), (2, ["b", "d"]), (3, [])], "tx_id long, items array<string>")
    sets = mining.prefix_itemsets(tx, 0.5)
    assert rows(sets.select(F.array_join("itemset", ","))) == [("a,b",), ("b",)]
    got = rows(mining.rules(sets, 0.0, 0.0).select(F.array_join("antecedent", ","), F.array_join("consequent", ","), "support", "confidence", "lift"))
    assert got == [("a", "b", 0.5, 1.0, 1.0), ("b", "a", 0.5, 0.5, 1.0)]
    assert mining.updated(sets, tx, 0.5).count() == 2  # singles go, repeated sets stay


def test_sequences(spark):
    one = [[1, 2, 3], [1, 4], [2, 3, 5], [1, 2], [3, 5], [4]]
    db = spark.createDataFrame(list(enumerate(one)), "seq_id long, seq array<int>")
    got = {tuple(r["pattern"]): r["support"] for r in mining.sequences(db, 2).collect()}
    assert got == {(1,): 3, (2,): 3, (3,): 3, (4,): 2, (5,): 2, (1, 2): 2, (2, 3): 2, (3, 5): 2}
    smoke = spark.createDataFrame(list(enumerate(["abcd", "acbe", "abce", "bcde"])), "i long, s string").select(F.col("i").alias("seq_id"), F.filter(F.split("s", ""), lambda x: x != "").alias("seq"))
    from pyspark.ml.fpm import PrefixSpan
    want = {tuple(x[0] for x in r["sequence"]): r["freq"] for r in PrefixSpan(minSupport=0.5).findFrequentSequentialPatterns(smoke.select(F.transform("seq", lambda x: F.array(x)).alias("sequence"))).collect()}
    assert {tuple(r["pattern"]): r["support"] for r in mining.sequences(smoke, 2).collect()} == want


def test_graph_fixture(spark):
    e = spark.createDataFrame([("e1", "e2", "DEPENDS_ON"), ("e2", "e3", "DEPENDS_ON"), ("e3", "e4", "DEPENDS_ON"), ("e1", "e3", "CONFLICTS_WITH"), ("e4", "e1", "BACK")], "src string, dst string, type string")
    v = spark.createDataFrame([(f"e{i}", "Package", f"p{i}") for i in range(1, 5)], "id string, label string, name string")
    root = spark.createDataFrame([("e1",)], "id string")
    assert rows(graph.k_hop(e.where("type = 'DEPENDS_ON'"), root, 2)) == [("e1", 0), ("e2", 1), ("e3", 2)] and len(rows(graph.k_hop(e, root, 9))) == 4
    sv, se = graph.subgraph(e, v, root, 1)
    assert sv.count() == 3 and se.count() == 2
    c = spark.createDataFrame([(0, "e1"), (0, "e3"), (1, "e1")], "grp int, id string")
    assert rows(relations.conflicts(e.where("type = 'CONFLICTS_WITH'"), c)) == [(0, "e1", ["e3"])]
    assert rows(graph.levels(e.where("type = 'DEPENDS_ON'"))) == [("e1", 3), ("e2", 2), ("e3", 1), ("e4", 0)]
    assert graph.levels(e).count() == 0  # all of it is one cycle
    assert rows(graph.neighbours(e, v, root, "DEPENDS_ON").select("src", "name")) == [("e1", "p2")] and graph.entity(v, "e2").count() == 1
    props = F.create_map(F.lit("confidence"), F.lit("1"))
    merged = graph.edges((e, "X", "src", "dst"), (e, "X", "src", "dst", props))
    assert merged.count() == 5 and merged.where("props['confidence'] = '1'").count() == 5
    statements = [r[0] for r in files.merge_statements(v, e).collect()]
    assert len(statements) == 9 and statements[0].startswith("MERGE (n:Package {id: 'e1'})")
    assert graph.graphviz(e).first()[0] == '"e1" -> "e2";'


def test_vector_fixtures(spark):
    box = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [10.0, 0.0], 1), (3, [10.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert vectors.calinski_harabasz(box).first()[0] == pytest.approx(50)
    line = spark.createDataFrame([(i, [float(x)], 0) for i, x in enumerate((0, 1, 2, 10, 11, 12, 50))], "vec_id long, embedding array<double>, label int")
    assert rows(vectors.dbscan(line, 1.0, 2)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, -1)]
    assert rows(vectors.medoids(line.where("vec_id < 3"))) == [(0, 1)]
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 4)) @ rnd.normal(size=(4, 4))
    w = vectors.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 4)
    y = np.array([r["embedding"] for r in w.orderBy("vec_id").collect()])
    u, s, _ = np.linalg.svd(np.cov(x.T))
    z = (x - x.mean(0)) @ (u / np.sqrt(s))
    assert np.allclose(np.abs(y), np.abs(z / np.linalg.norm(z, axis=1, keepdims=True)), atol=1e-6)
    images = [("x", "1", 9.0, ["a", "b"], 1.0), ("y", "1", 4.0, ["a"], 1.0), ("z", "1", 4.0, ["a", "b"], 1.0)]
    assert tuple(vectors.best_base_image(spark.createDataFrame(images, "name string, tag string, size double, packages array<string>, similarity double"), ["a", "b"]).first()) == ("z", "1", 0.2)
    layers = vectors.encoded(spark.createDataFrame([(1, "x")], "id long, text string"), lambda ts: [[[[0.0, 2.0]], [[1.0, 2.0]], [[3.0, 4.0]]] for _ in ts], "first_last_avg")
    assert layers.first()["embedding"] == [2.0, 3.0]
    assert vectors.kmeans_sweep(box, [2], 42).first()["ch"] == pytest.approx(50)


TREE = lit("DOCKER-FILE", None, lit("DOCKER-FROM", None, lit("DOCKER-IMAGE-NAME", "a")), lit("DOCKER-RUN", None, lit("BASH-SCRIPT", None, lit("UNKNOWN"))), lit("DOCKER-ENV", None, lit("DOCKER-NAME", "V"), lit("DOCKER-LITERAL", "'1'")), lit("DOCKER-WORKDIR", None, lit("DOCKER-PATH", "/srv/$V")))


def test_trees(spark):
    d = spark.createDataFrame([("x", json.dumps(TREE)), ("bad", '"text"'), ("worse", "{"), (None, None)], "file_sha string, ast string")
    got = tree.mapped_trees(d, tree._rows, tree.NODE)
    n = tree.good(got)
    assert n.count() == 11 and len(rows(tree.rejects(got).select(F.coalesce("file_sha", F.lit("")), "err"))) == 3
    assert rows(tree.holds(n, ["UNKNOWN"])) == [("x", True, False)]
    assert tree.tokens(n).first()["tokens"][:4] == ["@@DOCKER-FILE@@", "@@DOCKER-FROM@@", "@@DOCKER-IMAGE-NAME@@", "@@a@@"]
    from_root = {tuple(r["path"]) for r in tree.paths(n).where(F.size("root_ord") == 0).collect()}
    assert ("DOCKER-FILE", "DOCKER-RUN", "BASH-SCRIPT", "UNKNOWN") in from_root and len(from_root) == 5
    assert tree.paths(n).count() == sum(r["depth"] + 1 for r in n.where("leaf").collect())
    assert {r["type"] for r in tree.below_none(n, ["DOCKER-RUN"]).collect()}.isdisjoint({"BASH-SCRIPT", "UNKNOWN"})
    tags = spark.range(1).select(tree.abstract_tags(F.lit("http://a/x.tar")).alias("t")).first()["t"]
    assert {"ABS-URL-PROTOCOL-HTTP", "ABS-EXTENSION-TAR", "ABS-PROBABLY-URL"} <= set(tags) and "ABS-PATH-ABSOLUTE" not in tags
    assert rows(tree.retagged(spark.createDataFrame([("BASH-LITERAL", "http://a.b/c", True), ("X", "y", True)], "type string, value string, leaf boolean")).select("type")) == [("BASH-LITERAL-ABS-URL",), ("X",)]


def test_unparse_and_edits():
    t = lit("BASH-SCRIPT", None, lit("BASH-AND-IF", None, lit("BASH-AND-MEM", None, lit("BASH-LITERAL", "a"), lit("BASH-SINGLE-QUOTED", "b")), lit("BASH-AND-MEM", None, lit("BASH-VARIABLE", "V"))), lit("UNKNOWN"))
    assert tree.unparsed(t) == "a 'b' && ${V}"
    with pytest.raises(ValueError):
        tree.unparsed(lit("DOCKER-RUN"))
    gone = tree.edited(t, lambda n, up: ("delete", 1) if n["type"] == "BASH-VARIABLE" else ("replace", 0, lit("BASH-LITERAL", "z")) if n.get("value") == "a" else None)
    assert tree.unparsed(gone) == "z 'b'"
    deep = lit("BASH-LITERAL", "x")
    for _ in range(50):
        deep = lit("BASH-CONCAT", None, deep)
    assert tree.unparsed(deep) == "x"


def command(name, *args):
    return lit("MAYBE-SEMANTIC-COMMAND", None, lit("BASH-COMMAND-COMMAND", None, lit("BASH-LITERAL", name)), lit("BASH-COMMAND-ARGS", None, *[lit("BASH-LITERAL", a) for a in args]))


def test_command_grammar():
    flat = lambda n: [n["type"], *[flat(c) if c["children"] else c.get("value", c["type"]) for c in n["children"]]]
    assert flat(shell.parsed("apt-get", ["install", "-y", "curl"])) == ["SC-APT-GET-INSTALL", "SC-APT-GET-F-YES", ["SC-APT-GET-PACKAGES", ["SC-APT-GET-PACKAGE", "curl"]]]
    assert flat(shell.parsed("tar", ["-xzf", "a.tgz", "-C", "/opt"])) == ["SC-TAR", "SC-TAR-F-EXTRACT", "SC-TAR-F-GZIP", ["SC-TAR-FILE", "a.tgz"], ["SC-TAR-DIRECTORY", "/opt"]]
    assert flat(shell.parsed("cp", ["-r", "a", "b", "c"])) == ["SC-CP", "SC-CP-F-RECURSIVE", ["SC-CP-SOURCES", ["SC-CP-SOURCE", "a"], ["SC-CP-SOURCE", "b"]], ["SC-CP-DEST", "c"]]
    assert flat(shell.parsed("curl", ["-o", "f", "http://x"]))[1] == ["SC-CURL-OUTPUT", "f"]
    assert shell.parsed("nope", []) is None and shell.parsed("apt-get", ["dance"]) is None and shell.parsed("mkdir", ["--odd"]) is None
    got = shell.enriched(lit("BASH-SCRIPT", None, command("mkdir", "-p", "x"), command("nope", "y")))
    assert [c["type"] for c in got["children"]] == ["SC-MKDIR", "UNKNOWN"]


def test_variables_folding_splitting():
    s = shell.substituted(TREE)
    assert s["children"][3]["children"][0]["value"] == "/srv/1"
    assert shell.substituted(lit("BASH-VARIABLE", "no")) == lit("BASH-VARIABLE-VALUE", "$no")
    f = shell.folded(lit("X", None, lit("BASH-CONCAT", None, lit("BASH-LITERAL", "2"), lit("BASH-LITERAL", "+3")), lit("BASH-CONCAT", None, lit("BASH-LITERAL", "a"), lit("BASH-LITERAL", "b"))))
    assert [c["value"] for c in f["children"]] == ["5", "ab"]
    run = lit("DOCKER-RUN", None, lit("BASH-SCRIPT", None, lit("BASH-AND-IF", None, lit("BASH-AND-MEM", None, lit("A")), lit("BASH-AND-MEM", None, lit("B"))), lit("C")))
    assert [c["children"][0]["children"][0]["type"] for c in shell.split_runs(lit("DOCKER-FILE", None, run))["children"]] == ["A", "B", "C"]
    assert shell.folded(lit("SC-APK-PACKAGE", None, lit("BASH-LITERAL", ".deps")))["type"] == "SC-APK-VIRTUAL:.deps"


def test_dependency_inference(spark):
    """Trees of the built-in grammar through the relational operators, barriers by the grammar's names."""
    from drydock.operators import buildgraph
    from drydock.sources import rules
    run = lambda *c: lit("DOCKER-RUN", None, lit("BASH-SCRIPT", None, *c))
    sc = lambda name, *args: shell.parsed(name, list(args))
    copy = lambda kind, src, dst, *more: lit(kind, None, lit(f"{kind}-SOURCE", None, lit("DOCKER-PATH", src)), lit(f"{kind}-TARGET", None, lit("DOCKER-PATH", dst)), *more)
    t = lit("DOCKER-FILE", None, lit("DOCKER-FROM", None, lit("DOCKER-IMAGE-NAME", "a"), lit("DOCKER-IMAGE-ALIAS", "build")), run(sc("apt-get", "install", "-y", "curl")), run(sc("curl", "-o", "f.tar", "http://x/f")), run(sc("tar", "-xf", "f.tar", "-C", "out")),
            run(lit("UNKNOWN")), lit("DOCKER-FROM", None, lit("DOCKER-IMAGE-NAME", "b")), copy("DOCKER-COPY", "out", "/srv", lit("DOCKER-COPY-FROM", "build")), lit("DOCKER-CMD"))
    own = [("curl", ["SC-CURL"], False, False, ["SC-CURL-URLS"], ["SC-CURL-OUTPUT"], []), ("tar", ["SC-TAR"], False, False, ["SC-TAR-FILE"], ["SC-TAR-DIRECTORY"], [])]
    docs = spark.createDataFrame([("x", json.dumps(t))], "file_sha string, ast string")
    table = buildgraph.dependency_table(tree.nodes(docs), rules.install_rules(spark), rules.file_rules(spark, own), rules.grammar_names(spark, shell.GRAMMAR), strict=True)
    r = table.orderBy("cmdid").collect()
    assert [x["cmd_dep"] for x in r] == [[], [0], [0, 1], [0, 2], [3], [], [4, 5], [5]]
    assert r[1]["install_pkg"] == ["curl"] and r[2]["used_pkg"] == ["curl"] and r[2]["file_relate"]["target"] == ["./f.tar"]
    assert r[3]["file_relate"] == (["./f.tar"], ["./out"]) and [x["cmdid"] for x in r] == list(range(8))


def test_refactoring(spark):
    col = lambda c: spark.range(1).select(c).first()[0]
    assert col(refactor.unified(F.lit("RUN"), F.lit("apt install vim && wget U -O F && chmod 644 f"))) == "apt-get install -y vim && curl -L U -o F && chmod 755 f"
    assert col(refactor.unified(F.lit("COPY"), F.lit("apt install vim"))) == "apt install vim"
    standards = {"curl": {"preferred_name": "curl", "parameter_order": ["-L", "-o"]}}
    assert col(refactor.unified(F.lit("RUN"), F.lit("curl x -o f -L y -o"), standards)) == "curl -L -o x f y -o"
    d = spark.createDataFrame([(1, "# c\nFROM a:1\nRUN apt-get install vim\nRUN x\nCMD y"), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in refactor.refactored(d, base_images=spark.createDataFrame([(1, "b:2")], "doc_id long, name string")).collect()}
    assert out == {1: "FROM b:2\nRUN apt-get install -y vim && x && rm -rf /var/lib/apt/lists/*\nCMD y", 2: None, 3: ""}
    lint = refactor.lint_repaired(spark.createDataFrame([(1, "WORKDIR a\nADD b c"), (2, "WORKDIR a")], "doc_id long, text string"), spark.createDataFrame([(1, "x DL3000 m"), (1, "DL3020 n")], "doc_id long, message string"))
    assert rows(lint) == [(1, "WORKDIR /a\nCOPY b c"), (2, "WORKDIR a")]
    assert rows(refactor.entities(d.where("doc_id = 1"))) == [(1, ["image:a", "package:vim"])]
    assert relations.first_base_image(refactor.instructions(d)).first()["base_image"] == "a:1"
    f = refactor.features(d).where("doc_id = 1").first()
    assert (f["keywords"], f["n"], f["packages"]) == (["FROM", "RUN", "RUN", "CMD"], 4, ["vim"])
    shares = refactor.shares(refactor.instructions(d), 0.5)
    assert shares.count() == 4
    cand = spark.createDataFrame([(1, 0, ["a"], ["x"]), (1, 1, ["a", "b"], None)], "grp int, pos int, entities array<string>, conflicts array<string>")
    assert rows(refactor.ranked(cand).select("rank", "pos", "score")) == [(1, 1, 2), (2, 0, -1)]
    comp = spark.createDataFrame([(1, '["a", "b"]'), (2, "a\n\nb\n\n")], "doc_id long, completion string")
    assert rows(refactor.candidates(comp)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b")]
    ctx = refactor.contexts(d.na.fill(""), spark.createDataFrame([("vim", "hint")], "keyword string, context string"))
    p = refactor.prompts(d.where("doc_id = 1"), ctx, spark.createDataFrame([(1, "k")], "doc_id long, knowledge string")).first()["prompt"]
    assert p.startswith("Requirement:\n") and p.endswith("Knowledge:\nk\n\nHints:\nhint")
    assert refactor.completed(refactor.prompts(d, ctx, spark.createDataFrame([], "doc_id long, knowledge string")), lambda ps: ["ok"] * len(ps)).count() == 3
    fixed = refactor.build_repaired(d.where("doc_id = 1"), lambda t: (False, "log"), lambda t, log: log)
    assert fixed.first()["text"] == "log"


def test_corpus(spark):
    d = spark.createDataFrame([(1, "a b a", "s"), (2, None, "s"), (3, "c d e f", None), (4, "x y z", "s")], "doc_id long, text string, source string")
    assert rows(corpus.vocabulary(d, 2)) == [("a", 2), ("b", 1)]
    assert {(r["source"], r["chunk"], *r["items"]) for r in corpus.chunks(d, 2).collect()} == {("s", 0, "a", "b"), ("s", 1, "a", "x"), ("s", 2, "y", "z"), (None, 0, "c", "d"), (None, 1, "e", "f")}
    assert spark.range(1).select(corpus.fitted(F.array(F.lit("a")), 3)).first()[0] == ["a", "<pad>", "<pad>"]
    assert rows(corpus.lines(spark.createDataFrame([(1, "a\n \nb")], "doc_id long, text string"))) == [(1, 0, "a"), (1, 2, "b")]
    assert corpus.split(d).count() == corpus.shuffled(d).count() == 4 and corpus.capped(d, 2).count() == 2
    v = corpus.word_vectors(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, tokens array<string>"), size=3)
    got = {r["id"]: r["vector"] for r in v.collect()}
    assert len(got[1]) == 3 and got[2] is None
    m = corpus.merges(spark.createDataFrame([("abab",), ("ab",)], "word string"), 2).orderBy("rank").collect()
    assert [(r["a"], r["b"], r["n"]) for r in m] == [("a", "b", 3), ("ab", "ab", 1)]
    h = corpus.hand_features(spark.createDataFrame([(1, "FROM a\nRUN install x y")], "doc_id long, text string"), size=4).first()["features"]
    assert len(h) == 9 and h[4] == 1.0


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "é")], "k long, v string")
    files.write_jsonl(d.repartition(2), str(tmp_path / "x"), xz=True)
    got = files.read_jsonl(spark, str(tmp_path / "x" / "*.xz"), "k long, v string")
    assert rows(got) == [(1, "a"), (2, "é")]
    files.write_jsonl(d, str(tmp_path / "p"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "p"), "k long, v string")) == [(1, "a"), (2, "é")]
    with lzma.open(tmp_path / "y.jsonl.xz", "wt") as f:
        f.write('{"k": 5}\n\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "y.jsonl.xz"), "k long")) == [(5,)]
    (tmp_path / "m.json").write_text('{"ubuntu": {"used": ["a"]}, "b": 1}')
    assert rows(files.read_json_map(spark, str(tmp_path / "m.json"))) == [("b", "1"), ("ubuntu", '{"used":["a"]}')]
    book = {"a1": {"results": [{"n": 1}], "next": "a2"}, "a2": {"results": [{"n": 2}], "next": None}, "b1": {"results": [{"n": 3}], "next": "gone"}}
    pages = files.read_pages(spark, ["a", "b", "c"], lambda u: book[u], lambda n: n + "1").collect()
    assert sorted((r["name"], r["page"], r["error"] is None) for r in pages) == [("a", 0, True), ("a", 1, True), ("b", 0, True), ("b", 1, False), ("c", 0, False)]
    qa = spark.createDataFrame([(1, "t", "x"), (2, "t", "y"), (3, "u", " "), (4, "t", "")], "seq long, title string, answer string")
    assert rows(files.question_pairs(qa)) == [("t", "y")]
    man = spark.createDataFrame([("i", "t1", [("arm", 1, "d"), ("amd64", 2, "e")]), ("i", "t2", [("arm", 1, "d")])], "image string, name string, images array<struct<architecture:string,size:long,digest:string>>")
    assert rows(files.manifests(man)) == [("i:t1", 2, "e")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "rm.yml").write_text("command:\n  prefix: SC-RM\n  providerFor: [rm]\n  scenarios:\n    - cmd: $0 [paths...]\n      name: SC-RM\n      options:\n        booleans: ['-r, --recursive']\n")
    g = files.read_grammar(spark, str(tmp_path / "g"))
    assert shell.parsed("rm", ["-r", "x"], files.grammar_of(g.collect()))["children"][0]["type"] == "SC-RM-F-RECURSIVE"
    v = spark.createDataFrame([(1, [1.0, 2.0]), (0, [3.0, 4.0])], "vec_id long, embedding array<double>")
    files.write_npy(v, str(tmp_path / "v.npy"))
    assert rows(files.read_npy(spark, str(tmp_path / "v.npy"))) == [(0, [3.0, 4.0]), (1, [1.0, 2.0])]
    files.write_lines(spark.createDataFrame([("a, b",)], "value string"), str(tmp_path / "t"))
    assert rows(files.read_names(spark, str(tmp_path / "t"))) == [("a",), ("b",)] and files.read_lines(spark, str(tmp_path / "t")).count() == 1
    assert rows(files.transformed_lines(spark.createDataFrame([("a",), ("b",)], "value string"), lambda x: x.upper() if x == "a" else None)) == [("A",)]
    for _ in range(2):
        files.append_metrics(spark.createDataFrame([(2, 0.5)], "k int, ch double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert "<polyline" in open(files.write_chart(spark.createDataFrame([(1.0,), (2.0,)], "dist double"), str(tmp_path / "c.svg"))).read()
    assert files.read_dataset(spark, str(tmp_path / "p"), "json").where("part IN ('train', 'validation')").count() == 2
    files.write_graph(d, d, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).count() == 2


def test_pattern_store_and_stream(spark, tmp_path):
    store = incremental.PatternStore(spark, str(tmp_path / "s"))
    batch = lambda *xs: spark.createDataFrame([(x,) for x in xs], "items array<string>")
    store.upsert(mining.singletons(batch(["A", "B", "C"], ["A", "C"], ["B", "C"]), 2), 1)
    store.upsert(mining.singletons(batch(["C", "C", "D"]), 2), 2)
    store.upsert(mining.singletons(batch(["C", "C", "D"]), 2), 2)  # the same batch again
    assert rows(store.scan()) == [("A", 2), ("B", 2), ("C", 5)]
    assert rows(mining.added(store.scan(), spark.createDataFrame([("A", 1)], "pattern string, support long"))) == [("A", 3), ("B", 2), ("C", 5)]
    one = spark.createDataFrame([("k", 1, "old"), ("l", 1, "x")], "k string, seq int, v string")
    assert rows(relations.upsert(one, spark.createDataFrame([("k", 2, "new")], "k string, seq int, v string"), "k", "seq")) == [("k", 2, "new"), ("l", 1, "x")]
    assert incremental.appended(one, str(tmp_path / "c"), lambda d: d.count()) == 2 and incremental.appended(one, str(tmp_path / "c"), lambda d: d.count()) == 4


def test_chunks_of_null_and_repeated_ids(spark):
    """Every token of a group lands in its block, whatever the ids; the order is nulls, then ids, then the table's."""
    docs = [(None, "a b c"), (7, "d"), (None, None), (7, "e f g h i j k"), (3, "l m"), (9, "")]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs] + [(1, "x y", None)], "doc_id long, text string, source string").coalesce(1)
    got = {(r["source"], r["chunk"]): r["items"] for r in corpus.chunks(d, 3).collect()}
    assert got == {("s", 0): list("abc"), ("s", 1): list("lmd"), ("s", 2): list("efg"), ("s", 3): list("hij")}
    wide = spark.range(500).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 5) AS text", "if(id % 3 = 0, 'a', 'b') AS source").repartition(6)
    blocks = {(r["source"], r["chunk"]): r["items"] for r in corpus.chunks(wide, 7).collect()}
    for s, ids in (("a", range(0, 500, 3)), ("b", [i for i in range(500) if i % 3])):
        t = [f"w{i}" for i in ids for _ in range(5)]
        assert [blocks[s, c] for c in range(len(t) // 7)] == [t[7 * c:7 * c + 7] for c in range(len(t) // 7)]


def test_running_sums(spark):
    from drydock.functions.prefix import running_sums
    data = [(g, i, (i * 7) % 5) for g, n in (("hot", 300), ("b", 3), (None, 4)) for i in range(n)]
    got = running_sums(spark.createDataFrame(data, "g string, i long, n long").repartition(5), ["g"], ["i"], "n").collect()
    assert len(got) == len(data) and all(r["before"] == sum(n for g, i, n in data if g == r["g"] and i < r["i"]) for r in got)


def test_nothing_is_cut(spark):
    """More than 10,000 words, long patterns, a chain of levels, commands within commands."""
    d = spark.createDataFrame([("RUN", "echo " + "w " * 10_050)], "k string, c string").select(refactor.unified(F.col("k"), F.col("c"), {"echo": {"preferred_name": "print"}}).alias("c"))
    assert len(d.first()["c"].split()) == 10_051
    db = spark.createDataFrame([(i, list(range(11))) for i in range(2)], "seq_id long, seq array<int>")
    longest = mining.sequences(db, 2)
    assert longest.count() == 2**11 - 1 and longest.agg(F.max(F.size("pattern"))).first()[0] == 11
    assert mining.sequences(db, 2, 2).count() == 11 + 55
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    assert graph.levels(e).agg(F.max("level")).first()[0] == 12
    files_ = [(1, "FROM a\nRUN x && y"), (1, "FROM b\nRUN z"), (None, "RUN q"), (2, "# no")]
    got = refactor.refactored(spark.createDataFrame(files_, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "FROM a\nRUN x && y"), (1, "FROM b\nRUN z"), (None, "RUN q"), (2, "# no")]))


def test_shares_of_a_null_type(spark):
    i = spark.createDataFrame([("RUN", "a"), ("RUN", "a"), ("RUN", "b"), (None, "c")], "type string, content string")
    assert {(r["type"], r["content"], round(r["share"], 3)) for r in refactor.shares(i).collect()} == {("RUN", "a", 0.667), ("RUN", "b", 0.333), (None, "c", 1.0)}


def test_scenarios_keep_what_they_must_have(spark, tmp_path):
    (tmp_path / "x.yml").write_text("command:\n  prefix: SC-X\n  providerFor: [x]\n  scenarios:\n    - cmd: $0 [paths...]\n      name: SC-X-ALL\n      mustHave: ['-a, --all']\n      options:\n        booleans: ['-a, --all']\n    - cmd: $0 [paths...]\n      name: SC-X\n      options:\n        booleans: ['-b']\n")
    g = files.grammar_of(files.read_grammar(spark, str(tmp_path)).collect())
    assert [shell.parsed("x", a, g)["type"] for a in (["p"], ["-a", "p"], ["--all", "p"], ["-b", "p"])] == ["SC-X", "SC-X-ALL", "SC-X-ALL", "SC-X"]
    assert shell.parsed("x", ["-a", "-b", "p"], g) is None


def test_written_lines_replace_older_ones(spark, tmp_path):
    at = str(tmp_path / "x")
    files.write_jsonl(spark.range(8).repartition(4), at, xz=True)
    files.write_jsonl(spark.range(1), at, xz=True)
    assert files.read_jsonl(spark, at + "/*.xz", "id long").count() == 1


def test_annotations_and_detectors(spark):
    """Kept nodes and what stands below them have no abstractions; flags of whole subtrees."""
    t = lit("DOCKER-FILE", None, lit("DOCKER-PORT", "/80", lit("X", "/var")), lit("SC-APK-VIRTUAL", None, lit("X", "/a")), lit("X", "/var", lit("Y", "true")), lit("BASH-CONCAT", None, lit("BASH-LITERAL", "a"), lit("BASH-CONCAT", None, lit("BASH-VARIABLE-VALUE", "b"))), lit("BASH-CONCAT", None, lit("BASH-DOLLAR-PARENS", None, lit("BASH-LITERAL", "c"))))
    n = tree.nodes(spark.createDataFrame([("f", json.dumps(t))], "file_sha string, ast string"))
    tags = {tuple(r["ord"]): r["abs_type"] for r in tree.annotated(n).collect()}
    assert tags[(0,)] is None and tags[(0, 0)] is None and tags[(1, 0)] is None and "ABS-PATH-VAR" in tags[(2,)] and "ABS-TRUE" in tags[(2, 0)] and tags[()] is None
    got = {tuple(r["ord"]): (r["c"], r["d"]) for r in n.withColumn("c", tree.constant()).withColumn("d", tree.subtree_holds(F.col("type") == "BASH-DOLLAR-PARENS")).collect()}
    assert got[(3,)] == (True, False) and got[(3, 1)] == (True, False) and got[(4,)] == (False, True) and got[(4, 0, 0)] == (True, False) and got[()] == (False, True)


def test_arrays_of_many_tasks(spark, tmp_path):
    """Rows land by the rank of their id, whichever task writes them; repeated ids stand beside each other."""
    d = spark.range(500).selectExpr("(id * 7919) % 500 AS vec_id", "array(double((id * 7919) % 500), 0.5D, -1D) AS embedding").repartition(6)
    files.write_npy(d.unionByName(d.where("vec_id = 3")), str(tmp_path / "v.npy"))
    m = np.load(tmp_path / "v.npy")
    assert m.shape == (501, 3) and m[:, 0].tolist() == sorted([*range(500), 3]) and (m[:, 2] == -1).all()
    files.write_npy(d.limit(0), str(tmp_path / "n.npy"))
    assert np.load(tmp_path / "n.npy").shape == (0, 0)
    with pytest.raises(ValueError):
        files.write_npy(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), str(tmp_path / "x.npy"))


def test_sequences_of_two_batches(spark):
    """The two batches of the fixture and their additive upsert."""
    db = lambda data: spark.createDataFrame(list(enumerate(data)), "seq_id long, seq array<int>")
    of = lambda d: {"-".join(map(str, r["pattern"])): r["support"] for r in d.collect()}
    first, second = mining.sequences(db([[1, 2, 3], [1, 3, 4, 5], [1, 2, 4], [2, 3, 5]]), 2), mining.sequences(db([[1, 2, 5], [1, 3], [2, 4, 5]]), 2)
    assert of(first) == {"1": 3, "1-2": 2, "1-3": 2, "1-4": 2, "2": 3, "2-3": 2, "3": 3, "3-5": 2, "4": 2, "5": 2} and of(second) == {"1": 2, "2": 2, "2-5": 2, "5": 2}
    assert of(mining.added(first, second)) == {"1": 5, "1-2": 2, "1-3": 2, "1-4": 2, "2": 5, "2-3": 2, "2-5": 2, "3": 3, "3-5": 2, "4": 2, "5": 4}
