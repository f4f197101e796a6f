"""Rules, stages, barriers and variables of build files on fixtures with results worked out by hand."""
import json
import sys

import pytest
from pyspark.sql import functions as F

from drydock.operators import buildgraph, symbols, tree
from drydock.sources import rules

from .test_operators import lit

L = lambda v: lit("BASH-LITERAL", v)
RUN = lambda *c: lit("DOCKER-RUN", None, lit("BASH-SCRIPT", None, *c)) if c else lit("DOCKER-RUN")
FROM = lambda alias=None: lit("DOCKER-FROM", None, lit("DOCKER-IMAGE-NAME", "i"), *([lit("DOCKER-IMAGE-ALIAS", alias)] if alias else []))
PART = lambda kind, *v: lit(kind, None, *map(L, v))
MANY = lambda kind, *v: lit(kind + "S", None, *[PART(kind, x) for x in v])
APT = lambda *p: RUN(lit("SC-APT-GET-INSTALL", None, MANY("SC-APT-GET-PACKAGE", *p)))
COPY = lambda *s, to="/t", stage=None, kind="DOCKER-PATH": lit("DOCKER-COPY", None, *[lit("DOCKER-COPY-SOURCE", None, lit(kind, x)) for x in s], lit("DOCKER-COPY-TARGET", None, lit("DOCKER-PATH", to)), *([lit("DOCKER-FLAG-FROM", stage)] if stage else []))
WORKDIR = lambda d: lit("DOCKER-WORKDIR", None, lit("DOCKER-PATH", d))
NAMES = [("set", "SC-SET", "SC-SET"), ("setx", "SC-SET", "SC-SET"), ("chmod", "SC-CHMOD", "SC-CHMOD"), ("curl", "SC-CURL", "SC-CURL"), ("tar", "SC-TAR", "SC-TAR"), ("odd", "SC-OTHER", "SC-TAR")]


def nodes(spark, **files):
    rows = [(k, json.dumps(lit("DOCKER-FILE", None, *v))) for k, v in files.items()]
    return tree.nodes(spark.createDataFrame(rows, "file_sha string, ast string"))


PATH = "/usr/local/bin/rabbitmqadmin"
CURL = lit("SC-CURL", None, PART("SC-CURL-URL", "http://x/y.git"))
MKDIR, TAR = (lambda d: RUN(lit("SC-MKDIR", None, MANY("SC-MKDIR-PATH", d)))), (lambda f: RUN(lit("SC-TAR", None, PART("SC-TAR-FILE", f))))
FILES = {
    "sample": [FROM(), RUN(lit("UNKNOWN")), RUN(lit("SC-SET", None, lit("SC-SET-F-E"))), RUN(lit("BASH-REDIRECT", None, lit("BASH-REDIRECT-OVERWRITE", None, lit("BASH-PATH", None, L(PATH))))), RUN(lit("BASH-CONDITION", None, lit("BASH-OP", "SingleBracket"), L(PATH))), RUN(lit("SC-CHMOD", None, PART("SC-CHMOD-MODE", "+x"), MANY("SC-CHMOD-PATH", PATH))), RUN(lit("UNKNOWN")), lit("DOCKER-EXPOSE", None, lit("DOCKER-PORT", "1"))],
    "copied": [FROM(), COPY("app.tar", to="app.tar"), TAR("app.tar")],
    "placed": [FROM(), WORKDIR("/w"), COPY("x", "y", to="/d"), RUN(L("x")), COPY("http://h/z.tgz", to="z", kind="DOCKER-URL")],
    "installs": [FROM(), APT("curl"), RUN(lit("SC-APT-GET-INSTALL", None, MANY("SC-APT-GET-PACKAGE", "curl")), lit("SC-APT-GET-UPDATE")), RUN(CURL), RUN(), RUN(CURL)],
    "barriers": [RUN(), FROM(), RUN(), MKDIR("a"), MKDIR("b"), TAR("a"), RUN(), TAR("b"), RUN(), FROM(), RUN()],
    "stages": [FROM("one"), MKDIR("/o"), FROM("two"), lit("DOCKER-ENV"), FROM("one"), COPY("./o", stage="one"), COPY("/n", stage="two"), COPY("/n", stage="three"), COPY("/n", stage="one")],
    "unknown": [FROM(), RUN(lit("UNKNOWN")), RUN(lit("SC-FOO")), APT("curl"), RUN(lit("BASH-UNDEFINE-COMMAND", "x")), TAR("q")],
}


@pytest.fixture(scope="module")
def table(spark):
    """file -> its rows, by the literal rule; `unknown!` by the strict one."""
    names = spark.createDataFrame(NAMES, "command string, prefix string, name string")
    of = lambda n, strict: buildgraph.dependency_table(n, rules.install_rules(spark), rules.file_rules(spark), names, strict)
    rows = of(nodes(spark, **FILES), False).collect() + of(nodes(spark, **{"unknown!": FILES["unknown"]}), True).collect()
    return {f: [tuple(r) for r in sorted(rows, key=lambda r: r["cmdid"]) if r["file_sha"] == f] for f in [*FILES, "unknown!"]}


def deps(table, file):
    return [r[3] for r in table[file]]


def test_sample_instruction_table(table):
    """A RUN that is UNKNOWN rests on its base, paths chain, several commands share a node type."""
    t = table["sample"]
    assert deps(table, "sample") == [[], [0], [0], [0], [0, 3], [0, 4], [0], [0]]
    assert t[2][5] == ["set", "setx"] and t[5][5] == ["chmod"] and t[5][6] == (["./+x", "." + PATH], ["./+x", "." + PATH])
    assert [r[1] for r in t] == list(range(8)) and t[0][6] == ([], [])


def test_copied_files_are_found_by_runs(table):
    """COPY targets stand below the working directory, as the paths of RUNs do."""
    assert deps(table, "copied") == [[], [0], [0, 1]]
    assert deps(table, "placed") == [[], [0], [0], [0, 2], [0]] and [r[6][1] for r in table["placed"]] == [[], ["/w"], ["/w/x", "/w/y"], ["/w/x"], ["/w/z"]]


def test_installs_count_before_uses(table):
    """What a RUN installs itself is its own; an install before the base is out of reach."""
    assert deps(table, "installs") == [[], [0], [0, 1], [0, 2], [3], [4]] and table["installs"][3][6] == (["./http:/x/y.git"], ["./y"])


def test_barriers(table):
    """A RUN of nothing rests on all since its base that nothing rests on; it is the base of what follows."""
    assert deps(table, "barriers") == [[], [], [1], [2], [2], [2, 3], [4, 5], [6], [7], [], [9]]
    assert deps(table, "unknown!") == [[], [0], [1], [2], [3], [3]]


def test_copies_from_stages(table):
    """The last maker since the stage began, else the stage's last instruction; aliases of later stages do not exist yet."""
    assert deps(table, "stages")[5:] == [[1, 4], [3, 4], [4], [1, 4]]


def test_rules_are_rows(spark):
    """First rule of a type wins, prefixes must fit, commands within commands do not count, concatenations."""
    inner = lit("SC-APT-GET-INSTALL", None, MANY("SC-APT-GET-PACKAGE", "deep"))
    n = nodes(spark, f=[RUN(lit("SC-PIP-INSTALL", None, lit("SC-PIP-TARGETS", None, lit("X", None, lit("BASH-CONCAT", None, L("a"), lit("BASH-CONCAT", None, L("b"), lit("BASH-VARIABLE", "V")), lit("Y", "c", L("no")))), inner))), RUN(lit("SC-TAR")), RUN(lit("BASH-UNDEFINE-COMMAND", "get", L("install"), L("-y"), L("p")), lit("BASH-UNDEFINE-COMMAND", "x", L("q"))), lit("DOCKER-CMD", None, inner)])
    assert sorted(tuple(r) for r in buildgraph.installed(n, rules.install_rules(spark)).collect()) == [("f", 0, "ab$Vc"), ("f", 0, "deep"), ("f", 2, "p")]
    names = spark.createDataFrame(NAMES, "command string, prefix string, name string")
    assert sorted(tuple(r) for r in buildgraph.used(n, names).collect()) == [("f", 1, "tar"), ("f", 2, "get"), ("f", 2, "x")]
    two = rules.file_rules(spark, [("a", ["T"], True, True, [], [], ["P"]), ("b", ["T"], False, False, ["P"], [], [])])
    assert [r["multi"] for r in two.collect()] == [True]
    got = buildgraph.touched(nodes(spark, f=[RUN(lit("T", None, PART("P", "x", "y"), PART("P", "z")), lit("Q", None, lit("T", None, PART("P", "only"))))]), two).collect()
    assert [(r["source"], r["target"]) for r in got] == [(["x", "y"], ["z", "only"])]


def test_covered(spark):
    """Below a flagged node, by one window: nested flags, siblings, the root."""
    n = nodes(spark, f=[lit("A", None, lit("B", None, lit("A")), lit("C")), lit("C", None, lit("D"))])
    of = lambda flag: {tuple(r["ord"]) for r in n.withColumn("in", buildgraph.covered(flag)).where("in").collect()}
    assert of(F.col("type") == "A") == {(0, 0), (0, 0, 0), (0, 1)} and of(F.col("depth") == 0) == {(0,), (0, 0), (0, 0, 0), (0, 1), (1,), (1, 0)} and of(F.col("type") == "Z") == set()


V = lambda n: lit("BASH-VARIABLE", n)
ENV = lambda n, *v: lit("DOCKER-ENV", None, lit("DOCKER-NAME", n), *[lit("DOCKER-LITERAL", x) for x in v])
SET = lambda n, *v: lit("BASH-ASSIGN", None, PART("LHS", n), lit("RHS", None, *v))


def values(spark, *children):
    s = symbols.substituted(nodes(spark, f=children)).where("value IS NOT NULL").orderBy("ord")
    return [(r["type"], r["value"]) for r in s.collect() if r["type"] in ("BASH-LITERAL", "BASH-VARIABLE-VALUE", "DOCKER-PATH", "DOCKER-LITERAL")]


def test_variables_in_order(spark):
    """A use before its definition stays unbound; definitions use those before; later ones win."""
    got = values(spark, RUN(V("A")), ENV("A", ' "1" '), ENV("B", "x${A}$A/z"), RUN(SET("A", lit("BASH-CONCAT", None, V("A"), L("-"), V("B"), V("NO")))), RUN(V("A")), ENV("E"), RUN(V("E")), WORKDIR("${A}|$B$NO|${NOPE}-z$"))
    a = "1-x11/z$NO"
    assert got == [("BASH-VARIABLE-VALUE", "$A"), ("DOCKER-LITERAL", ' "1" '), ("DOCKER-LITERAL", "x11/z"), ("BASH-LITERAL", "A"), ("BASH-LITERAL", "1"), ("BASH-LITERAL", "-"), ("BASH-LITERAL", "x11/z"), ("BASH-VARIABLE-VALUE", "$NO"), ("BASH-LITERAL", a), ("BASH-LITERAL", "UNDEFINE"), ("DOCKER-PATH", f"{a}|x11/z$NO|${{NOPE}}-z$")]


def test_variables_of_nested_definitions(spark):
    """An inner definition that ends where the outer one does holds first; files do not share names."""
    n = nodes(spark, f=[RUN(SET("A", L("1"), lit("SUB", None, SET("B", V("A"), L("2"))))), RUN(V("A"), V("B"))], g=[RUN(V("A"))])
    got = {(r["file_sha"], r["value"]) for r in symbols.substituted(n).where("depth = 3 AND type <> 'BASH-ASSIGN'").collect()}
    assert {v for f, v in got if f == "g"} == {"$A"}
    names = [(r["name"], r["value"]) for r in symbols.symbol_table(n).orderBy("at").collect()]
    assert [x[0] for x in names] == ["B", "A"] and names[0][1] == "$A2"


@pytest.mark.parametrize("text,env,want", [("${V}", {"V": "1"}, "1"), ("$A/x", {"A": "p"}, "p/x"), ("${NOPE}-z", {}, "${NOPE}-z"), ("$A$B", {"A": "1", "B": "2"}, "12"), ("$AB", {"A": "1"}, "$AB"), ("$A", {"A": "$1\\$B", "B": "no"}, "$1\\$B"), ("", {}, ""), ("a$", {}, "a$")])
def test_put_in(spark, text, env, want):
    d = spark.createDataFrame([(text, env)], "t string, e map<string,string>")
    assert d.select(symbols.put_in(F.col("t"), F.col("e"))).first()[0] == want


def test_deep_trees(spark):
    """A use 1,200 levels down."""
    deep, limit = V("A"), sys.getrecursionlimit()
    for _ in range(1200):
        deep = lit("D", None, deep)
    sys.setrecursionlimit(20_000)
    try:
        n = nodes(spark, f=[ENV("A", "7"), deep])
    finally:
        sys.setrecursionlimit(limit)
    assert [r["value"] for r in symbols.substituted(n).where("depth > 1000 AND value IS NOT NULL").collect()] == ["7"]


def test_nothing(spark):
    none = tree.nodes(spark.createDataFrame([], "file_sha string, ast string"))
    assert symbols.substituted(none).isEmpty()
    assert buildgraph.staged(none).isEmpty()
