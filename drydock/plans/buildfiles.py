"""Queries that make build files of the driver's tables and run the build-file operators on them.

Each row becomes an instruction whose kind and names hang on its values, so the oracles work from the
tables by other means: windows and joins in SQL.
"""
from pyspark.sql import functions as F

from drydock.functions.storage import cut, parted
from drydock.operators import buildgraph, symbols, tree
from drydock.plans.registered import query
from drydock.sources import rules


def _node(kind, *children, value=None):
    """Column of the JSON of a node; children and value are columns or texts."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = [F.lit('{"type":"' + kind + '"')]
    parts += [F.lit(',"value":'), F.to_json(F.struct(text(value).alias("v")))] if value is not None else []
    # of {"v":"..."} the value alone
    parts = [F.substr(p, F.lit(6), F.length(p) - 6) if i == 2 else p for i, p in enumerate(parts)]
    return F.concat(*parts, F.lit(',"children":['), *([F.concat_ws(",", *map(text, children))] if children else []), F.lit("]}"))


def _literal(value):
    return _node("BASH-LITERAL", value=value)


def _run(*commands):
    return _node("DOCKER-RUN", _node("BASH-SCRIPT", *commands))


def _listed(kind, *values):
    """A list node `kind`S with an item for each value."""
    return _node(kind + "S", *[_node(kind, _literal(v)) for v in values])


def _files(rows, file, order, instruction):
    """docs(file_sha, ast): the instructions of each file, in order."""
    each = F.sort_array(F.collect_list(F.struct(*order, instruction.alias("json"))))
    body = F.array_join(F.transform(each, lambda x: x["json"]), ",")
    return rows.groupBy(F.col(file).cast("string").alias("file_sha")).agg(F.concat(F.lit('{"type":"DOCKER-FILE","children":['), body, F.lit("]}")).alias("ast"))


def _names(spark):
    return spark.createDataFrame([("apt-get", "SC-APT-GET", "SC-APT-GET-INSTALL"), ("apt", "SC-APT-GET", "SC-APT-GET-INSTALL"), ("pip", "SC-PIP", "SC-PIP-INSTALL"), ("tar", "SC-TAR", "SC-TAR"), ("mkdir", "SC-MKDIR", "SC-MKDIR"), ("git", "SC-GIT", "SC-GIT-CLONE")], "command string, prefix string, name string")


def _deps(docs, spark):
    t = buildgraph.dependency_table(tree.numbered(docs), rules.install_rules(spark), rules.file_rules(spark), _names(spark))
    return t.select("file_sha", "cmdid", F.array_join(F.col("cmd_dep").cast("array<string>"), ",").alias("cmd_dep"))


@query("""WITH e AS (SELECT user_id AS u, event_type AS t, event_id % 7 AS k, event_id % 2 AS odd, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS i FROM events),
b AS (SELECT *, CASE WHEN t = 'signup' THEN i ELSE coalesce(max(CASE WHEN t IN ('signup', 'purchase') THEN i END) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS base,
  max(CASE WHEN t = 'view' THEN i END) OVER w AS view, max(CASE WHEN t = 'error' THEN i END) OVER w AS error FROM e WINDOW w AS (PARTITION BY u, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT u, i, base AS dep FROM b WHERE t NOT IN ('signup', 'purchase') UNION SELECT u, i, greatest(view, base) FROM b WHERE t IN ('view', 'click') UNION SELECT u, i, greatest(error, base) FROM b WHERE t = 'error' AND odd = 1),
o AS (SELECT * FROM d WHERE dep <> i),
n AS (SELECT u, dep, min(i) AS needed FROM o GROUP BY u, dep),
s AS (SELECT b.u, b.i, CASE WHEN t IN ('signup', 'purchase') THEN b.i ELSE base END AS seg, needed FROM b LEFT JOIN n ON n.u = b.u AND n.dep = b.i),
a AS (SELECT u, i, dep FROM o UNION ALL SELECT b.u, b.i, s.i FROM b JOIN s ON s.u = b.u AND s.seg = b.base AND s.i < b.i AND (needed IS NULL OR needed >= b.i) WHERE b.t = 'purchase')
SELECT b.u::VARCHAR AS file_sha, b.i AS cmdid, coalesce(string_agg(a.dep::VARCHAR, ',' ORDER BY a.dep), '') AS cmd_dep FROM b LEFT JOIN a ON a.u = b.u AND a.i = b.i GROUP BY b.u, b.i""")
def dependency_table(t, spark):
    """Each user's events as a build file: FROM, RUNs that install, call, make or read, and RUNs of no content."""
    k = (F.col("event_id") % 7).cast("string")
    pkg, path = F.concat(F.lit("p"), k), F.concat(F.lit("d"), k)
    of = F.when(F.col("event_type") == "signup", _node("DOCKER-FROM", _node("DOCKER-IMAGE-NAME", value="i")))
    of = of.when(F.col("event_type") == "view", _run(_node("SC-APT-GET-INSTALL", _listed("SC-APT-GET-PACKAGE", pkg))))
    of = of.when(F.col("event_type") == "click", _run(_node("BASH-UNDEFINE-COMMAND", value=pkg)))
    of = of.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), _run(_node("SC-MKDIR", _listed("SC-MKDIR-PATH", path))))
    of = of.when(F.col("event_type") == "error", _run(_node("SC-TAR", _node("SC-TAR-FILE", _literal(path))))).otherwise(_node("DOCKER-RUN"))
    # a called package is looked up as such; a package that looks like a file is read and made as one too
    return _deps(_files(t("events"), "user_id", ["ts", "event_id"], of), spark)


@query("""WITH l AS (SELECT l_orderkey AS f, l_partkey % 5 AS t, l_suppkey AS s, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS i FROM lineitem),
b AS (SELECT *, CASE WHEN t = 0 THEN i ELSE coalesce(max(CASE WHEN t = 0 THEN i END) OVER w, 0) END AS base, coalesce(last_value(CASE WHEN t = 1 THEN 'w' || (s % 2) END IGNORE NULLS) OVER w, './') AS wd FROM l WINDOW w AS (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT f, i, CASE WHEN t = 1 THEN 'w' || (s % 2) ELSE regexp_replace(wd || '/f' || (s % 2), '/+', '/', 'g') END AS path FROM b WHERE t IN (1, 2, 4) UNION ALL SELECT f, i, regexp_replace(wd || '/c', '/+', '/', 'g') FROM b WHERE t = 3),
a AS (SELECT f, s, i, (SELECT min(z.i) FROM b z WHERE z.f = b.f AND z.t = 0 AND z.i < b.i AND z.s % 3 = b.s % 3) AS stage FROM b WHERE t = 3),
c AS (SELECT f, i, stage, (SELECT max(m.i) FROM m WHERE m.f = a.f AND m.i < a.i AND m.path = ['./f0', 'w0/f1', 'w1/f0', './f1'][(a.s % 4)::INTEGER + 1]) AS made, (SELECT min(z.i) FROM b z WHERE z.f = a.f AND z.t = 0 AND z.i > a.stage AND z.i < a.i) AS next FROM a WHERE stage IS NOT NULL),
d AS (SELECT f, i, base AS dep FROM b WHERE t <> 0 UNION SELECT f, i, CASE WHEN made > stage THEN made ELSE next - 1 END FROM c
  UNION SELECT f, i, greatest(base, (SELECT max(z.i) FROM b z WHERE z.f = b.f AND z.t = 1 AND z.i < b.i AND z.s % 2 = b.s % 2)) FROM b WHERE t = 1)
SELECT b.f::VARCHAR AS file_sha, b.i AS cmdid, coalesce(string_agg(d.dep::VARCHAR, ',' ORDER BY d.dep), '') AS cmd_dep FROM b LEFT JOIN d ON d.f = b.f AND d.i = b.i AND d.dep <> b.i GROUP BY b.f, b.i""")
def stage_dependencies(t, spark):
    """Each order's lines as a build file: stages with aliases, working directories, files, copies from stages."""
    n = lambda c, m: (F.col(c) % m).cast("string")
    kind, two = F.col("l_partkey") % 5, F.concat(F.lit("f"), n("l_suppkey", 2))
    path = lambda v: _node("DOCKER-PATH", value=v)
    of = F.when(kind == 0, _node("DOCKER-FROM", _node("DOCKER-IMAGE-NAME", value="i"), _node("DOCKER-IMAGE-ALIAS", value=F.concat(F.lit("s"), n("l_suppkey", 3)))))
    of = of.when(kind == 1, _node("DOCKER-WORKDIR", path(F.concat(F.lit("w"), n("l_suppkey", 2)))))
    of = of.when(kind == 2, _node("DOCKER-COPY", _node("DOCKER-COPY-SOURCE", path("x")), _node("DOCKER-COPY-TARGET", path(two))))
    there = F.get(F.array(*map(F.lit, ("./f0", "w0/f1", "w1/f0", "./f1"))), (F.col("l_suppkey") % 4).cast("int"))
    of = of.when(kind == 3, _node("DOCKER-COPY", _node("DOCKER-FLAG-FROM", value=F.concat(F.lit("s"), n("l_suppkey", 3))), _node("DOCKER-COPY-SOURCE", path(there)), _node("DOCKER-COPY-TARGET", path("c"))))
    return _deps(_files(t("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], of.otherwise(_run(_node("SC-MKDIR", _listed("SC-MKDIR-PATH", two))))), spark)


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS f, l_partkey AS p, l_suppkey AS s, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS i FROM lineitem),
d AS (SELECT DISTINCT a.f, a.i, b.i AS d FROM l a JOIN l b ON a.f = b.f AND b.i < a.i AND (b.p % 7 = a.s % 7 OR b.i = a.i - 1 - a.p % 3)),
r AS (SELECT f, i, 0 AS level FROM l UNION SELECT d.f, d.i, r.level + 1 FROM r JOIN d ON d.f = r.f AND d.d = r.i), m AS (SELECT f, i, max(level)::INTEGER AS level FROM r GROUP BY f, i)
SELECT f::VARCHAR AS file_sha, i AS cmdid, level, (row_number() OVER (PARTITION BY f ORDER BY level, i) - 1)::INTEGER AS place FROM m""")
def reordered(t, spark):
    """The lines of each order as instructions that rest on earlier ones: in the order of their levels."""
    l = t("lineitem").select(F.col("l_orderkey").cast("string").alias("file_sha"), "l_linenumber", "l_partkey", "l_suppkey")
    lines = parted(l, "file_sha").groupBy("file_sha").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    before = lambda i: F.transform(F.slice("lines", F.lit(1), i), lambda b, k: F.struct(k.alias("cmdid"), b["l_partkey"].alias("l_partkey")))
    on = lambda x, i: lambda b: (b["l_partkey"] % 7 == x["l_suppkey"] % 7) | (b["cmdid"] == i - 1 - x["l_partkey"] % 3)
    each = F.transform("lines", lambda x, i: F.struct(i.alias("cmdid"), F.transform(F.filter(before(i), on(x, i)), lambda b: b["cmdid"]).alias("cmd_dep")))
    return buildgraph.reordered(lines.select("file_sha", F.inline(each))).select("file_sha", "cmdid", "level", "place")


@query("""WITH p AS (SELECT p_partkey, p_size % 5 AS i, p_partkey % 6 AS j, lower(p_type) AS a, p_brand AS b FROM part),
x AS (SELECT *, CASE i WHEN 4 THEN [a] WHEN 3 THEN ['install', a] ELSE [a, b] END AS own FROM p)
SELECT p_partkey::VARCHAR AS file_sha, array_to_string(list_sort(CASE i WHEN 3 THEN [a] WHEN 4 THEN [] ELSE list_distinct([a, b]) END), ',') AS install_pkg,
  array_to_string(list_sort(list_distinct(list_concat(CASE i WHEN 0 THEN ['apt', 'apt-get'] WHEN 1 THEN ['pip'] WHEN 3 THEN ['any'] ELSE [] END, CASE j WHEN 1 THEN ['git'] WHEN 2 THEN ['mkdir'] ELSE [] END))), ',') AS used_pkg,
  array_to_string(list_concat(own, CASE j WHEN 0 THEN ['http://x/' || a] WHEN 1 THEN ['http://y/' || a || '.git'] WHEN 2 THEN [a] WHEN 3 THEN [a, b] WHEN 4 THEN ['s'] ELSE ['u', 'two words', '/z'] END), ',') AS source,
  array_to_string(list_concat(own, CASE j WHEN 0 THEN ['o'] WHEN 1 THEN [a] WHEN 2 THEN [b] WHEN 3 THEN ['d'] WHEN 4 THEN ['s'] ELSE ['u', 'two words', '/z'] END), ',') AS target FROM x""")
def rule_sets(t, spark):
    """A RUN of two commands for each part: what rules and grammar say it installs, calls, reads and makes."""
    a, b = F.lower("p_type"), F.col("p_brand")
    i, j = F.col("p_size") % 5, F.col("p_partkey") % 6
    first = F.when(i == 0, _node("SC-APT-GET-INSTALL", _node("SC-APT-GET-F-YES"), _listed("SC-APT-GET-PACKAGE", a, b)))
    first = first.when(i == 1, _node("SC-PIP-INSTALL", _listed("SC-PIP-TARGET", a, b))).when(i == 2, _node("SC-APK-ADD", _listed("SC-APK-PACKAGE", a, b)))
    first = first.when(i == 3, _node("BASH-UNDEFINE-COMMAND", _literal("install"), _literal("-y"), _literal(a), value="any"))
    first = first.otherwise(_node("SC-APT-GET-REMOVE", _listed("SC-APT-GET-PACKAGE", a)))
    url = lambda host, end="": F.concat(F.lit(f"http://{host}/"), a, F.lit(end))
    second = F.when(j == 0, _node("SC-CURL", _node("SC-CURL-URL", _literal(url("x"))), _node("SC-CURL-OUTPUT", _literal("o"))))
    second = second.when(j == 1, _node("SC-GIT-CLONE", _node("SC-GIT-URL", _literal(url("y", ".git"))))).when(j == 2, _node("SC-MKDIR", _listed("SC-MKDIR-PATH", a, b)))
    second = second.when(j == 3, _node("SC-MV", _node("SC-MV-DESTINATION", _literal("d")), _listed("SC-MV-PATH", a, b)))
    second = second.when(j == 4, _node("SC-UNZIP", _node("SC-UNZIP-FILE", _node("BASH-CONCAT", _literal("s"), _node("BASH-DOUBLE-QUOTED", _literal("no"))))))
    second = second.otherwise(_node("BASH-AND-IF", _literal("u"), _literal("two words"), _literal("/z")))
    docs = t("part").select(F.col("p_partkey").cast("string").alias("file_sha"), _node("DOCKER-FILE", _run(first, second)).alias("ast"))
    node, ruled = cut(tree.numbered(docs)), rules.file_rules(spark)
    raw = cut(buildgraph.touched(node, ruled))
    d = buildgraph.dependency_table(node, rules.install_rules(spark), ruled, _names(spark), touches=raw)
    return buildgraph.merged(d, raw, ["file_sha", "cmdid"]).select("file_sha", *[F.array_join(c, ",").alias(c) for c in ("install_pkg", "used_pkg", "source", "target")])


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, event_type AS t, event_id AS id, event_id % 3 AS k, event_id // 3 % 3 AS m, event_id // 9 % 3 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
f AS (SELECT u, -1::BIGINT AS i, NULL::VARCHAR AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS said FROM e GROUP BY u
  UNION ALL SELECT u, i, CASE WHEN k = 0 AND x IS NOT NULL THEN x ELSE v0 END, CASE WHEN k = 1 AND x IS NOT NULL THEN x ELSE v1 END, CASE WHEN k = 2 AND x IS NOT NULL THEN x ELSE v2 END, said
  FROM (SELECT f.u, e.i, k, v0, v1, v2, CASE t WHEN 'signup' THEN 'b' || id WHEN 'view' THEN ('x' || coalesce([v0, v1, v2][m + 1], '${V' || m || '}') || '-' || k) WHEN 'error' THEN (coalesce([v0, v1, v2][m + 1], '$V' || m) || '+') END AS x,
    CASE t WHEN 'click' THEN '/' || coalesce([v0, v1, v2][m + 1], '${V' || m || '}') || '/' || coalesce([v0, v1, v2][n + 1], '$V' || n) WHEN 'purchase' THEN coalesce([v0, v1, v2][m + 1], '$V' || m) END AS said FROM f JOIN e ON e.u = f.u AND e.i = f.i + 1) z)
SELECT u::VARCHAR AS file_sha, i::INTEGER AS cmdid, said AS text FROM f WHERE said IS NOT NULL""")
def symbol_values(t, spark):
    """Each user's events as definitions (ENV and assignments that use each other) and uses of three variables."""
    v = lambda div: F.concat(F.lit("V"), ((F.col("event_id") / div).cast("long") % 3).cast("string"))
    k, m, n = v(1), v(3), v(9)
    env = lambda value: _node("DOCKER-ENV", _node("DOCKER-NAME", value=k), _node("DOCKER-LITERAL", value=value))
    braced = lambda x: F.concat(F.lit("${"), x, F.lit("}"))
    of = F.when(F.col("event_type") == "signup", env(F.concat(F.lit('"b'), F.col("event_id").cast("string"), F.lit('"'))))
    of = of.when(F.col("event_type") == "view", env(F.concat(F.lit("x"), braced(m), F.lit("-"), (F.col("event_id") % 3).cast("string"))))
    assign = _node("BASH-ASSIGN", _node("BASH-ASSIGN-LHS", _literal(k)), _node("BASH-ASSIGN-RHS", _node("BASH-CONCAT", _node("BASH-VARIABLE", value=m), _literal("+"))))
    of = of.when(F.col("event_type") == "error", _run(assign))
    of = of.when(F.col("event_type") == "click", _node("DOCKER-WORKDIR", _node("DOCKER-PATH", value=F.concat(F.lit("/"), braced(m), F.lit("/$"), n))))
    docs = _files(t("events"), "user_id", ["ts", "event_id"], of.otherwise(_run(_node("BASH-VARIABLE", value=m))))
    s = symbols.substituted(tree.nodes(docs))
    read = s.where("type = 'DOCKER-PATH'").unionByName(s.where("depth = 3 AND type IN ('BASH-LITERAL', 'BASH-VARIABLE-VALUE')"))
    return read.select("file_sha", F.get("ord", F.lit(0)).alias("cmdid"), F.col("value").alias("text"))
