"""Relational core: operators over the driver's tables, and the SQL that says what each must give.

SQL maps a query name to a statement valid in Spark SQL and in the SQL oracle alike. A query runs its operator where
the library has one (OPERATORS) and the statement where the statement is all there is.
"""
import re

from pyspark.sql import functions as F

from drydock.operators import graph, mining, refactor, relations, tree
from drydock.plans.catalogue import _graph, _items

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_ITEM = "WITH item AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), freq AS (SELECT b, count(*) AS f FROM item GROUP BY b), pair AS (SELECT x.b AS b1, y.b AS b2, count(*) AS n FROM item x JOIN item y ON x.o = y.o AND x.b < y.b GROUP BY x.b, y.b HAVING count(*) >= 2), sym AS (SELECT b1, b2, n FROM pair UNION ALL SELECT b2, b1, n FROM pair), dep AS (SELECT b1 AS pkg1, b2 AS pkg2, round(n / CAST(f AS DOUBLE), 6) AS score FROM sym JOIN freq ON b1 = b WHERE n / CAST(f AS DOUBLE) >= 0.15) "
_V = "WITH v AS (SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), 'Nation', n_name FROM nation UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 'Customer', c_name FROM customer UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'Supplier', s_name FROM supplier), e AS (SELECT concat('n', CAST(n_nationkey AS STRING)) AS src, concat('r', CAST(n_regionkey AS STRING)) AS dst, 'PART_OF' AS type FROM nation UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'LOCATED_IN' FROM customer UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'LOCATED_IN' FROM supplier) "
_RUNS = "WITH a AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a) "
SQL = {
    "q_pkg_frequency": _ITEM + "SELECT b AS pkg, f AS freq FROM freq",
    "q_cooccurrence": _ITEM + "SELECT b1 AS pkg1, b2 AS pkg2, n FROM pair",
    "q_implicit_dependency": _ITEM + "SELECT * FROM dep",
    "q_dependency_anti": _ITEM + ", known AS (SELECT 'Brand#11' AS pkg1, 'Brand#12' AS pkg2 UNION ALL SELECT 'Brand#13', 'Brand#14') SELECT d.pkg1, d.pkg2, d.score FROM dep d LEFT ANTI JOIN known k ON d.pkg1 = k.pkg1 AND d.pkg2 = k.pkg2 UNION ALL SELECT k.pkg1, k.pkg2, 1.0 FROM known k LEFT SEMI JOIN freq f ON k.pkg1 = f.b LEFT SEMI JOIN freq g ON k.pkg2 = g.b",
    "q_used_minus_installed": "SELECT DISTINCT o_custkey AS cust, l_partkey AS part_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
    "q_kg_vertices": _V + "SELECT * FROM v", "q_kg_edges": _V + "SELECT * FROM e",
    "q_edge_endpoints": _V + "SELECT s.name AS src_name, e.type, d.name AS dst_name FROM e JOIN v s ON s.id = e.src JOIN v d ON d.id = e.dst",
    "q_khop_subgraph": _V + ", hop1 AS (SELECT src AS id, 1 AS depth FROM e WHERE dst = 'r0'), hop2 AS (SELECT e.src AS id, 2 AS depth FROM e JOIN hop1 ON e.dst = hop1.id) SELECT id, min(depth) AS depth FROM (SELECT 'r0' AS id, 0 AS depth UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) z GROUP BY id",
    "q_conflicts": _ITEM + "SELECT x.o AS order_id, x.b AS src, y.b AS dst FROM item x JOIN item y ON x.o = y.o WHERE x.b = 'Brand#11' AND y.b = 'Brand#12'",
    "q_instruction_share": "SELECT user_id, event_type, round(n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) z",
    "q_first_match": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem WHERE l_returnflag = 'R') z WHERE rn = 1",
    "q_contains_unknown": "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_r, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS all_r FROM lineitem GROUP BY l_orderkey",
    "q_merge_runs": _RUNS + "SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, island",
    "q_asof_creator": "SELECT event_id, user_id, creator FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS creator FROM events) z WHERE event_type = 'purchase'",
    "q_ref_normalise": "SELECT p_partkey, CASE WHEN p_size = 1 THEN concat(p_brand, ':latest') WHEN p_size < 10 THEN concat(p_brand, ':', CAST(p_size AS STRING)) WHEN p_size < 30 THEN concat(p_type, '/', p_brand, ':latest') ELSE concat(p_type, '/', p_brand, ':', CAST(p_size AS STRING)) END AS ref FROM part",
    "q_candidate_rank": "SELECT l_orderkey, score, count(*) OVER (PARTITION BY score) AS n_equal FROM (SELECT l_orderkey, CAST(count(*) - 2 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM lineitem GROUP BY l_orderkey) z ORDER BY score DESC, l_orderkey",
    "q_incremental_patterns": "SELECT event_type, CAST(sum(n) AS BIGINT) AS support FROM (SELECT event_type, event_id % 2 AS batch, count(*) AS n FROM events GROUP BY event_type, event_id % 2 HAVING count(*) >= 5) z GROUP BY event_type",
    "q_upsert_last_wins": "SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM pages) y) z WHERE rn = 1",
    "q_contexts": "SELECT d.doc_id, k.kw FROM documents d JOIN (SELECT 'the' AS kw UNION ALL SELECT 'License' UNION ALL SELECT 'que') k ON contains(d.text, k.kw)",
    "q_seq_patterns": "SELECT x.event_type AS first_type, y.event_type AS next_type, count(DISTINCT x.user_id) AS support FROM (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type) x JOIN (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY user_id, event_type) y ON x.user_id = y.user_id AND x.ts < y.ts GROUP BY x.event_type, y.event_type",
}
ORACLE = {k: re.sub(r"LEFT (ANTI|SEMI) JOIN", r"\1 JOIN", re.sub(r"AS STRING\)", "AS VARCHAR)", s)) for k, s in SQL.items()}


OPERATORS = {}


def operator(f):
    OPERATORS["q_" + f.__name__] = f
    return f


def _pairs(t, *pairs):
    return t("part").sparkSession.createDataFrame(list(pairs), "pkg1 string, pkg2 string")


@operator
def pkg_frequency(t):
    return relations.frequency(_items(t))


@operator
def cooccurrence(t):
    return relations.cooccurrence(_items(t))


@operator
def implicit_dependency(t):
    return relations.implicit_dependencies(_items(t), threshold=0.15).withColumn("score", F.round("score", 6))


@operator
def dependency_anti(t):
    known = _pairs(t, ("Brand#11", "Brand#12"), ("Brand#13", "Brand#14"))
    return relations.dependencies(_items(t), known, threshold=0.15).select("pkg1", "pkg2", F.round("confidence", 6).alias("score"))


@operator
def used_minus_installed(t):
    o = t("orders").where("o_orderstatus IN ('O', 'F')").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    uses = o.select(F.col("o_custkey").alias("file_sha"), F.col("o_custkey").alias("image"), F.when(F.col("o_orderstatus") == "F", "install").otherwise("used").alias("kind"), F.col("l_partkey").alias("name"))
    return relations.image_relations(uses).select(F.col("image").alias("cust"), F.explode("used_pkgs").alias("part_id"))


@operator
def kg_vertices(t):
    return _graph(t)[0]


@operator
def kg_edges(t):
    return _graph(t)[1].select("src", "dst", "type")


@operator
def edge_endpoints(t):
    v, e = _graph(t)
    return graph.endpoints(e, v)


@operator
def khop_subgraph(t):
    v, e = _graph(t)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return graph.subgraph(back, v, v.where("id = 'r0'").select("id"), 2)[0].select("id", "depth")


@operator
def conflicts(t):
    known = _pairs(t, ("Brand#11", "Brand#12")).toDF("src", "dst")
    c = relations.conflicts(known, _items(t).select(F.col("image").alias("grp"), F.col("pkg").alias("id")).distinct())
    return c.select(F.col("grp").alias("order_id"), "src", F.explode("dsts").alias("dst"))


@operator
def instruction_share(t):
    s = refactor.shares(t("events").select(F.col("user_id").alias("type"), F.col("event_type").alias("content")))
    return s.select(F.col("type").alias("user_id"), F.col("content").alias("event_type"), F.round("share", 6).alias("share"))


@operator
def first_match(t):
    """Of lines of one number the first in the table's files: the statement leaves them open, and no column parts them."""
    at = F.struct(F.col("l_linenumber").isNull(), "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    l = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", at.alias("at"), F.struct("l_linenumber", "l_partkey").alias("line"))
    return l.groupBy("l_orderkey").agg(F.min_by("line", "at").alias("line")).select("l_orderkey", "line.l_linenumber", "line.l_partkey")


@operator
def contains_unknown(t):
    h = tree.holds(t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("type")), ["R"], "l_orderkey")
    return h.select("l_orderkey", F.col("any").cast("int").alias("any_r"), F.col("all").cast("int").alias("all_r"))


@operator
def asof_creator(t):
    e = t("events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.col("ts").alias("id"), (F.col("event_type") == "view").alias("creates"))
    return relations.last_creator(e, ["user_id"], "at").where("event_type = 'purchase'").select("event_id", "user_id", "creator")


@operator
def ref_normalise(t):
    size = F.col("p_size")
    part = lambda kind, value: F.struct(F.lit(f"DOCKER-IMAGE-{kind}").alias("type"), value.cast("string").alias("value"))
    name, tag, repo = part("NAME", F.col("p_brand")), part("TAG", size), part("REPO", F.col("p_type"))
    kids = F.when(size == 1, F.array(name)).when(size < 10, F.array(name, tag)).when(size < 30, F.array(name, repo)).otherwise(F.array(name, repo, tag))
    return t("part").withColumn("kids", kids).select("p_partkey", relations.from_reference("kids").alias("ref"))


@operator
def candidate_rank(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("entities"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))).alias("conflicts"))
    s = refactor.scored(lines).select("l_orderkey", F.col("score").cast("long").alias("score"))
    # scores are a handful of values: counted by an aggregate, not by a window that sorts all rows of one
    return s.join(s.groupBy("score").agg(F.count(F.lit(1)).alias("n_equal")), "score").select("l_orderkey", "score", "n_equal")


@operator
def incremental_patterns(t):
    batch = lambda k: mining.singletons(t("events").where(F.col("event_id") % 2 == k).select(F.array("event_type").alias("items")), 5)
    return mining.added(batch(0), batch(1)).withColumnRenamed("pattern", "event_type")


@operator
def upsert_last_wins(t):
    p = t("pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id")
    return relations.upsert(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), "host", "page_id")


@operator
def contexts(t):
    known = t("documents").sparkSession.createDataFrame([(k, k) for k in ("the", "License", "que")], "keyword string, context string")
    c = refactor.contexts(t("documents"), known).select("doc_id", F.explode(F.split("context", "\n")).alias("kw"))
    return c.where("kw <> ''")


def _run(name, sql):
    def query(spark, sf_dir):
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if name in OPERATORS:
            return OPERATORS[name](read)
        for t in TABLES:
            if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
                read(t).createOrReplaceTempView(t)
        return spark.sql(sql)
    return query


def queries():
    return {k: _run(k, s) for k, s in SQL.items()}
