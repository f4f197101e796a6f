"""Queries over whole corpora: clusters of commands, itemsets that grow by batches, the assembled graph."""
import os
import uuid

from pyspark.sql import functions as F

from drydock.functions.storage import shared_dir
from drydock.operators import corpus, entity_index, graph, mining, refactor, relations, tree
from drydock.plans.catalogue import _items, _trees
from drydock.plans.registered import query
from drydock.sources import files
from drydock.streaming.incremental import PatternStore


@query("""WITH RECURSIVE c AS (SELECT lower(p_type) || ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' -y' ELSE '' END AS content, count(*) AS n FROM part GROUP BY 1),
b AS (SELECT *, list_sort(list_filter(string_split(content, ' '), lambda x: x <> '')) AS bag FROM c),
p AS (SELECT bag, min(content) AS id, sum(n) AS w FROM b GROUP BY bag),
d AS (SELECT a.id AS a, b.id AS b, b.w, list_sum(list_transform(list_distinct(list_concat(a.bag, b.bag)), lambda x: (len(list_filter(a.bag, lambda y: y = x)) - len(list_filter(b.bag, lambda y: y = x))) ** 2)) AS d FROM p a, p b),
n AS (SELECT a, b, w FROM d WHERE a <> b AND d <= 1),
k AS (SELECT p.id FROM p LEFT JOIN n ON n.a = p.id GROUP BY p.id, p.w HAVING p.w + coalesce(sum(n.w), 0) >= 5),
l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)),
r AS (SELECT id AS x, id AS y FROM k UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
m AS (SELECT x AS id, min(y) AS cluster FROM r GROUP BY x),
e AS (SELECT n.a AS id, min(m.cluster) AS cluster FROM n JOIN m ON m.id = n.b WHERE n.a NOT IN (SELECT id FROM k) GROUP BY n.a),
g AS (SELECT * FROM m UNION ALL SELECT * FROM e),
t AS (SELECT x.cluster, x.id, round(sum(d.w * sqrt(d.d)), 9) AS total FROM g x JOIN g y ON x.cluster = y.cluster JOIN d ON d.a = x.id AND d.b = y.id GROUP BY x.cluster, x.id),
z AS (SELECT cluster, id AS center FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY total, id) = 1)
SELECT b.content, b.n, round(b.n / (SELECT sum(n) FROM c), 6) AS share, g.cluster, z.center FROM b JOIN p ON p.bag = b.bag LEFT JOIN g ON g.id = p.id LEFT JOIN z ON z.cluster = g.cluster""")
def run_clusters(t, spark):
    text = F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.when(F.col("p_size") % 3 == 0, F.lit(" -y")).otherwise(F.lit("")))
    return refactor.run_clusters(t("part").select(text.alias("content")), 1.0, 5).withColumn("share", F.round("share", 6))


def _paths(k):
    """SQL of the distinct paths of one batch of orders."""
    return f"""o{k} AS (SELECT l_orderkey AS o, p_type AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 2 = {k}),
f{k} AS (SELECT x, count(*) AS n FROM o{k} GROUP BY x HAVING count(*) / (SELECT count(DISTINCT o)::DOUBLE FROM o{k}) >= 0.5), s{k} AS (SELECT o, list(x ORDER BY n DESC, pos) AS p FROM o{k} JOIN f{k} USING (x) GROUP BY o),
p{k} AS (SELECT DISTINCT p[1:k] AS p FROM (SELECT p, unnest(generate_series(1, len(p))) AS k FROM s{k}) z)"""


@query(f"WITH {_paths(0)}, {_paths(1)}, a AS (SELECT p FROM p0 UNION ALL (SELECT p FROM p0 UNION SELECT p FROM p1)) SELECT array_to_string(list_sort(p), ',') AS itemset, count(*) AS n FROM a WHERE len(p) >= 2 GROUP BY 1")
def incremental_itemsets(t, spark):
    """Two batches of orders taken into a stored prefix tree: the itemsets after the second."""
    store = PatternStore(spark, os.path.join(shared_dir(spark), f"drydock-tree-{uuid.uuid4().hex}"))
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    tx = rows.groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))), lambda x: x["p_type"]).alias("items"))
    sets = mining.tree_itemsets(mining.grown_tree(store, tx.where("tx_id % 2 = 0")))
    after = mining.updated_sets(sets, mining.grown_tree(store, tx.where("tx_id % 2 = 1")))
    return after.groupBy(F.array_join("itemset", ",").alias("itemset")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH item AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT b, count(*) AS n FROM item GROUP BY b),
p AS (SELECT x.b AS a, y.b AS b, count(*) AS n FROM item x JOIN item y ON x.o = y.o AND x.b <> y.b GROUP BY x.b, y.b HAVING count(*) >= 2),
k AS (SELECT 'Brand#13' AS a, 'Brand#5' AS b UNION ALL SELECT 'Brand#5', 'Brand#22' UNION ALL SELECT 'Brand#5', 'Brand#none'), s AS (SELECT * FROM k WHERE a IN (SELECT b FROM f) AND b IN (SELECT b FROM f)),
u AS (SELECT DISTINCT o_custkey AS f, p_brand AS i, p_type AS n, o_orderstatus = 'F' AS inst FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT DISTINCT i, n, inst FROM u WHERE inst OR NOT EXISTS (SELECT 1 FROM u z WHERE z.f = u.f AND z.i = u.i AND z.n = u.n AND z.inst))
SELECT 'Image:' || p_brand AS src, 'Image:' || p_type AS dst, 'BASED_ON' AS type, NULL::DOUBLE AS confidence FROM part GROUP BY p_brand, p_type
UNION ALL SELECT 'Image:' || i, CASE WHEN inst THEN 'Package:' ELSE 'Command:' END || n, CASE WHEN inst THEN 'INSTALLS' ELSE 'USES' END, NULL FROM g
UNION ALL SELECT 'Package:' || a, 'Package:' || b, 'DEPENDS_ON', 1.0 FROM s
UNION ALL SELECT 'Package:' || p.a, 'Package:' || p.b, 'DEPENDS_ON', round(p.n / f.n::DOUBLE, 6) FROM p JOIN f ON p.a = f.b WHERE p.n / f.n::DOUBLE >= 0.15 AND NOT EXISTS (SELECT 1 FROM s WHERE s.a = p.a AND s.b = p.b)
UNION ALL SELECT 'Package:' || a, 'Package:' || b, 'CONFLICTS_WITH', NULL FROM (SELECT 'Brand#13' AS a, 'Brand#5' AS b UNION ALL SELECT 'Brand#13', 'nothing') z WHERE b <> 'nothing'""")
def corpus_graph(t, spark):
    """The assembled graph, written as a version and read back."""
    o = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    uses = o.select(F.col("o_custkey").cast("string").alias("file_sha"), F.col("p_brand").alias("image"), F.when(F.col("o_orderstatus") == "F", "install").otherwise("used").alias("kind"), F.col("p_type").alias("name"))
    known = spark.createDataFrame([("Brand#13", "Brand#5"), ("Brand#5", "Brand#22"), ("Brand#5", "Brand#none")], "pkg1 string, pkg2 string")
    apart = spark.createDataFrame([("Brand#13", "Brand#5"), ("Brand#13", "nothing")], "pkg1 string, pkg2 string")
    parents = t("part").select(F.col("p_brand").alias("image"), F.col("p_type").alias("parent")).distinct()
    v, e = graph.assembled(parents, relations.image_relations(uses), relations.dependencies(_items(t), known, threshold=0.15), apart)
    path = os.path.join(shared_dir(spark), f"drydock-graph-{uuid.uuid4().hex}")
    files.replace_graph(v, e, path)
    return files.read_graph(spark, path)[1].select("src", "dst", "type", F.round(F.try_element_at("props", F.lit("confidence")).cast("double"), 6).alias("confidence"))


@query("""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array('apt  install -y ' || p_name || ' ' || lower(p_type), ' +'), lambda x: NOT starts_with(x, '-') AND x <> 'install') AS w FROM part)
SELECT p_partkey, array_to_string(w, ',') AS words, list_filter(w, lambda x: length(x) > 5)[1] AS first FROM w""")
def install_words(t, spark):
    """What an install command names, and the first long name of it."""
    text = F.concat(F.lit("  apt  install -y "), "p_name", F.lit(" "), F.lower("p_type"))
    w = t("part").select("p_partkey", relations.install_arguments(relations.package_words(text)).alias("w"))
    return w.select("p_partkey", F.array_join("w", ",").alias("words"), relations.first_match(F.col("w"), lambda x: F.length(x) > 5).alias("first"))



@query("""WITH w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type || ' s' || p_size), ' +'), lambda x: x <> '') AS w FROM part),
h AS (SELECT id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 64) AS h FROM w),
c AS (SELECT id, list_transform(range(0, 64), lambda k: len(list_filter(h, lambda x: x = k))::DOUBLE) AS c FROM h),
s AS (SELECT q.id AS query_id, r.id, round(list_dot_product(q.c, r.c) / (sqrt(list_dot_product(q.c, q.c)) * sqrt(list_dot_product(r.c, r.c))), 9) AS score FROM c q JOIN c r ON q.id <> r.id WHERE q.id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM s QUALIFY rank <= 5""")
def entity_search(t, spark):
    """Parts as entities in a stored index, built of half of them and grown by the rest: the five nearest of each part
    whose key is divisible by 20."""
    text = entity_index.entity_text(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type", F.concat(F.lit("s"), "p_size")))
    e = t("part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    path = os.path.join(shared_dir(spark), f"drydock-entities-{uuid.uuid4().hex}")
    entity_index.build(e.where("id % 2 = 0"), path)
    entity_index.grow(e.where("id % 2 = 1"), path)
    return entity_index.search(spark, path, e.where("id % 20 = 0"), 5, itself=False)


_PART = """p AS (SELECT p_brand AS grp, p_partkey AS pos, p_size AS z, 'package:' || lower(p_type) AS a, 'package:' || string_split(p_name, ' ')[1] AS b, 'package:' || string_split(p_name, ' ')[2] AS c, 'image:repo' || (p_size % 4) AS i FROM part),
x AS (SELECT grp, pos, list_distinct([a, b, c, i]) AS n FROM p), k AS (SELECT DISTINCT a AS s, c AS d FROM p WHERE z % 25 = 7), e AS (SELECT DISTINCT a AS s, b AS d FROM p WHERE z % 10 = 0 UNION SELECT DISTINCT b, c FROM p WHERE z % 10 = 5),
r AS (SELECT grp, pos, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos)::INTEGER AS rank FROM (SELECT grp, pos, (len(n) - 2 * (SELECT count(DISTINCT k.s) FROM k WHERE list_contains(x.n, k.s) AND list_contains(x.n, k.d)))::INTEGER AS score FROM x) z)"""


def _clarified(t):
    word = lambda i: F.concat(F.lit("package:"), F.get(F.split("p_name", " "), F.lit(i)))
    kind, part = F.concat(F.lit("package:"), F.lower("p_type")), t("part")
    text = F.concat(F.lit("FROM repo"), (F.col("p_size") % 4).cast("string"), F.lit(":1\nRUN apt-get install -y "), F.lower("p_type"), F.lit(" "), "p_name")
    pairs = lambda d, a, b: d.select(a.alias("src"), b.alias("dst")).distinct()
    e = pairs(part.where("p_size % 10 = 0"), kind, word(0)).unionByName(pairs(part.where("p_size % 10 = 5"), word(0), word(1)))
    return graph.clarified(part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("pos"), text.alias("text")), pairs(part.where("p_size % 25 = 7"), kind, word(1)), e)


@query(f"WITH {_PART} SELECT * FROM r")
def clarified_ranking(t, spark):
    """Each brand as a request, its parts as candidates: scores and ranks."""
    return _clarified(t)[0]


@query(f"""WITH {_PART}, n AS (SELECT grp, unnest(n) AS id FROM x JOIN r USING (grp, pos) WHERE rank = 1), h AS (SELECT grp, id, 0 AS depth FROM n UNION ALL SELECT grp, e.d, 1 FROM n JOIN e ON e.s = n.id UNION ALL SELECT grp, f.d, 2 FROM n JOIN e ON e.s = n.id JOIN e f ON f.s = e.d)
SELECT grp, id, min(depth)::INTEGER AS depth FROM h GROUP BY grp, id""")
def clarified_subgraph(t, spark):
    """What the best candidate of each brand names, and what that leads to."""
    return _clarified(t)[1]


@query("""SELECT 'region' AS corpus, r_regionkey::VARCHAR AS file_sha FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name < 'NATION_13' AND n_regionkey <> 0)
UNION ALL SELECT 'copy', r_regionkey::VARCHAR FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name < 'NATION_13' AND n_regionkey <> 0)""")
def united_report(t, spark):
    """The documents of two corpora that hold a nation before NATION_13, the first region apart."""
    of = lambda: tree.nodes(_trees(t)).withColumn("type", F.when(F.col("leaf") & (F.col("type") < "NATION_13"), "UNKNOWN").otherwise(F.col("type")))
    return corpus.united(region=tree.report(of(), apart=["0"]), copy=tree.report(of(), apart=["0"]))
