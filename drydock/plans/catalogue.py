"""Queries that apply the operators to the driver's tables, each with its oracle where SQL has one.

A query is (function of a table reader and the session, oracle SQL). Every query reads its whole tables.
"""
import os
import uuid

from pyspark.sql import functions as F

from drydock.functions.storage import shared_dir
from drydock.operators import corpus, graph, mining, refactor, relations, shell, tree, vectors
from drydock.plans.registered import query
from drydock.streaming import incremental

_TEXTS = "d AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t FROM documents)"
_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIR = _VEC + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)"
EPS, LEAST = 1.2, 4
TYPES = "ECONOMY STANDARD LARGE".split()
BRANDS = "Brand#13 Brand#5 Brand#22".split()


def _vec(t):
    return t("embeddings").select("vec_id", "embedding", "label")


def _items(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("image"), F.col("p_brand").alias("pkg"))


def _files(t):
    """A build file for each part."""
    text = F.concat(F.lit("# part\nFROM repo"), F.col("p_size").cast("string"), F.lit(":1\n\nRUN apt-get install -y "), F.lower("p_type"), F.lit(" curl\nrun echo "), "p_name")
    return t("part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def _trees(t):
    nations = t("nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("type"), F.array().cast("array<string>").alias("children")))).alias("children"))
    return t("region").join(nations, F.col("r_regionkey") == F.col("r")).select(F.col("r_regionkey").cast("string").alias("file_sha"), F.to_json(F.struct(F.col("r_name").alias("type"), "children")).alias("ast"))


def _graph(t):
    v = graph.vertices((t("region").withColumn("id", F.concat(F.lit("r"), "r_regionkey")), "Region", "id", "r_name"), (t("nation").withColumn("id", F.concat(F.lit("n"), "n_nationkey")), "Nation", "id", "n_name"), (t("customer").withColumn("id", F.concat(F.lit("c"), "c_custkey")), "Customer", "id", "c_name"), (t("supplier").withColumn("id", F.concat(F.lit("s"), "s_suppkey")), "Supplier", "id", "s_name"))
    link = lambda d, a, ka, b, kb: d.select(F.concat(F.lit(a), F.col(ka)).alias("src"), F.concat(F.lit(b), F.col(kb)).alias("dst"))
    e = graph.edges((link(t("nation"), "n", "n_nationkey", "r", "n_regionkey"), "PART_OF", "src", "dst"), (link(t("customer"), "c", "c_custkey", "n", "c_nationkey"), "LOCATED_IN", "src", "dst"), (link(t("supplier"), "s", "s_suppkey", "n", "s_nationkey"), "LOCATED_IN", "src", "dst"))
    return v, e


@query("SELECT p_brand AS image, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS used FROM part GROUP BY p_brand")
def image_union(t, spark):
    uses = t("part").select(F.col("p_size").cast("string").alias("file_sha"), F.col("p_brand").alias("image"), F.lit("used").alias("kind"), F.col("p_type").alias("name"))
    return relations.image_relations(uses).select("image", F.array_join("used_pkgs", ",").alias("used"))


@query("WITH u AS (SELECT DISTINCT o_custkey AS f, p_brand AS i, p_type AS n, o_orderstatus AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), i AS (SELECT DISTINCT i, n FROM u WHERE s = 'F'), x AS (SELECT DISTINCT i, n FROM u WHERE s = 'O' AND NOT EXISTS (SELECT 1 FROM u z WHERE z.f = u.f AND z.i = u.i AND z.n = u.n AND z.s = 'F')) SELECT b.i AS image, (SELECT count(*) FROM x WHERE x.i = b.i) AS n_used, (SELECT count(*) FROM i WHERE i.i = b.i) AS n_installed FROM (SELECT DISTINCT i FROM u WHERE s IN ('F', 'O')) b")
def image_relations(t, spark):
    o = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).where("o_orderstatus IN ('F', 'O')")
    uses = o.select(F.col("o_custkey").cast("string").alias("file_sha"), F.col("p_brand").alias("image"), F.when(F.col("o_orderstatus") == "F", "install").otherwise("used").alias("kind"), F.col("p_type").alias("name"))
    return relations.image_relations(uses).select("image", F.size("used_pkgs").cast("long").alias("n_used"), F.size("install_pkgs").cast("long").alias("n_installed"))


@query("WITH item AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT b, count(*) AS n FROM item GROUP BY b), p AS (SELECT x.b AS a, y.b AS b, count(*) AS n FROM item x JOIN item y ON x.o = y.o AND x.b <> y.b GROUP BY x.b, y.b HAVING count(*) >= 2), k AS (SELECT 'Brand#13' AS a, 'Brand#5' AS b UNION ALL SELECT 'Brand#5', 'Brand#22' UNION ALL SELECT 'Brand#5', 'Brand#none') SELECT a AS pkg1, b AS pkg2, 'explicit' AS type, 1.0::DOUBLE AS confidence FROM k WHERE a IN (SELECT b FROM f) AND b IN (SELECT b FROM f) UNION ALL SELECT p.a, p.b, 'implicit', round(p.n / f.n::DOUBLE, 6) FROM p JOIN f ON p.a = f.b WHERE p.n / f.n::DOUBLE >= 0.15 AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = p.a AND k.b = p.b)")
def dependencies(t, spark):
    known = spark.createDataFrame([("Brand#13", "Brand#5"), ("Brand#5", "Brand#22"), ("Brand#5", "Brand#none")], "pkg1 string, pkg2 string")
    return relations.dependencies(_items(t), known, threshold=0.15).withColumn("confidence", F.round("confidence", 6))


@query("WITH i AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT 'Brand#13' AS s, 'Brand#5' AS d UNION ALL SELECT 'Brand#13', 'Brand#22') SELECT x.o AS grp, x.b AS src, string_agg(y.b, ',' ORDER BY y.b) AS dsts FROM i x JOIN k ON k.s = x.b JOIN i y ON y.o = x.o AND y.b = k.d GROUP BY x.o, x.b")
def conflict_sets(t, spark):
    known = spark.createDataFrame([("Brand#13", "Brand#5"), ("Brand#13", "Brand#22")], "src string, dst string")
    c = relations.conflicts(known, _items(t).select(F.col("image").alias("grp"), F.col("pkg").alias("id")).distinct())
    return c.select("grp", "src", F.array_join("dsts", ",").alias("dsts"))


@query("WITH " + _VEC + " SELECT c.vec_id, round(list_cosine_similarity(c.e, q.e), 6) AS score FROM v c, (SELECT e FROM v WHERE vec_id = 0) q WHERE c.vec_id <> 0 ORDER BY list_cosine_similarity(c.e, q.e) DESC, c.vec_id LIMIT 5")
def topk_cosine(t, spark):
    v = _vec(t)
    return vectors.most_similar(v.where("vec_id <> 0"), v.where("vec_id = 0").first()["embedding"]).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT name, tag, round(score, 6) AS score FROM (SELECT p_brand AS name, p_partkey::VARCHAR AS tag, (CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 0.5 ELSE 0.0 END) / (p_size + 1) AS score FROM part) z ORDER BY z.score DESC, name, tag LIMIT 3")
def best_base_image(t, spark):
    i = t("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("tag"), F.col("p_size").alias("size"), F.array("p_type").alias("packages"), F.lit(1.0).alias("similarity"))
    return vectors.best_base_image(i, ["ECONOMY", "LARGE"], 3).withColumn("score", F.round("score", 6))


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS image FROM conversations QUALIFY image IS NOT NULL")
def forward_fill(t, spark):
    rows = t("conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "FROM").otherwise("x").alias("type"), F.col("turn").alias("image"))
    return relations.current_image(rows, "conv_id", "turn").select("conv_id", "turn", "image")


@query("SELECT event_id, user_id, creator FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS creator FROM events) z WHERE event_type <> 'view'")
def last_creator(t, spark):
    e = t("events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("id"), "event_id", (F.col("event_type") == "view").alias("creates"))
    return relations.last_creator(e, ["user_id"], "at").select("event_id", "user_id", "creator")


@query("WITH a AS (SELECT event_id, user_id, event_type, ts, max(CASE WHEN event_type = 'signup' THEN ts END) OVER w AS s, max(CASE WHEN event_type = 'view' THEN ts END) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, user_id, CASE WHEN s IS NULL OR v > s THEN v END AS creator FROM a WHERE event_type = 'purchase'")
def interval_creator(t, spark):
    e = t("events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.col("ts").alias("id"), (F.col("event_type") == "view").alias("creates"))
    # the start of a use is the last sign-up before it: an as-of join as well
    signup = relations.last_creator(e.withColumn("creates", F.col("event_type") == "signup"), ["user_id"], "at").select("event_id", F.col("creator").alias("start"))
    uses = e.where("event_type IN ('view', 'purchase')").join(signup, "event_id", "left")
    return relations.creator_since(uses, ["user_id"], "at", "start").select("event_id", "user_id", "creator")


@query("SELECT creator, count(*) AS n FROM (SELECT event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS creator FROM events) z WHERE event_type <> 'view' AND creator IS NOT NULL GROUP BY creator")
def in_degree(t, spark):
    e = last_creator(t, spark).where("creator IS NOT NULL").select(F.col("event_id").alias("src"), F.col("creator").alias("dst"))
    return graph.in_degree(e).withColumnRenamed("dst", "creator")


@query("SELECT 'n' || n_nationkey AS id, 1::INTEGER AS level FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 0 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def toposort_levels(t, spark):
    return graph.levels(_graph(t)[1])


@query("SELECT DISTINCT id, label, name FROM (SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier) z")
def graph_vertices(t, spark):
    return _graph(t)[0]


@query("SELECT DISTINCT src, dst, type FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' FROM supplier) z")
def graph_edges(t, spark):
    return _graph(t)[1].select("src", "dst", "type")


@query("WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT id, min(depth)::INTEGER AS depth FROM (SELECT 'r0' AS id, 0 AS depth UNION ALL SELECT src, 1 FROM e WHERE dst = 'r0' UNION ALL SELECT f.src, 2 FROM e JOIN e f ON f.dst = e.src WHERE e.dst = 'r0') z GROUP BY id")
def khop_frontier(t, spark):
    back = _graph(t)[1].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.k_hop(back, spark.createDataFrame([("r0",)], "id string"), 2)


@query("SELECT r_regionkey AS grp, 'Base Images: ' || string_agg(n_name, ', ' ORDER BY n_name) || chr(10) || 'Required Packages: ' || any_value(r_name) || chr(10) || string_agg(n_name || ' requires ' || r_name, chr(10) ORDER BY n_name || ' requires ' || r_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def graph_text(t, spark):
    n = t("nation").select(F.col("n_regionkey").alias("grp"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Image").alias("label"), F.col("n_name").alias("name"))
    r = t("region").select(F.col("r_regionkey").alias("grp"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Package").alias("label"), F.col("r_name").alias("name"))
    e = n.select("grp", F.col("id").alias("src"), F.concat(F.lit("r"), "grp").alias("dst"), F.lit("REQUIRES").alias("type"))
    return graph.as_text(n.unionByName(r.join(n.select("grp").distinct(), "grp", "left_semi")), e, "grp")


@query("WITH l AS (SELECT doc_id, trim(x, ' ') AS l FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) z) SELECT doc_id, count(*) AS n, sum(length(regexp_replace(l, '^[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*', '')))::BIGINT AS chars FROM l WHERE l <> '' AND NOT starts_with(l, '#') GROUP BY doc_id")
def line_parser(t, spark):
    return refactor.instructions(t("documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("SELECT p_partkey AS doc_id, array_to_string(list_sort(list_distinct(['image:repo' || p_size, 'package:' || lower(p_type), 'package:curl'])), ',') AS entities FROM part")
def entity_extract(t, spark):
    return refactor.entities(_files(t)).select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("SELECT p_partkey AS doc_id, array_to_string(list_sort(list_distinct(['-y', 'curl', lower(p_type)])), ',') AS packages FROM part")
def required_packages(t, spark):
    return refactor.required_packages(refactor.instructions(_files(t))).select("doc_id", F.array_join("packages", ",").alias("packages"))


@query("SELECT p_partkey AS doc_id, 'FROM repo' || p_size || ':1' || chr(10) || 'RUN apt-get install -y ' || lower(p_type) || ' curl && echo ' || p_name || ' && rm -rf /var/lib/apt/lists/*' AS text FROM part")
def refactored(t, spark):
    return refactor.refactored(_files(t)).select("doc_id", "text")


@query("SELECT p_partkey AS doc_id, regexp_replace(regexp_replace('apt-get install -y ' || p_brand || ' && wget ' || p_type || ' -O f && chmod 644 x && tar -xzvf a', 'wget\\s+([^\\s]+)\\s+-O\\s+([^\\s]+)', 'curl -L \\1 -o \\2'), 'chmod 644 x && tar -xzvf', 'chmod 755 x && tar -xzf') AS content FROM part")
def unify(t, spark):
    c = F.concat(F.lit("apt  install "), "p_brand", F.lit(" && wget "), "p_type", F.lit(" -O f &&  chmod 644 x && tar -xzvf a"))
    return t("part").select(F.col("p_partkey").alias("doc_id"), refactor.unified(F.lit("RUN"), c).alias("content"))


@query("WITH l AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(p_brand))) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) SELECT o, array_to_string(list_concat(list_filter(['Brand#13', 'Brand#5', 'Brand#22'], lambda x: list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(['Brand#13', 'Brand#5', 'Brand#22'], x))), ',') AS items FROM l")
def param_order(t, spark):
    i = _items(t).groupBy(F.col("image").alias("o")).agg(F.array_sort(F.collect_set("pkg")).alias("b"))
    return i.select("o", F.array_join(mining.ordered_by_reference(F.col("b"), F.array(*map(F.lit, BRANDS))), ",").alias("items"))


@query("SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'COPY ' || url || chr(10) || 'WORKDIR app' ELSE 'ADD ' || url || chr(10) || 'WORKDIR /app' END AS text FROM pages")
def lint_fix(t, spark):
    d = t("pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("ADD "), "url", F.lit("\nWORKDIR app")).alias("text"))
    return refactor.lint_repaired(d, d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "DL3020 Use COPY").otherwise("DL3000 relative path").alias("message")))


@query("SELECT event_id, event_type || '/' || user_id || '/' || event_type || '-${NOPE}' AS text FROM events")
def var_interpolate(t, spark):
    env = F.create_map(F.lit("event"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return t("events").select("event_id", tree.interpolated(F.concat(F.lit("$"), F.lit("{event}/$user/$event-$"), F.lit("{NOPE}")), env).alias("text"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events WHERE json_extract(props, '$.k')::BIGINT >= 10 GROUP BY event_type")
def json_props(t, spark):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t("events").select("event_type", k.alias("k")).where("k >= 10").groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(url, '\\.tar') THEN 'ABS-EXTENSION-TAR' END, CASE WHEN starts_with(url, '/') THEN 'ABS-PATH-ABSOLUTE' END, CASE WHEN contains(url, '/var') THEN 'ABS-PATH-VAR' END, CASE WHEN contains(url, 'http://') THEN 'ABS-URL-PROTOCOL-HTTP' END, CASE WHEN contains(url, 'https://') THEN 'ABS-URL-PROTOCOL-HTTPS' END], lambda x: x IS NOT NULL), ',') AS tags FROM pages")
def abs_tags(t, spark):
    some = {"ABS-EXTENSION-TAR", "ABS-PATH-ABSOLUTE", "ABS-PATH-VAR", "ABS-URL-PROTOCOL-HTTP", "ABS-URL-PROTOCOL-HTTPS"}
    return t("pages").select("page_id", F.array_join(tree.abstract_tags(F.col("url"), some), ",").alias("tags"))


@query("SELECT r_regionkey::VARCHAR AS file_sha, r_name || '/' || n_name AS path FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey::VARCHAR, n_name FROM nation")
def tree_paths(t, spark):
    return tree.paths(tree.nodes(_trees(t))).select("file_sha", F.array_join("path", "/").alias("path"))


@query("SELECT r_regionkey::VARCHAR AS file_sha, '@@' || any_value(r_name) || '@@ ' || string_agg('@@' || n_name || '@@', ' ' ORDER BY n_name) AS tokens FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def tree_tokens(t, spark):
    return tree.tokens(tree.nodes(_trees(t))).select("file_sha", F.array_join("tokens", " ").alias("tokens"))


@query("SELECT r_regionkey::VARCHAR AS file_sha, r_name AS type FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_regionkey::VARCHAR, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def ancestor_prune(t, spark):
    return tree.below_none(tree.nodes(_trees(t)), ["ASIA", "EUROPE"]).select("file_sha", "type")


@query("SELECT p_partkey::VARCHAR AS file_sha, 'DOCKER-FILE DOCKER-RUN BASH-SCRIPT SC-APT-GET-INSTALL SC-APT-GET-F-YES SC-APT-GET-PACKAGES SC-APT-GET-PACKAGE BASH-LITERAL ' || lower(p_type) AS text FROM part")
def command_tree(t, spark):
    """The grammar over a RUN of each part: enrich, substitute, fold, split, then as text."""
    lit = lambda k, v: '{"type":"' + k + '","children":[{"type":"BASH-LITERAL","value":"' + v + '","children":[]}]}'
    head = '{"type":"DOCKER-FILE","children":[{"type":"DOCKER-RUN","children":[{"type":"BASH-SCRIPT","children":[{"type":"MAYBE-SEMANTIC-COMMAND","children":[' + lit("BASH-COMMAND-COMMAND", "apt-get") + ',{"type":"BASH-COMMAND-ARGS","children":[' + ",".join('{"type":"BASH-LITERAL","value":"' + a + '","children":[]}' for a in ("install", "-y"))
    d = t("part").select(F.col("p_partkey").cast("string").alias("file_sha"), F.concat(F.lit(head + ',{"type":"BASH-LITERAL","value":"'), F.lower("p_type"), F.lit('","children":[]}]}]}]}]}]}')).alias("ast"))
    return tree.rendering(tree.nodes(tree.good(shell.processed(d)))).where(F.size("root_ord") == 0).select("file_sha", "text")


@query("WITH " + _TEXTS + " SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM d) z GROUP BY token ORDER BY n DESC, token LIMIT 100")
def token_counts(t, spark):
    return corpus.vocabulary(t("documents"), 100)


@query("WITH " + _TEXTS + " SELECT p, round(quantile_cont(len(t), p), 6) AS tokens FROM d, (SELECT unnest([0.75::DOUBLE, 0.8, 0.9]) AS p) q GROUP BY p".replace("quantile_cont(len(t), p)", "CASE p WHEN 0.75 THEN quantile_cont(len(t), 0.75) WHEN 0.8 THEN quantile_cont(len(t), 0.8) ELSE quantile_cont(len(t), 0.9) END"))
def length_percentile(t, spark):
    return corpus.length_percentiles(t("documents")).select("p", F.round("tokens", 6).alias("tokens"))


@query("WITH " + _TEXTS + ", x AS (SELECT source, doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM d), y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS i FROM x) SELECT source, (i // 128)::BIGINT AS chunk, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM y GROUP BY source, i // 128 HAVING count(*) = 128")
def chunk_tokens(t, spark):
    return corpus.chunks(t("documents"), 128).select("source", "chunk", F.md5(F.array_join("items", " ")).alias("digest"))


@query("WITH " + _TEXTS + ", x AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i FROM d), m AS (SELECT doc_id, count(*) AS n FROM x WHERE ('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.15 GROUP BY doc_id) SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n FROM d LEFT JOIN m USING (doc_id)")
def mask_tokens(t, spark):
    # a text may hold the mask's own word: what is counted is where the masked tokens differ from the text's
    d = corpus.masked(t("documents"), mask="\u0000")
    return d.select("doc_id", F.size(F.filter("items", lambda x: x == "\u0000")).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 'train' ELSE 'eval' END AS part FROM documents")
def train_eval_split(t, spark):
    return corpus.split(t("documents")).select("doc_id", "part")


@query("SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy, round(exp(avg(quality)), 6) AS perplexity FROM labels")
def masked_accuracy(t, spark):
    p = t("labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted"), F.col("quality").cast("double").alias("loss"))
    return corpus.masked_accuracy(p).select(F.round("accuracy", 6).alias("accuracy"), F.round("perplexity", 6).alias("perplexity"))


@query("WITH i AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT o)::DOUBLE AS n FROM i), f AS (SELECT b, count(*) AS f FROM i GROUP BY b), p AS (SELECT x.b AS a, y.b AS b, count(*) AS c FROM i x JOIN i y ON x.o = y.o AND x.b <> y.b GROUP BY x.b, y.b) SELECT p.a AS antecedent, p.b AS consequent, round(c / n, 6) AS support, round(c / fa.f::DOUBLE, 6) AS confidence, round(c * n / (fa.f * fb.f), 6) AS lift FROM p JOIN f fa ON fa.b = p.a JOIN f fb ON fb.b = p.b, n WHERE c / fa.f::DOUBLE >= 0.12")
def assoc_rules(t, spark):
    r = mining.pair_rules(_items(t).select(F.col("image").alias("tx_id"), F.col("pkg").alias("item")), confidence=0.12, lift=0.0)
    return r.select("antecedent", "consequent", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query("WITH o AS (SELECT l_orderkey AS o, l_linenumber AS l, p_type AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT x, count(*) AS n FROM o GROUP BY x HAVING count(*) / (SELECT count(DISTINCT o)::DOUBLE FROM o) >= 0.5), s AS (SELECT o, list(x ORDER BY n DESC, pos) AS p FROM o JOIN f USING (x) GROUP BY o), e AS (SELECT p, unnest(generate_series(1, len(p))) AS k FROM s) SELECT DISTINCT array_to_string(list_sort(p[1:k]), ',') AS itemset FROM e")
def prefix_itemsets(t, spark):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))), lambda x: x["p_type"]).alias("items"))
    return mining.prefix_itemsets(rows, 0.5).select(F.array_join("itemset", ",").alias("itemset"))


@query("WITH e AS (SELECT user_id AS u, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), a AS (SELECT u, x AS p, min(r) AS at FROM e GROUP BY u, x), b AS (SELECT a.u, a.p || '>' || e.x AS p, min(e.r) AS at FROM a JOIN e ON e.u = a.u AND e.r > a.at GROUP BY a.u, a.p, e.x), c AS (SELECT b.u, b.p || '>' || e.x AS p, min(e.r) AS at FROM b JOIN e ON e.u = b.u AND e.r > b.at GROUP BY b.u, b.p, e.x) SELECT p AS pattern, count(*) AS support FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) z GROUP BY p HAVING count(*) >= 10")
def prefixspan(t, spark):
    db = t("events").groupBy(F.col("user_id").alias("seq_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("seq"))
    return mining.sequences(db, 10, 3).select(F.array_join("pattern", ">").alias("pattern"), "support")


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), g AS (SELECT i, avg(x) AS m FROM x GROUP BY i), c AS (SELECT label, i, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM x GROUP BY label, i) SELECT round((sum(c.n * (c.m - g.m) ** 2) / sum(c.n * c.v)) * ((SELECT count(*) FROM embeddings) - count(DISTINCT label)) / (count(DISTINCT label) - 1), 6) AS ch FROM c JOIN g USING (i)")
def ch_index(t, spark):
    return vectors.calinski_harabasz(_vec(t)).select(F.round("ch", 6).alias("ch"))


@query("WITH " + _PAIR + ", m AS (SELECT a, la, lb, avg(d) AS m FROM p GROUP BY a, la, lb), s AS (SELECT a, min(CASE WHEN la <> lb THEN m END) AS o, max(CASE WHEN la = lb THEN m END) AS i FROM m GROUP BY a) SELECT round(avg(CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE (o - i) / greatest(o, i) END), 6) AS silhouette FROM s")
def silhouette(t, spark):
    return vectors.silhouette(_vec(t)).select(F.round("silhouette", 6).alias("silhouette"))


@query("WITH " + _PAIR + " SELECT a AS vec_id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) z WHERE r = 3")
def kdistance(t, spark):
    return vectors.k_distance(_vec(t), 4).select("vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {_PAIR} SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id AND d <= {EPS}) + 1 >= {LEAST} AS core FROM v")
def dbscan_core(t, spark):
    return vectors.core_points(_vec(t), EPS, LEAST)


@query(f"WITH {_PAIR} SELECT count(*) AS noise FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = v.vec_id AND p.d <= {EPS} AND (SELECT count(*) FROM p q WHERE q.a = p.b AND q.d <= {EPS}) + 1 >= {LEAST}) AND (SELECT count(*) FROM p WHERE p.a = v.vec_id AND d <= {EPS}) + 1 < {LEAST}")
def dbscan_noise(t, spark):
    return vectors.noise_rows(_vec(t), EPS, LEAST).agg(F.count(F.lit(1)).alias("noise"))


@query(f"WITH RECURSIVE {_PAIR}, n AS (SELECT a, b FROM p WHERE d <= {EPS}), c AS (SELECT a FROM n GROUP BY a HAVING count(*) + 1 >= {LEAST}), l AS (SELECT a, b FROM n WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)), r AS (SELECT a AS x, a AS y FROM c UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y), k AS (SELECT x, min(y) AS k FROM r GROUP BY x), e AS (SELECT n.a, min(k.k) AS k FROM n JOIN k ON k.x = n.b GROUP BY n.a) SELECT v.vec_id, coalesce(k.k, e.k, -1) AS cluster FROM v LEFT JOIN k ON k.x = v.vec_id LEFT JOIN e ON e.a = v.vec_id")
def dbscan_labels(t, spark):
    return vectors.dbscan(_vec(t), EPS, LEAST)


@query("WITH " + _PAIR + ", m AS (SELECT la, a, round(avg(d), 9) AS m FROM p WHERE la = lb GROUP BY la, a) SELECT la AS label, a AS vec_id FROM (SELECT *, row_number() OVER (PARTITION BY la ORDER BY m, a) AS r FROM m) z WHERE r = 1")
def medoid(t, spark):
    return vectors.medoids(_vec(t))


@query("SELECT label, (i - 1)::INTEGER AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) z GROUP BY label, i")
def pool_mean(t, spark):
    return vectors.mean_vectors(_vec(t)).select("label", "dim", F.round("mean", 6).alias("mean"))


@query("WITH " + _VEC + " SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_sum(e) / sqrt(list_dot_product(e, e)), 6) AS total FROM v")
def l2_normalise(t, spark):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return vectors.normalised(_vec(t)).select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(total, 6).alias("total"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i WHERE b.i < 8 GROUP BY a.i, b.i")
def cov_moments(t, spark):
    return vectors.covariance(_vec(t), range(8)).select("i", "j", F.round("cov", 6).alias("cov"))


@query("SELECT vec_id, 1.0::DOUBLE AS norm, 16::BIGINT AS width FROM embeddings")
def whiten(t, spark):
    w = vectors.whitened(_vec(t), 16)
    return w.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.size("embedding").cast("long").alias("width"))


@query("SELECT event_type AS pattern, count(*) AS support FROM events GROUP BY event_type")
def stream_counts(t, spark):
    path = t("events").inputFiles()[0]
    schema = t("events").schema
    base = os.path.join(shared_dir(spark), f"drydock-stream-{uuid.uuid4().hex}")
    s = spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return incremental.stream_patterns(s, "event_type", f"{base}/patterns", f"{base}/checkpoint")
