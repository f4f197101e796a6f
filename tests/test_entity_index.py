"""The stored index against brute force, its growth and what it leaves unread."""
import math
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from drydock.operators import entity_index as E

TOPICS = [[f"w{t}_{i}" for i in range(6)] for t in range(20)]
TEXTS = [" ".join(TOPICS[i % 20][j] for j in range(6) if (i >> j) & 1 or j == i % 6) + (" Extra" if i % 7 == 0 else "") for i in range(400)] + [None, "", "  "]


def vector(text):
    c = Counter(int(md5(w.encode()).hexdigest()[:8], 16) % E.WIDTH for w in (text or "").lower().split())
    return [c[k] for k in range(E.WIDTH)]


def brute(texts, queries, k, itself):
    v = {i: vector(t) for i, t in texts}
    norm = {i: math.sqrt(sum(x * x for x in c)) for i, c in v.items()}
    out = set()
    for q in queries:
        s = sorted((-round(sum(a * b for a, b in zip(v[q], v[i])) / (norm[q] * norm[i]), 9), i) for i in v if norm[i] and norm[q] and (itself or i != q))
        out |= {(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)}
    return out


def test_search_is_exact_and_grows(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    d = spark.createDataFrame(rows, "id long, text string")
    path = E.build(d.where("id < 150"), str(tmp_path / "x"), pivots=30)
    ask = d.where("id % 9 = 0")
    found = lambda texts, k, itself: {(r["query_id"], r["rank"], r["id"], r["score"]) for r in E.search(spark, path, ask, k, itself).collect()}
    ids = [i for i, _ in rows if i % 9 == 0]
    v = dict(rows)
    first = [(i, t) for i, t in rows if i < 150]
    near = lambda texts, k: {x for x in brute(texts + [(i, v[i]) for i in ids if i >= 150], ids, len(TEXTS), True) if x[2] in dict(texts)}
    want = {}
    for q, _, i, s in sorted(near(first, 3), key=lambda x: (x[0], -x[3], x[2])):
        want.setdefault(q, []).append((i, s))
    assert found(first, 3, True) == {(q, r, i, s) for q, x in want.items() for r, (i, s) in enumerate(x[:3], 1)}
    E.grow(d.where("id >= 100"), path)  # ids that it holds stay as they are
    assert E.rows_of(spark, path).count() == E.rows_of(spark, path).select("id").distinct().count() == 400
    for k, itself in ((3, True), (4, False)):
        assert found(rows, k, itself) == brute(rows, ids, k, itself)


def test_search_leaves_cells_out(spark, tmp_path):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    path = E.build(d, str(tmp_path / "x"), pivots=60)
    q = E.encoded(d.where("id < 40"))
    cells = E.summaries(spark, path).count()
    assert E.candidates(spark, path, q, 3).count() < 0.5 * 40 * cells
    assert E.summaries(spark, path).agg(F.sum("n")).first()[0] == 400


def test_texts(spark):
    d = spark.createDataFrame([("a", None, "1", ["p", "q"]), ("b", "d", "2", [])], "n string, d string, t string, p array<string>")
    assert [tuple(r) for r in d.select(E.entity_text(F.col("n"), F.col("d")), E.image_text(F.col("n"), F.col("t"), F.col("p"))).collect()] == [("a ", "a:1 p q"), ("b d", "b:2 ")]
    f = spark.createDataFrame([("x " * 600,)], "t string").select(E.features(F.col("t"), 8, 512).alias("f")).first()["f"]
    assert sum(f) == 512


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    path = E.build(none, str(tmp_path / "x"))
    assert E.search(spark, path, none).isEmpty()
    E.grow(spark.createDataFrame([(1, "a b")], "id long, text string"), path)
    assert [(r["id"], r["score"]) for r in E.search(spark, path, spark.createDataFrame([(9, "a b"), (8, "")], "id long, text string")).collect()] == [(1, 1.0)]
