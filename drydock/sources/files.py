"""Sources and sinks: JSON lines (xz too), JSON maps, YAML grammars, text, arrays, REST pages, processes."""
import io
import json
import lzma
import os
import uuid

from pyspark.sql import functions as F

from drydock.functions.prefix import running_sums


def read_jsonl(spark, path, schema=None):
    """Lines of JSON; files ending in .xz are unpacked line by line, one file a task."""
    if str(path).endswith(".xz"):
        raw = spark.read.format("binaryFile").load(path).select("content")

        def run(batches):
            import pandas as pd
            for b in batches:
                for blob in b["content"]:
                    rows = []
                    for line in lzma.open(io.BytesIO(blob), "rt", encoding="utf-8"):
                        rows.append(line.rstrip("\n"))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame({"value": rows})
                            rows = []
                    if rows:
                        yield pd.DataFrame({"value": rows})

        lines = raw.mapInPandas(run, "value string").where("trim(value) <> ''")
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*") if schema else lines
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df, path, xz=False):
    """One object a line; with xz each partition is a file part-*.jsonl.xz in a folder all executors share.

    A file gets its name once it is whole, by this write and its partition, so a repeated task replaces it;
    files of earlier writes go once all are there.
    """
    if not xz:
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
        return path
    os.makedirs(path, exist_ok=True)
    mark = uuid.uuid4().hex

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext
        c = TaskContext.get()
        own = os.path.join(path, f".part-{c.partitionId():05d}-{c.taskAttemptId()}")
        n = 0
        with lzma.open(own, "wt", encoding="utf-8") as f:
            for b in batches:
                for v in b["value"]:
                    f.write(v + "\n")
                    n += 1
        os.replace(own, os.path.join(path, f"part-{mark}-{c.partitionId():05d}.jsonl.xz"))
        yield pd.DataFrame({"n": [n]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(run, "n long").agg(F.sum("n")).first()
    for f in os.listdir(path):
        if f.startswith(("part-", ".part-")) and mark not in f:
            os.remove(os.path.join(path, f))
    return path


def read_json_map(spark, path):
    """key, value (JSON text): the entries of whole files that hold one object each."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_pages(spark, names, fetch, first):
    """name, page, result (JSON text): pages of a REST listing followed by `next` until null.

    fetch(url) gives {"results": [...], "next": url or None}; after an error what was read stays and a
    last row without a result says what went wrong.
    """
    def run(batches):
        import pandas as pd
        for b in batches:
            rows = []
            for n in b["name"]:
                url, page = first(n), 0
                while url:
                    try:
                        got = fetch(url)
                    except Exception as e:  # the row is the record of it
                        rows.append((n, page, None, f"{type(e).__name__}: {e}"))
                        break
                    rows += [(n, page, json.dumps(r), None) for r in got.get("results") or []]
                    url, page = got.get("next"), page + 1
            yield pd.DataFrame(rows, columns=["name", "page", "result", "error"])

    return spark.createDataFrame([(n,) for n in names], "name string").mapInPandas(run, "name string, page int, result string, error string")


def question_pairs(pages):
    """pages(seq, title, answer) -> title, answer: empty answers go, the last of a title wins."""
    return pages.where("trim(coalesce(answer, '')) <> ''").groupBy("title").agg(F.max_by("answer", "seq").alias("answer"))


def manifests(results):
    """results(image, name, images array of struct architecture, size, digest) -> name and the amd64 image."""
    hit = F.get(F.filter("images", lambda x: x["architecture"] == "amd64"), F.lit(0))
    return results.withColumn("hit", hit).where("hit IS NOT NULL").select(F.concat_ws(":", "image", "name").alias("name"), "hit.size", "hit.digest")


GRAMMAR = "command string, prefix string, seq int, cmd string, name string, booleans array<string>, strings array<string>, paths array<string>, arrays array<string>, counts array<string>, directives map<string,string>"
_KINDS = ("booleans", "strings", "paths", "arrays", "counts")


def read_grammar(spark, folder):
    """Grammar rows of the .yml files of a folder; option groups named by `merge` are put together."""
    import yaml

    rows = []
    for f in sorted(os.listdir(folder)):
        if not f.endswith(".yml"):
            continue
        c = (yaml.safe_load(open(os.path.join(folder, f), encoding="utf-8")) or {}).get("command") or {}
        for command in c.get("providerFor") or []:
            for seq, s in enumerate(c.get("scenarios") or []):
                o = s.get("options") or {}
                groups = o.get("merge") or [o]
                lists = {k: [str(x) for g in groups for x in (g or {}).get(k) or []] for k in _KINDS}
                rest = {k: json.dumps(v) for k, v in s.items() if k not in ("cmd", "name", "options")}
                rows.append((command, c.get("prefix"), seq, s.get("cmd"), s.get("name"), *(lists[k] for k in _KINDS), rest))
    return spark.createDataFrame(rows, GRAMMAR)


def grammar_of(rows):
    """The parser's form (shell.parsed) of collected grammar rows, which are a few hundred constants.

    Each scenario keeps what it must have (each a flag with its aliases) and its own options.
    """
    out = {}
    for r in sorted(rows, key=lambda r: (r["command"], r["seq"])):
        _, scenarios, groups = out.setdefault(r["command"], (r["prefix"], [], {k: "" for k in _KINDS}))
        must = json.loads((r["directives"] or {}).get("mustHave") or "[]")
        own = {k: "; ".join(r[k]) for k in _KINDS}
        scenarios.append((r["cmd"], r["name"], ";".join([must] if isinstance(must, str) else must), own))
        for k in _KINDS:
            groups[k] = "; ".join(filter(None, [groups[k], *r[k]]))
    return out


def read_lines(spark, path):
    return spark.read.text(path)


def write_lines(df, path, column="value"):
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_npy(spark, path):
    """vec_id, embedding of a two-dimensional .npy file, read in slices by tasks that share the path."""
    import numpy as np

    shape = np.load(path, mmap_mode="r").shape

    def run(batches):
        import pandas as pd
        m = np.load(path, mmap_mode="r")
        for b in batches:
            ids = b["id"].to_numpy()
            for i in range(0, len(ids), 4096):
                yield pd.DataFrame({"vec_id": ids[i:i + 4096], "embedding": [m[j].astype(float).tolist() for j in ids[i:i + 4096]]})

    return spark.range(shape[0]).mapInPandas(run, "vec_id long, embedding array<double>")


def write_npy(vec, path):
    """The vectors by vec_id as one .npy file on a path that driver and executors share.

    The driver writes the header and the file's length; each task puts its rows where their rank says, so a repeated task
    writes the same bytes again. Ranks are running sums over ranges of vec_id. All vectors must have one length.
    """
    import numpy as np

    n, width, least = vec.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if width != least:
        raise ValueError(f"vectors of {least} to {width} components do not make one array")
    np.lib.format.open_memmap(path, "w+", np.float32, (n, width or 0)).flush()
    if not n:
        return path
    ranked = running_sums(vec.select("vec_id", "embedding", F.lit(1).cast("long").alias("one")), [], ["vec_id"], "one")

    def run(batches):
        import pandas as pd
        m, done = np.load(path, mmap_mode="r+"), 0
        for b in batches:
            if len(b):
                m[b["before"].to_numpy()] = np.array(b["embedding"].tolist(), np.float32)
                done += len(b)
        m.flush()
        yield pd.DataFrame({"n": [done]})

    put = ranked.select("embedding", "before").mapInPandas(run, "n long").agg(F.sum("n")).first()[0]
    if put != n:
        raise RuntimeError(f"{put} of {n} vectors were written")
    return path


def write_graph(vertices, edges, path):
    """A property graph as two tables, the old one replaced."""
    vertices.write.mode("overwrite").parquet(os.path.join(path, "vertices"))
    edges.write.mode("overwrite").parquet(os.path.join(path, "edges"))


def violations(vertices, edges):
    """problem, key: ids that several vertices of a label bear, edges that repeat, and edges whose ends are no vertices."""
    twice = lambda d, *k: d.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), F.concat_ws(" ", *k).alias("key"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(vertices.select("id"), "id", "left_anti").select(F.lit("no vertex").alias("problem"), F.col("id").alias("key"))
    return twice(vertices, "label", "id").unionByName(twice(edges, "src", "dst", "type")).unionByName(ends)


def replace_graph(vertices, edges, path):
    """A property graph as a new version under `path`, taken up as a whole: returns its number.

    Both tables are written aside, checked (an error names a violation) and marked; readers take the last marked
    version. Then older ones and what lost writers left are wiped. A repeated call does the same again.
    """
    spark = vertices.sparkSession
    fs, root = _fs(spark, path)
    to = max([v for v, _ in _versions(spark, path)], default=0) + 1
    at = f"{path}/v{to}"
    for name, d in (("vertices", vertices), ("edges", edges)):
        d.write.mode("overwrite").parquet(f"{at}/{name}")
    bad = violations(*(spark.read.parquet(f"{at}/{n}") for n in ("vertices", "edges"))).limit(1).collect()
    if bad:
        fs.delete(_path(spark, at), True)
        raise ValueError(f"{bad[0]['problem']}: {bad[0]['key']}")
    fs.create(_path(spark, f"{at}/_COMMITTED"), True).close()
    for v, _ in _versions(spark, path):
        if v < to:
            fs.delete(_path(spark, f"{path}/v{v}"), True)
    return to


def read_graph(spark, path):
    """vertices, edges of the last whole version."""
    whole = [v for v, done in _versions(spark, path) if done]
    if not whole:
        raise FileNotFoundError(f"no whole graph under {path}")
    return tuple(spark.read.parquet(f"{path}/v{max(whole)}/{n}") for n in ("vertices", "edges"))


def _path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark, path):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()), _path(spark, path)


def _versions(spark, path):
    """(number, whether marked as whole) of the versions under a path."""
    fs, root = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return [(int(n[1:]), fs.exists(_path(spark, f"{path}/{n}/_COMMITTED"))) for n in names if n[:1] == "v" and n[1:].isdigit()]


def send_graph(vertices, edges, connect, rows=1000):
    """MERGEs vertices and then edges into a store by a callable of the caller's own: connect() gives, in each task,
    run(kind, rows) with lists of dicts of one label or type. Merging makes a repeated task harmless."""
    def send(kind, field):
        def part(it):
            run, held = connect(), {}
            for r in it:
                d = r.asDict(True)
                group = held.setdefault(d[field], [])
                group.append(d)
                if len(group) >= rows:
                    run(f"{kind}:{d[field]}", held.pop(d[field]))
            for k, group in held.items():
                run(f"{kind}:{k}", group)
        return part

    vertices.foreachPartition(send("vertex", "label"))
    edges.foreachPartition(send("edge", "type"))


def merge_statements(vertices, edges):
    """statement: one MERGE for each vertex and edge, for a graph store of the caller's own."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    v = vertices.select(F.concat(F.lit("MERGE (n:"), F.col("label"), F.lit(" {id: "), q("id"), F.lit("}) SET n.name = "), q("name")).alias("statement"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q("src"), F.lit("}), (b {id: "), q("dst"), F.lit("}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b)")).alias("statement"))
    return v.unionByName(e)


def append_metrics(df, path):
    df.write.mode("append").json(path)


def read_dataset(spark, path, form, validation=0.05, key=None):
    """Rows of csv, json or text with `part`: validation for a share of them by the hash of the whole row."""
    df = {"csv": lambda: spark.read.option("header", True).csv(path), "json": lambda: spark.read.json(path), "text": lambda: spark.read.text(path)}[form]()
    u = F.pmod(F.xxhash64(F.to_json(F.struct("*")) if key is None else F.col(key)), F.lit(10_000)) / 10_000
    return df.withColumn("part", F.when(u < validation, "validation").otherwise("train"))


def write_chart(points, path, width=640, height=400):
    """A curve of sorted values as SVG: `width` quantiles of points(dist), whatever their number."""
    qs = points.select(F.percentile_approx("dist", [i / (width - 1) for i in range(width)], 10_000)).first()[0] or []
    top = max(qs, default=0) or 1
    line = " ".join(f"{i},{height - q / top * height:.1f}" for i, q in enumerate(qs))
    with open(path, "w") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}"><polyline fill="none" stroke="black" points="{line}"/></svg>')
    return path


def transformed_lines(lines, func):
    """value -> func(value) (None drops the line), in process, a batch at a time; no program is started for a row."""
    def run(batches):
        import pandas as pd
        for b in batches:
            yield pd.DataFrame({"value": [x for x in map(func, b["value"]) if x is not None]}, dtype="object")

    return lines.mapInPandas(run, "value string")


#: Dependencies and conflicts known beforehand (fixed values).
KNOWN_DEPENDENCIES = {
    "ros-kinetic-desktop-full": ["ros-kinetic-rviz", "ros-kinetic-gazebo-ros-pkgs"],
    "gazebo7": ["libogre-1.9-dev", "libbullet-dev"],
    "tensorflow": ["numpy", "grpcio"],
    "keras": ["tensorflow", "numpy"],
    "numpy": ["python-dev", "libblas-dev"],
}
KNOWN_CONFLICTS = {"tensorflow": ["theano"], "gazebo7": ["gazebo9"]}


def known_pairs(spark, table):
    """pkg1, pkg2 of a table of constants such as KNOWN_DEPENDENCIES."""
    return spark.createDataFrame([(a, b) for a, bs in table.items() for b in bs], "pkg1 string, pkg2 string")


def read_names(spark, path):
    """name: the comma-separated names of a text file."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
