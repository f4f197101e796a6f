"""Syntax trees as rows: documents {type, value, children} become node tables keyed by their place.

node(file_sha, ord array<int>, parent_ord, depth, child_pos, type, value, leaf): `ord` is the path of
child numbers from the root (itself empty), so pre-order is the order by ord and a subtree is a
prefix. An empty value counts as none. Documents that are no tree go to the rejects. The same order in numbers: `pre` counts
nodes from the root (0), `last` is that of the last node at or below one. `cmdid` and `instr` are place and type of the
instruction, the child of the root at or above a node, and `parent_type` the type of its parent; null where there is none.
"""
import itertools
import json

from pyspark.sql import functions as F, Window as W

from drydock.functions.storage import spread

#: Rows that a task holds as Python objects before it passes them on, about.
HELD = 20000
NODE = "file_sha string, ord array<int>, parent_ord array<int>, depth int, child_pos int, type string, value string, leaf boolean, pre int, last int, cmdid int, instr string, parent_type string"
#: The same without places: what a window over one instruction needs.
NUMBERED = "file_sha string, depth int, child_pos int, type string, value string, leaf boolean, pre int, last int, cmdid int, instr string, parent_type string"

#: Value abstraction: name and pattern, searched anywhere in the value (fixed values).
ABSTRACTIONS = [
    ("ABS-SINGLE-SPACE", " "), ("ABS-DOUBLE-SPACE", "  "), ("ABS-NEW-LINE", r"\n"), ("ABS-TAB", r"\t"),
    ("ABS-URL-PROTOCOL-HTTP", "http://"), ("ABS-URL-PROTOCOL-HTTPS", "https://"), ("ABS-URL-PROTOCOL-FTP", "ftp://"), ("ABS-URL-PROTOCOL-GIT", "git://"),
    ("ABS-PROBABLY-URL", r"(?:https?|ftp)://[^\s/$.?#][^\s]*"), ("ABS-CONFIG-NO-DOCUMENT", "--no-document|--no-rdoc"),
    ("ABS-MAYBE-PATH", r"^/$|(^(?=/)|^\.|^\.\.)(/(?=[^/\x00])[^/\x00]+)*/?$"), ("ABS-MAYBE-BUILD-DIR", "/build|build/"), ("ABS-VAR-CACHE-YUM", "var/cache/yum"),
    ("ABS-MAYBE-SRC-DIR", "/src|src/"), ("ABS-USR-SRC-DIR", "/usr/src"), ("ABS-PATH-DOT-CACHE", r"/\.cache"), ("ABS-PATH-DOT-GEM", r"/\.gem"),
    ("ABS-EXTENSION-ASC", r"\.asc"), ("ABS-EXTENSION-TAR", r"\.tar"), ("ABS-PATH-ROOT-DIR", "/root"), ("ABS-URL-POOL", r"pool\."), ("ABS-URL-HA-POOL", r"ha\.pool\."),
    ("ABS-PATH-ABSOLUTE", "^/"), ("ABS-PATH-RELATIVE", r"^(\.)+/"), ("ABS-PATH-HOME", "^~"), ("ABS-PATH-VAR", "/var"), ("ABS-GLOB-STAR", r"^\*$"), ("ABS-APT-LISTS", "apt/lists"),
    ("ABS-TRUE", "(t|T)rue"), ("ABS-FALSE", "(f|F)alse"), ("ABS-FILENAME", r"^(\.?/)?([^/.\n]+/)*([^/.\n]*\.)*[^/.\n-]+$"),
]


def abstract_tags(value, only=None):
    """Sorted names of the abstractions that a value matches; null for null."""
    hits = [F.when(value.rlike(p), F.lit(n)) for n, p in ABSTRACTIONS if only is None or n in only]
    return F.when(value.isNotNull(), F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def walk(node, at=()):
    """(place, node) of a tree in pre-order; no recursion, so depth is bounded by memory alone."""
    todo = [(at, node)]
    while todo:
        place, n = todo.pop()
        yield place, n
        todo += [((*place, i), c) for i, c in reversed(list(enumerate(n.get("children") or [])))]


def valid(node):
    return isinstance(node, dict) and all(isinstance(n, dict) and isinstance(n.get("type"), str) and isinstance(n.get("children") or [], list) and all(isinstance(c, dict) for c in n.get("children") or []) for _, n in walk(node))


def parsed(text):
    """The tree of a JSON text; an error where it is none."""
    tree = json.loads(text)
    if not valid(tree):
        raise ValueError("not a tree of {type, children}")
    return tree


def mapped_trees(docs, func, schema, column="ast"):
    """docs(file_sha, ast JSON) -> the rows that func(file_sha, tree) yields and, with ok = false, the
    rejects: a struct column `row` of `schema`, and `error`. A failing document stops no other."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    kind = StructType().add("file_sha", "string").add("row", StructType.fromDDL(schema)).add("error", "string")
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            out = []
            for sha, text in zip(b.column(0), b.column(1)):
                sha = sha.as_py()
                try:
                    out += [{"file_sha": sha, "row": r, "error": None} for r in func(sha, parsed(text.as_py()))]
                except Exception as e:  # the dead letter holds what went wrong
                    out.append({"file_sha": sha, "row": None, "error": f"{type(e).__name__}: {e}"})
                if len(out) >= HELD:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(docs.select("file_sha", column)).mapInArrow(run, kind)


def good(rows):
    return rows.where("error IS NULL").select("row.*")


def rejects(rows):
    return rows.where("error IS NOT NULL").select("file_sha", F.col("error").alias("err"))


def _rows(sha, tree):
    each = list(walk(tree))
    number = {place: k for k, (place, _) in enumerate(each)}
    last = {}
    for place, n in reversed(each):  # children come before their parents
        last[place] = max([last[(*place, i)] for i in range(len(n.get("children") or []))], default=number[place])
    kinds = {place: n["type"] for place, n in each}
    for place, n in each:
        v = n.get("value")
        yield {"file_sha": sha, "ord": list(place), "parent_ord": list(place[:-1]) if place else None, "depth": len(place), "child_pos": place[-1] if place else 0, "type": n["type"], "value": None if v in (None, "") else str(v), "leaf": not n.get("children"), "pre": number[place], "last": last[place], "cmdid": place[0] if place else None, "instr": kinds[place[:1]] if place else None, "parent_type": kinds[place[:-1]] if place else None}


def _flat(tree, cols, places=None):
    """A tree's nodes put behind the columns of NUMBERED but file_sha, in one walk in pre-order; their places behind
    `places` if given. Returns their count; an error where it is no tree, with columns of unequal length then."""
    depths, at, kinds, values, leaves, pres, lasts, cmds, instrs, ups = cols
    start, parents = len(depths), []
    todo = [(tree, 0, 0, -1, None, None, None, ())]
    k = 0
    while todo:
        n, depth, pos, up, up_type, cmd, instr, place = todo.pop()
        kind, kids, value = n["type"], n.get("children") or [], n.get("value")
        if not isinstance(kind, str) or not isinstance(kids, list):
            raise ValueError("not a tree of {type, children}")
        if depth == 1:
            cmd, instr = pos, kind
        depths.append(depth)
        at.append(pos)
        kinds.append(kind)
        values.append(None if value is None or value == "" else value if type(value) is str else str(value))
        leaves.append(not kids)
        pres.append(k)
        cmds.append(cmd)
        instrs.append(instr)
        ups.append(up_type)
        parents.append(up)
        if places is not None:
            places.append(place)
            todo += [(kids[i], depth + 1, i, k, kind, cmd, instr, (*place, i)) for i in range(len(kids) - 1, -1, -1)]
        elif kids:
            todo += [(kids[i], depth + 1, i, k, kind, cmd, instr, place) for i in range(len(kids) - 1, -1, -1)]
        k += 1
    lasts += range(k)
    for i in range(k - 1, 0, -1):
        p, end = start + parents[i], lasts[start + i]
        if end > lasts[p]:
            lasts[p] = end
    return k


def _nodes(docs, schema):
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    import numpy as np
    import pyarrow as pa

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    narrow = [f for f in NUMBERED.replace(",", "").split()[2::2]]

    def lists(places, none):
        cuts = np.cumsum([0, *map(len, places)], dtype=np.int32)
        flat = np.fromiter(itertools.chain.from_iterable(places), np.int32, int(cuts[-1]))
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat), mask=pa.array(none, pa.bool_()) if none is not None else None)

    def table(shas, cols, places):
        got = dict(zip(narrow, cols), file_sha=shas)
        if places is not None:
            got["ord"], got["parent_ord"] = lists(places, None), lists([p[:-1] for p in places], [not p for p in places])
        made = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow)], schema=arrow)

    def run(batches):
        wide = "ord" in arrow.names
        new = lambda: ([], [[] for _ in narrow], [] if wide else None)
        for b in batches:
            shas, cols, places = new()
            for sha, text in zip(b.column(0), b.column(1)):
                n = len(shas)
                try:
                    more = _flat(json.loads(text.as_py()), cols, places)
                except Exception:  # no tree: nothing of it stays
                    for c in cols + ([places] if wide else []):
                        del c[n:]
                    continue
                shas += [sha.as_py()] * more
                if len(shas) >= HELD:
                    yield table(shas, cols, places)
                    shas, cols, places = new()
            yield table(shas, cols, places)

    return spread(docs.select("file_sha", "ast")).mapInArrow(run, schema)


def nodes(docs):
    """The node table of docs(file_sha, ast); the rows of _rows, made by columns; documents that are no tree have none."""
    return _nodes(docs, NODE)


def numbered(docs):
    """The node table without places: `pre` and `last` say what stands below what."""
    return _nodes(docs, NUMBERED)


def holds(node, types, key="file_sha"):
    """key, any, all: whether any node, or every one, is of the types."""
    on = F.col("type").isin(*types)
    return node.groupBy(key).agg(F.bool_or(on).alias("any"), F.bool_and(on).alias("all"))


def report(node, types=("UNKNOWN",), apart=()):
    """file_sha of the documents that hold a node of the types, some of them apart."""
    return holds(node, types).where(F.col("any") & ~F.col("file_sha").isin(*apart)).select("file_sha")


def lookup(docs, sha):
    """The first document of a file_sha: the filter reaches the files, the search ends at the first row."""
    return docs.where(F.col("file_sha") == sha).limit(1)


def tokens(node):
    """file_sha, tokens: `@@type@@` and `@@value@@` in pre-order."""
    mark = lambda c: F.concat(F.lit("@@"), c, F.lit("@@"))
    each = F.when(F.col("value").isNull(), F.array(mark(F.col("type")))).otherwise(F.array(mark(F.col("type")), mark(F.col("value"))))
    return node.groupBy("file_sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", each.alias("t")))), lambda x: x["t"])).alias("tokens"))


def _above():
    """Column: the places of a node's ancestors and its own."""
    up = F.transform(F.sequence(F.lit(0), F.size("ord")), lambda k: F.slice("ord", 1, k))
    return F.when(F.size("ord") == 0, F.array("ord")).otherwise(up)


def ancestors(node):
    """file_sha, root_ord, ord: each node under each of its ancestors and itself; as many rows as depths add up to."""
    return node.select("file_sha", F.explode(_above()).alias("root_ord"), "ord", "type", "leaf")


def paths(node):
    """file_sha, root_ord, leaf_ord, path: types from the root of each subtree to each of its leaves."""
    leaf = ancestors(node.where("leaf")).select("file_sha", "root_ord", F.col("ord").alias("leaf_ord"))
    between = F.transform(F.sequence(F.size("root_ord"), F.size("leaf_ord")), lambda k: F.slice("leaf_ord", 1, k))
    step = leaf.select("file_sha", "root_ord", "leaf_ord", F.explode(between).alias("ord")).join(node.select("file_sha", "ord", "type"), ["file_sha", "ord"])
    return step.groupBy("file_sha", "root_ord", "leaf_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type"))), lambda x: x["type"]).alias("path"))


def rendering(node):
    """file_sha, root_ord, text: `type value` of the nodes of each subtree, depth first."""
    each = node.select("file_sha", F.explode(_above()).alias("root_ord"), F.struct("ord", F.concat_ws(" ", "type", "value").alias("t")).alias("at"))
    return each.groupBy("file_sha", "root_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["t"]), " ").alias("text"))


def successor(place):
    """The first place behind the subtree of a node, in pre-order."""
    last = F.size(place) - 1
    return F.when(last < 0, F.array(F.lit(2**31 - 1))).otherwise(F.concat(F.slice(place, 1, F.greatest(last, F.lit(0))), F.array(F.get(place, last) + 1)))


def covered(flag, by=("file_sha",)):
    """Column: whether a node stands below a flagged one, itself not counted."""
    before = W.partitionBy(*by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.col("ord") < F.max(F.when(flag, successor(F.col("ord")))).over(before), F.lit(False))


def subtree_holds(flag, by=("file_sha",)):
    """Column: whether a node or one below it is flagged: the next flagged place in pre-order lies in its subtree."""
    after = W.partitionBy(*by).orderBy("ord").rowsBetween(0, W.unboundedFollowing)
    return F.coalesce(F.min(F.when(flag, F.col("ord"))).over(after) < successor(F.col("ord")), F.lit(False))


#: Node types that are worth what they say (fixed values).
CONSTANT = ("BASH-LITERAL", "BASH-VARIABLE-VALUE", "DOCKER-LITERAL")


def constant(by=("file_sha",)):
    """Column: whether a value is known: a literal, or a concatenation of literals and concatenations alone."""
    other = ~F.col("type").isin("BASH-CONCAT", *CONSTANT)
    return F.col("type").isin(*CONSTANT) | ((F.col("type") == "BASH-CONCAT") & ~subtree_holds(other, by))


def below_none(node, keep):
    """Nodes that stand below no node of the kept types (those themselves stay)."""
    return node.withColumn("_in", covered(F.col("type").isin(*keep))).where(~F.col("_in")).drop("_in")


#: Node types that keep their values, and types whose valued children do (fixed values).
KEEP_TYPES = ("SC-APT-GET-PACKAGE", "SC-APT-PACKAGE", "SC-APK-PACKAGE", "SC-YUM-PACKAGE", "SC-DNF-PACKAGE", "SC-NPM-PACKAGE", "SC-PIP-PACKAGE", "DOCKER-IMAGE-NAME", "DOCKER-IMAGE-REPO", "DOCKER-IMAGE-TAG", "DOCKER-PORT", "DOCKER-NAME", "BASH-VARIABLE")
KEEP_PARENTS = ("SC-APK-VIRTUAL",)


def annotated(node, keep=KEEP_TYPES, parents=KEEP_PARENTS):
    """The node table with abs_type: the abstractions of each value that is neither kept nor below a kept node, else null.

    Kept are nodes of some types and valued children of others.
    """
    over = node.where(F.col("type").isin(*parents)).select("file_sha", F.col("ord").alias("parent_ord"), F.lit(True).alias("_of"))
    n = node.join(over, ["file_sha", "parent_ord"], "left")
    kept = F.col("type").isin(*keep) | (F.coalesce("_of", F.lit(False)) & F.col("value").isNotNull())
    n = n.withColumn("_kept", kept).withColumn("_in", covered(F.col("_kept")))
    return n.select(*node.columns, F.when(~F.col("_kept") & ~F.col("_in"), abstract_tags(F.col("value"))).alias("abs_type"))


def retagged(node):
    """Leaves whose value is an URL get `-ABS-URL` behind their type."""
    url = F.col("leaf") & F.coalesce(F.col("value").rlike(dict(ABSTRACTIONS)["ABS-PROBABLY-URL"]), F.lit(False))
    return node.withColumn("type", F.when(url, F.concat("type", F.lit("-ABS-URL"))).otherwise(F.col("type")))


def interpolated(value, env):
    """${NAME} and $NAME of a string by a map column; names that it lacks stay. Longest names first."""
    names = F.array_sort(F.map_keys(env), lambda a, b: F.length(b) - F.length(a))
    def put(text, n):
        braced = F.replace(text, F.concat(F.lit("${"), n, F.lit("}")), F.element_at(env, n))
        # a bare name ends where no letter, digit or underscore follows
        plain = F.replace(F.replace(F.element_at(env, n), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(braced, F.concat(F.lit(r"\$"), n, F.lit("(?![A-Za-z0-9_])")), plain)
    return F.when(value.isNull(), value).otherwise(F.aggregate(names, value, put))


def edges(node):
    return node.where("parent_ord IS NOT NULL").select("file_sha", F.col("parent_ord").alias("src"), F.col("ord").alias("dst"))


#: Un-parsing of shell nodes: type -> (separator, prefix, suffix) of its children (fixed values).
JOINS = {
    "BASH-AND-IF": (" && ", "", ""), "BASH-AND-MEM": (" ", "", ""), "BASH-ARRAY": (" ", "( ", " )"), "BASH-ASSIGN": ("=", "", ""), "BASH-BACKGROUNDED": (" ", "", " &"),
    "BASH-BACKTICKED": (" ", "`", "`"), "BASH-BANGED": (" ", " ! ", ""), "BASH-BRACE-EXPANSION": (",", "{", "}"), "BASH-BRACE-GROUP": (" ; ", "{", "}"),
    "BASH-CASE-EXP-CASES": ("\t", "", ""), "BASH-CASE-EXPRESSIONS": (" ; ", "", ""), "BASH-CONCAT": ("", "", ""), "BASH-CONDITION-AND": (" && ", "", ""), "BASH-CONDITION-OR": (" || ", "", ""),
    "BASH-DOLLAR-PARENS": ("", "$(", ")"), "BASH-DOUBLE-QUOTED": ("", '"', '"'), "BASH-FOR-IN-BODY": (" ; ", "{", "}"), "BASH-IF-CONDITION": (" ", "if ", ""), "BASH-IF-ELSE": (" ; ", "else ", ""),
    "BASH-IF-ELSE-IF-EXP-CHECK": (" ; ", "", ""), "BASH-IF-ELSE-IF-EXPRESSION": (" ; el", "", "; fi"), "BASH-IF-EXPRESSION": (" ; ", "", "fi"), "BASH-IF-THEN": (" ; ", "then ", ""),
    "BASH-OR-IF": (" || ", "", ""), "BASH-PIPELINE": (" | ", "", ""), "BASH-REDIRECT-APPEND": (" ", ">> ", ""), "BASH-REDIRECT-OVERWRITE": (" ", "> ", ""), "BASH-REDIRECT-STDIN": (" ", "< ", ""),
    "BASH-SCRIPT": (" ; ", "", ""), "BASH-SUBSHELL": (" ; ", "$(", ")"), "BASH-WHILE-EXPRESSION": (" ; ", "{", "}"),
}
#: Un-parsing of values: type -> (prefix, suffix) (fixed values); other values stand bare.
QUOTES = {"BASH-SINGLE-QUOTED": ("'", "'"), "BASH-DOLLAR-SINGLE-QUOTED": ("$'", "'"), "BASH-VARIABLE": ("${", "}")}
#: Types without an un-parse rule (fixed values: prefixes and names).
NO_TEXT = ("DOCKER-", "BASH-ARITHMETIC-", "BASH-UNTIL-", "BASH-CONDITION-EMPTY", "BASH-DOLLAR-ARITHMETIC")


def unparsed(tree):
    """The shell text of a tree; UNKNOWN parts go; a type without a rule is an error."""
    text = {}
    for place, n in reversed(list(walk(tree))):
        kind, kids = n["type"], n.get("children") or []
        if kind.startswith(NO_TEXT):
            raise ValueError(f"no text for {kind}")
        if kind == "UNKNOWN":
            text[place] = None
        elif n.get("value") not in (None, "") and not kids:
            a, b = QUOTES.get(kind, ("", ""))
            text[place] = f"{a}{n['value']}{b}"
        else:
            sep, a, b = JOINS.get(kind, (" ", "", ""))
            parts = [t for i in range(len(kids)) if (t := text[(*place, i)]) is not None]
            text[place] = a + sep.join(parts) + b if parts or kind not in ("BASH-FOR-IN-BODY", "BASH-IF-ELSE", "BASH-WHILE-EXPRESSION") else None
    return (text[()] or "").strip()


def unparsed_documents(docs):
    """file_sha, text of docs(file_sha, ast); rejects by `tree.rejects`."""
    return mapped_trees(docs, lambda sha, t: [{"text": unparsed(t)}], "text string")


def edited(tree, edit):
    """Post-order edits: edit(node, parents) gives None, ("delete", up) or ("replace", up, node), where `up`
    says how many levels above the node the edit lands. A delete beats a replace; of several
    replaces the first wins; the children of what goes are not asked again."""
    def visit(n, parents):
        kids, bubbling = [], []
        for c in n.get("children") or []:
            new, asked = visit(c, [*parents, n])
            kids += [] if new is None else [new]
            bubbling += asked
        here = {k: n[k] for k in ("type", "value") if n.get(k) not in (None, "")} | {"children": kids}
        own = edit(here, parents)
        bubbling += [own] if own else []
        now = [e for e in bubbling if e[1] == 0]
        rest = [(e[0], e[1] - 1, *e[2:]) for e in bubbling if e[1] > 0]
        if any(e[0] == "delete" for e in now):
            return None, rest
        return (now[0][2] if now else here), rest
    return visit(tree, [])[0]
