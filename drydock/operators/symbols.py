"""Variables of build files over node tables: definitions folded in order, uses joined as of their place.

A definition holds from behind its own subtree on, so its own right side sees what was known before. Only
the definitions of a file meet in one fold; uses find theirs by a window over one name of one file.
Trees of any depth are flat rows here.
"""
from pyspark.sql import functions as F, Window as W

from drydock.functions.storage import cut

from . import relations
from .tree import successor

DEFINES = ("BASH-ASSIGN", "DOCKER-ENV", "DOCKER-ARG")
TEXTS = ("DOCKER-LITERAL", "DOCKER-PATH")
VARIABLE = "BASH-VARIABLE"
#: What a name without a value is worth (fixed value).
MISSING = "UNDEFINE"


def _place(place, late, depth):
    """Order of effects: where, definitions before uses, inner definitions before outer ones that end there too."""
    return F.struct(place.alias("place"), F.lit(late).alias("late"), (-depth).alias("up"))


#: A text in parts: ${NAME}, $NAME and what stands between them.
PARTS = r"\$\{[^${}]+\}|\$[A-Za-z0-9_]+|[^$]+|\$"


def named(part):
    """The name that a part of a text asks for, null where it is no variable."""
    return F.when(part.startswith("$") & (F.length(part) > 1), F.regexp_replace(part, r"[${}]", ""))


def put_in(text, env):
    """A text with its variables by a map column, in one pass: what is put in is not looked at again."""
    parts = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(env, F.coalesce(named(p), F.lit(""))), p)), "")


def definitions(node):
    """file_sha, at, name, parts: each definition with where it takes effect and its value in parts.

    parts(kind, text): `lit` as it stands, `var` the name of a variable, `text` a string to interpolate. A
    BASH-ASSIGN defines its first child's text; DOCKER-ENV and DOCKER-ARG each DOCKER-NAME by the
    DOCKER-LITERAL after it, trimmed and without double quotes, by MISSING where none follows.
    """
    d = node.where(F.col("type").isin(*DEFINES)).select("file_sha", F.col("ord").alias("def"), F.col("type").alias("kind"), "depth")
    below = W.partitionBy("file_sha").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    # of assignments that hold each other only the innermost owns a node: its last definition in pre-order
    n = node.withColumn("def", F.last(F.when(F.col("type") == "BASH-ASSIGN", F.col("ord")), ignorenulls=True).over(below)).where(F.col("ord") < successor(F.col("def")))
    n = n.withColumn("side", F.get("ord", F.size("def"))).where("value IS NOT NULL AND (leaf OR type = 'BASH-VARIABLE')")
    part = F.struct("ord", F.when(F.col("type") == VARIABLE, F.lit("var")).otherwise(F.lit("lit")).alias("kind"), F.col("value").alias("text"))
    sides = n.groupBy("file_sha", "def").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.struct("ord", "value")))), lambda x: x["value"]), "").alias("name"), F.array_sort(F.collect_list(F.when(F.col("side") > 0, part))).alias("p"))
    shell = d.where("kind = 'BASH-ASSIGN'").join(sides, ["file_sha", "def"]).select("file_sha", _place(successor(F.col("def")), 0, F.col("depth")).alias("at"), F.trim("name").alias("name"), F.transform("p", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("parts"))
    kids = node.where(F.col("type").isin("DOCKER-NAME", "DOCKER-LITERAL")).select("file_sha", F.col("parent_ord").alias("def"), "child_pos", "type", F.coalesce("value", F.lit("")).alias("value"))
    kids = kids.join(d.where("kind <> 'BASH-ASSIGN'"), ["file_sha", "def"])
    pair = W.partitionBy("file_sha", "def").orderBy("child_pos")
    kids = kids.withColumn("next", F.lead(F.struct("type", "value")).over(pair)).where("type = 'DOCKER-NAME'")
    value = F.when(F.col("next.type") == "DOCKER-LITERAL", F.trim(F.trim("next.value"), F.lit('"'))).otherwise(F.lit(MISSING))
    docker = kids.select("file_sha", _place(successor(F.col("def")), 0, F.col("depth")).alias("at"), F.trim("value").alias("name"), F.array(F.struct(F.lit("text").alias("kind"), value.alias("text"))).alias("parts"))
    return shell.unionByName(docker).where("name <> ''")


def symbol_table(node):
    """file_sha, at, name, value: each definition with its value, worked out from those before it in one fold."""
    each = definitions(node)
    seq = each.groupBy("file_sha").agg(F.array_sort(F.collect_list(F.struct("at", "name", "parts"))).alias("defs"))
    none = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("env"), F.array().cast("array<struct<at:struct<place:array<int>,late:int,up:int>,name:string,value:string>>").alias("out"))

    def said(env, p):
        known = F.try_element_at(env, p["text"])
        return F.when(p["kind"] == "var", F.coalesce(known, F.concat(F.lit("$"), p["text"]))).when(p["kind"] == "text", put_in(p["text"], env)).otherwise(p["text"])

    def step(acc, d):
        value = F.trim(F.array_join(F.transform(d["parts"], lambda p: said(acc["env"], p)), ""))

        def put(v):
            env = F.map_concat(F.map_filter(acc["env"], lambda k, _: k != d["name"]), F.map_from_arrays(F.array(d["name"]), F.array(v)))
            return F.struct(env.alias("env"), F.concat(acc["out"], F.array(F.struct(d["at"].alias("at"), d["name"].alias("name"), v.alias("value")))).alias("out"))

        return F.get(F.transform(F.array(value), put), F.lit(0))  # the value is worked out once

    return seq.select("file_sha", F.explode(F.aggregate("defs", none, step)["out"]).alias("d")).select("file_sha", "d.at", "d.name", "d.value")


def as_of(uses, table):
    """uses(file_sha, ord, name) with `bound`: the value of the name where it stands, null where it has none."""
    made = table.select("file_sha", "name", "at", F.col("value").alias("id"), F.lit(None).cast("array<int>").alias("ord"), F.lit(True).alias("creates"))
    ask = uses.select("file_sha", "name", _place(F.col("ord"), 1, F.lit(0)).alias("at"), F.lit(None).cast("string").alias("id"), "ord", F.lit(False).alias("creates"))
    return relations.last_creator(made.unionByName(ask), ["file_sha", "name"], "at").select("file_sha", "ord", "name", F.col("creator").alias("bound"))


def substituted(node):
    """The node table with its variables put in.

    A bound BASH-VARIABLE becomes a BASH-LITERAL, an unbound one BASH-VARIABLE-VALUE `$name`; ${NAME} and $NAME in
    DOCKER-LITERAL and DOCKER-PATH values are interpolated, names without a value stay.
    """
    node = cut(node)  # read six times below, so made once
    table = symbol_table(node)
    var = node.where((F.col("type") == VARIABLE) & F.col("value").isNotNull()).select("file_sha", "ord", F.col("value").alias("name"))
    text = node.where(F.col("type").isin(*TEXTS) & F.contains("value", F.lit("$")))
    asked = F.filter(F.transform(F.regexp_extract_all("value", F.lit(PARTS), F.lit(0)), named), lambda x: x.isNotNull())
    texts = text.select("file_sha", "ord", F.explode(F.array_distinct(asked)).alias("name"))
    known = as_of(var.unionByName(texts), table).where("bound IS NOT NULL").groupBy("file_sha", "ord").agg(F.map_from_entries(F.collect_list(F.struct("name", "bound"))).alias("env"))
    n = node.join(known, ["file_sha", "ord"], "left")
    is_var, bound = F.col("type") == VARIABLE, F.try_element_at("env", F.col("value"))
    value = F.when(is_var, F.coalesce(bound, F.concat(F.lit("$"), "value"))).when(F.col("type").isin(*TEXTS) & F.col("env").isNotNull(), put_in(F.col("value"), F.col("env"))).otherwise(F.col("value"))
    kind = F.when(is_var, F.when(bound.isNotNull(), "BASH-LITERAL").otherwise("BASH-VARIABLE-VALUE")).otherwise(F.col("type"))
    return n.select(*[kind.alias(c) if c == "type" else value.alias(c) if c == "value" else c for c in node.columns])
