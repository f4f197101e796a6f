"""Build files as relations: rules joined to syntax trees, and what each instruction depends on.

Everything starts from a node table (tree.nodes, or tree.numbered without places). A subtree is an interval of the
pre-order, so what stands below a command is found by windows over the nodes of one instruction in the order of their
numbers, never by pairing nodes with ancestors. Rules and grammars are tables of constants (sources.rules), joined by type.
A window sorts the nodes of one instruction, or the events of one path or package of one file; windows and
aggregates of one instruction follow one shuffle. Tables that grow with the input are merged, never sent to the driver
as a broadcast, however small their files make them look.
"""
from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from drydock.functions.storage import cut

from . import relations, tree
from .tree import covered  # noqa: F401 (by places; here by numbers)

INSTR = ["file_sha", "cmdid"]
UNDEFINED, LITERAL, CONCAT = "BASH-UNDEFINE-COMMAND", "BASH-LITERAL", "BASH-CONCAT"


def ordered():
    """The nodes of an instruction in order."""
    return W.partitionBy(*INSTR).orderBy("pre")


def merged(left, right, on, how="inner"):
    return left.join(right.hint("merge"), on, how)


def in_order(of):
    """Column: the values of structs (place, t) of a group in the order of their places."""
    return F.transform(F.sort_array(F.collect_list(of)), lambda x: x["t"])


def instructions(node):
    """file_sha, cmdid, type of the instructions: the children of the root, in order."""
    return node.where("depth = 1").select("file_sha", "cmdid", "type")


def within(node, kinds=None):
    """The nodes below the root, those of instructions of some kinds only if given."""
    return node.where(F.col("instr").isin(*kinds) if kinds else "depth >= 1")


def below(flag):
    """Column: whether a node stands below a flagged one of its instruction, itself not counted."""
    before = ordered().rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.col("pre") <= F.max(F.when(flag, F.col("last"))).over(before), F.lit(False))


def owned(node, flag):
    """node(file_sha, cmdid, ...) with `cmd` (pre, last, depth, type): the topmost flagged node at or above each; of those
    below one, `part` (pre, type) is the child of it and `item` the number of the grandchild that they belong to."""
    run = ordered().rowsBetween(W.unboundedPreceding, 0)
    last = lambda on, of: F.last(F.when(on, of), ignorenulls=True).over(run)
    n = node.withColumn("top", flag & ~below(flag))
    n = n.withColumn("cmd", last(F.col("top"), F.struct("pre", "last", "depth", "type"))).where("pre <= cmd.last")
    down = F.col("depth") - F.col("cmd.depth")
    n = n.withColumn("part", last(down == 1, F.struct("pre", "type"))).withColumn("item", last(down == 2, F.col("pre")))
    return n.withColumn("part", F.when(down >= 1, F.col("part"))).withColumn("item", F.when(down >= 2, F.col("item")))


def item_texts(own):
    """The items of `owned` rows with their text: file_sha, cmdid, cmd, cmd_type, part_type, item, alone, text. Rows with a
    column `alone` that is set are items of their value.

    A text is what the nodes of an item say in order: literals, $ and the name of a variable, values; below a
    concatenation only the parts of it count, nested concatenations included.
    """
    n = (own if "alone" in own.columns else own.withColumn("alone", F.lit(False))).where("alone OR item IS NOT NULL")
    stop = (F.col("parent_type") == CONCAT) & (F.col("type") != CONCAT)
    n = n.withColumn("mute", below(stop))  # an item holds all that is below its nodes, so none of another is muted
    said = F.when(F.col("alone"), F.col("value")).when(F.col("mute") | (F.col("type") == CONCAT), F.lit("")).when(F.col("type") == "BASH-VARIABLE", F.concat(F.lit("$"), "value")).otherwise(F.col("value"))
    n = n.select(*INSTR, F.col("cmd.pre").alias("cmd"), F.col("cmd.type").alias("cmd_type"), F.col("part.type").alias("part_type"), "item", "alone", F.struct("pre", F.coalesce(said, F.lit("")).alias("t")).alias("said"))
    return n.groupBy(*INSTR, "cmd", "cmd_type", "part_type", "item", "alone").agg(F.array_join(in_order(F.col("said")), "").alias("text"))


def is_command():
    return (F.col("type") == UNDEFINED) | F.col("type").startswith("SC")


def commands(node):
    """The `owned` rows of the commands of RUN instructions."""
    return owned(within(node, ["DOCKER-RUN"]), is_command())


def installed(node, rules, own=None):
    """file_sha, cmdid, pkg: packages that RUN instructions install, by rules(cmd, part) or as the words of an
    undefined command that says install. Commands within commands do not count. `own`: commands(node) if it is there."""
    own = commands(node) if own is None else own
    ruled = own.where((F.col("cmd.type") != UNDEFINED) & F.col("part").isNotNull()).join(F.broadcast(rules.select(F.col("cmd").alias("r_cmd"), F.col("part").alias("r_part"))), (F.col("cmd.type") == F.col("r_cmd")) & (F.col("part.type") == F.col("r_part")), "left_semi")
    listed = item_texts(ruled).select(*INSTR, F.col("text").alias("pkg"))
    words = own.where((F.col("cmd.type") == UNDEFINED) & (F.col("pre") == F.col("part.pre")) & (F.col("type") == LITERAL)).groupBy(*INSTR, "cmd.pre").agg(F.collect_set("value").alias("w")).where(F.array_contains("w", "install"))
    said = words.select(*INSTR, F.explode(relations.install_arguments(F.col("w"))).alias("pkg"))
    return listed.unionByName(said).distinct()


def used(node, names, own=None):
    """file_sha, cmdid, pkg: commands that RUN instructions call: those of names(command, prefix, name) whose
    prefix begins and whose name equals the type, or what an undefined command is called."""
    top = (commands(node) if own is None else own).where("top")
    known = top.join(F.broadcast(names), (F.col("type") == F.col("name")) & F.col("type").startswith(F.col("prefix")))
    return known.select(*INSTR, F.col("command").alias("pkg")).unionByName(top.where(F.col("type") == UNDEFINED).select(*INSTR, F.col("value").alias("pkg"))).where("pkg IS NOT NULL").distinct()


def touched(node, rules):
    """file_sha, cmdid, source, target: paths by rules(cmd, multi, last, roles), in document order.

    A literal below no ruled command that looks like a file name or a path counts as both.
    """
    cmds = F.broadcast(rules.select("cmd").withColumnRenamed("cmd", "r_cmd").withColumn("ruled", F.lit(True)))
    n = within(node, ["DOCKER-RUN"]).join(cmds, F.col("type") == F.col("r_cmd"), "left").drop("r_cmd")
    found = ("ABS-FILENAME", "ABS-MAYBE-PATH")
    tagged = F.arrays_overlap("abs_type", F.array(*map(F.lit, found))) if "abs_type" in node.columns else reduce(lambda a, b: a | b, [F.col("value").rlike(dict(tree.ABSTRACTIONS)[k]) for k in found])
    path = F.coalesce((F.col("type") == LITERAL) & tagged, F.lit(False))
    own = owned(n.withColumn("path", path), F.coalesce("ruled", F.lit(False)) | path)
    # a path below no command is an item of its own; all items of an instruction stay where its nodes are
    item = item_texts(own.withColumn("alone", F.col("top") & F.col("path") & F.col("ruled").isNull()))
    item = item.join(F.broadcast(rules.withColumnRenamed("cmd", "r_cmd").withColumnRenamed("last", "takes_last")), F.col("cmd_type") == F.col("r_cmd"), "left").where("alone OR r_cmd IS NOT NULL")
    of = lambda role: in_order(F.when(F.try_element_at("roles", F.col("part_type")) == role, F.struct("item", F.col("text").alias("t"))))
    c = item.groupBy(*INSTR, "cmd", "alone", "multi", "takes_last").agg(of("source").alias("s"), of("target").alias("t"), of("path").alias("p"), F.max("text").alias("text"))
    pops = F.col("takes_last") & (F.size("t") == 0) & (F.size("p") > 0)
    c = c.select(*INSTR, F.col("cmd").alias("at"), "alone", "text", "multi", "s", F.when(pops, F.slice("p", -1, 1)).otherwise(F.col("t")).alias("t"), F.when(pops, F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.col("p")).alias("p"))
    c = c.withColumn("s", F.when(F.col("multi"), F.col("p")).otherwise(F.col("s")))
    name = F.replace(F.substring_index(F.get("s", F.size("s") - 1), "/", -1), F.lit(".git"), F.lit(""))
    target = F.when((F.size("t") == 0) & (F.size("s") > 0), F.array(name)).otherwise(F.col("t"))
    itself = lambda c: F.when(F.col("alone"), F.array("text")).otherwise(c)
    c = c.select(*INSTR, F.struct("at", itself(F.col("s")).alias("source"), itself(target).alias("target")).alias("x"))
    flat = lambda k: F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x[k]))
    return c.groupBy(*INSTR).agg(flat("source").alias("source"), flat("target").alias("target"))


def opaque(node, names=None):
    """file_sha, cmdid: RUN instructions that are barriers, as nothing is known of them.

    Without names a RUN of no content; with names(name) also one that holds no command of the grammar.
    """
    run = instructions(node).where("type = 'DOCKER-RUN'").select(*INSTR)
    below = within(node, ["DOCKER-RUN"]).where("depth > 1")
    if names is not None:
        below = below.join(F.broadcast(names.select(F.col("name").alias("type")).distinct()), "type", "left_semi").select(*INSTR).unionByName(below.where(F.col("type") == UNDEFINED).select(*INSTR))
    return merged(run, below.select(*INSTR).distinct(), INSTR, "left_anti")


def staged(node, barriers=None):
    """Instructions with `base`, the last FROM or barrier before each (0 at first; a FROM is its own), and
    `workdir`, the last WORKDIR before it, `./` at first. Barriers are rows (file_sha, cmdid) or a column of the instruction."""
    follow = W.partitionBy("file_sha").orderBy("pre")
    n = node.where("depth = 1 OR depth = 2 AND child_pos = 0")
    n = n.withColumn("next", F.lead(F.struct("depth", "value")).over(follow)).where("depth = 1")
    n = n.withColumn("dir", F.when(F.col("next.depth") == 2, F.col("next.value")))
    if isinstance(barriers, DataFrame):
        n = merged(n, barriers.select(*INSTR, F.lit(True).alias("barrier")), INSTR, "left")
    else:
        n = n.withColumn("barrier", F.lit(None).cast("boolean") if barriers is None else barriers)
    i = n.select(*INSTR, "pre", "type", F.coalesce("barrier", F.lit(False)).alias("barrier"), "dir")
    before = follow.rowsBetween(W.unboundedPreceding, -1)
    last = lambda on, c: F.last(F.when(on, F.col(c)), ignorenulls=True).over(before)
    base = F.when(F.col("type") == "DOCKER-FROM", F.col("cmdid")).otherwise(F.coalesce(last((F.col("type") == "DOCKER-FROM") | F.col("barrier"), "cmdid"), F.lit(0)))
    return i.withColumn("base", base).withColumn("workdir", F.coalesce(last(F.col("type") == "DOCKER-WORKDIR", "dir"), F.lit("./"))).select(*INSTR, "type", "barrier", "base", "workdir", F.when(F.col("type") == "DOCKER-WORKDIR", F.col("dir")).alias("dir"))


def placed(paths, workdir):
    """Column: paths below the working directory, slashes squeezed; those that begin with ./ stay."""
    return F.transform(paths, lambda p: F.when(p.startswith("./"), p).otherwise(F.regexp_replace(F.concat(workdir, F.lit("/"), p), "/+", "/")))


def copies(node):
    """file_sha, cmdid, sources, targets, stage of COPY and ADD instructions, paths as written.

    stage is the cmdid of the first FROM whose alias --from names, null without one or with an URL among the
    sources. Of an URL the last part is the name; several sources are targets themselves.
    """
    n = within(node, ["DOCKER-COPY", "DOCKER-ADD"]).where("depth IN (2, 3)")
    n = n.withColumn("next", F.lead(F.struct("depth", "type", "value")).over(ordered())).where("depth = 2")
    first = lambda c: F.when(F.col("next.depth") == 3, F.col(f"next.{c}"))
    part = n.select(*INSTR, "pre", "type", "value", first("type").alias("kind"), first("value").alias("path"))
    url = F.coalesce(F.col("kind").endswith("URL"), F.lit(False))
    name = F.when(url, F.substring_index("path", "/", -1)).otherwise(F.coalesce("path", "value"))
    source = F.col("type").endswith("SOURCE")
    listed = in_order(F.when(source, F.struct("pre", name.alias("t"))))
    ends = lambda end, of: F.max(F.when(F.col("type").endswith(end), F.struct("pre", of.alias("t"))))["t"]
    c = part.groupBy(*INSTR).agg(listed.alias("sources"), ends("TARGET", F.coalesce("path", "value")).alias("target"), ends("FROM", F.col("value")).alias("origin"), F.bool_or(source & url).alias("remote"))
    alias = node.where("type = 'DOCKER-IMAGE-ALIAS' AND depth = 2").groupBy("file_sha", F.col("value").alias("origin")).agg(F.min("cmdid").alias("first"))
    at = merged(c, alias, ["file_sha", "origin"], "left")
    stage = F.when(~F.col("remote") & (F.col("first") < F.col("cmdid")), F.col("first"))
    return at.select(*INSTR, "sources", F.when(F.size("sources") > 1, F.col("sources")).otherwise(F.array("target")).alias("targets"), stage.alias("stage"))


def last_made(asks, makes, key, own_first):
    """As-of join of one file's events: asks(file_sha, cmdid, key, floor) with `creator`, the last makes(file_sha, cmdid,
    key) before each, `floor` at least where it is not null. With own_first what an instruction makes itself counts."""
    e = makes.select("file_sha", key, "cmdid", F.lit(0 if own_first else 1).alias("late"), F.col("cmdid").alias("id"), F.lit(True).alias("creates"), F.lit(None).cast("int").alias("floor"))
    u = asks.select("file_sha", key, "cmdid", F.lit(1 if own_first else 0).alias("late"), F.col("cmdid").alias("id"), F.lit(False).alias("creates"), "floor")
    return relations.last_creator(e.unionByName(u), ["file_sha", key], ["cmdid", "late"], "floor").select("file_sha", "cmdid", key, "creator")


def stage_copies(copy, makes, starts):
    """file_sha, cmdid, dep of copies from a stage: the last maker of each source since that stage began, else the
    last instruction of the stage; nothing where no later stage has begun. starts(file_sha, cmdid): the FROMs."""
    asks = copy.where("stage IS NOT NULL").select(*INSTR, "stage", F.explode("sources").alias("path"))
    made = last_made(asks.select(*INSTR, "path", F.lit(None).cast("int").alias("floor")).distinct(), makes, "path", False)
    follow = W.partitionBy("file_sha").orderBy("cmdid")
    after = starts.select("file_sha", F.col("cmdid").alias("stage"), F.lead("cmdid").over(follow).alias("next"))
    got = merged(merged(asks, made, [*INSTR, "path"]), after, ["file_sha", "stage"], "left")
    end = F.when(F.col("next") <= F.col("cmdid"), F.col("next") - 1)
    return got.select(*INSTR, F.when(F.col("creator") > F.col("stage"), F.col("creator")).otherwise(end).alias("dep")).where("dep IS NOT NULL")


def barrier_dependencies(staged_rows, deps):
    """file_sha, cmdid, dep of barriers: the instructions since the base on which nothing before the barrier depends.

    A barrier begins a segment, so only the other instructions' deps(file_sha, cmdid, dep) can rule one out, and the first
    that does so decides for it: one minimum and one join within segments.
    """
    first = deps.where("dep <> cmdid").groupBy("file_sha", F.col("dep").alias("d_id")).agg(F.min("cmdid").alias("needed")).withColumnRenamed("file_sha", "d_file")
    one = staged_rows.select("file_sha", F.col("cmdid").alias("dep"), F.when((F.col("type") == "DOCKER-FROM") | F.col("barrier"), F.col("cmdid")).otherwise(F.col("base")).alias("base"))
    one = merged(one, first, (F.col("file_sha") == F.col("d_file")) & (F.col("dep") == F.col("d_id")), "left").select("file_sha", "base", "dep", "needed")
    # a segment ends at its next barrier or FROM: each barrier meets its own segment only
    stop = staged_rows.where("barrier").select("file_sha", "cmdid", "base")
    return merged(stop, one, ["file_sha", "base"]).where("dep < cmdid AND (needed IS NULL OR needed >= cmdid)").select(*INSTR, "dep")


def reordered(table):
    """table(file_sha, cmdid, cmd_dep) with `level`, the longest way of dependencies below an instruction, and `place`, its
    number by level and then by cmdid: nothing stands before what it depends on.

    Dependencies lead to smaller cmdids, so one fold over a file's instructions in order gives all levels, and their order
    the places. A table that is dealt by file_sha already moves no more; files of no name go.
    """
    rows = table.where("file_sha IS NOT NULL").groupBy("file_sha").agg(F.sort_array(F.collect_list(F.struct("cmdid", "cmd_dep"))).alias("i"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))
    deepest = lambda env, deps: F.coalesce(F.array_max(F.transform(deps, lambda d: F.try_element_at(env, d))) + 1, F.lit(0))
    step = lambda env, x: F.map_concat(env, F.map_from_arrays(F.array(x["cmdid"]), F.array(deepest(env, x["cmd_dep"]))))
    each = F.arrays_zip(F.col("i"), F.map_values(F.aggregate("i", none, step)).alias("level"))
    each = F.transform(each, lambda z: F.struct(z["level"].alias("level"), z["i"]["cmdid"].alias("cmdid"), z["i"]["cmd_dep"].alias("cmd_dep")))
    out = rows.select("file_sha", F.posexplode(F.sort_array(each)).alias("place", "x")).select("file_sha", "x.cmdid", "x.cmd_dep", "x.level", "place")
    more = [c for c in table.columns if c not in out.columns]
    return merged(table, out.drop("cmd_dep"), INSTR) if more else out.select(*table.columns, "level", "place")


#: What the dependency table reads of a node table.
READ = ["file_sha", "cmdid", "pre", "last", "depth", "child_pos", "type", "value", "leaf", "instr", "parent_type"]


def dependency_table(node, install_rules, file_rules, names, strict=False, touches=None):
    """file_sha, cmdid, type, cmd_dep, install_pkg, used_pkg, file_relate of all instructions of a node table.

    An instruction depends on its base; a RUN on the last install of each command it calls and the last maker of each file it
    reads, not before the base; a copy from a stage on what made its sources there; a barrier (see opaque; `strict`
    asks the grammar) on all since the base that nothing depends on. Arrays that stand for sets come sorted.
    `touches`: touched(node, file_rules) if it is there.
    """
    node = cut(node.select(*READ))
    # without the grammar a barrier is a RUN of no content, which a node says of itself
    s = cut(staged(node, opaque(node, names) if strict else (F.col("type") == "DOCKER-RUN") & F.col("leaf")))
    own = cut(commands(node).select(*INSTR, "pre", "last", "type", "value", "parent_type", "top", "cmd", "part", "item"))
    inst, call = installed(node, install_rules, own), used(node, names, own)
    if strict:
        seen = s.where("NOT barrier").select(*INSTR)
        inst, call = merged(inst, seen, INSTR, "left_semi"), merged(call, seen, INSTR, "left_semi")
    inst, call, copy = cut(inst), cut(call), cut(copies(node))
    named = (touched(node, file_rules) if touches is None else touches).unionByName(copy.select(*INSTR, F.array().cast("array<string>").alias("source"), F.col("targets").alias("target")))
    put = merged(named, s.where("NOT barrier").select(*INSTR, "workdir"), INSTR)
    put = put.select(*INSTR, placed(F.col("source"), F.col("workdir")).alias("source"), placed(F.col("target"), F.col("workdir")).alias("target"))
    move = s.where("type = 'DOCKER-WORKDIR' AND dir IS NOT NULL").select(*INSTR, F.array("dir").alias("source"), F.array("dir").alias("target"))
    files = cut(put.unionByName(move))
    makes = files.select(*INSTR, F.explode("target").alias("path"))
    floor = s.select(*INSTR, F.col("base").alias("floor"))
    by_pkg = last_made(merged(call, floor, INSTR), inst, "pkg", True)
    by_path = last_made(merged(files.select(*INSTR, F.explode("source").alias("path")).distinct(), floor, INSTR), makes, "path", False)
    base = s.where("type <> 'DOCKER-FROM' AND NOT barrier").select(*INSTR, F.col("base").alias("dep"))
    staged_copy = stage_copies(copy, makes, s.where("type = 'DOCKER-FROM'"))
    deps = reduce(lambda a, b: a.unionByName(b), [base, *(d.select(*INSTR, F.col("creator").alias("dep")) for d in (by_pkg, by_path)), staged_copy]).where("dep <> cmdid").distinct()
    deps = cut(deps)
    # what is known of an instruction meets in one aggregate
    kinds = {"dep": "int", "inst": "string", "call": "string", "files": "struct<source:array<string>,target:array<string>>"}
    row = lambda d, c, of: d.select(*INSTR, *[(F.col(of) if isinstance(of, str) else of).cast(k).alias(c) if n == c else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    known = reduce(lambda a, b: a.unionByName(b), [row(deps.unionByName(barrier_dependencies(s, deps)), "dep", "dep"), row(inst, "inst", "pkg"), row(call, "call", "pkg"), row(files, "files", F.struct("source", "target"))])
    sets = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    known = known.groupBy(*INSTR).agg(sets("dep"), sets("inst"), sets("call"), F.first("files", ignorenulls=True).alias("files"))
    out = merged(s, known, INSTR, "left")
    none = lambda c, name, kind="string": F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(name)
    relate = F.struct(none("files.source", "source"), none("files.target", "target")).alias("file_relate")
    return out.select(*INSTR, "type", none("dep", "cmd_dep", "int"), none("inst", "install_pkg"), none("call", "used_pkg"), relate)
