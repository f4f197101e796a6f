"""Image, package and instruction relations over DataFrames of the caller's own.

Null keys take no part in joins and counts; repeated rows count once where a set is meant;
every array that stands for a set comes sorted.
"""
from pyspark.sql import functions as F, Window as W

from drydock.functions.storage import cut


def from_reference(children):
    """Image reference of `children` (array of struct type, value): name, tag, repository, alias.

    A name alone gets `:latest`; with an alias beside it the name stays bare; a tag without a
    value counts as none.
    """
    c = F.col(children) if isinstance(children, str) else children
    part = lambda kind: F.get(F.filter(c, lambda x: x["type"].endswith(kind) & (F.coalesce(x["value"], F.lit("")) != "")), F.lit(0))["value"]
    name, repo, tag = part("NAME"), part("REPO"), part("TAG")
    alias = F.exists(c, lambda x: x["type"].endswith("ALIAS"))
    full = F.concat(F.coalesce(F.concat(repo, F.lit("/")), F.lit("")), name)
    return F.when(name.isNull(), F.lit(None)).when(alias & repo.isNull() & tag.isNull(), name).otherwise(F.concat(full, F.lit(":"), F.coalesce(tag, F.lit("latest"))))


def package_words(text):
    """The blank-separated words of a package string."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def install_arguments(tokens):
    """Tokens of an install command that name packages."""
    return F.filter(tokens, lambda x: ~x.startswith("-") & (x != "install"))


def current_image(instr, file="file_sha", pos="pos"):
    """instr(file, pos, type, image, ...) with the image of the last FROM; rows before the first FROM go."""
    run = W.partitionBy(file).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return instr.withColumn("image", F.last(F.when(F.col("type") == "FROM", F.col("image")), ignorenulls=True).over(run)).where("image IS NOT NULL")


def image_relations(uses):
    """uses(file_sha, image, kind in used/install, name) -> image, used_pkgs, install_pkgs.

    What a file installs into an image is not among what it uses there; across files the sets unite.
    """
    on = lambda k: F.bool_or(F.coalesce(F.col("kind") == k, F.lit(False)))
    each = uses.groupBy("file_sha", "image", "name").agg(on("used").alias("u"), on("install").alias("i"))
    got = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("name"))))
    return each.groupBy("image").agg(got(F.col("u") & ~F.col("i")).alias("used_pkgs"), got(F.col("i")).alias("install_pkgs"))


def frequency(items):
    """items(image, pkg) -> pkg, freq: the images that list it."""
    return items.select("image", "pkg").distinct().groupBy("pkg").agg(F.count(F.lit(1)).alias("freq"))


def cooccurrence(items, least=2):
    """items(image, pkg) -> pkg1 < pkg2, n: images that list both, `least` at least."""
    one = items.select("image", "pkg").distinct()
    two = one.select("image", F.col("pkg").alias("pkg2"))
    return one.withColumnRenamed("pkg", "pkg1").join(two, "image").where("pkg1 < pkg2").groupBy("pkg1", "pkg2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def implicit_dependencies(items, least=2, threshold=0.5):
    """pkg1, pkg2, score: the share of the images of pkg1 that list pkg2, both ways."""
    pairs = cooccurrence(items, least)
    both = pairs.unionByName(pairs.select(F.col("pkg2").alias("pkg1"), F.col("pkg1").alias("pkg2"), "n"))
    score = F.col("n") / F.col("freq")
    return both.join(frequency(items).withColumnRenamed("pkg", "pkg1"), "pkg1").where(score >= threshold).select("pkg1", "pkg2", score.alias("score"))


def seen_pairs(known, items):
    """known(pkg1, pkg2) of which both packages occur in items."""
    p = items.select("pkg").distinct()
    return known.join(p.withColumnRenamed("pkg", "pkg1"), "pkg1", "left_semi").join(p.withColumnRenamed("pkg", "pkg2"), "pkg2", "left_semi").select(*known.columns)


def dependencies(items, known, least=2, threshold=0.5):
    """Explicit dependencies (confidence 1) of seen packages and implicit ones that they do not hold."""
    items = cut(items.select("image", "pkg").distinct())  # read six times below, so made once
    explicit = seen_pairs(known, items).select("pkg1", "pkg2").distinct()
    implied = implicit_dependencies(items, least, threshold).join(explicit, ["pkg1", "pkg2"], "left_anti")
    return explicit.select("pkg1", "pkg2", F.lit("explicit").alias("type"), F.lit(1.0).alias("confidence")).unionByName(implied.select("pkg1", "pkg2", F.lit("implicit").alias("type"), F.col("score").alias("confidence")))


def first_match(array, predicate):
    """The first element of an array for which predicate holds, or null."""
    return F.get(F.filter(array, predicate), F.lit(0))


def first_base_image(instr, key="doc_id"):
    """The content of the first FROM of each document."""
    return instr.where("type = 'FROM'").groupBy(key).agg(F.min_by("content", "pos").alias("base_image"))


def last_creator(events, key, at, floor=None):
    """As-of join: for each use the last id at which its key was created before, `floor` at least.

    events(key..., at, id, creates boolean, [floor]) -> rows of uses with `creator`. `at` may be several columns.
    """
    before = W.partitionBy(*key).orderBy(*([at] if isinstance(at, str) else at)).rowsBetween(W.unboundedPreceding, -1)
    made = F.last(F.when(F.col("creates"), F.col("id")), ignorenulls=True).over(before)
    got = F.greatest(made, F.col(floor)) if floor else made
    return events.withColumn("creator", F.coalesce(got, F.col(floor)) if floor else got).where("NOT creates")


def creator_since(events, key, at, start):
    """Interval as-of join: the last id made before each use, where it is after `start`; null where it is not.

    Where start is null any id counts.
    """
    made = last_creator(events, key, at)
    return made.withColumn("creator", F.when(F.col(start).isNull() | (F.col("creator") > F.col(start)), F.col("creator")))


def conflicts(relations, candidates):
    """relations(src, dst) of which both ends are among candidates(grp, id) of one group -> grp, src, dsts."""
    s, d = candidates.select("grp", F.col("id").alias("src")), candidates.select(F.col("grp").alias("g2"), F.col("id").alias("dst"))
    hit = s.join(relations, "src").join(d, (F.col("grp") == F.col("g2")) & (relations["dst"] == d["dst"])).select("grp", "src", relations["dst"].alias("dst"))
    return hit.groupBy("grp", "src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


def upsert(old, new, key, order):
    """Keyed upsert, last wins: of the rows of a key the one with the largest `order`."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
