"""Pattern mining: itemsets, association rules, sequences, and their additive upkeep."""
from pyspark.sql import functions as F

from drydock.functions.storage import cut


def item_counts(tx, least=0.0):
    """tx(tx_id, items) -> item, n, first: occurrences of items whose n / transactions reaches `least`."""
    total = tx.agg(F.count(F.lit(1)).alias("total"))
    each = tx.select("tx_id", F.posexplode("items").alias("pos", "item"))
    return each.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tx_id", "pos")).alias("first")).join(F.broadcast(total)).where(F.col("n") / F.col("total") >= least).select("item", "n", "first")


def prefix_itemsets(tx, least=0.5):
    """Distinct prefixes of the transactions' frequent items in descending frequency, as sorted sets.

    Ties keep the order of the transaction, as a stable sort does.
    """
    often = item_counts(tx, least).select("item", "n")
    each = tx.select("tx_id", F.posexplode("items").alias("pos", "item")).join(often, "item")
    rows = each.groupBy("tx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pos", "item"))), lambda x: x["item"]).alias("path"))
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("prefix")).distinct().select(F.array_sort("prefix").alias("itemset"))


def prefix_tree(tx, least=0.5):
    """path array, n: the nodes of a batch's prefix tree, each the items from the root to it, with the transactions
    that pass it. Items are those frequent in the batch, by descending frequency, ties as they stand."""
    often = item_counts(tx, least).select("item", "n")
    each = tx.select("tx_id", F.posexplode("items").alias("pos", "item")).join(often, "item")
    rows = each.groupBy("tx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pos", "item"))), lambda x: x["item"]).alias("path"))
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def grown_tree(store, batch, least=0.5, version=None):
    """path, n: the tree of a store (streaming.PatternStore) with a batch taken in; the nodes are its patterns.

    A tree is an upsert of its nodes, keyed by path: no batch is read twice and a repeated version is void.
    """
    new = prefix_tree(batch, least).select(F.to_json("path").alias("pattern"), F.col("n").alias("support"))
    got = store.upsert(new, version).scan()
    return got.select(F.from_json("pattern", "array<string>").alias("path"), F.col("support").alias("n"))


def tree_itemsets(tree):
    """itemset: a sorted set for each node of a tree; two paths of the same items are two rows."""
    return tree.select(F.array_sort("path").alias("itemset"))


def updated_sets(itemsets, tree):
    """The multiset of itemsets after an update: those of the grown tree are added, single items go."""
    return itemsets.unionByName(tree_itemsets(tree)).where(F.size("itemset") >= 2)


def rules(itemsets, confidence=0.5, lift=1.0):
    """itemsets(itemset) (a multiset) -> antecedent, consequent, support, confidence, lift.

    Support of a set is the share of the itemsets that hold it. Sides are all proper subsets, by
    a bit mask over the set, so an itemset must have at most 20 items.
    """
    n, longest = itemsets.agg(F.count(F.lit(1)), F.max(F.size("itemset"))).first()
    if (longest or 0) > 20:
        raise ValueError(f"an itemset of {longest} items has too many subsets: mine shorter ones")
    wide = itemsets.where(F.size("itemset") >= 2)
    masks = F.explode(F.expr("sequence(1L, shiftleft(1L, size(itemset)) - 2)"))
    side = lambda bit: F.expr(f"filter(transform(itemset, (x, i) -> CASE WHEN (shiftright(mask, i) & 1) = {bit} THEN x END), x -> x IS NOT NULL)")
    cand = wide.select("itemset", masks.alias("mask")).select(side(1).alias("antecedent"), side(0).alias("consequent"))
    asked = cand.select(F.explode(F.array("antecedent", "consequent", F.array_sort(F.array_union("antecedent", "consequent")))).alias("part")).distinct()
    # each part meets the itemsets that hold its first item only
    held = itemsets.withColumn("row", F.monotonically_increasing_id()).select("row", "itemset", F.explode(F.array_distinct("itemset")).alias("item"))
    sup = asked.withColumn("item", F.get("part", F.lit(0))).join(held, "item").where(F.size(F.array_except("part", "itemset")) == 0).groupBy("part").agg((F.count(F.lit(1)) / n).alias("s"))
    of = lambda c, name: sup.select(F.col("part").alias(c), F.col("s").alias(name))
    got = cand.withColumn("all", F.array_sort(F.array_union("antecedent", "consequent"))).join(of("all", "support"), "all").join(of("antecedent", "sa"), "antecedent").join(of("consequent", "sc"), "consequent")
    got = got.select("antecedent", "consequent", "support", (F.col("support") / F.col("sa")).alias("confidence"), (F.col("support") / (F.col("sa") * F.col("sc"))).alias("lift"))
    return got.where((F.col("confidence") >= confidence - 1e-12) & (F.col("lift") >= lift - 1e-12))


def updated(old, batch, least=0.5):
    """The multiset of itemsets after a further batch: its prefixes are added, single items go."""
    return old.unionByName(prefix_itemsets(batch, least)).where(F.size("itemset") >= 2)


def pair_rules(tx, least=0.0, confidence=0.5, lift=1.0):
    """tx(tx_id, item) -> rules of one item on either side over distinct transactions."""
    one = tx.select("tx_id", "item").distinct()
    n = one.agg(F.countDistinct("tx_id").alias("total"))
    freq = one.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    pairs = one.withColumnRenamed("item", "a").join(one.withColumnRenamed("item", "b"), "tx_id").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = pairs.join(freq.select(F.col("item").alias("a"), F.col("f").alias("fa")), "a").join(freq.select(F.col("item").alias("b"), F.col("f").alias("fb")), "b").join(F.broadcast(n))
    got = got.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), (F.col("n") / F.col("total")).alias("support"), (F.col("n") / F.col("fa")).alias("confidence"), (F.col("n") * F.col("total") / (F.col("fa") * F.col("fb"))).alias("lift"))
    return got.where((F.col("support") >= least) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def sequences(db, least, longest=None):
    """db(seq_id, seq array) -> pattern array, support: projection on first occurrences, of any length or up to `longest`.

    Level by level: the database projected on a pattern is the place after its first match in
    each sequence that has one, so a level is one explode, one minimum and one count.
    """
    each = db.select("seq_id", F.posexplode("seq").alias("pos", "item"))
    kind = each.schema["item"].dataType.simpleString()
    here = db.select("seq_id", F.array().cast(f"array<{kind}>").alias("pattern"), F.lit(-1).alias("at"))
    out = None
    length = 0
    while longest is None or length < longest:
        length += 1
        grown = here.join(each, "seq_id").where("pos > at").groupBy("seq_id", "pattern", "item").agg(F.min("pos").alias("at"))
        grown = cut(grown.select("seq_id", F.concat("pattern", F.array("item")).alias("pattern"), "at"))
        often = grown.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
        if often.isEmpty():
            break
        out = often if out is None else out.unionByName(often)
        here = grown.join(often.select("pattern"), "pattern", "left_semi").select("seq_id", "pattern", "at")
    return out if out is not None else here.select("pattern", F.lit(0).cast("long").alias("support")).limit(0)


def singletons(batch, least):
    """batch(items) -> pattern, support: items by occurrences, `least` at least."""
    return batch.select(F.explode("items").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def added(old, new):
    """Additive upsert of pattern supports."""
    return old.unionByName(new).groupBy("pattern").agg(F.sum("support").alias("support"))


def ordered_by_reference(items, reference):
    """SQL-side sort of an array: items of the reference first, in its order, the others as they stand."""
    known = F.filter(F.transform(reference, lambda r: F.when(F.array_contains(items, r), r)), lambda x: x.isNotNull())
    return F.concat(known, F.filter(items, lambda x: ~F.array_contains(reference, x)))
