"""Interaction of filters: for each order of five filters, what every step removes and costs.

Null texts are empty; null langs are the part ''; a null doc_id is no number, so such a row equals no
smaller id, makes no other row fail and has no label; rows of one doc_id and text do not fail for each
other; of several labels of a doc_id each that says 1 counts. An empty table gives no rows. Only
doc_id, text and lang (and doc_id, quality, toxic of the labels) are read, so further columns cannot
clash. Texts of any length are read whole.
"""
from itertools import groupby, permutations

import xxhash
from pyspark.sql import functions as F

LETTERS = "ABCDE"
LAST = 1 << LETTERS.index("E")
UPPER, SIGNS, TRAIL = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))
#: Bytes of text that a map task gathers before it hands its chains on.
HOLD = 64 << 20
#: Bytes of text for which there is a partition of hashes, where all texts differ.
ROUTED = 64 << 20
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(raw):
    """Bits of the conditions A to D that a text (UTF-8) fails; words are parted at ASCII white space."""
    words = raw.split()
    upper, points = len(raw) - len(raw.translate(None, UPPER)), len(raw.translate(None, TRAIL))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


def enter(chain, raw, doc_id, langs, mask):
    """Adds a text with the smallest id seen of it to a collision chain, a list of [text, id, langs, mask].

    Texts are compared whole. Returns the (id, langs, mask) that is not the smallest of its text, or None.
    """
    for link in chain:
        if link[0] == raw:
            if doc_id == link[1]:
                for k, n in langs.items():
                    link[2][k] = link[2].get(k, 0) + n
                return None
            loser = (max(doc_id, link[1]), langs if doc_id > link[1] else link[2], link[3] | LAST)
            if doc_id < link[1]:
                link[1:3] = doc_id, langs
            return loser
    chain.append([raw, doc_id, dict(langs), mask])
    return None


def local_chains(rows):
    """(hash, record) of a map task: chains of its texts to be routed, and facts about ids that a smaller
    one of the same task already beats: copies of a text leave a task once."""
    table, held = {}, 0
    for doc_id, text, lang in rows:
        raw, langs = (text or "").encode("utf-8", "surrogatepass"), {lang or "": 1}
        if doc_id is None:
            yield xxhash.xxh64_intdigest(raw), (None, langs, mask_of(raw))
            continue
        h = xxhash.xxh64_intdigest(raw)
        chain = table.setdefault(h, [])
        known = next((link[3] for link in chain if link[0] == raw), None)
        held += len(raw) if known is None else 0
        loser = enter(chain, raw, doc_id, langs, mask_of(raw) if known is None else known)
        if loser:
            yield xxhash.xxh64_intdigest(str(loser[0])), loser
        if held > HOLD:
            yield from ((k, tuple(link)) for k, c in table.items() for link in c)
            table, held = {}, 0
    yield from ((k, tuple(link)) for k, c in table.items() for link in c)


def routed_facts(records):
    """(doc_id, (langs, mask)) of a partition sorted by hash: one chain at a time is in memory."""
    for _, same in groupby(records, key=lambda kv: kv[0]):
        chain = []
        for _, r in same:
            lost = enter(chain, *r) if len(r) == 4 else r
            if lost:
                yield lost[0], lost[1:]
        for _, doc_id, langs, mask in chain:
            yield doc_id, (langs, mask)



def facts(docs, labels):
    """RDD of (lang, mask, rows, good, toxic) per document id; shuffles of its own for texts and for ids."""
    source = docs.select("doc_id", "text", "lang").rdd.map(tuple)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    known = source.mapPartitions(local_chains).repartitionAndSortWithinPartitions(n, lambda h: h % n).mapPartitions(routed_facts)
    alone, named = known.filter(lambda kv: kv[0] is None), known.filter(lambda kv: kv[0] is not None)
    marks = labels.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))).rdd.map(lambda r: (r[0], (r[1], r[2])))

    def put(acc, v):
        if isinstance(v[0], dict):
            for lang, k in v[0].items():
                acc[0][lang, v[1]] = acc[0].get((lang, v[1]), 0) + k
            return acc
        return acc[0], acc[1] or v[0], acc[2] or v[1]

    def join(a, b):
        for k, v in b[0].items():
            a[0][k] = a[0].get(k, 0) + v
        return a[0], a[1] or b[1], a[2] or b[2]

    per_id = named.union(marks).combineByKey(lambda v: put(({}, False, False), v), put, join, n)
    flat = per_id.flatMap(lambda kv: [(lang, (mask, k, kv[1][1], kv[1][2])) for (lang, mask), k in kv[1][0].items()])
    return flat.union(alone.flatMap(lambda kv: [(lang, (kv[1][1], k, False, False)) for lang, k in kv[1][0].items()]))


def mask_vectors(pairs):
    """RDD of (part, vector): for each of the 32 masks its documents, the good and the toxic among them."""
    def put(vector, v):
        mask, k, good, toxic = v
        for i, on in enumerate((True, good, toxic)):
            vector[3 * mask + i] += k * on
        return vector

    return pairs.combineByKey(lambda v: put([0] * 96, v), put, lambda a, b: [x + y for x, y in zip(a, b)])


def interactions(part, vector):
    """The rows of one part: 120 orders of five steps, from its vector alone."""
    count = lambda i, keep: sum(vector[3 * m + i] for m in range(32) if keep(m))
    shapley, rows = dict.fromkeys(LETTERS, 0), []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            here = lambda m: m & bit and not m & before
            removed = count(0, here)
            shapley[letter] += removed
            rows.append(["".join(order), step, count(0, lambda m: not m & (before | bit)), removed, count(0, lambda m: m & bit and m & before), vector[3 * bit], count(1, here), count(2, here), letter])
            before |= bit
    return [(part, *r[:-1], shapley[r[-1]]) for r in rows]


def audited(docs, labels):
    """One row for each part, order of the filters and step."""
    return docs.sparkSession.createDataFrame(mask_vectors(facts(docs, labels)).flatMap(lambda kv: interactions(*kv)), ROWS, verifySchema=False)
