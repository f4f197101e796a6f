"""Suffix-array dedup of byte passages shared across documents.

A byte goes when a 50-byte string that covers it also starts in a document of smaller doc_id.
Every 50-byte string holds a 20-byte minimizer, equal wherever the string stands, so anchors
shared by two documents mark the places to look at. The suffixes around equal anchors are
sorted by a mergesort whose comparisons find the common extension by binary search over
prefix polynomial hashes; neighbours in that order whose common extension reaches 50 bytes
are the finding, verified byte by byte. Suffixes whose hash stands alone in their group have
no such neighbour and are not sorted; equal contexts of the texts that one task reads go on
once, for their smallest document. Null texts are empty, null doc_ids count as the largest,
equal texts are worked on once, repeated rows stay; texts of any length are read whole; of
equal doc_ids neither is earlier, so they keep what they share; an empty table gives no rows;
further columns stay with their row (deduplicated) or are not read (digests).
"""
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .common import mapped, written

SPAN, GRAM = 50, 20
LEFT = SPAN - GRAM  # bytes of context on either side of an anchor
B = np.uint64(0x9E3779B97F4A7C15)
B_INV = np.uint64(pow(int(B), -1, 2**64))
LAST = 2**63 - 1
#: Anchors or contexts that a task collects before it hands them on.
FLUSH = 1_000_000


def gram_hash(columns):
    """Hash of the grams whose bytes are given place by place."""
    h = np.uint64(0)
    for x in columns:
        h = h * B + (x + np.uint64(1))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def alike(rows):
    """Numbers of the classes of equal rows of a byte matrix: by hash, verified."""
    n, w = rows.shape
    x, h = np.zeros((n, -(-w // 8) * 8), np.uint8), np.zeros(n, np.uint64)
    x[:, :w] = rows
    for col in x.view(np.uint64).T:
        h = (h ^ col) * B
        h ^= h >> np.uint64(29)
    _, first, cls = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(rows, rows[first[cls]]):
        return cls
    return np.unique(np.ascontiguousarray(rows).view(f"V{w}").ravel(), return_inverse=True)[1]


def anchors(raw):
    """Places of the minimizers of a byte string and the hashes of their grams."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(x) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(x) - GRAM + 1
    h = gram_hash(x[k:n + k] for k in range(GRAM))
    low, width = h, 1  # sliding minimum over LEFT + 1 places by doubling
    while width * 2 <= LEFT + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(h) - LEFT
    low = np.minimum(low[:n], low[LEFT + 1 - width:LEFT + 1 - width + n])
    near, width = np.concatenate([low[:1].repeat(LEFT), low, low[-1:].repeat(LEFT)]), 1
    while width * 2 <= LEFT + 1:  # sliding maximum of the minima
        near = np.maximum(near[:-width], near[width:])
        width *= 2
    # a place is taken if it is the least of some window that holds it
    at = np.flatnonzero(h == np.maximum(near[:len(h)], near[LEFT + 1 - width:LEFT + 1 - width + len(h)]))
    return at, h[at]


def bucket_order(key, buckets):
    """Order of rows by the bucket of their key, the buckets and where each begins."""
    at = ((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    return order, pa.array(at[cut[:-1]], pa.int32()), cut


def packs(col, cut):
    return pa.array([col[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())


def short(h):
    """32 of the bits; equal ones of unequal grams only add a context to compare."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _unpack(col, kind):
    return np.frombuffer(b"".join(col.to_pylist()), kind)


def _anchor_rows(buckets):
    def packed(h, key):
        h, key = np.concatenate(h), np.concatenate(key)
        order, bucket, cut = bucket_order(h, buckets)
        h, key = short(h[order]), key[order]
        new = np.concatenate(([True], key[1:] != key[:-1], [True]))  # a text of several anchors in a run stands once
        new[cut] = True
        run = np.flatnonzero(new)
        at = np.searchsorted(run, cut)
        return pa.RecordBatch.from_arrays([bucket, packs(h, cut), packs(key[run[:-1]], at), packs(np.diff(run).astype(np.uint32), at)], names=["bucket", "h", "k", "run"])

    def run(batches):
        for b in batches:
            h, key, n, seen = [], [], 0, set()
            for k, t in zip(b.column(0), b.column(1)):
                k = k.as_py()
                if k in seen:  # equal texts of a batch once
                    continue
                seen.add(k)
                g = np.unique(anchors(t.as_py().encode())[1])
                h.append(g)
                key.append(np.full(len(g), k, np.int64))
                n += len(g)
                if n > FLUSH:
                    yield packed(h, key)
                    h, key, n = [], [], 0
            if n:
                yield packed(h, key)
    return run


def _shared(t):
    h, key = _unpack(t["h"], np.uint32), np.repeat(_unpack(t["k"], np.int64), _unpack(t["run"], np.uint32))
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))[:len(h)]  # copies of a text count once
    h, key = h[new], key[new]
    _, inv, n = np.unique(h, return_inverse=True, return_counts=True)
    on = n[inv] > 1
    h, key = h[on], key[on]
    order = np.argsort(key, kind="stable")
    h, key = h[order], key[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    return pa.table([pa.array(key[cut[:-1]], pa.int64()), packs(h, cut)], names=["k", "h"])


def _context_rows(buckets):
    names = ["bucket", "k", "d", "p", "c"]

    def packed(*cols):
        g, key, d, p, c = map(np.concatenate, cols)
        cls = alike(c)
        order = np.lexsort((d, cls))  # equal contexts of this batch: the smallest document stands for all
        g, key, d, p, c, cls = g[order], key[order], d[order], p[order], c[order], cls[order]
        new = np.concatenate(([True], cls[1:] != cls[:-1]))
        gone = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if gone.any():
            k, dd, x, y = _spans_of(key[gone], d[gone], p[gone] - c[gone, -2], p[gone] + c[gone, -1])
            at = np.argsort(k % buckets, kind="stable")
            k, dd, x, y = k[at], dd[at], x[at], y[at]
            cut = np.flatnonzero(np.concatenate(([True], np.diff(k % buckets) != 0, [True])))
            yield pa.RecordBatch.from_arrays([pa.array(-1 - k[cut[:-1]] % buckets, pa.int32()), *(packs(v, cut) for v in (k, dd, x, y))], names=names)
        g, key, d, p, c = (x[~gone] for x in (g, key, d, p, c))
        order, bucket, cut = bucket_order(g, buckets)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([bucket, *(packs(x[order], cut) for x in (key, d, p)), pa.array(map(zip_, packs(c[order], cut).to_pylist()), pa.binary())], names=names)

    def run(batches):
        for b in batches:
            cols, n, seen = [[] for _ in range(5)], 0, set()
            for k, d, t, hs in zip(*(b.column(i) for i in range(4))):
                k, d = k.as_py(), d.as_py()
                if (k, d) in seen:  # repeated rows once
                    continue
                seen.add((k, d))
                raw = t.as_py().encode()
                at, g = anchors(raw)
                on = np.isin(short(g), np.frombuffer(b"".join(hs.as_py()), np.uint32))
                at, g = at[on], g[on]
                pad = np.concatenate([np.zeros(LEFT, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(SPAN, np.uint8)])
                edge = np.stack([np.minimum(at, LEFT), np.minimum(len(raw) - at, SPAN)], 1).astype(np.uint8)
                c = np.concatenate([pad[at[:, None] + np.arange(LEFT + SPAN)], edge], 1)
                for col, x in zip(cols, (g, np.full(len(g), k, np.int64), np.full(len(g), d, np.int64), at.astype(np.int32), c)):
                    col.append(x)
                n += len(g)
                if n > FLUSH // 4:
                    yield from packed(*cols)
                    cols, n = [[] for _ in range(5)], 0
            if n:
                yield from packed(*cols)
    return run


def prefix_hashes(text):
    """Prefix polynomial hashes of a text and the inverse powers that align them."""
    n = len(text)
    pw, ipw = np.full(n + 1, B, np.uint64), np.full(n + 1, B_INV, np.uint64)
    pw[0] = ipw[0] = 1
    pw, ipw = np.cumprod(pw, dtype=np.uint64), np.cumprod(ipw, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * pw[:n], dtype=np.uint64)]), ipw


def suffix_order(text, pre, ipw, start, whole, seg):
    """Order of the suffixes at `start` (SPAN bytes each, hashed in `whole`) within equal, adjacent
    `seg`, and the common extension of each with the next."""
    def common(x, y):
        """Common extension, SPAN at most: the whole length is probed first, then binary search."""
        out = np.full(len(x), SPAN)
        at = np.flatnonzero(whole[x] != whole[y])
        i, j = start[x[at]], start[y[at]]
        lo, hi, a, b, pa_, pb = np.zeros(len(i), np.int64), np.full(len(i), SPAN - 1, np.int64), ipw[i], ipw[j], pre[i], pre[j]
        for _ in range(6):
            mid = (lo + hi + 1) // 2
            same = (pre[i + mid] - pa_) * a == (pre[j + mid] - pb) * b
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[at] = lo
        return out

    def compare(x, y):
        k = common(x, y)
        at = np.flatnonzero(k < SPAN)
        out = np.zeros(len(x), np.int64)
        out[at] = np.sign(text[start[x[at]] + k[at]].astype(np.int64) - text[start[y[at]] + k[at]])
        return out

    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    size = np.diff(np.append(first, len(seg)))
    a0, a1 = np.repeat(first, size), np.repeat(first + size, size)
    order, slot, width = np.arange(len(seg)), np.arange(len(seg)), 1
    while width < size.max():
        p = slot - a0
        run = p // width
        lo = np.minimum(a0 + (run ^ 1) * width, a1)
        base, end = lo.copy(), np.minimum(lo + width, a1)
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):  # binary search of each suffix in the neighbouring run
            mid = (lo[live] + hi[live]) // 2
            c = compare(order[mid], order[slot[live]])
            less = np.where(run[live] % 2 == 0, c < 0, c <= 0)
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        new = a0 + run // 2 * 2 * width + p % width + (lo - base)
        moved = np.empty_like(order)
        moved[new] = order
        order, width = moved, width * 2
    return order, common(order[:-1], order[1:])


def _spans(bucket, t):
    """Removed stretches (key, d, begin, end) that the contexts of one bucket show; a bucket below
    zero holds stretches that were found before the shuffle."""
    key, d, p = (_unpack(t[c], k) for c, k in (("k", np.int64), ("d", np.int64), ("p", np.int32)))
    if bucket[0].as_py() < 0:
        return _span_table(key, d, p, _unpack(t["c"], np.int32))
    unzip = zstandard.ZstdDecompressor().decompress
    c = np.frombuffer(b"".join(map(unzip, t["c"].to_pylist())), np.uint8).reshape(-1, LEFT + SPAN + 2)
    if not len(key):
        return _span_table(key, d, p, p)
    h, cls = gram_hash(c[:, LEFT + k].astype(np.uint64) for k in range(GRAM)), alike(c)
    order = np.lexsort((d, cls, h))  # equal contexts: the smallest document stands for all
    h, key, d, p, c, cls = h[order], key[order], d[order], p[order].astype(np.int64), c[order], cls[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    whole = d > d[head]
    whole &= c[:, -2].astype(np.int64) + c[:, -1] >= SPAN
    K, D, S, E = [key[whole]], [d[whole]], [p[whole] - c[whole, -2]], [p[whole] + c[whole, -1]]
    same = d == d[head]  # all that stand for a class, repeated places of its document too
    h, key, d, p, c = h[same], key[same], d[same], p[same], c[same]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    many = np.repeat(np.diff(cut) > 1, np.diff(cut))
    h, key, d, p, c = h[many], key[many], d[many], p[many], c[many]
    for a, b in _pieces(h, 20_000):
        n, off = b - a, np.arange(LEFT + 1)
        ok = (off >= LEFT - c[a:b, -2:-1]) & (off + SPAN <= LEFT + c[a:b, -1:])
        i, o = np.nonzero(ok)
        if not len(i):
            continue
        grp = np.cumsum(np.concatenate(([True], h[a + 1:b] != h[a:b - 1])))
        seg = grp[i] * (LEFT + 1) + o
        text = c[a:b, :-2].ravel()
        start = i * (LEFT + SPAN) + o
        pre, ipw = prefix_hashes(text)
        whole = (pre[start + SPAN] - pre[start]) * ipw[start]
        # a suffix whose hash stands alone in its group equals no other: it need not be sorted
        by = np.lexsort((whole, seg))
        same = (whole[by[1:]] == whole[by[:-1]]) & (seg[by[1:]] == seg[by[:-1]])
        by = np.sort(by[np.append(same, False) | np.append(False, same)])
        if not len(by):
            continue
        by = by[np.argsort(seg[by], kind="stable")]
        i, o, seg, start, whole = i[by], o[by], seg[by], start[by], whole[by]
        order, extension = suffix_order(text, pre, ipw, start, whole, seg)
        i, o, start = i[order], o[order], start[order]
        eq = (extension >= SPAN) & (seg[1:] == seg[:-1])
        at = np.flatnonzero(eq)  # verification byte by byte of what the hashes call equal
        if not (text[start[at + 1][:, None] + np.arange(SPAN)] == text[start[at][:, None] + np.arange(SPAN)]).all():
            exact = alike(text[start[:, None] + np.arange(SPAN)])  # a collision: order by the bytes themselves
            order = np.lexsort((exact, seg))
            i, o, start, exact = i[order], o[order], start[order], exact[order]
            eq = (exact[1:] == exact[:-1]) & (seg[1:] == seg[:-1])
        run = np.cumsum(np.concatenate(([True], ~eq))) - 1
        least = np.full(run[-1] + 1, LAST, np.int64)
        np.minimum.at(least, run, d[a + i])
        gone = d[a + i] > least[run]
        at = p[a + i[gone]] - LEFT + o[gone]
        K.append(key[a + i[gone]])
        D.append(d[a + i[gone]])
        S.append(at)
        E.append(at + SPAN)
    return _span_table(*map(np.concatenate, (K, D, S, E)))


def _pieces(h, size):
    """Cuts between groups of equal h, about `size` rows apart."""
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    a = 0
    while a < len(h):
        b = int(cut[np.searchsorted(cut, min(a + size, len(h)))])
        yield a, b
        a = b


def merged(s, e):
    """Union of stretches as sorted, disjoint, not touching ones."""
    order = np.argsort(s, kind="stable")
    s, top = s[order], np.maximum.accumulate(e[order]) if len(e) else e
    first = np.concatenate(([True], s[1:] > top[:-1])) if len(s) else np.empty(0, bool)
    return s[first], top[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)] if len(s) else top


def _spans_of(key, d, s, e):
    """Merged stretches, in the order of their texts; those below SPAN bytes go."""
    on = e - s >= SPAN
    key, d, s, e = key[on], d[on], s[on].astype(np.int64), e[on].astype(np.int64)
    order = np.lexsort((d, key))
    key, d, s, e = key[order], d[order], s[order], e[order]
    if len(key):  # one line of numbers, each text in a range of its own
        g = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (d[1:] != d[:-1]))))
        w = int(e.max()) + 2
        first = np.searchsorted(g, np.arange(g[-1] + 1))
        s, e = merged(s + g * w, e + g * w)
        g = s // w
        key, d, s, e = key[first[g]], d[first[g]], s - g * w, e - g * w
    return key, d, s.astype(np.int32), e.astype(np.int32)


def _span_table(key, d, s, e):
    key, d, s, e = _spans_of(key, d, s, e)
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (d[1:] != d[:-1]), [True]))) if len(key) else np.zeros(1, np.int64)
    return pa.table([pa.array(key[cut[:-1]], pa.int64()), pa.array(d[cut[:-1]], pa.int64()), packs(s, cut), packs(e, cut)], names=["k", "d", "s", "e"])


def removals(docs, *more):
    """docs(doc_id, text) -> doc_id, text, whole (an earlier equal text), s, e: packed stretches."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("x", F.unhex(F.sha2("text", 256)))
    long = d.where(F.octet_length("text") >= SPAN)
    heads = written(long.groupBy("x").agg(F.min("d").alias("head")).withColumn("k", F.xxhash64("x")), "heads")
    texts = heads.count()
    buckets = max(16, texts // 3000)
    long = long.withColumn("k", F.xxhash64("x"))
    first = long.select("k", "text").mapInArrow(_anchor_rows(max(16, texts // 8000)), "bucket int, h binary, k binary, run binary")
    # k only steers: texts that share one by chance get the anchors of both, and (k, head) tells them apart
    shared = written(first.groupBy("bucket").applyInArrow(_shared, "k long, h binary").groupBy("k").agg(F.collect_list("h").alias("hs")), "shared")
    # of rows that share a text those with the smallest doc_id stand for it
    at = shared.join(heads.select("k", F.col("head").alias("d")), "k")
    ctx = long.select("k", "d", "text").join(at, ["k", "d"]).select("k", "d", "text", "hs").mapInArrow(_context_rows(buckets), "bucket int, k binary, d binary, p binary, c binary")
    spans = written(ctx.groupBy("bucket").applyInArrow(_spans, "k long, d long, s binary, e binary").groupBy("k", F.col("d").alias("head")).agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e")), "spans")
    marks = heads.join(spans, ["k", "head"], "left").select("x", "head", "s", "e")
    return d.join(marks, "x", "left").select("doc_id", "text", F.coalesce(F.col("d") > F.col("head"), F.lit(False)).alias("whole"), "s", "e", *more)


def stretches(raw, whole, s, e):
    if whole:
        return np.zeros(1, np.int64), np.full(1, len(raw), np.int64)
    if not s:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return merged(np.frombuffer(b"".join(s), np.int32).astype(np.int64), np.frombuffer(b"".join(e), np.int32).astype(np.int64))


def kept_bytes(raw, a, b):
    return b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))


def digests(docs):
    def run(ids, texts, whole, s, e):
        out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for t, w, x, y in zip(texts, whole, s, e):
            raw = t.encode()
            a, b = stretches(raw, w, x, y)
            for c, v in zip(list(out.values())[1:], (len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept_bytes(raw, a, b)).hexdigest())):
                c.append(v)
        return out
    return mapped(removals(docs), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs):
    """docs with passages removed from text, each row with its other columns; characters cut in part go whole."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    docs, names = docs.select("doc_id", "text", rest.alias("rest")), docs.columns
    def run(ids, texts, whole, s, e, rest):
        return {"rest": rest, "text": [kept_bytes(t.encode(), *stretches(t.encode(), w, x, y)).decode("utf-8", "ignore") for t, w, x, y in zip(texts, whole, s, e)]}
    kind = docs.select("rest", "text").schema
    return mapped(removals(docs, "rest"), run, kind).select(*["text" if c == "text" else F.col("rest")[c].alias(c) for c in names])
