"""Best-fit packing: local best fit, nearly full bins leave, underfull bins merge up a tree.

Null and empty texts are one piece holding id 0. Every row is packed, whatever its doc_id,
repeated rows too; texts of any length are cut into pieces, none is left out; of pieces or bins
that tie any may come first, which changes no count; an empty table gives no rows. Only doc_id
and text are read, so further columns cannot clash.
"""
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import regex
from pyspark.sql import functions as F

from .bpe import Splitter, byte_symbols, loaded
from .common import mapped, written

PRETOKEN = Splitter("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")
#: Texts of these characters alone are stable under NFC and lower-case one to one.
SIMPLE = regex.compile(r"[\t-\r -~\xa1-\xa9\xab-\xb3\xb6-\xb9\xbb-įĲ-ňŊ-ž]*+")
MEMO = 400_000


class Words(dict):
    """Pretoken -> its ids as little-endian bytes, filled by the tokenizers library."""

    def __init__(self, path):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model, self.symbols = self.tok.model, byte_symbols()

    def ids(self, text):
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        # a pretoken of a simple text is normal and whole already: only the model remains
        found = self.model.tokenize("".join([self.symbols[b] for b in word.encode()]))
        self[word] = got = np.array([t.id for t in found], "<u4").tobytes()
        return got

    def encode(self, text):
        if "<|" in text or not SIMPLE.fullmatch(text):
            return self.ids(text)  # normalisation or special strings may matter: the whole text
        return b"".join(map(self.__getitem__, PRETOKEN.findall(text.lower())))


def pieces(docs, path, limit=2048):
    """One row per piece: doc_id, piece, start, length, ids_crc32; id 0 ends each document."""
    def run(ids, texts):
        w = loaded(Words, path)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for d, t in zip(ids, texts):
            raw = w.encode(t or "") + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(raw), 4 * limit)):
                part = raw[at:at + 4 * limit]
                for c, v in zip(out.values(), (d, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    c.append(v)
        return out

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(totals, limit):
    """Best-fit decreasing of an array of totals: the bin and the offset of each, and the bins' totals.

    Open bins are found by a bit mask of residuals; a bin holds its number and its total only.
    """
    at, mask, sizes = [[] for _ in range(limit + 1)], 0, []
    order = np.argsort(-totals, kind="stable")
    bins, offsets = np.empty(len(totals), np.int64), np.empty(len(totals), np.int64)
    for i, total in zip(order.tolist(), totals[order].tolist()):
        fit = mask >> total
        if fit:
            r = total + (fit & -fit).bit_length() - 1
            k = at[r].pop()
            if not at[r]:
                mask &= ~(1 << r)
        else:
            k, r = len(sizes), limit
            sizes.append(0)
        bins[i], offsets[i] = k, limit - r
        sizes[k] += total
        if r := r - total:
            at[r].append(k)
            mask |= 1 << r
    return bins, offsets, np.array(sizes, np.int64)


def underfull(sizes, limit, slack, most):
    """Which bins go on up the tree: those with a residual above `slack`, of equal totals `most`.

    After best fit all bins of a task but one are more than half full, and two such never share a
    bin. So a subtree of `most` tasks has at most `most` bins to place beside others, and of
    equal ones no more than that can be used: the rest is final, without loss.
    """
    order = np.argsort(sizes, kind="stable")
    s = sizes[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    on = np.zeros(len(s), bool)
    on[order] = (limit - s > slack) & (rank < most)
    return on


def packed(piece_rows, limit=2048, slack=2, rows_per_task=200_000, fan=8):
    """Adds sequence_id and offset, gapless from 0.

    Pieces are dealt to tasks by a hash of their row, so that each task sees the mix of lengths
    of the whole table, whatever its order. Each task packs its pieces best-fit decreasing;
    bins within `slack` of the limit are final, underfull ones become items of the next level,
    where `fan` tasks merge, until one is left. A task holds `rows_per_task` pieces, and at the
    levels above at most fan times fan bins of each total.
    """
    n = piece_rows.count()
    tasks = max(1, -(-n // rows_per_task))
    dealt = piece_rows.withColumn("task", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)))

    def leaf(key, t):
        bins, offsets, sizes = best_fit(t["length"].to_numpy(), limit)
        on = underfull(sizes, limit, slack, fan)
        cols = {c: t[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table({**cols, "seq": pa.array(bins + (key[0].as_py() << 24)), "offset": pa.array(offsets), "total": pa.array(sizes[bins]), "on": pa.array(on[bins])})

    def merge(t):
        seq, totals = t["seq"].to_numpy(), t["total"].to_numpy()
        bins, offsets, sizes = best_fit(totals, limit)
        on = underfull(sizes, limit, slack, fan)
        head = np.full(len(sizes), 2**63 - 1, np.int64)
        np.minimum.at(head, bins, seq)  # a merged bin takes the number of one of its parts
        return pa.table({"seq": pa.array(seq), "into": pa.array(head[bins]), "shift": pa.array(offsets), "total": pa.array(sizes[bins]), "on": pa.array(on[bins])})

    first = written(dealt.groupBy("task").applyInArrow(leaf, "doc_id long, piece int, start long, length long, ids_crc32 long, seq long, offset long, total long, on boolean"), "packed")
    moves, level = None, 0
    bins = first.where("on").select("seq", "total").distinct()
    while tasks > 1:
        level, tasks = level + 1, -(-tasks // fan)
        width = fan ** level
        step = written(bins.withColumn("grp", F.expr(f"shiftright(seq, 24) div {width}")).groupBy("grp").applyInArrow(merge, "seq long, into long, shift long, total long, on boolean"), "merges")
        bins = step.where("on").select(F.col("into").alias("seq"), "total").distinct()
        if moves is None:
            moves = step.select("seq", "into", "shift")
        else:  # bins that moved before move along with what they are in now
            later = step.select(F.col("seq").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            moves = written(moves.join(later, "into", "left").select("seq", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moves")
    if moves is not None:
        first = first.join(moves, "seq", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("seq", F.coalesce("into", "seq"))
    return first.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def packed_documents(docs, path=None):
    return packed(written(pieces(docs, path or P.path("word_bpe_49k.json")), "pieces"))
