"""Token counts (heap and linked list) and byte-level BPE encoding (padded matrices).

Null texts count as empty; null or repeated doc_ids keep their rows; empty tables give
empty results; only doc_id and text are read, so further columns cannot clash. Of pairs that tie
in rank the leftmost merges first. Texts of any length are read whole; a single pretoken of
more than LONG bytes is merged by the heap, which takes n log n and gives the same ids.
"""
import base64
import hashlib
import heapq
import json
import re

import numpy as np
import public_tokenizers as P
import regex

from .common import WS, mapped

#: Texts below this code point are split by `re`, with classes spelled out: twice as fast as `regex`.
NARROW = 0x250
WIDE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]")


def spelled(cls):
    """The characters of a class below NARROW, for use inside brackets."""
    return "".join(re.escape(c) for c in map(chr, range(NARROW)) if regex.match(cls, c))


class Splitter:
    """findall by a pattern in which {L}, {N} and {S} stand for letters, numbers and white space."""

    def __init__(self, pattern):
        fill = lambda l, n, s: pattern.replace("{L}", l).replace("{N}", n).replace("{S}", s)
        self.any = regex.compile(fill(r"\p{L}", r"\p{N}", WS))
        self.narrow = re.compile(fill(spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(f"[{WS}]")))

    def findall(self, text):
        return (self.any if WIDE.search(text) else self.narrow).findall(text)


#: The library's \\s is White_Space of Unicode, unlike that of `re` and `regex`.
PATTERN = Splitter(P.PATTERN.replace(r"\p{L}+|", "[{L}]+|").replace(r"\p{N}+|", "[{N}]+|").replace(r"[^\s\p{L}\p{N}]", "[^{S}{L}{N}]").replace(r"\s+(?!\S)", "[{S}]+(?![^{S}])").replace(r"\s+", "[{S}]+"))
#: Pretokens of more bytes than this leave the matrices, where a row of n bytes takes n rounds.
LONG = 4096
#: A worker's memo of words is emptied at this many entries; results do not depend on it.
MEMO = 400_000


def heap_merged(symbols, ranks):
    """Merges made and the symbols after them (None where merged away): pop the lowest-rank, then
    leftmost, live pair from the heap."""
    n = len(symbols)
    sym, prev, nxt = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if sym[i] == a else n
        if j >= n or sym[j] != b:
            continue
        merges += 1
        sym[i], sym[j], nxt[i] = a + b, None, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for x, y in ((prev[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (r := ranks.get((sym[x], sym[y]))) is not None:
                heapq.heappush(heap, (r, x, sym[x], sym[y]))
    return merges, sym


def heap_count(symbols, ranks):
    """Symbols left after merging: initial symbols minus merges."""
    return len(symbols) - heap_merged(symbols, ranks)[0]


def byte_symbols():
    """The printable stand-in of each byte in GPT-2 style vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Counts(dict):
    """Word -> number of tokens, filled on demand."""

    def __init__(self, path):
        merges = json.load(open(path, encoding="utf-8"))["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.symbols = byte_symbols()

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        self[word] = n = heap_count([self.symbols[b] for b in word.encode()], self.ranks)
        return n


_LOADED = {}


def loaded(kind, path):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def token_counts(docs, path, special="<|endoftext|>", limit=512):
    """doc_id, n_bytes, n_tokens, over_limit; a special string in a text is one token."""
    def count(ids, texts):
        memo, out = loaded(Counts, path), {"doc_id": ids, "n_bytes": [], "n_tokens": [], "over_limit": []}
        for text in texts:
            text = text or ""
            parts = text.split(special)
            n = len(parts) - 1 + sum(sum(map(memo.__getitem__, PATTERN.findall(p))) for p in parts)
            out["n_bytes"].append(len(text.encode()))
            out["n_tokens"].append(n)
            out["over_limit"].append(n > limit)
        return out

    return mapped(docs.select("doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def cut(m, size):
    """The first `size` ids of each row of a matrix, as bytes."""
    raw, to = m[np.arange(m.shape[1]) < size[:, None]].astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
    return [raw[a:b] for a, b in zip([0, *to], to)]


class Ranks:
    """Ranks with a hashed pair table: open addressing over id pairs, for whole matrices."""

    def __init__(self, path):
        self.token = {}
        for line in open(path, "rb"):
            a, b = line.split()
            self.token[base64.b64decode(a)] = int(b)
        self.bytes = [b""] * (max(self.token.values()) + 1)
        for t, r in self.token.items():
            self.bytes[r] = t
        self.byte_ids = np.array([self.token[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.token[t[:k]] * 2**20 + self.token[t[k:]], r) for t, r in self.token.items() for k in range(1, len(t)) if t[:k] in self.token and t[k:] in self.token]
        keys, vals = (np.array(x, np.int64) for x in zip(*pairs))
        self.mask = (1 << int(np.ceil(np.log2(4 * len(keys))))) - 1
        self.keys, self.vals = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.vals[at[won]] = vals[won]
            keys, vals, at = keys[~won], vals[~won], (at[~won] + 1) & self.mask
        self.memo = {}

    def get(self, pair):
        """Rank of a pair of byte strings."""
        return self.token.get(pair[0] + pair[1])

    def slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def lookup(self, keys):
        """Rank of each pair, or a large number where there is none."""
        out, live, at = np.full(keys.shape, 2**40, np.int64), np.arange(len(keys)), self.slot(keys)
        while len(live):
            got = self.keys[at]
            hit = got == keys[live]
            out[live[hit]] = self.vals[at[hit]]
            on = ~hit & (got != -1)
            live, at = live[on], (at[on] + 1) & self.mask
        return out

    def merge_rows(self, m, size):
        """Every row merges its leftmost minimum-rank pair each round until none has one.

        A round looks up the two pairs beside each merge only; all other ranks move along.
        """
        none, done, rows = 2**40, {}, np.arange(len(m))
        rank = np.full((len(m), max(m.shape[1] - 1, 1)), none, np.int64)
        if m.shape[1] > 1:
            ok = np.arange(1, m.shape[1]) < size[:, None]
            rank[ok] = self.lookup((m[:, :-1] * 2**20 + m[:, 1:])[ok])
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(m)), at]
            go = best < none
            if not go.all():
                done.update(zip(rows[~go].tolist(), cut(m[~go], size[~go])))
            m, size, at, best, rows, rank = m[go], size[go] - 1, at[go], best[go], rows[go], rank[go]
            if len(rows):  # compaction: shift what stands right of the merged pair
                w, c, every = m.shape[1] - 1, np.arange(m.shape[1] - 1), np.arange(len(m))
                m = np.where(c > at[:, None], m[:, 1:], m[:, :-1])
                m[every, at] = best
                rank = np.where(c[:-1] > at[:, None], rank[:, 1:], rank[:, :-1]) if w > 1 else np.full((len(m), 1), none, np.int64)
                for left in (at - 1, at):
                    ok = (left >= 0) & (left + 1 < size)
                    if w > 1:
                        on = (left >= 0) & (left < w - 1) & ~ok
                        rank[every[on], left[on]] = none
                    r, x = every[ok], left[ok]
                    rank[r, x] = self.lookup(m[r, x] * 2**20 + m[r, x + 1])
                m, rank = m[:, : size.max()], rank[:, : max(size.max() - 1, 1)]
        return done

    def learn(self, words, cells=400_000):
        """Encode words unseen so far, in buckets of near lengths of bounded size."""
        words = set(words)
        if len(self.memo) + len(words.difference(self.memo)) > MEMO:
            self.memo.clear()
        todo = list(words.difference(self.memo))
        for w in todo:
            if len(w) > LONG // 4 and len(raw := w.encode()) > LONG:
                sym = heap_merged([raw[i:i + 1] for i in range(len(raw))], self)[1]
                self.memo[w] = np.array([self.token[x] for x in sym if x is not None], "<u4").tobytes()
        todo = [w for w in todo if w not in self.memo]
        raw = [w.encode() for w in todo]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        done = 0
        while done < len(order):
            width, take = len(raw[order[done]]), []
            for i in order[done:done + cells]:
                if len(raw[i]) > max(width * 1.25, 8) or take and len(take) * len(raw[i]) > cells:
                    break
                take.append(i)
            done += len(take)
            size = np.array([len(raw[i]) for i in take])
            m = np.zeros((len(take), size.max()), np.int64)
            m[np.arange(size.max()) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in take), np.uint8)]
            for k, ids in self.merge_rows(m, size).items():
                self.memo[todo[take[k]]] = ids

    def encode(self, *texts):
        """The ids of each text, as bytes; texts given together share the matrices."""
        words = [PATTERN.findall(t) for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]

    def decode(self, ids):
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunks(texts, most=1 << 21):
    """Runs of texts of about `most` characters together; a longer text stands alone."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > most:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def encoded(docs, path):
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    def run(ids, texts):
        r, out = loaded(Ranks, path), {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for part in chunks(t or "" for t in texts):
            for got in r.encode(*part):
                out["n_tokens"].append(len(got) // 4)
                out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(r.decode(got)).hexdigest())
        return out

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
