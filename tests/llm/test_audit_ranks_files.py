"""Filter audit, grouped ranks and token files against brute force, on odd and hot rows."""
import random
import zlib
from collections import Counter
from itertools import groupby, permutations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drydock.llm import audit, ranking, token_files
from drydock.llm.common import sums_before

RND = random.Random(11)


def prose(n):
    return " ".join("".join(RND.choices("abcdefgh", k=4)) for _ in range(n))


# -- filter audit

LONG = prose(120)
DOCS = [(1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (1, LONG, "en"), (3, None, None), (4, "", "en"), (None, LONG, "en"), (None, "", None), (5, "A B C " * 50, "fr"), (6, "x # y", "fr"), (7, "a b " * 60, "fr"), (8, prose(150), ""), (9, "ÄÖ" * 5 + " Z", "en"), (10, prose(101) + " $", "de")]
LABELS = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (4, 1, 1), (8, None, 1), (99, 1, 1), (None, 1, 1)]


def audit_brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": any(e is not None and d is not None and e < d and (u or "") == t for e, u, _ in docs)}
        fails.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = []
    for part in {f[0] for f in fails}:
        mine, total, rows = [f for f in fails if f[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [f for f in mine if x in f[1] and not f[1] & before]
                total[x] += len(gone)
                rows.append(["".join(order), k + 1, sum(not f[1] & (before | {x}) for f in mine), len(gone), sum(x in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone), x])
        out += [(part, *r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


def test_audit(spark):
    docs = spark.createDataFrame([(*d, i, "q") for i, d in enumerate(DOCS)], "doc_id long, text string, lang string, part int, mask string").repartition(3)
    labels = spark.createDataFrame([(*x, 0) for x in LABELS], "doc_id long, quality int, toxic int, text int")
    assert sorted(map(tuple, audit.audited(docs, labels).collect())) == audit_brute(DOCS, LABELS)
    assert audit.audited(docs.limit(0), labels).isEmpty() and audit.audited(docs, labels.limit(0)).count() == 600 * 4


def test_audit_of_a_hot_text(spark):
    """Copies in every task and more than a task holds: one of them stays, whatever the order of arrival."""
    rows = [(i, LONG if i % 3 else prose(3), "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    hold, audit.HOLD = audit.HOLD, 400
    try:
        facts = list(audit.local_chains(rows))
    finally:
        audit.HOLD = hold
    assert sum(len(r) == 4 and r[0] == LONG.encode() for _, r in facts) > 1
    got = [r for r in audit.audited(docs, labels).collect() if r["filter_order"] == "EABCD" and r["step"] == 1][0]
    assert (got["removed"], got["kept"]) == (599, 301)


def test_chains_of_equal_hashes():
    """Texts that share a hash are told apart by comparing them."""
    records = [(7, (b"a", 5, {"x": 1}, 0)), (7, (b"b", 4, {"x": 1}, 2)), (7, (b"a", 3, {"y": 2}, 0)), (7, (b"a", 3, {"y": 1}, 0))]
    assert sorted((d, sorted(l.items()), m) for d, (l, m) in audit.routed_facts(records)) == [(3, [("y", 3)], 0), (4, [("x", 1)], 2), (5, [("x", 1)], audit.LAST)]


# -- grouped ranks

ORDER = [("a", "desc_nulls_first"), ("b", "asc_nulls_first"), ("c", "asc_nulls_last")]


def ranks_brute(rows, at_most):
    null_first = lambda v, sign: (0, 0) if v is None else (1, sign * v)
    null_last = lambda v: (1, 0) if v is None else (0, v)
    out = []
    for g, same in groupby(sorted(rows, key=lambda r: str(r[0])), key=lambda r: r[0]):
        same = sorted(same, key=lambda r: (null_first(r[1], -1), null_first(r[2], 1), null_last(r[3])))
        n = Counter(r[1:3] for r in same)
        out += [(*r, i, n[r[1:3]]) for i, r in enumerate(same, 1) if at_most is None or i <= at_most]
    return out


@pytest.mark.parametrize("at_most", [2, 5, None])
def test_ranks(spark, at_most):
    pick = lambda *xs: RND.choice(xs)
    rows = [(pick(None, "hot", "hot", "hot", "x", "y"), pick(None, 1, 2, 3), pick(None, 1, 2), pick(None, *range(6))) for _ in range(3000)] + [("hot", 3, 1, 1)] * 2000 + [("lone", None, None, None)]
    d = spark.createDataFrame([(*r, 0, "z") for r in rows], "g string, a long, b int, c long, pos int, tied string").repartition(9)
    got = ranking.ranked(d, ["g"], ORDER, 2, at_most)
    assert got.columns == ["g", "a", "b", "c", "pos", "tied"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranks_brute(rows, at_most), key=key)


def test_ranks_of_one_tuple_in_pieces(spark, monkeypatch):
    """Duplicates above CHUNK are restored in pieces; empty tables give no rows."""
    monkeypatch.setattr(ranking, "CHUNK", 10)
    d = spark.createDataFrame([("g", 1, 1, 1)] * 47 + [("g", 1, 1, 2)], "g string, a long, b long, c long")
    got = ranking.ranked(d, ["g"], ORDER, 2)
    assert sorted(r["pos"] for r in got.collect()) == list(range(1, 49)) and {r["tied"] for r in got.collect()} == {48}
    assert ranking.ranked(d.limit(0), ["g"], ORDER, 2, 2).isEmpty()


def test_sums_before(spark):
    """Prefix sums over more blocks than one, nulls a key of their own."""
    rows = [(k, at, RND.randint(0, 9)) for k in ("a", None) for at in range(50)]
    got = sums_before(spark.createDataFrame(rows, "k string, at long, n long"), "at", "n", ["k"], block=7).collect()
    assert len(got) == 100 and all(r["before"] == sum(n for k, at, n in rows if k == r["k"] and at < r["at"]) for r in got)


def test_ranks_of_odd_lines(spark):
    lines = [(None, 1, None, None, None, None, None, "x", None), (3, None, 7, 2, 25, 1.005, 0.055, "x", None), (3, None, 7, 2, 25, 1.005, 0.055, "x", None), (4, 2, 7, 2, 25, 2.5, None, "x", None)]
    d = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz")
    got = {tuple(r) for r in ranking.sale_line_ranks(d).collect()}
    one = [zlib.crc32(str(i).encode()) % 5 == 0 for i in (3, 4)]
    assert one == [False, False]  # neither lies in the one group
    assert got == {(None, -1, -1, 1, 1, None, 1, None, None, None, 1), (2, 2, -1, 1, 1, 4, 2, 25, None, 250, 1), (2, 2, -1, 2, 2, 3, None, 25, 6, 100, 2)}


# -- token files


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    texts = [None, "", "Hello <|endoftext|> world", "É ü 漢字", "ab " * 30_000, LONG, LONG] + [prose(RND.randint(1, 40)) for _ in range(400)]
    rows = [(i * 3 if i != 9 else None, t, i) for i, t in enumerate(texts)] + [(30, "again", 0), (30, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    return rows, token_files.write(docs, str(tmp_path_factory.mktemp("ids") / "t"), stripe=1 << 16, stride=1000)


def test_token_files(spark, files):
    rows, target = files
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = sorted(token_files.digests(spark, target).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in rows), key=lambda d: -1 if d is None else d)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, _ in rows)


def test_token_files_are_orc_with_indexes(spark, files):
    """Several stripes, a Bloom filter that rules ids out, and filters that reach the files."""
    import glob
    from pyarrow import orc
    paths = sorted(glob.glob(files[1] + "/*.orc"))
    read = [orc.ORCFile(p) for p in paths]
    assert sum(f.nrows for f in read) == len(files[0]) and all(f.row_index_stride == 1000 for f in read)
    firsts = [f.read(columns=["doc_id"]).column(0).drop_null() for f in read]
    ends = [(c[0].as_py(), c[-1].as_py()) for c in firsts if len(c)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))  # files follow each other
    hit = token_files.lookup(spark, files[1], [30, 33])
    assert sorted(r["doc_id"] for r in hit.collect()) == [30, 30, 30, 33]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [30,33])]" in plan
    assert "ids" not in token_files.starts(spark, files[1])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_token_files_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.written_and_read(none).isEmpty()
