"""License scan: families told apart, recall on edited notices, alignment against brute force."""
import random

import pytest

from drydock.llm import licenses

RND = random.Random(3)


def found(spark, texts):
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def test_families(spark):
    """One word decides: CC BY is not BY-NC, the lesser license not the general one, version 2 not 3."""
    gpl = licenses.TEMPLATES["GPL-2.0"][1]
    texts = ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0", "licensed under cc by-nc-sa 4.0", "Licensed under CC BY 3.0.", gpl, gpl.replace("version 2", "version 3"), gpl.replace("GNU General", "GNU Lesser General"), licenses.TEMPLATES["LGPL-2.1"][1].replace("2.1", "7")]
    assert found(spark, texts) == [["CC-BY-4.0"], ["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], ["CC-BY-NC-SA-4.0"], [], ["GPL-2.0"], ["GPL-3.0"], [], []]


def test_recall_on_edited_notices(spark):
    """Of notices with one word in twelve replaced, lost or added, nine in ten are found and none under another name."""
    texts, want = [], []
    for name, ts in licenses.TEMPLATES.items():
        for t in [ts] if isinstance(ts, str) else ts:
            if len(t.split()) < 16:
                continue
            keep = set(licenses.telling(name, [w.lower() for w in licenses.WORD.findall(t)]))
            for _ in range(12):
                out = []
                for w in t.split():
                    if RND.random() < 1 / 12 and not keep & {x.lower() for x in licenses.WORD.findall(w)}:
                        out += RND.choice([[], ["zzz"], [w, "zzz"]])
                    else:
                        out.append(w)
                texts.append("before " * 5 + " ".join(out) + " after" * 5)
                want.append(name)
    got = found(spark, texts)
    assert sum(w in g for w, g in zip(want, got)) >= 0.9 * len(want)
    # the short clause of a longer notice of the same license may stand for it; nothing else may
    assert all(set(g) <= {w} | ({"BSD-2-Clause", "BSD-3-Clause"} if w.startswith("BSD") else set()) for w, g in zip(want, got))


def brute(doc, template):
    """Most words of a template that stand in a document in order, by the whole table."""
    best = [0] * (len(doc) + 1)
    for w in template:
        last = 0
        for j, x in enumerate(doc, 1):
            last, best[j] = best[j], last + 1 if x == w else max(best[j], best[j - 1])
    return best[-1]


def test_alignment_against_brute_force():
    """In a band that holds the edits the alignment matches as many words as the whole table does."""
    t = [w.lower() for w in licenses.WORD.findall(licenses.TEMPLATES["ISC"])]
    for _ in range(20):
        doc = list(t)
        for _ in range(6):
            k = RND.randrange(len(doc))
            doc[k:k + 1] = RND.choice([[], ["zz"], [doc[k], "zz"]])
        m, first, last = licenses.aligned(["x"] * 5 + doc + ["y"] * 5, 5, t, len(t) // 8)
        assert m == brute(doc, t) and 5 <= first <= last < 5 + len(doc)


@pytest.mark.parametrize("text", [None, "", " ", "word " * 200_000 + "Released under the MIT License."])
def test_odd_texts(spark, text):
    d = spark.createDataFrame([(None, text, 1.0, 2), (7, text, 1.0, 2), (7, text, 1.0, 2)], "doc_id long, text string, coverage double, begin int")
    got = licenses.scan(d).collect()
    assert sorted(str(r["doc_id"]) for r in got) == (["7", "7", "None"] if text and "MIT" in text else [])
