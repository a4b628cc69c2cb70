"""The filter audit against a walk of every document through every order."""

import re
from itertools import permutations

import pytest

from ledgerloom.llm.op12_filter_audit import audited

SCHEMA = "doc_id long, text string, lang string, part string, fails int, n int, quality int, subset string"
WORDS = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    (1, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "en"), (3, WORDS + " $", "de"), (4, WORDS.upper(), "de"), (5, "a " * 150, None),
    (6, None, "en"), (7, "", "en"), (8, None, None), (None, WORDS, "en"), (None, "", "fr"), (-4, " \t\x0b ", "fr"), (9, "A|B " * 40000, "en"), (10, "Éé " * 101, "en"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (9, None, 1), (77, 1, 1), (None, 1, 1), (3, 1, 1)]


def walked(rows, labels):
    out = {}
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    docs = [(i, t or "", lang or "") for i, t, lang in rows]
    fails = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails.append({k for k, v in f.items() if v})
    for part in {p for _, _, p in docs}:
        mine = [(d, f) for d, f in zip(docs, fails) if d[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                there = [(d, f) for d, f in mine if not f & set(order[:k])]
                gone = [d for d, f in there if x in f]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(there) - len(gone), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), x,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], []])
def test_audit_against_every_order(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "s") for i, t, lang in rows], SCHEMA)
    labels = spark.createDataFrame([(*x, "k") for x in LABELS], "doc_id long, quality int, toxic int, lang string")
    found = audited(docs, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in found} == walked(rows, LABELS)
    assert len(found) == 600 * len({lang or "" for _, _, lang in rows})


def test_without_labels(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in TEXTS], "doc_id long, text string, lang string")
    found = audited(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in found} == walked(TEXTS, [])
