"""Scores against the model's definition in plain Python; probabilities sum to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF
from ledgerloom.llm import op13_lm_scoring as lm

SCHEMA = "doc_id long, text string, score string, n_tokens int, words int, place int, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(folded), "\n"]


class Plain:
    """The definition."""

    def __init__(self, rows):
        texts = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter((a, b) for t in texts for a, b in zip([" ", *t], t))
        self.context, self.by = Counter(), defaultdict(lambda: [0, 0, 0])
        for (a, _), n in self.pairs.items():
            self.context[a] += n
            self.by[a][min(n, 3) - 1] += 1
        self.left = Counter(b for _, b in self.pairs)
        of = lambda counts: lm.discounts_of([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])
        self.d, self.e = of(self.pairs), of(self.left)
        self.free = sum(self.e[min(a, 3) - 1] for a in self.left.values())

    def word(self, w):
        total, a = sum(self.left.values()), self.left[w]
        if not total:
            return 1 / (self.v + 1)
        return (max(a - (self.e[min(a, 3) - 1] if a else 0), 0) + self.free / (self.v + 1)) / total

    def p(self, h, w):
        if not self.context[h]:
            return self.word(w)
        n = self.pairs[h, w]
        return (max(n - (self.d[min(n, 3) - 1] if n else 0), 0) + sum(d * k for d, k in zip(self.d, self.by[h])) * self.word(w)) / self.context[h]

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(a, b)) for a, b in zip([" ", *t], t))


def corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(None, "the of and"), (None, None), (1001, None), (1002, ""), (1003, " \n\x0b"), (1004, "É é THE the\x1cx"), (1005, "the end " * 60_000), (rows[3]), (rows[3]), (-1, "nowhere seen"), (1006, "\n")]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


def checked(spark, rows):
    docs = frame(spark, rows)
    plain = Plain(rows)
    expected = sorted((repr((i, t)), *plain.row(t)) for i, t in rows)
    found = sorted((repr((r["doc_id"], r["text"])), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.with_scores(docs, lm.trained(docs)).collect())
    assert [x[:4] for x in found] == [x[:4] for x in expected]
    assert np.allclose([x[4:] for x in found], [x[4:] for x in expected], rtol=1e-9)
    return plain


def test_scores_against_the_definition(spark, monkeypatch):
    rows = corpus(spark)
    plain = checked(spark, rows)
    assert plain.d != lm.FALLBACK
    contexts = [" ", "the", "\n", "never seen", next(iter(plain.c))]
    for h in contexts:  # the unknown word has the probability of any word that is in no count
        assert sum(plain.p(h, w) for w in plain.c) + plain.p(h, "never seen") == pytest.approx(1)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 16)  # more buckets
    docs = frame(spark, rows)
    again = lm.trained(docs)
    assert again.buckets > 10
    score = lambda model: sorted((r["n_tokens"], r["score"]) for r in lm.with_scores(docs, model).collect())
    assert np.allclose(score(again), sorted((n, s) for n, _, _, _, s in map(plain.row, (t for _, t in rows))))


@pytest.mark.parametrize("rows", [[(None, "a b"), (None, None)], [(1, "a a a a"), (2, "a"), (3, None)]])
def test_small_corpora(spark, rows):
    checked(spark, rows)


def test_empty_and_held_out(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    assert lm.with_scores(docs, lm.trained(docs)).count() == 0
    ids = frame(spark, [(i, "") for i in [*range(200), None]])
    assert {r["doc_id"]: r["h"] for r in ids.select("doc_id", lm.is_held_out().alias("h")).collect()} == {None: False} | {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(200)}


def test_unseen_texts_are_likelier_than_by_the_base(spark):
    found = lm.op13_lm_scoring(spark, SF).filter("held_out").toPandas()
    assert len(found) and found.score.sum() > found.base_score.sum()


def test_folders_that_cannot_be_mounted_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        lm.mounted("hdfs://host/shared")
