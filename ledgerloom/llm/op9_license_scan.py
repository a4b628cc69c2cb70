"""Licence scans with a positional index of rare words.

The words of all templates (notices and licence texts) are indexed with their positions.  Of a file's own licence words,
those that some template holds, the RARE_SHARE of highest IDF and at least RARE_LEAST are looked up; ties go to the smaller
word, and document frequencies are counted over all documents.  Every place of such a word votes for the templates and
relative positions its postings name.  Votes for one template at relative positions within its drift of each other are
intersected: an alignment needs votes from MIN_VOTES of the template's places that hold looked-up words, all of its key
phrases within the aligned stretch, and MIN_SCORE of its words in order there.

Apart from that, base phrases are found wherever their words stand consecutively.  Words are maximal runs of a-z, 0-9
and non-ASCII characters after lower-casing A-Z.  Null and empty texts have no words, labels are then empty strings and
the score is 0.  Whole texts are scanned, row by row, so repeated rows get equal results, and an empty table an empty one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._licences import TEMPLATES
from ledgerloom.llm._shared import SLICE_ROWS, utf8_rows, with_columns_from

RARE_SHARE, RARE_LEAST, MIN_VOTES, MIN_SCORE = 0.5, 8, 0.6, 0.7

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def license_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def drift_of(template: list[bytes]) -> int:
    """Words by which a place may be off: two, and one more for each 25 words."""
    return 2 + len(template) // 25


def in_order(words: list[bytes], template: list[bytes], start: int) -> float:
    """Share of a template's words that follow each other in words[start : ...], within its drift of their places."""
    at, found, drift = max(0, start), 0, drift_of(template)
    for q, w in enumerate(template):
        for p in range(max(at, start + q - drift), min(len(words), start + q + drift + 1)):
            if words[p] == w:
                found, at = found + 1, p + 1
                break
    return found / len(template)


def has_keys(words: list[bytes], template: list[bytes], keys: list[list[bytes]], start: int) -> bool:
    """Whether all key phrases stand in the stretch that a template would take."""
    drift = drift_of(template)
    stretch = words[max(0, start - drift) : max(0, start + len(template) + 2 * drift)]
    return all(any(stretch[i : i + len(k)] == k for i in range(len(stretch) - len(k) + 1)) for k in keys)


class LicenseIndex:
    """Postings of the templates' words."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _, _ in templates]
        self.templates = [license_words(t.encode()) for _, t, _ in templates]
        self.keys = [[license_words(k.encode()) for k in keys] for _, _, keys in templates]
        self.key_words = [{w for k in keys for w in k} for keys in self.keys]
        self.base = [(license_words(p.encode()), label) for p, label in base.items()]
        self.base_firsts = {p[0] for p, _ in self.base}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in self.postings}
        self.rank = {w: r for r, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}

    @staticmethod
    def vocabulary(templates=TEMPLATES) -> set[bytes]:
        return {w for _, t, _ in templates for w in license_words(t.encode())}

    def aligned(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, score) of each verified alignment."""
        present = self.rank.keys() & set(words)
        possible = {t for t, needed in enumerate(self.key_words) if needed <= present}  # others lack words of their key phrases
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words) if possible else ():
            if w in self.rank:
                places[w].append(p)
        own = sorted(places, key=self.rank.__getitem__)
        votes: dict[int, Counter] = defaultdict(Counter)
        asked: Counter = Counter()
        for w in own[: max(RARE_LEAST, math.ceil(RARE_SHARE * len(own)))]:
            for t, q in self.postings[w]:
                if t in possible:
                    asked[t] += 1
                    votes[t].update([p - q for p in places[w]])
        out = []
        for t, at in votes.items():
            template, starts, need = self.templates[t], sorted(at), math.ceil(MIN_VOTES * asked[t])
            drift = drift_of(template)
            for i, s in enumerate(starts):
                j = bisect_left(starts, s + drift + 1)
                if sum(at[x] for x in starts[i:j]) >= need and has_keys(words, template, self.keys[t], s) and (
                    score := max(in_order(words, template, x) for x in starts[i:j])
                ) >= MIN_SCORE:
                    out.append((t, score))
        return out

    def scan(self, text: bytes | None) -> tuple:
        words = license_words(text)
        places, base_labels = [], set()
        for p in [i for i, w in enumerate(words) if w in self.base_firsts]:
            for phrase, label in self.base:
                if words[p : p + len(phrase)] == phrase:
                    places.append(p)
                    base_labels.add(label)
        found = self.aligned(words)
        labels = base_labels | {self.labels[t] for t, _ in found}
        score = 1.0 if places else max([s for _, s in found], default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of `vocabulary` stands, and the number of documents (at most a row a word comes here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for t in utf8_rows(batch.slice(at, SLICE_ROWS).column(0)):
                    count[b""] += 1
                    count.update(vocabulary.intersection(license_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
]


def with_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """docs with the columns of FIELDS (which replace any of those names)."""
    frequency, documents = word_frequencies(docs, LicenseIndex.vocabulary(templates), text)
    index = LicenseIndex(frequency, documents, templates, base)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [index.scan(t) for t in utf8_rows(batch.column(text))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return with_columns_from(docs, FIELDS, make, [text])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id and the columns of FIELDS."""
    return with_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
