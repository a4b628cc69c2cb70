"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit distances.

An item of m words leaks into a document if a stretch of it has a word edit distance of at most `allowed(m)`, a fifth of
the item's words, to the item.  Items with fewer than five words have to stand there unchanged.

1. Every window of every document is embedded by WALKS random walks.  A walk emits the word it stands on at each step, and
   a random function of step and word says whether it moves on, so that walks over two texts fall into step again behind
   an edit: few edits become few differing places.  Items are embedded from several origins all over them, so that edits
   in one stretch leave the walks through the others alone: `origins_of`.
2. Each walk is sampled BANDS times at four to six places; the words there are hashed to a key.  Sampled are steps of which a
   walk seldom leaves the item, a walk takes about two for a word: `steps_of`.  A window is a candidate for an item if one
   of its WALKS * BANDS keys is the item's.  How the walk is sampled depends on the item's size class alone, so a window is
   looked up once for each class that the items fall into.
3. Where windows are candidates for one item, their surroundings are united, and each is verified by the edit distance of
   the whole item to the best stretch of it; first on hashes of words, then on the words.  The nearest stretch of all is
   reported, of equally near ones the first.

Recall with as many edits as the bound allows, at random places, side by side at any place, or spread evenly: at least 0.9,
measured in the tests on more than 1,000 pairs.

Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased.  Items without words don't count.  Items go to the
tasks in parts of at most MAX_ITEM_WORDS words, a pass of its own for each, so what is broadcast is bounded.  Null and
empty texts hold nothing; an empty table on either side gives an empty result.  Repeated rows of documents each get their
rows; repeated item ids are told by their text.  A document of any length is one row to verify item by item: united
surroundings are never longer than the document.  Columns of the input named like the result's are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._shared import ALNUM_WORDS, mixed, saved, utf8_rows, with_columns_from

WALKS, BANDS = 6, 4
MAX_ITEM_WORDS = 2_000_000
#: Least words of the size classes, the steps they are sampled from, and how many places are sampled.
CLASSES = ((1, 1, 1), (3, 4, 4), (6, 9, 4), (12, 18, 6), (24, 32, 6))
#: Words embedded at a time.
CHUNK_WORDS = 1 << 15

_PAD = np.uint64(0)


def allowed(m: int) -> int:
    """Word edits an item of m words is still found with."""
    return m // 5


def hashes_of(text: bytes | None) -> np.ndarray:
    return ALNUM_WORDS.of(text)


def class_of(m: int) -> int:
    return max(i for i, (least, _, _) in enumerate(CLASSES) if m >= least)


def origins_of(m: int) -> list[int]:
    """Words that an item of m words is embedded from: every so many that walks overlap by half, up to the last that fits."""
    span = -(-CLASSES[class_of(m)][1] // 2)
    last = max(0, m - span)
    return sorted({*range(0, last, max(1, span // 2)), last})


_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes: A-Z alone


@lru_cache(maxsize=None)
def steps_of(size_class: int) -> list[list[list[int]]]:
    """For each walk and band the steps sampled; all distinct where there are enough."""
    _, steps, sampled = CLASSES[size_class]
    draw = lambda w, b: np.random.default_rng((w, b, steps)).choice(steps, sampled, replace=False)
    return [[draw(w, b).tolist() for b in range(BANDS)] for w in range(WALKS)]


_FACTORS = mixed(np.arange(64, dtype=np.uint64), 50) | np.uint64(1)


def window_keys(words: np.ndarray, classes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size class, walk * BANDS + band, keys of the windows that start at each word); words end in pads, one a step of the largest class."""
    plans, n = {c: steps_of(c) for c in classes}, len(words) - max(CLASSES[c][1] for c in classes)
    word, move, term = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.uint64)
    for walk in range(WALKS):
        moves = mixed(words, 1 + walk).view(np.int64)  # bit j: whether the walk moves on from this word at step j
        at, keys = np.arange(n), {(c, b): np.zeros(n, np.uint64) for c in classes for b in range(BANDS)}
        sampled = {j: [(c, b) for c in classes for b in range(BANDS) if j in plans[c][walk][b]] for j in range(64)}
        last = max(j for j, s in sampled.items() if s)
        for j in range(last + 1):
            if sampled[j]:
                np.take(words, at, out=word, mode="clip")
                np.multiply(word, _FACTORS[j], out=term)
                for k in sampled[j]:
                    keys[k] += term
            if j < last:
                np.take(moves, at, out=move, mode="clip")
                np.right_shift(move, j, out=move)
                np.bitwise_and(move, 1, out=move)
                at += move
        for (c, b), k in keys.items():
            yield c, walk * BANDS + b, k


def fitting(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to the item; it may begin anywhere, or, anchored, at 0."""
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for word in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != word))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class ItemIndex:
    """Keys of some items, by size class, walk and band."""

    def __init__(self, items: list[tuple[int, bytes]]):
        hashed = [(i, hashes_of(text), text) for i, text in items]
        self.ids, self.words, self.texts = ([x[k] for x in hashed if len(x[1])] for k in range(3))
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.classes = sorted({class_of(len(w)) for w in self.words})
        self.tables: dict[tuple[int, int], tuple] = {}
        for c in self.classes:
            own = [(i, o) for i, w in enumerate(self.words) if class_of(len(w)) == c for o in origins_of(len(w))]
            pads, keys = np.full(CLASSES[c][1], _PAD), []
            for first in range(0, len(own), 1024):
                part = [self.words[i][o : o + len(pads)] for i, o in own[first : first + 1024]]
                places = np.cumsum([0] + [len(x) + len(pads) for x in part[:-1]])
                side_by_side = np.concatenate([x for words in part for x in (words, pads)])
                keys.append([k[places] for _, _, k in window_keys(side_by_side, [c])])
            bits = max(12, int(32 * len(own) - 1).bit_length())
            for which, column in enumerate(np.concatenate([np.array(k, np.uint64) for k in keys], axis=1)):
                order = np.argsort(column, kind="stable")
                hit = np.zeros(1 << bits, bool)
                hit[column >> np.uint64(64 - bits)] = True
                self.tables[c, which] = hit, np.uint64(64 - bits), column[order], np.array(own, np.int64)[order]

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where it would start, where the window does) of the windows that share a key with an item."""
        items, starts, places, pads = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], self.pads()
        n = len(words) - pads
        for first in range(0, n, CHUNK_WORDS):
            for c, which, keys in window_keys(words[first : min(n, first + CHUNK_WORDS) + pads], self.classes):
                hit, shift, sorted_keys, own = self.tables[c, which]
                maybe = np.flatnonzero(hit[keys >> shift])  # most windows end here
                lo = np.searchsorted(sorted_keys, keys[maybe], "left")
                met = np.flatnonzero(sorted_keys[np.minimum(lo, len(sorted_keys) - 1)] == keys[maybe])
                if len(met):
                    lo, maybe = lo[met], maybe[met]
                    count = np.searchsorted(sorted_keys, keys[maybe], "right") - lo
                    of = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    items.append(own[of, 0])
                    places.append(first + np.repeat(maybe, count))
                    starts.append(places[-1] - own[of, 1])
        return np.concatenate(items), np.concatenate(starts), np.concatenate(places)

    def pads(self) -> int:
        return max(CLASSES[c][1] for c in self.classes)

    def leaks(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, start, words, distance) of the nearest stretch for each item that leaks."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.tables:
            return out
        gap, at = np.full(self.pads(), _PAD), 0
        while at < len(texts):  # texts side by side, as many as make a chunk
            held, ends, first = [], [], at
            while at < len(texts) and sum(map(len, held)) < CHUNK_WORDS:
                held += [hashes_of(texts[at]), gap]
                ends.append(len(held[-2]))
                at += 1
            begins = np.cumsum([0] + [e + len(gap) for e in ends])
            words = np.concatenate(held)
            items, starts, places = self.candidates(words)
            text = np.clip(np.searchsorted(begins, places, "right") - 1, 0, len(ends) - 1)
            order = np.lexsort((starts, items, text))
            items, starts, text = items[order], starts[order], text[order]
            cut = np.flatnonzero((np.diff(items, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
            for a, z in zip(cut, np.append(cut[1:], len(items))):
                i, t = int(items[a]), int(text[a])
                own = words[begins[t] : begins[t] + ends[t]]
                best = self.nearest(self.words[i], self.counts[i], own, starts[a:z] - begins[t])
                if best is not None and (best := self.by_words(i, texts[first + t], starts[a:z] - begins[t])) is not None:
                    out[first + t].append((self.ids[i], best[1], best[2], best[0]))
        return out

    def by_words(self, i: int, text: bytes, starts: np.ndarray) -> tuple[int, int, int] | None:
        """`nearest` with the words themselves, numbered, in place of their hashes."""
        item = words_of(self.texts[i])
        number = {w: k for k, w in enumerate(dict.fromkeys(item))}
        code = lambda words: np.array([number.get(w, len(number)) for w in words], np.int64)
        own = code(item)
        return self.nearest(own, np.unique(own, return_counts=True), code(words_of(text)), starts)

    @staticmethod
    def nearest(item: np.ndarray, counts: tuple[np.ndarray, np.ndarray], words: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
        """(distance, start, words) of the stretch nearest to the item around the sorted starts, if it is near enough; counts: of the item's words."""
        k = allowed(len(item))
        before, behind = 2 * k + 2, len(item) + 2 * k + 2
        (own, times), best = counts, None
        cuts = [0, len(starts)] if len(starts) == 1 else [0, *(np.flatnonzero(np.diff(starts) > before + behind) + 1).tolist(), len(starts)]
        for a, z in zip(cuts, cuts[1:]):
            begin, end = max(int(starts[a]) - before, 0), min(int(starts[z - 1]) + behind, len(words))
            around = words[begin:end]
            # words of the item that stand around at all: each other one is an edit
            at = np.minimum(np.searchsorted(own, around), len(own) - 1)
            there = np.zeros(len(own), bool)
            there[at[own[at] == around]] = True
            if len(item) - times[there].sum() > k:
                continue
            distance, end = fitting(item, around)
            if distance <= k and (best is None or distance < best[0]):
                _, back = fitting(item[::-1], around[:end][::-1], anchored=True)
                best = distance, begin + end - back, back
        return best


def item_parts(items: DataFrame, key: str, text: str, most: int = MAX_ITEM_WORDS) -> Iterator[list[tuple[int, bytes]]]:
    """The items in parts of at most `most` words or one item, fetched one part at a time."""
    held, words = [], 0
    for r in items.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text)).orderBy(key, text).toLocalIterator():
        n = len(hashes_of(r[1].encode()))
        if held and words + n > most:
            yield held
            held, words = [], 0
        held.append((r[0], r[1].encode()))
        words += n
    yield held


LEAK = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "n_words", "distance")]))
_LEAK = pa.list_(pa.struct([(f.name, pa.int64()) for f in LEAK.elementType]))


def _with_part(docs: DataFrame, part: list[tuple[int, bytes]], text: str) -> DataFrame:
    """docs with the leaks of one part of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(part)
    index: list[ItemIndex] = []  # one for each task

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not index:
            index.append(ItemIndex(shared.value))
        found = [[dict(zip(("item_id", "start", "n_words", "distance"), leak)) for leak in leaks] for leaks in index[0].leaks(utf8_rows(batch.column(text)))]
        return [pa.array(found, _LEAK)]

    return with_columns_from(docs, [T.StructField("leaks", LEAK)], make, [text])


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = MAX_ITEM_WORDS) -> DataFrame:
    """docs with `leaks` (replaces a column of that name): for each item that leaks into the text, its place in words and edit distance.

    Several parts of items are searched one after another, each by a job whose leaks are written by digest of the text
    and met with the documents in the end, so executors hold one part's index at a time.
    """
    docs = docs.drop(*[c for c in ("leaks",) if c != text])
    parts = item_parts(items, item_key, item_text, most)
    part, after = next(parts), next(parts, None)
    if after is None:
        return _with_part(docs, part, text)
    digest = F.unhex(F.md5(F.col(text)))
    texts, found = docs.select(F.col(text).alias("text")), None
    while part is not None:
        own = saved(
            _with_part(texts, part, "text").filter(F.size("leaks") > 0).select(F.unhex(F.md5("text")).alias("__digest"), F.explode("leaks").alias("leak")).distinct(),
            "leaks"
        )
        found = own if found is None else found.union(own)
        part, after = after, next(parts, None)
    leaks = found.groupBy("__digest").agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    met = docs.withColumn("__own", digest).join(leaks.hint("shuffle_hash"), F.col("__own") == F.col("__digest"), "left")
    return met.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAK))).drop("__own", "__digest")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    most: int = MAX_ITEM_WORDS
) -> DataFrame:
    """A row (doc_id, item_id, start, n_words, distance) for each document and item that leaks into it."""
    found = with_leaks(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), items, "text", item_key, item_text, most)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that leaks into it."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
