"""Language-model scores: interpolated modified Kneser-Ney bigrams, counted in Spark, kept as sorted hash arrays.

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) p(w)        p(w) = max(a(w) - E(a(w)), 0) / A + delta / (V + 1)

c counts in the training texts, a(w) counts the distinct words before w, A sums a.  D and E take one of three discounts by
count (1, 2, 3 or more), estimated from the counts of counts; gamma and delta are what the discounts set free, so that the
V training words and one unknown word share all probability.  A context that was never seen leaves p(w) alone.

1. Words are counted: each task sums runs of RUN_TOKENS tokens and sends the sorted hashes, cut into ranges, to the
   buckets of those ranges.  A bucket writes its hashes as one sorted array and the counts beside it.  A word's id is its
   bucket and its place there.
2. Pairs of ids are counted alike, in ranges of the pairs' hashes, so neither a frequent word nor a repeated passage
   weighs on one bucket: a run sends a pair once.  A bucket sends what it adds to each word as a context and as a
   continuation, summed, to the bucket of that word, which writes those sums by place.
3. Scoring tasks map the arrays into memory and look up the distinct words and pairs of a slice of documents at a time.

Arrays are written to a temporary name and renamed, and are the same whichever attempt of a task writes them.  The shared
folder (spark.checkpoint.dir) has to be mounted on all workers for that, as a file: path.

Tokens are the words between white space, A-Z lower-cased, then one end; null and empty texts are an end alone.  Texts are
learnt from whole, and scored whole, whatever their length; repeated rows count each.  Rows with a null doc_id are scored,
not held out and never learnt from.  Without training texts V and A are zero and every token has probability one.  Columns
named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import secrets
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._blocks import expand, expand_sorted, squeeze, squeeze_sorted
from ledgerloom.llm._shared import keyed_words, mixed, partition_count, saved, utf8_rows, with_columns_from, work_path

#: Tokens a task sums at a time; bytes of text whose words and pairs a bucket holds, on average; bytes of text scored at a time.
RUN_TOKENS, BUCKET_BYTES, SLICE_BYTES = 2_500_000, 16 << 20, 4 << 20
#: Discounts of counts 1, 2 and 3 or more where the counts of counts don't give any (a corpus too small or too regular).
FALLBACK = (0.5, 1.0, 1.5)
START, END = mixed(np.arange(2, dtype=np.uint64), 13)
#: A word's id: its bucket, then PLACE_BITS bits of its place there.
PLACE_BITS = 40


def is_held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens_of(texts: list[bytes | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, one text after the other, and where each text's begin."""
    each = [keyed_words(seed).of(t) for t in texts]
    sizes = np.array([len(x) + 1 for x in each], np.int64)
    ends = np.cumsum(sizes)
    out = np.full(int(sizes.sum()), END)
    at_word = np.ones(len(out), bool)
    at_word[ends - 1] = False
    out[at_word] = np.concatenate(each) if each else []
    return out, ends - sizes


def slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of texts of about SLICE_BYTES bytes, or of one text."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or b"") + 8
        if held >= SLICE_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit hashes; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stretches(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of each stretch of equal values."""
    if len(sorted_values):
        cuts = [0, *(np.flatnonzero(np.diff(sorted_values)) + 1).tolist(), len(sorted_values)]
        for start, stop in zip(cuts, cuts[1:]):
            yield int(sorted_values[start]), start, stop


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with each column of values summed over equal ones."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


def small(counts: np.ndarray) -> np.ndarray:
    """counts in the narrowest unsigned integers that hold them."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)


def packed(counts: np.ndarray) -> bytes:
    c = small(counts)
    return bytes([c.itemsize]) + squeeze(c)


def unpacked(blob: bytes) -> np.ndarray:
    return expand(blob[1:], np.dtype(f"u{blob[0]}")).astype(np.int64)


# -- arrays in the shared folder ---------------------------------------------------------------------------------------


def mounted(path: str) -> str:
    """The path that workers open."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: arrays can be mapped into memory in a mounted folder only; set spark.checkpoint.dir to a file: path")
    return unquote(parts.path)


def write_array(folder: str, name: str, bucket: int, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    temporary = f"{folder}/.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        np.save(out, values)
    os.replace(temporary, f"{folder}/{name}-{bucket}.npy")


@lru_cache(maxsize=4096)
def read_array(folder: str, name: str, bucket: int) -> np.ndarray | None:
    """An array mapped into memory; None for a bucket that nothing fell into."""
    path = f"{folder}/{name}-{bucket}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def places(folder: str, name: str, buckets: int, sorted_hashes: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(bucket, part of sorted_hashes, its places in that bucket's array, which of them are there)."""
    for bucket, start, stop in stretches(bucket_of(sorted_hashes, buckets)):
        known = read_array(folder, name, bucket)
        if known is not None and len(known):
            part = sorted_hashes[start:stop]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            yield bucket, slice(start, stop), at, known[at] == part


def word_ids(folder: str, buckets: int, sorted_hashes: np.ndarray) -> np.ndarray:
    """Ids of words, -1 for those that training didn't show."""
    out = np.full(len(sorted_hashes), -1, np.int64)
    for bucket, part, at, there in places(folder, "words", buckets, sorted_hashes):
        out[part] = np.where(there, at + (bucket << PLACE_BITS), -1)
    return out


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(left.astype(np.uint64), 3) + right.astype(np.uint64), 4)


# -- counting ----------------------------------------------------------------------------------------------------------


def in_runs(batches: Iterator[pa.RecordBatch], take: Callable[[list[bytes | None]], int], flush: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Feeds slices of the texts to `take`, which says how many tokens they have, and flushes after each run of them."""
    held = 0
    for batch in batches:
        for texts in slices(utf8_rows(batch.column(0))):
            held += take(texts)
            if held >= RUN_TOKENS:
                yield from flush()
                held = 0
    yield from flush()


def word_counts(train: DataFrame, folder: str, buckets: int, seed: int) -> tuple[int, int]:
    """Writes the words' hashes and counts; (tokens, distinct words)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def take(texts: list[bytes | None]) -> int:
            hashes, _ = tokens_of(texts, seed)
            seen.append(np.unique(hashes, return_counts=True))
            return len(hashes)

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                seen.append((np.array([START]), np.array([0])))  # a context, but no token
                keys, n = summed(np.concatenate([k for k, _ in seen]), np.concatenate([n for _, n in seen]))
                seen.clear()
                cut = list(stretches(bucket_of(keys, buckets)))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
                    "words": pa.array([squeeze_sorted(keys[i:j]) for _, i, j in cut], pa.binary()),
                    "n": pa.array([packed(n[i:j]) for _, i, j in cut], pa.binary()),
                })

        return in_runs(batches, take, flush)

    def merge(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        keys, n = summed(np.concatenate([expand_sorted(x) for x in rows.column("words").to_pylist()]), np.concatenate([unpacked(x) for x in rows.column("n").to_pylist()]))
        write_array(folder, "words", bucket, keys)
        write_array(folder, "counts", bucket, small(n))
        return pa.table({"tokens": [int(n.sum())], "words": [int((n > 0).sum())]})

    made = train.mapInArrow(send, "bucket int, words binary, n binary").groupBy("bucket").applyInArrow(merge, "tokens long, words long")
    found = made.agg(F.sum("tokens"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


#: What a bucket of pairs adds to the words of a bucket: as contexts (0) or as continuations (1); or, of kind 2, its counts of counts.
_ADDED = "kind int, bucket int, place binary, total binary, ones binary, twos binary, more binary"


def pair_counts(train: DataFrame, folder: str, buckets: int, seed: int) -> DataFrame:
    """Writes the pairs' hashes and counts; returns what they add to the words, as rows of _ADDED."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, ...]] = []

        def take(texts: list[bytes | None]) -> int:
            hashes, starts = tokens_of(texts, seed)
            distinct, which = np.unique(np.append(hashes, START), return_inverse=True)
            ids = word_ids(folder, buckets, distinct)[which]
            right, left = ids[:-1], np.roll(ids[:-1], 1)
            left[starts] = ids[-1]
            keys, first, n = np.unique(pair_hashes(left, right), return_index=True, return_counts=True)
            seen.append((keys, left[first], right[first], n))
            return len(hashes)

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                keys, left, right, n = (np.concatenate(x) for x in zip(*seen))
                seen.clear()
                keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
                left, right, n = left[first], right[first], np.bincount(which, n, len(keys)).astype(np.int64)
                cut, rows = list(stretches(bucket_of(keys, buckets))), []
                for _, i, j in cut:
                    order = i + np.argsort(left[i:j], kind="stable")  # contexts as differences
                    rows.append((squeeze_sorted(left[order].astype(np.uint64)), squeeze(right[order]), packed(n[order])))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in cut], pa.int32())} | {name: pa.array([r[k] for r in rows], pa.binary()) for k, name in enumerate(("left", "right", "n"))})

        return in_runs(batches, take, flush)

    def merge(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        joined = lambda name, f: np.concatenate([f(x) for x in rows.column(name).to_pylist()])
        left, right, n = joined("left", lambda x: expand_sorted(x).astype(np.int64)), joined("right", lambda x: expand(x, np.int64)), joined("n", unpacked)
        keys, first, which = np.unique(pair_hashes(left, right), return_index=True, return_inverse=True)
        left, right, n = left[first], right[first], np.bincount(which, n, len(keys)).astype(np.int64)
        write_array(folder, "pairs", bucket, keys)
        write_array(folder, "pair_counts", bucket, small(n))
        out = [(2, -1, b"", packed(np.array([(n == k).sum() for k in (1, 2, 3, 4)])), b"", b"", b"")]
        for kind, ids, columns in ((0, left, (n, n == 1, n == 2, n >= 3)), (1, right, (np.ones(len(n), np.int64),))):
            ids, *sums = summed(ids, *[c.astype(np.int64) for c in columns])
            for b, i, j in stretches(ids >> PLACE_BITS):
                place = squeeze_sorted((ids[i:j] & ((1 << PLACE_BITS) - 1)).astype(np.uint64))
                out.append((kind, b, place, *[packed(s[i:j]) for s in sums], *[b""] * (4 - len(sums))))
        return pa.table({name: pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.binary()) for k, name in enumerate(x.split()[0] for x in _ADDED.split(", "))})

    return saved(train.mapInArrow(send, "bucket int, left binary, right binary, n binary").groupBy("bucket").applyInArrow(merge, _ADDED), "lm-added")


def word_sums(added: DataFrame, folder: str, discounts: tuple[float, ...]) -> tuple[int, list[int], int]:
    """Writes, by place of a word: how often it is a context, what the discounts set free there, and how many words it follows.

    Returns the sum of the last, how many words follow 1, 2, 3, 4 words, and how many follow three or more.
    """

    def merge(rows: pa.Table) -> pa.Table:
        bucket, kinds = rows.column("bucket")[0].as_py(), rows.column("kind").to_pylist()
        size = len(read_array(folder, "words", bucket))
        total, free, left = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
        for kind, place, sums, *by_count in zip(kinds, *[rows.column(c).to_pylist() for c in ("place", "total", "ones", "twos", "more")]):
            at = expand_sorted(place).astype(np.int64)
            if kind == 1:
                left[at] += unpacked(sums)
            else:
                total[at] += unpacked(sums)
                free[at] += sum(d * unpacked(x) for d, x in zip(discounts, by_count))
        for name, values in (("total", small(total)), ("free", free.astype(np.float64)), ("left", small(left))):
            write_array(folder, name, bucket, values)
        return pa.table({"total": [int(left.sum())]} | {f"n{k}": [int((left == k).sum())] for k in (1, 2, 3, 4)} | {"more": [int((left >= 3).sum())]})

    made = added.filter("kind < 2").groupBy("bucket").applyInArrow(merge, "total long, n1 long, n2 long, n3 long, n4 long, more long")
    total, *by_count, more = [x or 0 for x in made.agg(*[F.sum(c) for c in ("total", "n1", "n2", "n3", "n4", "more")]).first()]
    return total, by_count, more


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """The three discounts, from how many things were seen 1, 2, 3 and 4 times."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return FALLBACK


class Model(NamedTuple):
    """Where the arrays are, and the few numbers that hold for all words."""

    folder: str
    buckets: int
    seed: int
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    left_discounts: tuple[float, float, float]
    left_total: int
    left_free: float


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from the rows that aren't held out."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(partition_count(spark), -(-size // BUCKET_BYTES))
    train = docs.filter(F.col(key).isNotNull() & ~is_held_out(key)).select(F.col(text).cast("string").alias("text"))
    folder = mounted(work_path(spark, "lm"))
    seed = secrets.randbits(63)  # of the words' hashes, which no text can foresee
    tokens, words = word_counts(train, folder, buckets, seed)
    added = pair_counts(train, folder, buckets, seed)

    def four(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += unpacked(x)
        yield pa.RecordBatch.from_pydict({f"n{k}": [int(v)] for k, v in enumerate(total, 1)})

    n = added.filter("kind = 2").select("total").mapInArrow(four, "n1 long, n2 long, n3 long, n4 long").agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()
    discounts = discounts_of([x or 0 for x in n])
    left_total, by_count, more = word_sums(added, folder, discounts)
    left_discounts = discounts_of(by_count)
    left_free = sum(d * m for d, m in zip(left_discounts, (by_count[0], by_count[1], more)))
    return Model(folder, buckets, seed, tokens, words, discounts, left_discounts, left_total, left_free)


# -- scoring -----------------------------------------------------------------------------------------------------------


def scored(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, tokens that training showed, base score, log10 probability."""
    hashes, starts = tokens_of(texts, model.seed)
    distinct, which = np.unique(np.append(hashes, START), return_inverse=True)
    ids = np.full(len(distinct), -1, np.int64)
    count, total, left, free = (np.zeros(len(distinct)) for _ in range(4))
    for bucket, part, at, there in places(model.folder, "words", model.buckets, distinct):
        ids[part] = np.where(there, at + (bucket << PLACE_BITS), -1)
        for name, into in (("counts", count), ("total", total), ("left", left), ("free", free)):
            into[part] = np.where(there, read_array(model.folder, name, bucket)[at], 0)
    less = np.array([0.0, *model.left_discounts])[np.minimum(left, 3).astype(np.int64)]
    share = model.left_free / (model.words + 1) if model.left_total else 1 / (model.words + 1)
    word = (np.maximum(left - less, 0) + share) / max(model.left_total, 1)
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))

    now, before = which[:-1], np.roll(which[:-1], 1)
    before[starts] = which[-1]
    both = (ids[now] >= 0) & (total[before] > 0)
    keys, back = np.unique(pair_hashes(ids[before][both], ids[now][both]), return_inverse=True)
    pairs = np.zeros(len(keys))
    for bucket, part, at, there in places(model.folder, "pairs", model.buckets, keys):
        pairs[part] = np.where(there, read_array(model.folder, "pair_counts", bucket)[at], 0)
    seen = np.zeros(len(now))
    seen[both] = pairs[back]
    seen -= np.array([0.0, *model.discounts])[np.minimum(seen, 3).astype(np.int64)]
    context = total[before]
    p = np.where(context > 0, (np.maximum(seen, 0) + free[before] * word[now]) / np.maximum(context, 1), word[now])
    by_text = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
    return np.diff(starts, append=len(now)), by_text((count[now] > 0).astype(np.int64)), by_text(base[now]), by_text(np.log10(p))


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score."""
    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [scored(model, run) for run in slices(utf8_rows(batch.column(0)))]
        n, known, base, score = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0)] * 4
        tokens = np.full(len(n), model.tokens)
        return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]

    return with_columns_from(docs.withColumn(text, F.col(text).cast("string")), [T.StructField(c, t) for c, t in kinds.items()], make, [text])


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its tokens, its base score and its log10 probability."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_scores(docs, trained(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
