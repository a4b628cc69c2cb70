"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (GRAMS bytes long, of its UTF-8 with A-Z lower-cased and white space as one
space) that it holds.  A feature's scale is the log ratio of its smoothed shares of the toxic and of the other training
documents; logistic regression then learns weights of the scaled features.  Weights are kept as one array of 2**BITS
numbers, which is what the scoring tasks get: its size does not depend on the data.

Training uses labelled rows whose crc32(doc_id as text) mod 4 is not 2, of these the MAX_TRAIN_ROWS with the smallest
hash of their id at most: the one bound on what is learnt from.  Used are all features that MIN_DOCUMENTS of them hold and
whose scale is MIN_ERRORS standard errors from zero or more.  Loss and gradient are summed in tasks over the saved
training rows, a job for each step of the optimiser (limited-memory BFGS); the driver holds a few vectors of weights.

Rows with one doc_id and different labels count as toxic; of different texts with one doc_id the one with the smallest
hash is learnt from, so repeated rows count once.  Without any training row, or with one class only, the score is the
smoothed share of toxic rows.  Null and empty texts have no features and score what the intercept says; texts of any length
are read whole.  A null doc_id is never learnt from and not held out.  Ids and other columns are never features.  Columns
named score or predicted are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._blocks import expand, squeeze
from ledgerloom.llm._shared import SLICE_ROWS, discard, saved, utf8_rows, with_columns_from

GRAMS, BITS = (4, 5, 6), 18
#: Labelled rows the classifier is fitted on at most; least training documents with a feature, least standard errors of its scale.
MAX_TRAIN_ROWS, MIN_DOCUMENTS, MIN_ERRORS = 40_000, 5, 3
#: Parts the training rows are summed in; steps of the optimiser at most, and pairs of steps and gradients it remembers.
PARTS, STEPS, MEMORY = 12, 60, 10
THRESHOLD = 0.3

_WHITE = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def features_of(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text."""
    b = np.frombuffer(b" " + _WHITE.sub(b" ", (text or b"").translate(_LOWER)).strip() + b" ", np.uint8).astype(np.uint64)
    if len(b) <= 2:
        return np.empty(0, np.int64)
    found = np.zeros(1 << BITS, bool)
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(b) - n + 1] * np.uint64(0x9FB21C651E98DF25) + b[n - 1 :]
        if n in GRAMS and len(h):
            found[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(found)


def is_held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of the rows to learn from; the labels are bounded by `rows`, so that they can be broadcast."""
    known = labels.filter(
        F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(key)
    ).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    met = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    return met.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"), F.max("toxic").alias("toxic")).select("toxic", "row.text")


def packed(ids: np.ndarray) -> bytes:
    """Sorted ids as compressed differences."""
    return squeeze(np.diff(ids, prepend=0).astype("<u4"))


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint32), dtype=np.int64)


def feature_rows(train: DataFrame) -> DataFrame:
    """(toxic, features): packed ids of each training text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([packed(features_of(t)) for t in utf8_rows(part.column(1))], pa.binary())],
                    names=["toxic", "features"]
                )

    return train.mapInArrow(run, "toxic int, features binary")


def class_counts(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and for each class how many have each feature: summed in ranges of features."""
    width = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for toxic, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[int(toxic > 0), unpacked(ids)] += 1
                rows[int(toxic > 0)] += 1
        ranges = [count[:, at : at + width].tobytes() for at in range(0, 1 << BITS, width)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(ranges))], pa.int32()), pa.array([rows.tobytes(), *ranges], pa.binary())], names=["part", "counts"])

    def total(group: pa.Table) -> pa.Table:
        out = np.sum([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()], axis=0)
        return pa.table({"part": group.column("part").slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    parts = {
        r["part"]: np.frombuffer(r["counts"], np.int64) for r in features.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(total, "part int, counts binary").collect()
    }
    rows = parts.pop(-1, np.zeros(2, np.int64))
    counts = np.concatenate([parts[k].reshape(2, -1) for k in sorted(parts)], axis=1) if parts else np.zeros((2, 1 << BITS), np.int64)
    return rows, counts


def log_ratios(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes scale of each feature, and the features to use."""
    share = (counts + 1) / (rows[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    error = np.sqrt((1 - share[1]) / (counts[1] + 1) + (1 - share[0]) / (counts[0] + 1))
    return ratio, np.flatnonzero((counts.sum(axis=0) >= MIN_DOCUMENTS) & (np.abs(ratio) > MIN_ERRORS * error))


def loss_and_gradient(rows: Iterator[tuple[int, bytes]], weights: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss of rows (label, packed feature places) and its gradient; the intercept is last."""
    k, value = len(scale), np.append(weights[:-1] * scale, 0.0)
    loss, gradient = 0.0, np.zeros(k + 1)
    for y, blob in rows:
        ids = unpacked(blob)
        margin = float(value[ids].sum()) + weights[-1]
        loss += np.logaddexp(0.0, margin) - y * margin
        gap = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        gradient[ids] += gap
        gradient[k] += gap
    gradient[:k] *= scale
    return loss, gradient


def minimized(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, memory: int = MEMORY) -> np.ndarray:
    """Limited-memory BFGS with halved steps until the objective falls enough."""
    x, (f, g), past = start, objective(start), []
    for _ in range(steps):
        if np.abs(g).max() < 1e-4:
            break
        q, taken = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            taken.append(a)
            q -= a * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(taken)):
            q += (a - y @ q / (s @ y)) * s
        rate = 1.0
        while True:
            new = x - rate * q
            f_new, g_new = objective(new)
            if f_new <= f - 1e-4 * rate * (g @ q) or rate < 1e-6:
                break
            rate /= 2
        if (new - x) @ (g_new - g) > 1e-12:
            past = [*past[1 - memory :], (new - x, g_new - g)]
        done = f - f_new < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def train_weights(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = MAX_TRAIN_ROWS,
    l2: float = 1.0
) -> tuple[np.ndarray, float]:
    """(weight of each hashed feature, intercept): the least mean of loss and l2 / 2 times the squared weights over the rows."""
    spark = docs.sparkSession
    features = saved(feature_rows(training_rows(docs, labels, key, text, label, rows)), "toxicity-features")
    n, counts = class_counts(features)
    weights = np.zeros(1 << BITS, np.float32)
    if n.min() == 0:
        return weights, float(np.log((n[1] + 1) / (n[0] + 1)))
    ratio, keep = log_ratios(n, counts)
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    scale, total = ratio[keep], int(n.sum())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [place[unpacked(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(x[x >= 0]) for x in own], pa.binary())], names=["toxic", "features"])

    sample = saved(features.coalesce(PARTS).mapInArrow(kept, "toxic int, features binary"), "toxicity-sample")
    discard(features)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((int(y > 0), x) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            loss, gradient = loss_and_gradient(rows, shared.value, scale)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        # a vector of weights from each of about PARTS tasks
        sums = sample.mapInArrow(run, "loss double, gradient binary").collect()
        shared.unpersist()
        inner = np.append(w[:-1], 0.0)
        gradient = np.sum([np.frombuffer(r["gradient"]) for r in sums], axis=0)
        return (sum(r["loss"] for r in sums) + l2 / 2 * float(inner @ inner)) / total, (gradient + l2 * inner) / total

    found = minimized(objective, np.append(np.zeros(len(keep)), np.log((n[1] + 1) / (n[0] + 1))))
    weights[keep] = found[:-1] * scale
    return weights, float(found[-1])


def with_toxicity(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (which replace any columns of those names)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        w = shared.value
        score = [1 / (1 + np.exp(-np.clip(float(w[features_of(t)].sum()) + intercept, -40, 40))) for t in utf8_rows(batch.column(text))]
        return [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]

    return with_columns_from(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, [text])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights, intercept = train_weights(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return with_toxicity(docs, weights, intercept).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
