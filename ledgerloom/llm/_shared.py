"""Pieces the operators of this folder share: work folders, Arrow helpers, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handled at a time inside a task, so that memory does not follow the Arrow batch size.
SLICE_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where the session has none, one of this machine if that is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/ledgerloom/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, partition_by: list[str] | None = None, outer: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive any executor.

    The table outlives the innermost `scratch` if it is for what is outside.
    """
    spark, schema = df.sparkSession, df.schema
    path = work_path(spark, what)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if open_scratch := _SCRATCH[:-1] if outer else _SCRATCH:
        open_scratch[-1].append(path)
    out = spark.read.schema(schema).parquet(path)
    out.saved_path = path
    return out


#: Paths written within each `scratch` that is open, the innermost last.
_SCRATCH: list[list[str]] = []


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of `saved` that nothing will read any more."""
    for table in tables:
        if (path := getattr(table, "saved_path", None)) is not None:
            _deleted(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within are deleted at the end: what is made of them has to be written elsewhere before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _deleted(spark, path)


def partition_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner", ways: int = 4) -> DataFrame:
    """many joined with few, rows of `many` with one key dealt by their columns `by` into so many parts, to each of which few's rows go.

    For keys that a large share of `many` may have and of which `few` has few rows.
    """
    dealt = many.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int"))
    copied = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copied.hint("merge"), [*on, "__part"], how).drop("__part")


def with_columns_from(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    reads: list[str],
    at_end: Callable[[], None] | None = None
) -> DataFrame:
    """df with the columns `fields` appended, each batch's values made by `make` from the columns `reads`.

    Columns of df that have the name of an appended one are replaced.  `at_end` is called when a task has no more batches,
    as its worker stays for the tasks of other stages.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    out = T.StructType([df.schema[c] for c in kept] + fields)
    shadow = [f"__in_{i}" for i in range(len(reads))]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(s) for c, s in zip(reads, shadow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    ins = part.select(shadow).rename_columns(reads)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + make(ins), names=kept + [f.name for f in fields])
        finally:
            if at_end is not None:
                at_end()

    return wide.mapInArrow(run, out)


def utf8_rows(column: pa.Array) -> list[bytes | None]:
    """A string column's rows as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of a text's words, all of them at once: sums of the bytes times random keys of their places, mixed.

    Each place of a word has a key of its own, made from a seed.  Where the seed is drawn anew for a run (`keyed_words`),
    two given words share a hash with a chance of at most 2**-56, whatever they are made of; with the fixed seed 0 words can
    be made to share one, so what rests on that has to compare words.  `pair` gives two independent hashes.  Words are runs
    of bytes that aren't separators.
    """

    def __init__(self, separators: bytes, lower: bool, seed: int = 0):
        self.seed = seed
        self.gap = np.isin(np.arange(256), np.frombuffer(separators, np.uint8))
        folded = np.arange(256)
        if lower:
            folded[65:91] += 32
        self.values = np.where(self.gap, 0, folded + 1).astype(np.uint64)
        self.keys = [np.empty(0, np.uint64)] * 2

    def _sums(self, text: bytes | None, hashes: int) -> list[np.ndarray]:
        b = np.frombuffer(text or b"", np.uint8)
        gap = self.gap[b]
        begins = ~gap
        begins[1:] &= gap[:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [np.empty(0, np.uint64)] * hashes
        place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
        values, out = self.values[b[starts[0] :]], []
        with np.errstate(over="ignore"):
            if (most := int(place.max()) + 1) > len(self.keys[0]):
                self.keys = [mixed(np.arange(2 * most, dtype=np.uint64), 101 + i + 2 * self.seed) for i in range(2)]
            for i in range(hashes):
                out.append(mixed(np.add.reduceat(values * self.keys[i][place], starts - starts[0]), 78 + i))
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        return self._sums(text, 1)[0]

    def pair(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        first, second = self._sums(text, 2)
        return first, second


WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Words between white space as they are; and runs of a-z, 0-9 and non-ASCII bytes.
PLAIN_WORDS = WordHasher(WHITE_SPACE, False)
ALNUM_WORDS = WordHasher(bytes(i for i in range(128) if not chr(i).isalnum()), True)


@lru_cache(maxsize=4)
def keyed_words(seed: int) -> WordHasher:
    """Words between white space with A-Z lower-cased, by keys of a seed that the driver has drawn."""
    return WordHasher(WHITE_SPACE, True, seed)


def shingle_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25 + 2 * seed)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * factor + words[i : i + n]
        return mixed(h, seed)
