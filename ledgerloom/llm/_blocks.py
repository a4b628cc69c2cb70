"""Blocks of documents that look hashes up in an index spread over all blocks.

Documents are dealt into blocks by their key and text, so that neither a hot key nor many copies land in one block; rows
with one key and one text do share a block.  A block sends what it indexes, sorted by hash and cut into ranges of hashes,
to the buckets of those ranges; a bucket answers each block.  There are as many blocks and buckets as the measured size of
the texts asks for (BLOCK_BYTES, BUCKET_BYTES), and at least one for each shuffle partition, so what a task holds depends
neither on the input nor on that setting: a block, or the longest document.  A block sends a hash once, whatever single
hashes, documents or sources weigh.  All passes over the documents stand in one plan and share one exchange of their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import partition_count

#: Bytes of text a block holds, and bytes of text whose hashes a bucket holds, on average.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20

#: The id that stands for null: larger than any other.
NO_ID = np.iinfo(np.int64).max


def dealt(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """((block, key, text_hash, text), the number of buckets)."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    least = partition_count(docs.sparkSession)
    blocks, buckets = max(least, -(-size // BLOCK_BYTES)), max(least, -(-size // BUCKET_BYTES))
    k, t = F.col(key).cast("long"), F.col(text).cast("string")
    return docs.select(F.pmod(F.xxhash64(k, t), F.lit(blocks)).cast("int").alias("block"), k.alias("key"), F.xxhash64(t).alias("text_hash"), t.alias("text")), buckets


def block_rows(table: pa.Table, more: list[str] = []) -> tuple:
    """Keys, texts and whether the key is null, in order of the keys (nulls last), and more columns.  `table` has no rows where a block only has answers."""
    keys = table.column("key").combine_chunks()
    null = np.asarray(keys.is_null())
    keys = np.asarray(keys.fill_null(NO_ID)).astype(np.int64)
    order = np.lexsort((null, keys))
    text = table.column("text").combine_chunks()
    text = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
    return keys[order], text.take(pa.array(order)).to_pylist(), null[order], *[table.column(c).combine_chunks().take(pa.array(order)) for c in more]


def squeeze(values: np.ndarray) -> bytes:
    """An array of unsigned integers, byte by byte of equal weight, compressed."""
    v = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes(), 1)


def expand(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit integers, as differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def bucket_cuts(sorted_keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of keys of so many bits begins, and the end."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values

