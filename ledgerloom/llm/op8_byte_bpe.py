"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text's encoding is the product of its parts' encodings.  The tree has two levels:

* A text is halved at places the split pattern can never match across (a non-space followed by a space), down to
  leaves of LEAF characters.  Nothing changes at such a cut, so the product is plain concatenation.
* A match of the pattern that is no token itself is halved at a byte.  The product of two halves re-encodes a
  window around the joint and lets it grow, a token at a time, on each side where it isn't stable yet.

Stability is provable from neighbours alone: a sequence of tokens is the encoding of its bytes exactly if every two
neighbours are the encoding of theirs.  Outside the window all neighbours are so already, inside they are as the
window is an encoding; so only the two pairs at its ends have to be looked at.

Decoding concatenates the tokens' bytes up the tree.  Nulls and empty texts have no ids and decode to empty bytes.  Texts of
any length are encoded whole; rows are encoded one by one, so repeated rows get equal ids and an empty table an empty
result.  Of matches equal in rank the leftmost merges first, as the library has it.

`round_trip` encodes and decodes in one pass: two passes in a chain keep two workers a core, each with the vocabulary.  What a
worker remembers of a task's texts goes when the task ends, as the worker stays for other stages.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._shared import with_columns_from

#: Characters in a leaf of a text's tree, ids in a leaf of the decoding tree, bytes that are merged without halving.
LEAF, ID_LEAF, PIECE_LEAF = 65_536, 65_536, 6
#: Parts and windows of up to so many bytes are remembered.
WINDOW_BYTES = 12
#: Bytes, about, that a worker's memory of encoded matches takes, and each of those of parts, windows and neighbours.
MATCH_CACHE, PART_CACHE = 64 << 20, 32 << 20


class Cache(dict):
    """A dictionary that starts afresh when what it holds outgrows its bound."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key, value, size: int):
        """value, remembered; size: bytes of key and value besides some 200 for their objects."""
        if self.held > self.most:
            self.forget()
        self.held += size + 200
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.held = 0


class TreeCodec:
    """Encodes and decodes with one vocabulary of ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        # \s by name: the two regular-expression engines must agree on what white space is
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cut = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
        self.packed = Cache(MATCH_CACHE)  # match: packed ids
        self.parts, self.windows = Cache(PART_CACHE), Cache(PART_CACHE)  # bytes: ids
        self.stable = Cache(PART_CACHE)  # two neighbouring ids: whether they are stable

    def forget(self) -> None:
        """Empties what is remembered of texts; the vocabulary stays."""
        for cache in (self.packed, self.parts, self.windows, self.stable):
            cache.forget()

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first: the definition, for windows; a heap over linked parts, so that long ones cost n log n."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= WINDOW_BYTES and (known := self.windows.get(piece)) is not None:
            return known
        n, rank = len(piece), self.ranks.get
        if n <= WINDOW_BYTES:
            return self.windows.keep(piece, self.merge_short(piece), 9 * n)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts at a byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, stop = heappop(heap)
            middle = end[start]
            if middle == 0 or middle >= n or end[middle] != stop:
                continue  # one of the two parts has been merged meanwhile
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                if (r := rank(piece[start : end[stop]])) is not None:
                    heappush(heap, (r, start, end[stop]))
            if (left := before[start]) >= 0 and (r := rank(piece[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def merge_short(self, piece: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        key = left, right
        if (known := self.stable.get(key)) is None:
            known = self.stable.keep(key, self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right], 0)
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes; a side's step doubles each time it has to grow."""
        if not left or not right:
            return left + right
        i, j, window, step_left, step_right = len(left), 0, [], 1, 1
        grow_left = grow_right = not self.is_stable(left[-1], right[0])
        while grow_left or grow_right:
            if grow_left:
                i, step_left = max(0, i - step_left), 2 * step_left
            if grow_right:
                j, step_right = min(len(right), j + step_right), 2 * step_right
            window = self.merge(b"".join([self.bytes_of[t] for t in left[i:] + right[:j]]))
            grow_left = i > 0 and not self.is_stable(left[i - 1], window[0])
            grow_right = j < len(right) and not self.is_stable(window[-1], right[j])
        return left[:i] + window + right[j:]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Encodes one match of the pattern."""
        if (known := self.parts.get(piece)) is not None:
            return known
        n = len(piece)
        if n <= PIECE_LEAF or piece in self.ranks:
            out = self.merge(piece)
        else:
            out = self.joined(self.encode_piece(piece[: n // 2]), self.encode_piece(piece[n // 2 :]))
        return self.parts.keep(piece, out, 9 * n) if n <= WINDOW_BYTES else out

    def pack(self, piece: str) -> bytes:
        value = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        return self.packed.keep(piece, value, len(piece) + len(value)) if len(piece) < 64 else value

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if len(text) > LEAF:
            half = len(text) // 2
            # the cut next to the middle on one side: what lies between holds none, so the depth is about the length's logarithm
            cut = self.cut.search(text, half) or next(iter(deque(self.cut.finditer(text, 1, half), maxlen=1)), None)
            if cut:
                return self.encode(text[: cut.start()]) + self.encode(text[cut.start() :])
        known, pack = self.packed.get, self.pack
        return b"".join([known(piece) or pack(piece) for piece in self.pattern.findall(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > ID_LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> TreeCodec:
    return TreeCodec(ranks_path, pattern)


def _forget(ranks_path: str, pattern: str) -> None:
    """At a task's end; Arrow gives back what its batches have left free."""
    codec(ranks_path, pattern).forget()
    pa.default_memory_pool().release_unused()


def _encoded(tree: TreeCodec, texts: pa.Array) -> list[bytes]:
    return [tree.encode(t) if t else b"" for t in texts.to_pylist()]


def _decoded(tree: TreeCodec, ids: list[bytes | None]) -> pa.Array:
    return pa.array([tree.decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids], pa.binary())


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with `ids`, each text's token ids as packed little-endian unsigned 32-bit integers (replaces a column of that name)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_encoded(codec(ranks_path, pattern), batch.column(text)), pa.binary())]

    return with_columns_from(df, [T.StructField(ids, T.BinaryType())], make, [text], lambda: _forget(ranks_path, pattern))


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with `decoded`, the bytes that the packed ids stand for (null ids: empty)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_decoded(codec(ranks_path, pattern), batch.column(ids).to_pylist())]

    return with_columns_from(df, [T.StructField(decoded, T.BinaryType())], make, [ids])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with `ids`, as encode_texts has them, and `decoded`, the bytes that they stand for (replace columns of those names)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        tree = codec(ranks_path, pattern)
        packed = _encoded(tree, batch.column(text))
        return [pa.array(packed, pa.binary()), _decoded(tree, packed)]

    return with_columns_from(df, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())], make, [text], lambda: _forget(ranks_path, pattern))


def ids_as_array(ids: str = "token_ids"):
    """Column expression: packed ids as array<bigint>."""
    hexed = F.hex(F.col(ids))
    four = lambda i: F.concat(*[F.substring(hexed, i * 8 + at, 2) for at in (7, 5, 3, 1)])
    count = (F.length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(four(i), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path, pattern, decoded="text").select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
