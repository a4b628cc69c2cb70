"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format of a folder written by `write_token_files` (Parquet is only the container, so that Spark's commit protocol,
any shared store and the loss of executors are taken care of):

* `ranks/`: (rank, id).  Rank 0 is the corpus' most frequent id; ties go to the smaller id.
* `blocks/`: one row for about BLOCK_IDS ids of consecutive documents: shard, start (ids before it in its shard),
  the documents' ids and lengths, a stream of control bytes and a stream of data bytes.  A rank takes 1 to 4 data
  bytes, little-endian; its two control bits hold that number less one, four ranks to a control byte, first in the
  lowest bits; each document starts a control byte.  Shards hold ascending ranges of doc_id.

Reading looks the four lengths of each control byte up in a table of 256 rows and gathers the data bytes by numpy.

Ids are ordered by (doc_id nulls first); rows with one doc_id keep any order among themselves.  Null texts are empty
documents, which hold the end id alone.  A text of any length is one document, in one block.  An empty table gives folders
without blocks.  Of the input only key and text are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import SLICE_ROWS, saved, work_path

#: Ids in a block, parts of words a worker's cache holds, and bytes of text encoded at a time.
BLOCK_IDS, CACHED_WORDS, SLICE_BYTES = 1 << 20, 600_000, 16 << 20

#: Marks that are cut off a word's end, and what has to stand before them: a letter that stays one in lower case, or a digit.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_BEFORE_MARKS = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]\z"
#: How the vocabulary writes bytes: printable Latin-1 characters stand for themselves, all others for those from 256 on.
_OTHER_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(_OTHER_BYTES)}


# fixed values: what the vocabulary's file says of its normalizers and its splitter
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class WordEncoder(dict):
    """Packed ids of the parts of white-space separated words, by the tokenizers library.

    The vocabulary's splitter drops white space and never matches across it, so a text's ids are its words' ids one
    after the other.  Marks at a word's end, after a letter or digit, are a match of their own, so that words are made of
    two parts at most; letters are lower-cased one by one, and a run of letters is one match, which goes to the library's
    merge model as it is; all else goes through its whole pipeline.  All this holds for the normalizers and the splitter of
    _NORMALIZERS and _SPLITTER; with any other file whole texts go through the library.  The cache of parts has two
    generations, of CACHED_WORDS each: parts met again move to the younger.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.old = self.tokenizer.model, {}
        settings = json.loads(self.tokenizer.to_str())
        #: Whether words can be encoded one by one: the splitter and the normalizers are those that this class knows.
        self.by_word = [
            n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])
        ] == _NORMALIZERS and (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0] == _SPLITTER
        #: Ids on their way take two bytes where the vocabulary allows.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    @staticmethod
    def folded(word: bytes) -> bytes:
        if b"<" in word:
            return word  # may be part of a special token, in which case counts
        if word.isascii():
            return word.lower()
        text = word.decode()
        return text.lower().encode() if max(text) <= "ɏ" and "İ" not in text else word

    def letters(self, part: bytes) -> bytes | None:
        """Ids of a folded run of letters; None for anything else."""
        if part.isalpha() and part.islower():  # of bytes: ASCII letters only
            text = part.decode()
        else:
            text = part.decode()
            if not text.isalpha() or max(text) > "ɏ" or "İ" in text:
                return None
            text = part.decode("latin-1").translate(_BYTE_CHARS)
        return self.packed([t.id for t in self.model.tokenize(text)])

    def __missing__(self, part: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        if (known := self.old.get(part)) is None and (known := self.letters(folded := self.folded(part))) is None:
            known = self.packed(self.tokenizer.encode(folded.decode(), add_special_tokens=False).ids)
        self[part] = known
        return known

    @staticmethod
    def _ends(words: pa.Array, begin: pa.Array) -> pa.Array:
        """What each word has from byte `begin` on."""
        out = np.full(len(words), b"", object)
        at = np.flatnonzero(pc.binary_length(words).to_numpy() > begin.to_numpy())
        starts = begin.to_numpy()[at].tolist()
        out[at] = [w[b:] for w, b in zip(words.cast(pa.large_binary()).take(pa.array(at)).to_pylist(), starts)]
        return pa.array(out, pa.large_binary())

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of each word (large_binary); ASCII letters are lower-cased and marks at the end cut off by column."""
        special = pc.match_substring(words, "<")  # as in `folded`
        cores = pc.ascii_rtrim(words, _MARKS)
        cores = pc.if_else(pc.and_not(pc.match_substring_regex(cores, _BEFORE_MARKS), special), cores, words)
        cores = pc.if_else(pc.and_not(pc.string_is_ascii(cores), special), pc.ascii_lower(cores), cores)
        tails = self._ends(words, pc.binary_length(cores))
        out = []
        for parts in (cores, tails):
            parts = parts.cast(pa.large_binary()).dictionary_encode()
            out.append(pa.array([self[x] for x in parts.dictionary.to_pylist()], pa.large_binary()).take(parts.indices))
        return pc.binary_join_element_wise(*out, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        return self.encode_column(pa.array([(t or b"").decode() for t in texts], pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Packed ids of each text, null ones as empty ones, with `end` after each (large_binary).

        Words are cut, told apart and put together by Arrow; Python sees each different word of the column once.
        """
        if not self.by_word:
            return pa.array([self.packed(self.tokenizer.encode(t or "", add_special_tokens=False).ids) + end for t in texts.to_pylist()], pa.large_binary())
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))  # empty words at a text's ends have no ids
        words, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        known = self.encode_words(words.dictionary)
        # the end stands behind each text's words as one more word
        places = np.insert(words.indices.to_numpy(), ends, len(known))
        ids = pa.concat_arrays([known, pa.array([end], pa.large_binary())]).take(pa.array(places))
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        offsets = np.concatenate([at[:1], at[ends + np.arange(1, len(ends) + 1)]])
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), ids.buffers()[2]])


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with SLICE_BYTES of text at most, or of one row."""
    total = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = before = 0
    while at < len(column):
        rows = max(1, int(np.searchsorted(total, before + SLICE_BYTES, "right")) - at)
        yield at, rows
        at, before = at + rows, int(total[at + rows - 1])


@lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    return WordEncoder(tokenizer_path)


_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    most, code = int(v.max(initial=0)), np.zeros(-(-len(v) // 4) * 4, np.uint8)
    own = code[: len(v)]
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        if most > bound:
            own += v > bound
    width = 2 if most <= 0xFFFF else 4
    bytes_of = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    data = bytes_of[np.arange(width, dtype=np.uint8) <= own[:, None]].tobytes()
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """`count` values from their control bytes and data bytes (uint8 arrays; three bytes of slack may follow data)."""
    length = _LENGTHS[control].reshape(-1)[:count]
    at = np.cumsum(length, dtype=np.int64) - length
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    wide = padded[at].astype(np.uint32)
    for i in range(1, int(length.max(initial=1))):
        wide |= padded[at + i].astype(np.uint32) << np.uint32(8 * i)
    return wide & _MASKS[length]


def encode_documents(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): packed little-endian ids of each text, of the encoder's kind, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            for at, rows in _slices(batch.column(1)):
                part = batch.slice(at, rows)
                ids = encoder.encode_column(part.column(1), end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids binary")


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs in all of `encoded`; each task sends one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                n = np.bincount(np.frombuffer(ids, kind))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text of df and writes the folder `path` in this module's format."""
    spark, kind = df.sparkSession, word_encoder(tokenizer_path).kind
    encoded = saved(encode_documents(df, tokenizer_path, end_id, key, text), "ids")
    # the vocabulary bounds these rows, whatever the corpus
    order = Window.orderBy(F.desc("n"), "id")
    ranks = id_counts(encoded, kind).select((F.row_number().over(order) - 1).alias("rank"), "id")
    ranks.write.parquet(f"{path}/ranks")
    by_id = sorted(spark.read.parquet(f"{path}/ranks").collect(), key=lambda r: r["id"])
    rank_of = np.zeros(by_id[-1]["id"] + 1 if by_id else 1, np.uint32)
    for r in by_id:
        rank_of[r["id"]] = r["rank"]
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard, start, rows, held = shared.value, TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            keys, lengths = [r[0] for r in rows], [r[1] for r in rows]
            values = [[shard], [start], [keys], [lengths], [b"".join([r[2] for r in rows])], [b"".join([r[3] for r in rows])]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "start", "keys", "lengths", "control", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for key, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ranks = table[np.frombuffer(ids, kind)]
                    rows.append((key, len(ranks), *pack(ranks)))
                    held += len(ranks)
                    if held >= BLOCK_IDS:
                        yield block()
                        start, rows, held = start + held, [], 0
        if rows:
            yield block()

    # ids are dealt before they are packed, so that finding the ranges of keys costs no Python pass
    ordered = encoded.repartitionByRange("key").sortWithinPartitions("key")
    ordered.mapInArrow(
        blocks,
        "shard int, start long, keys array<long>, lengths array<long>, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start in the shard, doc_id, ids) of each document: ids as packed little-endian unsigned 32-bit integers."""
    id_of = np.array([r["id"] for r in sorted(spark.read.parquet(f"{path}/ranks").collect())], dtype="<u4")
    shared = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for shard, start, keys, lengths, control, data in zip(*[c.to_pylist() for c in batch.columns]):
                control, data, starts, ids, c, d = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), [], [], 0, 0
                for n in lengths:
                    own = control[c : c + -(-n // 4)]
                    size = int(_LENGTHS[own].sum()) - (-n % 4)  # unused codes of the last byte are 0: length 1
                    ids.append(table[unpack(own, data[d : d + size], n)].tobytes())
                    starts.append(start)
                    c, d, start = c + len(own), d + size, start + n
                arrays = [pa.array([shard] * len(keys), pa.int32()), pa.array(starts, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "start", "doc_id", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "shard int, start long, doc_id long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in all shards before each; a row for each written file."""
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("ids"))
    return totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files written: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    docs = read_token_files(spark, path).select("shard", "start", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(F.broadcast(shard_starts(spark, path)), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
