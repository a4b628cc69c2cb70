"""Cross-tokenizer alignment: a sweep over the ends of the tokens of two tokenizers.

A encodes space + text byte-level, B encodes the text with pieces whose first space it adds itself; both cover the same
bytes.  Offsets where tokens of both end cut the tokens into groups; tokens whose bytes overlap are linked.

1. Each side's token ends are events.  A row holds the events of one side within WINDOW bytes of a document (ids, and
   where the first begins; an id says how long its token is).
2. The rows of both sides are united, dealt by document, and sorted within partitions by document and offset.
3. A machine reads them in that order and holds the events since the last common end: one window and the open group.  At a
   common end it emits the groups before it, into the document's running digest, and the links, of which there is one at
   each distinct offset.  Of a document it keeps the counts and its distinct linked pairs of ids.
4. How many documents hold a pair is summed over blocks of documents, each of which sends a pair once; an A id's highest
   count is the maximum over its pairs.  Blocks get the counts of their pairs back and sum them for each document.

A side whose tokens don't join to space + text (unknown characters, U+2581) leaves the document without tokens, as null and
empty texts are: zeros and an empty digest.  Texts of any length are encoded whole.  Documents are told apart by doc_id and
the text's SHA-256; of repeated rows one is swept, and each counts as a document and has a result.  A null doc_id is an id
like others.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._blocks import BLOCK_BYTES, expand_sorted, squeeze_sorted
from ledgerloom.llm._shared import partition_count, saved
from ledgerloom.llm.op8_byte_bpe import Cache
from ledgerloom.llm.op13_lm_scoring import packed, unpacked

#: Bytes of a document whose token ends stand in one row; pairs of ids a task sums before it sends them; characters encoded at a time.
WINDOW, RUN_PAIRS, SLICE_BYTES = 1 << 16, 2_000_000, 2 << 20
#: Bytes, about, that a worker's memory of encoded words takes, for each tokenizer.
WORD_CACHE = 64 << 20

# -- tokenizers --------------------------------------------------------------------------------------------------------


#: Characters whose class (letter, number, white space) is the same in every version of Unicode that a library may follow.
_SETTLED = re.compile(r"[\x00-\u024F]*")


class Side:
    """A tokenizer as a function from texts to ids whose tokens' bytes are known.

    Neither tokenizer joins a character that is no white space to a space behind it, so a text without other runs of white
    space is encoded word by word, and words are remembered.
    """

    #: In place of a word's ids: it doesn't stand for itself; its text can't be taken word by word.
    VOID, UNEVEN = b"?", b"!"

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], by_words: bool):
        self.encode, self.token_bytes, self.by_words = encode, token_bytes, by_words
        self.sizes = np.array([len(x) for x in token_bytes], np.int64)
        self.code = "H" if len(token_bytes) <= 1 << 16 else "I"
        self.kind = np.dtype(np.uint16 if self.code == "H" else np.uint32)
        self.words = Cache(WORD_CACHE)

    def checked(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; VOID where they don't stand for space + text."""
        token = self.token_bytes.__getitem__
        return [array(self.code, ids).tobytes() if b"".join(map(token, ids)) == b" " + text.encode() else self.VOID for text, ids in zip(texts, self.encode(texts))]

    def at_once(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, encoded with single spaces between them and cut where words end."""
        text = " ".join(words)
        ids = array(self.code, self.encode([text])[0])
        if b"".join(map(self.token_bytes.__getitem__, ids)) == b" " + text.encode():
            ends = np.cumsum(self.sizes[np.frombuffer(ids, self.kind)])
            stops = np.cumsum([len(w.encode()) + 1 for w in words])
            at = np.searchsorted(ends, stops)
            if np.array_equal(ends[at], stops):
                packed_ids, cuts = ids.tobytes(), [0, *((at + 1) * ids.itemsize).tolist()]
                return [packed_ids[i:j] for i, j in zip(cuts, cuts[1:])]
        return self.checked(words)

    def learnt(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words between single spaces; UNEVEN for those that tell of other white space before a space, or hold a sign for it."""
        out = {w: self.UNEVEN for w in words if not w or w[-1].isspace() or "▁" in w}
        rest = [w for w in words if w not in out] if out else words
        settled = rest if _SETTLED.fullmatch("".join(rest)) else [w for w in rest if _SETTLED.fullmatch(w)]
        for group in (settled, [] if len(settled) == len(rest) else [w for w in rest if not _SETTLED.fullmatch(w)]):
            if group:
                out.update(zip(group, self.at_once(group)))
        keep = self.words.keep
        for w, ids in out.items():
            keep(w, ids, len(w) + len(ids))
        return out

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of each text; None where it has no tokens."""
        if not self.by_words or not texts:
            return [None if ids == self.VOID else ids for ids in self.checked(texts)]
        words = " ".join(texts).split(" ")
        parts = list(map(self.words.get, words))
        if None in parts:
            new = [i for i, ids in enumerate(parts) if ids is None]
            fresh = self.learnt(list(dict.fromkeys([words[i] for i in new])))
            for i in new:
                parts[i] = fresh[words[i]]
        out, at = [], 0
        for text in texts:
            own = parts[at : at + text.count(" ") + 1]
            at += len(own)
            whole = self.checked([text])[0] if self.UNEVEN in own else self.VOID if self.VOID in own else b"".join(own)
            out.append(None if whole == self.VOID else whole)
        return out


def byte_level(path: str) -> Side:
    """A tokenizer of the tokenizers library whose tokens are byte-level.

    Texts of settled characters are encoded by tiktoken, which is several times as fast, where the file says no more than
    ranks do: a byte-level split, merges in the order of their ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings within texts are plain text
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""
    library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    file = json.loads(tokenizer.to_str())
    split, model = file["pre_tokenizer"] or {}, file["model"]
    merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    ranked = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file["normalizer"]
    if not (ranked and merges == sorted(merges) and len(merges) + 256 + len(file["added_tokens"]) == len(vocabulary)):
        return Side(library, token_bytes, False)
    special = {t["id"] for t in file["added_tokens"]}
    ranks = {t: i for i, t in enumerate(token_bytes) if t and i not in special}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast(" " + t) if _SETTLED.fullmatch(t) else library([t])[0] for t in texts]

    return Side(encode, token_bytes, True)


def pieces(path: str) -> Side:
    """A model of the sentencepiece library, which puts a space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts = [model.id_to_piece(i) for i in ids]
    token_bytes = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, texts)]
    return Side(lambda batch: model.encode(batch, num_threads=1), token_bytes, not any("▁" in p.lstrip("▁") for p in texts))


_KINDS = {"byte_level": byte_level, "pieces": pieces}


@lru_cache(maxsize=4)
def side(kind: str, path: str) -> Side:
    return _KINDS[kind](path)


# -- events ------------------------------------------------------------------------------------------------------------

_DOCUMENT = "block int, doc_id long, digest binary"
_EVENTS = f"{_DOCUMENT}, window int, side int, begins long, ids binary"


def documents_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """((block, doc_id, digest, text), the number of blocks)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    blocks = max(partition_count(docs.sparkSession), -(-size // BLOCK_BYTES))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    return named.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "digest", "text"), blocks


def events(named: DataFrame, which: int, kind: str, path: str) -> DataFrame:
    """Rows of one side's events; a single row with null ids, before all windows, for a document that has none."""

    def cut(ids: bytes | None, size: int) -> Iterator[tuple[int, int, bytes | None]]:
        if ids is None:
            yield -1, 0, None
        elif size <= WINDOW:
            yield 0, 0, zstandard.compress(ids, 1)
        else:
            encoder = side(kind, path)
            tokens = np.frombuffer(ids, encoder.kind)
            ends = np.cumsum(encoder.sizes[tokens])
            edges = np.searchsorted(ends, np.arange(WINDOW, ends[-1], WINDOW), "right").tolist()
            for window, (i, j) in enumerate(zip([0, *edges], [*edges, len(tokens)])):
                if j > i:
                    yield window, int(ends[i - 1]) if i else 0, zstandard.compress(tokens[i:j].tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = side(kind, path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some documents at a time, or a long one
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < 512 and held < SLICE_BYTES:
                    texts.append(batch.column(3)[at + len(texts)].as_py())
                    held += len(texts[-1])
                part = batch.slice(at, len(texts))
                at += len(texts)
                encoded = iter(encoder([t for t in texts if t]))
                rows = [(k, *row) for k, text in enumerate(texts) for row in cut(next(encoded) if text else None, len(text.encode()) + 1)]
                of, window, begins, ids = zip(*rows)
                same = part.take(pa.array(of))
                arrays = [*same.columns[:3], pa.array(window, pa.int32()), pa.array([which] * len(of), pa.int32()), pa.array(begins, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _EVENTS.split(", ")])

    return named.mapInArrow(run, _EVENTS)


# -- the sweep ---------------------------------------------------------------------------------------------------------

_SWEPT = f"{_DOCUMENT}, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


@lru_cache(maxsize=4)
def decimals(count: int) -> np.ndarray:
    """The digits of the numbers below count, padded with zero bytes, behind a place for a separator."""
    width = len(str(count))
    digits = np.array([str(i) for i in range(count)], f"S{width}").view(np.uint8).reshape(count, width)
    return np.concatenate([np.zeros((count, 1), np.uint8), digits], axis=1)


class Sweep:
    """One document's state: the events since the last common end, counts, the digest so far, linked pairs."""

    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        self.ids = [np.empty(0, a.kind), np.empty(0, b.kind)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.base, self.void = 0, False
        self.counts = [0, 0, 0, 0]  # tokens of A and B, groups, links
        self.digest, self.pairs = hashlib.sha256(), []

    def add(self, which: int, begins: int, ids: bytes | None) -> None:
        if ids is None:
            self.void = True
        if self.void:
            return
        new = np.frombuffer(zstandard.decompress(ids), self.sides[which].kind)
        ends = begins + np.cumsum(self.sides[which].sizes[new])
        self.ids[which], self.ends[which] = (np.concatenate([self.ids[which], new]), np.concatenate([self.ends[which], ends])) if len(self.ids[which]) else (new, ends)
        if which == 1:
            self.advance()

    def advance(self) -> None:
        """Emits what lies before the last common end."""
        (a, b), (ends_a, ends_b), base = self.ids, self.ends, self.base
        if not len(a) or not len(b):
            return
        marks = np.zeros(int(min(ends_a[-1], ends_b[-1])) - base + 1, np.uint8)
        n_a, n_b = np.searchsorted(ends_a, base + len(marks)), np.searchsorted(ends_b, base + len(marks))
        marks[ends_a[:n_a] - base] = 1
        marks[ends_b[:n_b] - base] += 2
        at = np.flatnonzero(marks)
        flags = marks[at]
        common = flags == 3
        last = len(common) - int(np.argmax(common[::-1])) if common.any() else 0
        if not last:
            return
        flags, common, cut = flags[:last], common[:last], base + int(at[last - 1])
        is_a, is_b = (flags & 1).astype(bool), flags >= 2
        upto_a, upto_b, upto = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(common)
        n_a, n_b, groups = int(upto_a[-1]), int(upto_b[-1]), int(upto[-1])
        of_a, of_b, group = upto_a - is_a, upto_b - is_b, upto - common  # the token over each stretch between two ends
        a, b = a[:n_a], b[:n_b]
        self.pairs.append(a[of_a].astype(np.uint64) * np.uint64(len(self.sides[1].sizes)) + b[of_b])

        closing_a, closing_b = upto_a[common], upto_b[common]  # tokens up to each group's end
        group_a, group_b = group[is_a], group[is_b]
        before_b = np.concatenate([[0], closing_b[:-1]])
        text_a, text_b = decimals(len(self.sides[0].sizes))[a], decimals(len(self.sides[1].sizes))[b]
        for text, first, separator in ((text_a, np.concatenate([[0], closing_a[:-1]]), ord(";")), (text_b, before_b, ord("|"))):
            text[:, 0] = ord(",")
            text[first, 0] = separator
        if not self.counts[2]:
            text_a[0, 0] = 0  # nothing stands before the first group
        out = np.zeros((n_a + n_b, max(text_a.shape[1], text_b.shape[1])), np.uint8)
        out[np.arange(n_a) + before_b[group_a], : text_a.shape[1]] = text_a
        out[np.arange(n_b) + closing_a[group_b], : text_b.shape[1]] = text_b
        self.digest.update(out[out != 0].tobytes())
        for k, n in enumerate((n_a, n_b, groups, len(flags))):
            self.counts[k] += n
        self.base = cut
        for k, n in enumerate((n_a, n_b)):
            self.ids[k], self.ends[k] = self.ids[k][n:], self.ends[k][n:]

    def result(self) -> tuple:
        """n_a, n_b, n_groups, n_links, digest, linked pairs, how often each is linked."""
        if self.void or not self.counts[2]:
            return 0, 0, 0, 0, "", squeeze_sorted(np.empty(0, np.uint64)), packed(np.empty(0, np.int64))
        pairs, times = np.unique(np.concatenate(self.pairs), return_counts=True)
        return *self.counts, self.digest.hexdigest(), squeeze_sorted(pairs), packed(times)


def swept(both: DataFrame, blocks: int, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Deals and sorts the events of both sides, and runs the machine over them; saved, as it is read three times."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        document, state, first, copies, last = None, None, None, 0, None
        for batch in batches:
            for block, doc_id, digest, window, which, begins, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (block, doc_id, digest) != document:
                    if state is not None:
                        done.append((*document, copies, *state.result()))
                    document, state, first, copies = (block, doc_id, digest), Sweep(side(*a), side(*b)), (window, which), 0
                    last = None
                copies += (window, which) == first
                if (window, which) != last:  # repeated documents have equal rows
                    state.add(which, begins, ids)
                    last = window, which
            if len(done) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
                done.clear()
        if state is not None:
            done.append((*document, copies, *state.result()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "doc_id", "digest", "window", "side")
    return saved(dealt.mapInArrow(run, _SWEPT), "alignment")


# -- counts of pairs ---------------------------------------------------------------------------------------------------


def pairs_by_block(documents: DataFrame) -> DataFrame:
    """(block, pair, documents): how many documents of a block hold a pair; a long block may send one more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, found in held.items():
                pairs, which = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                n = np.bincount(which, np.repeat([c for _, c in found], [len(p) for p, _ in found]), len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block, np.int32)), pa.array(pairs.astype(np.int64)), pa.array(n)], names=["block", "pair", "documents"])

        for batch in batches:
            for block, copies, pairs in zip(*[c.to_pylist() for c in batch.columns]):
                found = expand_sorted(pairs)
                held.setdefault(block, []).append((found, copies))
                size += len(found) + 16
                if size >= RUN_PAIRS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return documents.select("block", "copies", "pairs").mapInArrow(run, "block int, pair long, documents long")


def with_counts(documents: DataFrame, b_ids: int) -> DataFrame:
    """The documents with n_best and count_sum."""
    found = saved(pairs_by_block(documents), "alignment-pairs")
    a_id = F.expr(f"pair div {b_ids}").alias("a_id")
    counted = found.groupBy("pair").agg(F.sum("documents").alias("n"))
    highest = counted.groupBy(a_id).agg(F.max("n").alias("most"))
    ranked = counted.select("pair", "n", a_id).join(F.broadcast(highest), "a_id")  # as many rows as A has ids at most
    answers = found.select("block", "pair").distinct().join(ranked, "pair").select("block", "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    names = ["doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = [*[pa.int64()] * 6, pa.string()]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        pairs = known.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, n, best = pairs[order].astype(np.uint64), known.column("n").to_numpy()[order], known.column("best").to_numpy()[order]
        sums = []
        for blob, times in zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist()):
            at, t = np.searchsorted(pairs, expand_sorted(blob)), unpacked(times)
            sums.append((int((t * best[at]).sum()), int((t * n[at]).sum())) if len(at) else (0, 0))
        columns = [rows.column(c).cast(t) for c, t in zip(names, kinds)]
        return pa.table([*columns, pa.array([x for x, _ in sums], pa.int64()), pa.array([x for _, x in sums], pa.int64())], names=[*names, "n_best", "count_sum"])

    schema = "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.drop("digest").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, schema)


def aligned(docs: DataFrame, a: tuple[str, str], b: tuple[str, str], b_ids: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a and b name the kind of each side ("byte_level", "pieces") and its file; B's ids are below b_ids.
    """
    named, blocks = documents_of(docs, key, text)
    both = events(named, 0, *a).unionByName(events(named, 1, *b))
    found = with_counts(swept(both, blocks, a, b), b_ids)
    repeated = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of both tokenizers, groups, links and how frequent the linked pairs are."""
    import public_tokenizers

    b = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned(docs, ("byte_level", public_tokenizers.path("byte_bpe_50k.json")), ("pieces", b), len(pieces(b).sizes))
