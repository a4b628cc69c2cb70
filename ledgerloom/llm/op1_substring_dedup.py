"""Substring dedup by relative Lempel-Ziv parsing.

Every block of documents is a reference block, and the index over all of them holds the first place (smallest doc_id,
then position) of each window of WINDOW words that more than one document may have.  A document is factored greedily,
from left to right: a factor begins at the first window, not yet covered by one, whose first place is in a document with a
smaller doc_id, and takes in word after word while the next window has its first place one word further in the same
source.  At its boundary, the window that straddles it is looked up: it opens the next factor, which may overlap, or none
does.  The words of each factor are then compared with those of its source (their bytes, by a 128-bit BLAKE2b digest):
a block asks the blocks of the sources once for each stretch and words, and factors that these refuse are dropped.  Factors are at least WINDOW words
long and together hold exactly the windows that start in an earlier document.

Which windows may be shared is found first, from anchors: the smallest hash of ANCHOR consecutive words in a window.
Equal windows have equal anchors, about every fifth word is one, and only windows whose anchor occurs twice are indexed.

Words are maximal runs of characters other than \\x20 and \\x09-\\x0D.  Null and empty texts have no words and an empty
kept text.  Rows with one doc_id are one document to each other; a null doc_id is larger than all others, and such rows
do not count as each other's source.  Ties between places of a window go to the smallest.  A very long document is one row
of a block, whatever the block's size.  An empty table gives an empty result.  The result has the columns named in SCHEMA
and none of the input's others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._blocks import block_rows, bucket_cuts, dealt, expand, expand_sorted, is_in, squeeze, squeeze_sorted
from ledgerloom.llm._shared import PLAIN_WORDS, shingle_hashes

WINDOW, ANCHOR = 13, 5
#: Bits of an anchor's hash that are looked up; two anchors with equal bits only mean more windows to look up.
ANCHOR_BITS = 40
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: int, length: int, source: long, source_start: int>>"
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
#: Factors on their way.  A document's own (block `home`, key, digest of its text) go to its block; where `doc` is null, the row asks
#: block `target` for sources, or tells `home` that they don't agree.  `factors` is packed, a FACTOR an entry.
_ROWS = "target int, home int, key long, doc binary, factors binary"
FACTOR = np.dtype([("source", np.int64), ("source_start", np.int32), ("length", np.int32), ("words", "V16"), ("start", np.int32)])


def _rows(rows: list[tuple]) -> pa.Table:
    """(target, home, key, doc, factors) as a table."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [()] * 5
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip((x.split() for x in _ROWS.split(", ")), columns)})


def _asked(factors: np.ndarray) -> np.ndarray:
    """Distinct factors, wherever they stand."""
    factors = factors.copy()
    factors["start"] = 0
    return np.unique(factors.view(f"V{FACTOR.itemsize}")).view(FACTOR)


def anchors_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window, in order."""
    grams = shingle_hashes(hashes, ANCHOR, seed=1) >> np.uint64(64 - ANCHOR_BITS)
    wide = window - ANCHOR + 1
    return np.lib.stride_tricks.sliding_window_view(grams, wide).min(axis=1) if len(grams) >= wide else np.empty(0, np.uint64)


def word_hashes(text: bytes | None) -> np.ndarray:
    return PLAIN_WORDS.of(text)


def digest(data: bytes | None) -> bytes:
    return hashlib.blake2b(data or b"", digest_size=16).digest()


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _sent(columns: dict[str, np.ndarray], keys: np.ndarray, block: int, buckets: int, bits: int) -> pa.Table:
    """Sorted keys and what belongs to them, a row for each bucket that gets some."""
    cuts = bucket_cuts(keys, buckets, bits)
    used = np.flatnonzero(np.diff(cuts)).tolist()
    part = lambda b: slice(cuts[b], cuts[b + 1])
    out = {
        "bucket": pa.array(used, pa.int32()),
        "block": pa.array([block] * len(used), pa.int32()),
        "keys": pa.array([squeeze_sorted(keys[part(b)]) for b in used], pa.binary())
    }
    return pa.table(out | {name: pa.array([squeeze(x[part(b)]) for b in used], pa.binary()) for name, x in columns.items()})


def factor_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Parses each document against all with a smaller id; see SCHEMA."""
    if window < ANCHOR:
        raise ValueError(f"windows have at least {ANCHOR} words")
    blocks, buckets = dealt(docs, key, text)

    def send_anchors(table: pa.Table) -> pa.Table:
        _, texts, _ = block_rows(table)
        keys, n = np.unique(_joined([np.unique(anchors_of(word_hashes(t), window)) for t in texts], np.uint64), return_counts=True)
        return _sent({"twice": (n > 1).astype(np.uint8)}, keys, table.column("block")[0].as_py(), buckets, ANCHOR_BITS)

    def shared_anchors(table: pa.Table) -> pa.Table:
        own = [expand_sorted(x) for x in table.column("keys").to_pylist()]
        keys, n = np.unique(np.concatenate(own + [k[expand(x, np.uint8) > 0] for k, x in zip(own, table.column("twice").to_pylist())]), return_counts=True)
        shared = keys[n > 1]
        answers = [k[is_in(k, shared)] for k in own]
        keep = [i for i, a in enumerate(answers) if len(a)]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "keys": pa.array([squeeze_sorted(answers[i]) for i in keep], pa.binary())})

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The block's first place of each window, and whether a document with a larger id has it too."""
        ids, texts, _ = block_rows(table) if len(table) else (np.empty(0, np.int64), [], None)
        shared = np.sort(_joined([expand_sorted(x) for x in answers.column("keys").to_pylist()], np.uint64))
        keys, checks, places, sources = [], [], [], []
        for i, t in zip(ids, texts) if len(shared) else ():
            h, other = PLAIN_WORDS.pair(t)
            at = np.flatnonzero(is_in(anchors_of(h, window), shared))
            if len(at):
                keys.append(shingle_hashes(h, window, seed=2)[at])
                checks.append((shingle_hashes(other, window, seed=3)[at] >> np.uint64(32)).astype(np.uint32))
                places.append(at.astype(np.uint32))
                sources.append(np.full(len(at), i, np.int64))
        keys, checks, places, sources = _joined(keys, np.uint64), _joined(checks, np.uint32), _joined(places, np.uint32), _joined(sources, np.int64)
        order = np.argsort(keys, kind="stable")  # documents come by id, places ascend
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
        last = np.append(first[1:], len(order)) - 1
        again = (sources[order[last]] > sources[order[first]]).astype(np.uint8) if len(order) else np.empty(0, np.uint8)
        first = order[first]
        return _sent(
            {"checks": checks[first], "sources": sources[first], "places": places[first], "again": again},
            keys[first],
            table.column("block")[0].as_py() if len(table) else 0,
            buckets,
            64
        )

    def first_places(table: pa.Table) -> pa.Table:
        own = [expand_sorted(x) for x in table.column("keys").to_pylist()]
        read = lambda name, kind: np.concatenate([expand(x, kind) for x in table.column(name).to_pylist()])
        keys, checks, sources, places, again = np.concatenate(own), read("checks", np.uint32), read("sources", np.int64), read("places", np.uint32), read("again", np.uint8) > 0
        homes = np.repeat(np.asarray(table.column("block")), [len(k) for k in own]).astype(np.uint32)
        order = np.lexsort((places, sources, checks, keys))
        new = (np.diff(keys[order], prepend=~keys[order[:1]]) != 0) | (np.diff(checks[order], prepend=~checks[order[:1]]) != 0)
        leader = np.empty(len(keys), np.int64)
        leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        told = (sources[leader] < sources) | again
        ends = np.cumsum([len(k) for k in own])
        spans = [np.arange(e - len(k), e)[told[e - len(k) : e]] for k, e in zip(own, ends)]
        keep = [i for i, s in enumerate(spans) if len(s)]
        out = {"block": table.column("block").take(pa.array(keep, pa.int64())), "keys": pa.array([squeeze_sorted(keys[spans[i]]) for i in keep], pa.binary())}
        return pa.table(
            out | {name: pa.array([squeeze(x[leader[spans[i]]]) for i in keep], pa.binary()) for name, x in (("sources", sources), ("places", places), ("homes", homes))}
        )

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The block's factors by document, and what it asks other blocks: each question once."""
        ids, texts, null = block_rows(table) if len(table) else (np.empty(0, np.int64), [], np.empty(0, bool))
        known = _joined([expand_sorted(x) for x in answers.column("keys").to_pylist()], np.uint64)
        order = np.argsort(known)
        known = known[order]
        read = lambda name, kind: _joined([expand(x, kind) for x in answers.column(name).to_pylist()], kind)[order]
        sources, places, homes = read("sources", np.int64), read("places", np.uint32), read("homes", np.uint32)
        home, rows, asked = table.column("block")[0].as_py() if len(table) else 0, [], []
        done: set[tuple[int, bytes]] = set()  # repeated rows send their factors once
        for i, t, no in zip(ids.tolist(), texts, null.tolist()) if len(known) else ():
            keys = shingle_hashes(word_hashes(t), window, seed=2)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            begins = np.flatnonzero((known[at] == keys) & (sources[at] < i))
            if not len(begins) or (i, doc := digest(t)) in done:
                continue
            done.add((i, doc))
            source, place = sources[at[begins]], places[at[begins]].astype(np.int64)
            goes_on = (np.diff(begins) == 1) & (np.diff(source) == 0) & (np.diff(place) == 1)
            heads = np.append(0, np.flatnonzero(~goes_on) + 1)
            own = np.zeros(len(heads), FACTOR)
            own["start"], own["source"], own["source_start"] = begins[heads], source[heads], place[heads]
            own["length"] = begins[np.append(heads[1:], len(begins)) - 1] - begins[heads] + window
            words = (t or b"").split()
            spans = zip(own["start"].tolist(), (own["start"] + own["length"]).tolist())
            own["words"] = np.frombuffer(b"".join([digest(b" ".join(words[a:z])) for a, z in spans]), "V16")
            rows.append((home, home, None if no else i, doc, own.tobytes()))
            asked.append((own, homes[at[begins]][heads]))
        if asked:
            own, blocks_of = np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked])
            rows += [(int(b), home, None, None, _asked(own[blocks_of == b]).tobytes()) for b in np.unique(blocks_of)]
        return _rows(rows)

    def compare(table: pa.Table, factors: pa.Table) -> pa.Table:
        """Documents' own factors as they came; of what others ask those whose words don't stand in the source."""
        asks = factors.filter(pa.compute.is_null(factors.column("doc")))
        own = factors.filter(pa.compute.is_valid(factors.column("doc")))
        blobs = asks.column("factors").to_pylist()
        wanted = _joined([np.frombuffer(x, FACTOR) for x in blobs], FACTOR)
        whose = np.repeat(np.asarray(asks.column("home"), np.int32), [len(x) // FACTOR.itemsize for x in blobs])
        order = np.argsort(wanted["source"], kind="stable")
        wanted, whose, agree = wanted[order], whose[order], np.zeros(len(order), bool)
        ids, texts, _ = block_rows(table) if len(table) and len(wanted) else (np.empty(0, np.int64), [], None)
        for i, t in zip(ids.tolist(), texts):
            first, stop = np.searchsorted(wanted["source"], i), np.searchsorted(wanted["source"], i, "right")
            words = (t or b"").split() if stop > first else []
            seen: dict[tuple[int, int], bytes] = {}
            for n in range(first, stop):
                span = int(wanted[n]["source_start"]), int(wanted[n]["length"])
                if span not in seen:
                    seen[span] = digest(b" ".join(words[span[0] : sum(span)]))
                agree[n] |= seen[span] == wanted[n]["words"].tobytes()
        refused, whose = wanted[~agree], whose[~agree]
        told = _rows([(int(h), int(h), None, None, refused[whose == h].tobytes()) for h in np.unique(whose)])
        return pa.concat_tables([own.select(told.column_names).cast(told.schema), told])

    def cut(table: pa.Table, factors: pa.Table) -> pa.Table:
        """Documents without the words of their factors."""
        ids, texts, null = block_rows(table) if len(table) else (np.empty(0, np.int64), [], np.empty(0, bool))
        known, bare = {}, lambda f: f[["source", "source_start", "length", "words"]].tobytes()
        refused: set[bytes] = set()
        for key, doc, blob in zip(*(factors.column(c).to_pylist() for c in ("key", "doc", "factors"))):
            if doc is None:
                refused.update(bare(f) for f in np.frombuffer(blob, FACTOR))
            else:
                known[key, doc] = blob
        keyed = {k for k, _ in known}
        counts, removed, kept, factors_out = [], [], [], []
        for i, t, no in zip(ids.tolist(), texts, null.tolist()):
            words, key = (t or b"").split(), None if no else i
            blob = known.get((key, digest(t))) if key in keyed else None
            found, left = np.frombuffer(blob or b"", FACTOR), words
            if refused:
                found = found[[bare(f) not in refused for f in found]]
            if len(found):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, found["start"], 1)
                np.add.at(cover, found["start"] + found["length"], -1)
                left = [w for w, s in zip(words, (np.cumsum(cover[:-1]) == 0).tolist()) if s]
            counts.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
            factors_out.append(found)
        spans = _joined(factors_out, FACTOR)
        entries = pa.StructArray.from_arrays([pa.array(spans[n].copy()) for n in ("start", "length", "source", "source_start")], fields=list(_FACTOR.value_type))
        ends = pa.array(np.cumsum([0] + [len(f) for f in factors_out]), pa.int32())
        counted = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        kept_text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), **counted, "kept_text": kept_text, "factors": pa.ListArray.from_arrays(ends, entries)})

    sent = blocks.groupBy("block").applyInArrow(send_anchors, "bucket int, block int, keys binary, twice binary")
    shared = sent.groupBy("bucket").applyInArrow(shared_anchors, "block int, keys binary")
    windows = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send_windows,
        "bucket int, block int, keys binary, checks binary, sources binary, places binary, again binary"
    )
    found = windows.groupBy("bucket").applyInArrow(first_places, "block int, keys binary, sources binary, places binary, homes binary")
    factors = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(parse, _ROWS)
    agreed = blocks.groupBy("block").cogroup(factors.groupBy("target")).applyInArrow(compare, _ROWS)
    return blocks.groupBy("block").cogroup(agreed.groupBy("home")).applyInArrow(cut, SCHEMA)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return factor_documents(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.size("factors").cast("long").alias("n_factors")
    )
