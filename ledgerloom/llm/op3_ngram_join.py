"""N-gram Jaccard join with vertical partitioning.

A document's set holds its distinct shingles of SIZE words (A-Z lower-cased; the whole sequence if it has fewer words).
Documents with equal sets are one class; classes link when their sets' Jaccard similarity is at least PERCENT / 100.

1. Shingles are ordered globally, rarest first: by the size class of how many sets of blocks hold them, then by hash.
   Shingles that no other set holds are left out of what is compared; they count for a set's size alone.
2. A class is indexed under its prefix: as many of its first shingles as a linked class must share one of, without those
   that no other set holds.
3. Classes under one shingle are candidates where sizes and what follows the shingle allow a link.  The first round
   compares one of a shingle's classes with all others.  From then on those outside the shingle's largest connected part
   are compared with all others, AT_ONCE or, if there are more, LEADERS of them in a round, and taken out, until what is
   left of the shingle is connected.  So every link is found or joins classes that other links join already, and a group
   of n near copies costs about n comparisons.
4. Vertical partitioning: pivots cut the global order into FRAGMENTS stretches that hold equally many of all sets'
   shingles.  A set falls into its parts in the fragments, each fragment is joined by itself and counts the partial
   overlap of a pair, and the partial overlaps are summed for each pair.

The search of step 3 finds components alone.  `with_class_links` compares every candidate pair and returns all links with
their overlaps and the number of links of each class; its pairs grow with the square of a group of different near copies.

Shingles are 64-bit and sets 128-bit hashes by keys that are drawn anew for each run, so no texts can be made to share
one; classes are named by the smallest of their rows, as their sets' hashes differ from run to run.  Null and empty texts, and texts without
words, have an empty set: they link with nothing.  Rows with one doc_id each keep their own row.  A null doc_id never is
a component's smallest, unless all are.  Texts of any length are one set, whole.  Ties: shingles of one size class are
ordered by hash, sets of one size by id.  An empty table gives an empty result.  The result has the columns named at each
function and none of the input's others.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._blocks import NO_ID, block_rows, bucket_cuts, dealt, expand, expand_sorted, squeeze, squeeze_sorted
from ledgerloom.llm._components import components
from ledgerloom.llm._shared import discard, keyed_words, saved, scratch, shingle_hashes, spread_join

SIZE, PERCENT = 5, 80
#: Fragments of the global order a pair's overlap is counted in; classes of a shingle that are compared in a round if there are more than the next number.
FRAGMENTS, LEADERS, AT_ONCE = 4, 256, 1024
#: Bits of a shingle's hash that count for its frequency, which only orders the shingles.
COUNT_BITS = 40


def shingle_set(text: bytes | None, size: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = keyed_words(seed).of(text)
    if 0 < len(words) < size:
        return shingle_hashes(words, len(words), seed=len(words))
    return np.unique(shingle_hashes(words, size, seed=size))


def set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles of a set of n: a set that is similar enough holds one of them."""
    return n - -(-percent * n // 100) + 1


def rarity(counts: np.ndarray) -> np.ndarray:
    """Size classes of counts, eight for each doubling."""
    return np.floor(8 * np.log2(counts)).astype(np.uint8)


#: Of a row's set: size and id; where it shares shingles, its prefix and, in global order, shared shingles and their size classes.
SET = "key long, text_hash long, n long, sid binary, prefix array<struct<token: bigint, place: int>>, hashes binary, rarity binary"


def document_sets(docs: DataFrame, key: str, text: str, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Each row's set; see SET."""
    blocks, buckets = dealt(docs, key, text)
    shift, seed = np.uint64(64 - COUNT_BITS), secrets.randbits(63)

    def send(table: pa.Table) -> pa.Table:
        sets = {set_id(s): s for s in (shingle_set(t, size, seed) for t in block_rows(table)[1])}  # copies count once in a block
        keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]) >> shift, return_counts=True)
        cuts = bucket_cuts(keys, buckets, COUNT_BITS)
        used = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        part = lambda b: slice(cuts[b], cuts[b + 1])
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
                "keys": pa.array([squeeze_sorted(keys[part(b)]) for b in used], pa.binary()),
                "counts": pa.array([squeeze(n[part(b)].astype(np.uint32)) for b in used], pa.binary())
            }
        )

    def total(table: pa.Table) -> pa.Table:
        own = [expand_sorted(x) for x in table.column("keys").to_pylist()]
        keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([expand(x, np.uint32) for x in table.column("counts").to_pylist()])).astype(np.uint32)
        ends = np.cumsum([len(k) for k in own])
        counts = [n[inverse[e - len(k) : e]] for k, e in zip(own, ends)]
        return pa.table(
            {
                "block": table.column("block"),
                "keys": pa.array([squeeze_sorted(k[c > 1]) for k, c in zip(own, counts)], pa.binary()),
                "counts": pa.array([squeeze(c[c > 1]) for c in counts], pa.binary())
            }
        )

    def sets(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, texts, null, digests = block_rows(table, ["text_hash"]) if len(table) else (np.empty(0, np.int64), [], np.empty(0, bool), pa.array([], pa.int64()))
        shared = np.concatenate([np.empty(0, np.uint64), *[expand_sorted(x) for x in answers.column("keys").to_pylist()]])
        counts = np.concatenate([np.empty(0, np.uint32), *[expand(x, np.uint32) for x in answers.column("counts").to_pylist()]])
        order = np.argsort(shared)
        shared, counts = shared[order], counts[order]
        ns, sids, prefixes, hashes, classes = [], [], [], [], []
        for t in texts:
            s = shingle_set(t, size, seed)
            k = s >> shift
            at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
            n = np.where(shared[at] == k, counts[at], 1) if len(shared) else np.ones(len(s), np.uint32)
            rare = rarity(n)
            order = np.lexsort((s, rare))
            alone = int((n == 1).sum())  # the rarest; no pair has them in common
            tokens = s[order]
            first = tokens[alone : prefix_length(len(s), percent)] if len(s) else tokens
            ns.append(len(s))
            sids.append(set_id(s) if len(s) else None)
            prefixes.append([{"token": t, "place": alone + p} for p, t in enumerate(first.astype(np.int64).tolist())] if len(first) else None)
            hashes.append(tokens[alone:].tobytes() if len(first) else None)
            classes.append(rare[order][alone:].tobytes() if len(first) else None)
        kinds = {"key": pa.array(keys, pa.int64(), mask=null), "text_hash": digests, "n": pa.array(ns, pa.int64()), "sid": pa.array(sids, pa.binary())}
        return pa.table(
            kinds | {
                "prefix": pa.array(prefixes, pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())]))),
                "hashes": pa.array(hashes, pa.binary()),
                "rarity": pa.array(classes, pa.binary())
            }
        )

    sent = blocks.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(total, "block int, keys binary, counts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sets, SET)


def pivots(sets: DataFrame, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Where fragments after the first begin in the global order: (size class, hash); a row for each size class comes here, 256 at most."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["rarity", "n"])

    found = sets.select("rarity").mapInArrow(count, "rarity int, n long").groupBy("rarity").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(256, np.int64)
    for r in found:
        n[r["rarity"]] = r["n"]
    ends, out = np.cumsum(n), []
    for f in range(1, fragments):  # hashes of a size class are spread evenly
        goal = int(ends[-1]) * f // fragments
        c = int(np.searchsorted(ends, goal, "right"))
        if c < 256 and ends[-1]:
            out.append((c, ((goal - int(ends[c] - n[c])) << 64) // int(n[c])))
    return out


def fragments_of(hashes: np.ndarray, rarities: np.ndarray, cuts: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """(fragment, sorted hashes) of a set in global order."""
    of = np.zeros(len(hashes), np.int64)
    for c, h in cuts:
        of += (rarities > c) | ((rarities == c) & (hashes >= np.uint64(h)))
    return [(f, np.sort(hashes[of == f])) for f in np.unique(of).tolist()]


def overlaps(pairs: DataFrame, sets: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """pairs (a, b, ...) with `overlap`, the size of the intersection of sets a and b; pairs without any are left out."""

    def cut(batches):
        for batch in batches:
            for sid, hashes, rarities in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = fragments_of(np.frombuffer(hashes, np.uint64), np.frombuffer(rarities, np.uint8), cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid] * len(parts), pa.binary()), pa.array([f for f, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())],
                    names=["sid", "fragment", "part"]
                )

    def count(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            n = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "n"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    parts = saved(sets.join(ends.hint("merge"), "sid").select("sid", "hashes", "rarity").mapInArrow(cut, "sid binary, fragment int, part binary"), "fragments")
    left = parts.select(F.col("sid").alias("a"), "fragment", F.col("part").alias("x"))
    right = parts.select(F.col("sid").alias("b"), "fragment", F.col("part").alias("y"))
    met = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), ["a", "fragment"])
    partial = met.select("a", "b", "x", "y").mapInArrow(count, "a binary, b binary, n long")
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("n").alias("overlap")), ["a", "b"])


def class_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between classes (sid, n, prefix, hashes) that connect all that are connected."""
    entries = saved(sets.select("sid", "n", F.explode("prefix").alias("p")).select("sid", "n", "p.token", "p.place"), "prefixes")
    shared = entries.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    entries, cuts = saved(spread_join(entries, shared, ["token"], ["sid"]), "prefixes"), pivots(sets)

    def compared(leaders: DataFrame, entries: DataFrame) -> DataFrame:
        """Links between leaders (token, lead, lead_n, lead_place, lead_root) and the other classes of their shingles, where roots differ.

        At the first shingle two sets share, no more than what follows it in either can be shared, so a linked pair
        passes there.
        """
        enough = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place")) >= percent * (F.col("n") + F.col("lead_n"))
        close = enough & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & (F.col("root") != F.col("lead_root"))
        met = spread_join(entries, leaders, ["token"], ["sid"]).filter(close)
        own = F.struct(F.col("sid").alias("id"), F.col("n").alias("n"))
        lead = F.struct(F.col("lead").alias("id"), F.col("lead_n").alias("n"))
        both = met.select(F.least(own, lead).alias("x"), F.greatest(own, lead).alias("y")).distinct()
        pairs = saved(both.select(F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("y.id").alias("b"), F.col("y.n").alias("nb")), "pairs")
        return overlaps(pairs, sets, cuts).filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")

    def lead(df: DataFrame) -> DataFrame:
        return df.select("token", F.col("sid").alias("lead"), F.col("n").alias("lead_n"), F.col("place").alias("lead_place"), F.col("root").alias("lead_root"))

    # the first round compares one class with all others of its shingle: that with the fewest rarer ones, as a text
    # that others were made from has
    held, entries, spark = entries, entries.withColumn("root", F.col("sid")), sets.sparkSession
    first = entries.groupBy("token").agg(F.min(F.struct("place", "n", "sid", "root")).alias("r")).select("token", "r.*")
    leaders, links, roots = saved(lead(first), "leaders"), None, None
    while True:
        with scratch(spark):
            new = saved(compared(leaders, entries), "links", outer=True)
        if links is None or not new.isEmpty():
            with scratch(spark):
                known = saved(components(new if links is None else links.union(new)), "roots", outer=True)
            discard(roots)
            roots, links = known, known.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        discard(new)
        # what is left: no leaders, and only shingles whose classes aren't connected yet
        left = entries.select("token", "sid", "n", "place").join(leaders.select("token", F.col("lead").alias("sid")).hint("merge"), ["token", "sid"], "left_anti")
        left = left.join(roots.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        left = saved(left, "prefixes")
        parts = left.groupBy("token", "root").agg(F.count("*").alias("m"))
        largest = parts.groupBy("token").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m")).filter("m > top.m").select(
            "token",
            F.col("top.root").alias("top"),
            (F.col("m") - F.col("top.m")).alias("strays")
        )
        entries = saved(spread_join(left, largest, ["token"], ["sid"]), "prefixes")
        discard(held, left)
        held = entries
        if entries.isEmpty():
            return links
        # with all but a shingle's largest part compared, all of its pairs that matter are
        strays = entries.filter("root <> top")
        many = strays.filter(F.col("strays") > AT_ONCE).groupBy(
            "token",
            F.pmod(F.xxhash64("sid"), F.lit(LEADERS)).alias("salt")
        ).agg(F.min(F.struct("place", "n", "sid", "root")).alias("r")).select("token", "r.*")
        old, leaders = leaders, saved(lead(strays.filter(F.col("strays") <= AT_ONCE)).union(lead(many)), "leaders")
        discard(old)
        entries = entries.drop("top", "strays")


def all_class_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, na, b, nb, overlap): every link between two classes (sid, n, prefix, hashes), a the smaller by (n, sid)."""
    entries = saved(sets.select("sid", "n", F.explode("prefix").alias("p")).select("sid", "n", "p.token", "p.place"), "prefixes")
    one = lambda at: entries.select("token", F.struct("n", "sid").alias(at), (F.col("n") - F.col("place")).alias(f"rest_{at}"))
    enough = (100 + percent) * F.least("rest_x", "rest_y") >= percent * (F.col("x.n") + F.col("y.n"))  # as in class_links
    met = one("x").join(one("y").hint("merge"), "token").filter(
        (F.col("x") < F.col("y")) & (100 * F.col("x.n") >= percent * F.col("y.n")) & enough
    ).select("x", "y").distinct()
    pairs = saved(met.select(F.col("x.sid").alias("a"), F.col("x.n").alias("na"), F.col("y.sid").alias("b"), F.col("y.n").alias("nb")), "pairs")
    return overlaps(pairs, sets, pivots(sets)).filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))


def class_sets(sets: DataFrame) -> DataFrame:
    """(sid, n, prefix, hashes, rarity): one set for each class with a shared prefix, as copies of a prefix are equal."""
    shared = sets.filter("prefix IS NOT NULL").groupBy("sid").agg(F.min(F.struct("key")).alias("k"))
    own = spread_join(sets.filter("prefix IS NOT NULL"), shared, ["sid"], ["key"]).filter(F.col("key").eqNullSafe(F.col("k.key"))).select("sid", "n", "prefix", "hashes", "rarity").dropDuplicates(["sid"])
    return saved(own, "classes")


def class_names(sets: DataFrame) -> DataFrame:
    """(sid, first, class_id): each class with the smallest key of its rows, and the name that it has in every run: of the
    row with the smallest key (null the largest) and hash of the text.
    """
    row = F.struct(F.coalesce("key", F.lit(NO_ID)).alias("key"), "text_hash")
    named = sets.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("first"), F.min(row).alias("row"))
    return named.select("sid", "first", F.concat_ws("-", F.coalesce(F.col("first").cast("string"), F.lit("null")), F.lower(F.hex("row.text_hash"))).alias("class_id"))


def with_class_links(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(class_a, class_b, n_a, n_b, overlap, links_a, links_b): every link between two classes, and how many links each end has in all."""
    sets = saved(document_sets(docs, key, text, size, percent), "sets")
    links = saved(all_class_links(class_sets(sets), percent), "links")
    names = saved(class_names(sets).select("sid", "class_id"), "names")
    counts = saved(links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links")), "counts")
    for end in ("a", "b"):
        links = links.join(counts.select(F.col("sid").alias(end), F.col("links").alias(f"links_{end}")).hint("merge"), end)
        links = links.join(names.select(F.col("sid").alias(end), F.col("class_id").alias(f"class_{end}")).hint("merge"), end)
    return links.select("class_a", "class_b", F.col("na").alias("n_a"), F.col("nb").alias("n_b"), "overlap", "links_a", "links_b")


def with_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, class_id, component_id, text_hash): a row for each of docs' rows; class_id is null for empty sets.

    text_hash, Spark's xxhash64 of the text, tells rows with one key apart.
    """
    sets = saved(document_sets(docs, key, text, size, percent), "sets")
    classes = class_names(sets)
    roots = components(class_links(class_sets(sets), percent)).select(F.col("node").alias("sid"), "root")
    classes = saved(classes.join(roots.hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest.hint("merge"), "root").select("sid", "class_id", "component_id")
    rows = spread_join(sets.select(F.col("key").alias(key), "text_hash", F.col("n").alias("n_shingles"), "sid"), named, ["sid"], [key, "text_hash"], "left")
    return rows.select(key, "n_shingles", "class_id", F.coalesce("component_id", key).alias("component_id"), "text_hash")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id."""
    return with_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash")


def op3_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links between classes of documents with equal sets: class_a, class_b, n_a, n_b, overlap, links_a, links_b."""
    return with_class_links(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
