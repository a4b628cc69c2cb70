"""Line deduplication over content-defined chunks of lines.

A text's lines (split at \\n) are cut into chunks behind lines with words whose rolling hash, a polynomial over the hashes
of the last WINDOW lines with words, is smaller than those of the lines with words before and behind.  Boundaries follow
from nearby lines alone, so they shift with inserted text and line up again within equal passages, and every chunk has two
lines with words or more, if its text has.  Where no boundary comes, as in a run of equal lines, chunks end after MAX_LINES
lines with words, or one later where one alone would be left.  A chunk with at least MIN_LINES lines that hold words and whose text occurs earlier, in
a smaller (doc_id, place of the chunk), is removed, with the lines beside it, within the chunks next to it, that equal those
beside its first occurrence, so that a passage goes up to its ends where a chunk of it has been found.  Of every line the
first occurrence stays.  Chunks meet by hash and are compared by their bytes before anything is removed; the lines beside
them by 128 bits of their SHA-256.

Null texts stay null and have no lines; an empty text is one empty line.  A null doc_id counts as the smallest.  Rows are
told apart by doc_id and text: rows with one doc_id and different texts each lose their own chunks, repeated rows the
same ones, and equal chunks at equal places of rows with one doc_id all stay.  All columns of the input stay, but for
n_lines, n_removed and clean_text, which replace any of that name.  An empty table gives an empty result.

Passages too short to hold a whole chunk are missed.  `with_passage_dedup`
misses none: a line goes if it lies in a stretch from one line with words to the MIN_LINES - 1st after it whose bytes
occur earlier.  So every repeated run of MIN_LINES lines with words or more goes whole, wherever it stands, and of every
line the first occurrence stays.  Stretches are told apart by 128 bits of their SHA-256.  Rows are told apart as above.
`with_whole_dedup`, the pipeline's, puts both together: repeated chunks go with the lines beside them, as above, and of the
stretches that lie in none of these those that occur earlier, after comparing their bytes too.  So it loses all that
`with_passage_dedup` finds, and the blank lines at a found chunk's ends.

Shuffled are hashes of chunks, the text of repeated chunks, and the documents by key, to meet what they lose; minima are
formed before the shuffle, and the rows of a hot hash are dealt into parts to meet its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import saved, spread_join
from ledgerloom.llm.op5_quality_rules import let

WINDOW, MIN_LINES, MAX_LINES = 2, 2, 16
PRIME, FACTOR = 2_147_483_647, 1_000_003
_WORD = r"[^\x20\x09-\x0D]"


def chunks_of(text: Column, window: int = WINDOW, most: int = MAX_LINES) -> Column:
    """A text's chunks in order: array of (text, start, lines, word_lines); start is the first line's number."""

    def rolling(hashes: Column, k: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in reversed(range(window)):
            value = F.pmod(value * FACTOR + F.coalesce(F.get(hashes, k - back), F.lit(0)), F.lit(PRIME))
        return value

    def cut(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())

        def boundaries(at: Column) -> Column:
            """Of the lines with words the numbers of those that a chunk ends at, the last one apart."""
            hashes = F.transform(at, lambda i: F.conv(F.substring(F.md5(F.get(lines, i)), 1, 7), 16, 10).cast("long"))
            values = let(hashes, lambda h: F.transform(h, lambda x, k: rolling(h, k)))
            least = lambda v: F.filter(
                F.transform(v, lambda x, k: F.when((x < F.get(v, k - 1)) & (x < F.get(v, k + 1)) & (k + 2 < F.size(v)), k)),
                lambda k: k.isNotNull()
            )

            def divided(minima: Column) -> Column:
                start = lambda j: F.coalesce(F.get(minima, j - 1) + 1, F.lit(0))
                last = F.size(at) - 1
                inner = lambda s, e: F.when(s + most < e, F.sequence(s + most - 1, e - 2, F.lit(most))).otherwise(F.array().cast("array<int>"))
                parts = F.transform(
                    F.concat(minima, F.array(last)),
                    lambda e, j: F.concat(inner(start(j), e), F.when(e < last, F.array(e)).otherwise(F.array().cast("array<int>")))
                )
                return F.flatten(parts)

            return let(let(values, least), divided)

        def chunk(own: Column, first: Column) -> Column:
            return F.struct(
                F.array_join(own, "\n").alias("text"),
                first.alias("start"),
                F.size(own).alias("lines"),
                F.size(F.filter(own, lambda x: x.rlike(_WORD))).alias("word_lines")
            )

        def chunks(e: Column) -> Column:
            start = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
            return F.transform(e, lambda end, k: let(F.slice(lines, start(k) + 1, end - start(k) + 1), lambda own: chunk(own, start(k))))

        ends = let(places, lambda at: F.concat(F.transform(boundaries(at), lambda k: F.get(at, k)), F.array(F.size(lines) - 1)))
        return let(ends, chunks)

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), cut))


def _line_digests(x: Column, backwards: bool = False) -> Column:
    """128 bits of the SHA-256 of each of a text's lines, from the first or from the last; null for null."""
    digests = F.transform(F.split(x, "\n", -1), lambda line: F.substring(F.unhex(F.sha2(line, 256)), 1, 16))
    return F.reverse(digests) if backwards else digests


def _equal_lines(a: Column, b: Column) -> Column:
    """How many entries two arrays begin with in common; none where one is null."""
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(let(both, lambda same: F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False) - 1)).cast("int"), F.lit(0))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(key, doc, place, end): the lines that go; doc is the hash of the row's text."""
    hashed = lambda c: F.transform(c, lambda x: F.struct(F.xxhash64(x["text"]).alias("hash"), x["word_lines"].alias("word_lines")))
    own = [F.col(key).alias("key"), F.xxhash64(text).alias("doc")]
    rows = docs.select(*own, F.posexplode(hashed(chunks_of(F.col(text)))).alias("place", "chunk")).filter(F.col("chunk.word_lines") >= min_lines)
    rows = rows.select("key", "doc", "place", F.col("chunk.hash").alias("hash"))
    at = F.struct("key", "place")
    index = rows.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last")
    found = spread_join(rows, index, ["hash"], ["key", "place"]).select("key", "doc", F.struct("place", "hash", (at == F.col("first")).alias("is_first")).alias("chunk"))
    found = found.groupBy(F.col("key").alias("__key"), F.col("doc").alias("__doc")).agg(F.collect_set("chunk").alias("__found"))
    # of the texts, only repeated chunks and those beside them go on from here
    met = docs.join(found.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__doc")))

    def with_texts(c: Column) -> Column:
        one = lambda x: let(
            F.get(c, x["place"]),
            lambda own: F.struct(
                x["hash"].alias("hash"),
                x["is_first"].alias("is_first"),
                x["place"].alias("place"),
                own["text"].alias("text"),
                own["start"].alias("start"),
                own["lines"].alias("lines"),
                _line_digests(F.get(c, x["place"] - 1)["text"], backwards=True).alias("before"),
                _line_digests(F.get(c, x["place"] + 1)["text"]).alias("after")
            )
        )
        return F.transform("__found", one)

    met = saved(
        met.select(*own, F.explode(let(chunks_of(F.col(text)), with_texts)).alias("c")).select("key", "doc", "c.*").filter(F.xxhash64("text") == F.col("hash")),
        "repeated-chunks"
    )
    first = met.filter("is_first").groupBy("hash").agg(F.min(F.struct("text", "before", "after")).alias("first"))
    later = spread_join(met.filter("NOT is_first"), first, ["hash"], ["key", "place"]).filter(F.encode("text", "utf-8") == F.encode("first.text", "utf-8"))
    before, after = _equal_lines(F.col("before"), F.col("first.before")), _equal_lines(F.col("after"), F.col("first.after"))
    return later.select("key", "doc", (F.col("start") - before).alias("place"), (F.col("start") + F.col("lines") - 1 + after).alias("end"))


def without_lines(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """docs with n_lines, n_removed (lines), clean_text: without the lines of gone (key, doc, place, end)."""
    gone = gone.groupBy(F.col("key").alias("__key"), F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("place", "end")).alias("__gone"))
    docs = docs.drop(*[c for c in ("n_lines", "n_removed", "clean_text") if c != text])
    met = docs.join(gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__doc")), "left").drop("__key", "__doc")
    covered = F.flatten(F.transform("__gone", lambda x: F.sequence(x["place"], x["end"])))
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    made = let(
        F.split(F.col(text), "\n", -1),
        lambda lines: let(
            left(lines),
            lambda at: F.struct((F.size(lines) - F.size(at)).alias("n"), F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n").alias("text"))
        )
    )
    out = met.withColumn("__made", F.when(F.col("__gone").isNotNull(), made)).withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.col("__made.n"), F.lit(0)).cast("long"),
            "clean_text": F.coalesce(F.col("__made.text"), F.col(text)),
        }
    )
    return out.drop("__gone", "__made")


def with_line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with n_lines, n_removed (lines), clean_text: repeated chunks go."""
    return without_lines(docs, repeated_chunks(docs, key, text, min_lines), key, text)


def stretches_of(text: Column, min_lines: int = MIN_LINES) -> Column:
    """A text's stretches of min_lines lines with words, and the blank lines among them: array of (place, end, digest)."""

    def found(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())

        def stretches(at: Column) -> Column:
            def stretch(i: Column, k: Column) -> Column:
                end = F.get(at, k + min_lines - 1)
                own = F.array_join(F.slice(lines, i + 1, end - i + 1), "\n")
                return F.struct(i.alias("place"), end.alias("end"), F.substring(F.unhex(F.sha2(own, 256)), 1, 16).alias("digest"))

            return F.transform(F.slice(at, 1, F.greatest(F.size(at) - min_lines + 1, F.lit(0))), stretch)

        return let(places, stretches)

    return let(F.split(text, "\n", -1), found)


def _indexed(rows: DataFrame) -> DataFrame:
    """Of rows (key, doc, place, end, digest) those whose digest occurs at two places or more, with the first (key, place)."""
    at = F.struct("key", "place")
    index = rows.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last")
    return spread_join(rows, index, ["digest"], ["key", "place"])


def repeated_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(key, doc, place, end): the stretches of the row with that key and text hash that occur earlier."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("doc"), F.explode(stretches_of(F.col(text), min_lines)).alias("s")).select("key", "doc", "s.*")
    return _indexed(rows).filter(F.struct("key", "place") > F.col("first")).select("key", "doc", "place", "end")


def with_passage_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with n_lines, n_removed (lines), clean_text: all repeated passages of min_lines lines with words or more go."""
    return without_lines(docs, repeated_stretches(docs, key, text, min_lines), key, text)


def stretches_beside(docs: DataFrame, gone: DataFrame, key: str, text: str, min_lines: int) -> DataFrame:
    """(key, doc, place, end): of the stretches in no range of gone (key, doc, place, end) those that occur earlier, by their bytes.

    With rows of one key a first occurrence may lie in such a range; the first of those outside then stays in its place.
    """
    own = [F.col(key).alias("key"), F.xxhash64(text).alias("doc")]
    same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("doc") == F.col("__doc"))
    ranges = gone.groupBy(F.col("key").alias("__key"), F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("place", "end")).alias("__gone"))
    rows = docs.select(*own, stretches_of(F.col(text), min_lines).alias("s")).filter(F.size("s") > 0)
    rows = rows.join(ranges.hint("shuffle_hash"), same, "left")
    inside = lambda s: F.exists("__gone", lambda g: (g["place"] <= s["place"]) & (s["end"] <= g["end"]))
    outside = F.when(F.col("__gone").isNull(), F.col("s")).otherwise(F.filter("s", lambda s: ~inside(s)))
    found = _indexed(rows.select("key", "doc", F.explode(outside).alias("s")).select("key", "doc", "s.*"))
    one = F.struct("place", "end", "digest", (F.struct("key", "place") == F.col("first")).alias("is_first"))
    found = found.groupBy(F.col("key").alias("__key"), F.col("doc").alias("__doc")).agg(F.collect_set(one).alias("__found"))
    # of the texts, only these stretches go on from here
    texts = docs.select(*own, F.col(text).alias("text")).join(found.hint("shuffle_hash"), same)
    whole = lambda lines: F.transform(
        "__found",
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("place", "end", "digest", "is_first")],
            F.array_join(F.slice(lines, x["place"] + 1, x["end"] - x["place"] + 1), "\n").alias("text")
        )
    )
    texts = saved(texts.select("key", "doc", F.explode(let(F.split("text", "\n", -1), whole)).alias("s")).select("key", "doc", "s.*"), "repeated-stretches")
    first = texts.filter("is_first").groupBy("digest").agg(F.min("text").alias("first"))
    later = spread_join(texts.filter("NOT is_first"), first, ["digest"], ["key", "place"]).filter(F.encode("text", "utf-8") == F.encode("first", "utf-8"))
    return later.select("key", "doc", "place", "end")


def with_whole_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with n_lines, n_removed (lines), clean_text: repeated chunks go, and the repeated passages that no chunk has shown."""
    chunks = saved(repeated_chunks(docs, key, text, min_lines), "repeated-ranges")
    rest = stretches_beside(docs, chunks, key, text, min_lines)
    return without_lines(docs, chunks.unionByName(rest), key, text)


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the digest of what is left without any repeated passage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_passage_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


#: Common table expressions that end in `deduped` (doc_id, text, n_lines, n_removed, clean_text), over `{docs}`.
DEDUP_SQL = rf"""
dl AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, row_number() OVER () AS r FROM (SELECT DISTINCT doc_id, text FROM {{docs}})),
dh AS (SELECT r, i, line, regexp_matches(line, '{_WORD}') AS word FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM dl)),
dw AS (SELECT r, i, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM dh WHERE word),
dv AS (SELECT r, i, (coalesce(lag(h) OVER w, 0) * {FACTOR} + h) % {PRIME} AS v, lead(i) OVER w IS NULL AS is_last FROM dw WINDOW w AS (PARTITION BY r ORDER BY i)),
dm AS (SELECT r, i, is_last, coalesce(v < lag(v) OVER w AND v < lead(v) OVER w AND lead(v, 2) OVER w IS NOT NULL, false) AS least FROM dv WINDOW w AS (PARTITION BY r ORDER BY i)),
db AS (SELECT *, coalesce(sum(least::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM dm),
de AS (SELECT r, i, NOT is_last AND (least OR (row_number() OVER (PARTITION BY r, base ORDER BY i) % {MAX_LINES} = 0 AND row_number() OVER (PARTITION BY r, base ORDER BY i DESC) > 2)) AS cut FROM db),
dc AS (SELECT h.r, h.i, line, word, coalesce(sum(cut::INT) OVER (PARTITION BY h.r ORDER BY h.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM dh h LEFT JOIN de e ON e.r = h.r AND e.i = h.i),
cg AS (SELECT r, place, string_agg(line, chr(10) ORDER BY i) AS chunk, min(i) AS start, max(i) AS stop, count(*) FILTER (word) AS word_lines FROM dc GROUP BY r, place),
ch AS (SELECT c.*, doc_id, lag(chunk) OVER w AS before, lead(chunk) OVER w AS after FROM cg c JOIN dl USING (r) WINDOW w AS (PARTITION BY r ORDER BY place)),
cm AS (SELECT *, rank() OVER (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, place) AS n FROM ch WHERE word_lines >= {MIN_LINES}),
cf AS (SELECT chunk, before AS b1, after AS a1, row_number() OVER (PARTITION BY chunk ORDER BY before NULLS FIRST, after NULLS FIRST) AS k FROM cm WHERE n = 1),
cl AS (SELECT r, start, stop, string_split(before, chr(10)) AS b, string_split(b1, chr(10)) AS b1, string_split(after, chr(10)) AS a, string_split(a1, chr(10)) AS a1 FROM cm JOIN cf USING (chunk) WHERE n > 1 AND k = 1),
cs AS (SELECT r, start - CASE WHEN len(b) > 0 AND len(b1) > 0 THEN coalesce(list_position(list_transform(range(1, least(len(b), len(b1)) + 1), lambda j: b[-j] <> b1[-j]), true) - 1, least(len(b), len(b1))) ELSE 0 END AS start,
  stop + CASE WHEN len(a) > 0 AND len(a1) > 0 THEN coalesce(list_position(list_transform(range(1, least(len(a), len(a1)) + 1), lambda j: a[j] <> a1[j]), true) - 1, least(len(a), len(a1))) ELSE 0 END AS stop FROM cl),
gone AS (SELECT DISTINCT r, unnest(range(start, stop + 1)) AS i FROM cs),
cd AS (SELECT h.r, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY h.i) FILTER (g.i IS NULL), '') AS clean FROM dh h LEFT JOIN gone g ON g.r = h.r AND g.i = h.i GROUP BY h.r),
deduped AS (SELECT d.doc_id, d.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN clean END AS clean_text FROM {{docs}} d JOIN dl ON d.doc_id IS NOT DISTINCT FROM dl.doc_id AND d.text IS NOT DISTINCT FROM dl.text LEFT JOIN cd ON dl.r = cd.r)
"""

ORACLE = f"WITH {DEDUP_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_removed, sha256(clean_text) AS kept_sha256 FROM deduped"
