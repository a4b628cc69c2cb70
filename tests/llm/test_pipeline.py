"""The pipeline's stages, each on its own input, against plain Python."""

import base64

import corpus_pipeline as P
import public_tokenizers
import tiktoken
from conftest import SF
from pyspark.sql import functions as F
from test_ops import brute_components

from ledgerloom.llm._shared import saved
from ledgerloom.llm.op9_license_scan import license_words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = saved(stage(spark, docs, SF), "test")
        assert name == P.STAGES[-1][0] or docs.columns == columns
    # quality: the verdicts of the operator, which SQL checks
    from ledgerloom.llm.op5_quality_rules import with_quality

    kept = {r["doc_id"]: r["clean_text"] for r in with_quality(seen["quality rules"]).filter("kept").collect()}
    assert {r["doc_id"]: r["text"] for r in seen["line dedup"].collect()} == kept
    assert seen["line dedup"].filter(F.col("n_chars") != F.length("text")).count() == 0
    # near duplicates: one document of each component
    before = [(r["doc_id"], r["text"]) for r in seen["n-gram join"].collect()]
    assert sorted(r["doc_id"] for r in seen["decontamination"].collect()) == sorted({c for _, _, c in brute_components(before)})
    # decontamination: no verbatim passage is left, and nothing clean went
    items = [b" ".join(license_words(r["text"].encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(x in b" ".join(license_words(t.encode())) for x in items)
    ids = {r["doc_id"] for r in docs.collect()}
    assert all(holds(r["text"]) != (r["doc_id"] in ids) for r in seen["decontamination"].collect())
    # encoding
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in seen["byte bpe"].collect()}
    assert all(r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) and r["round_trip"] for r in docs.collect())


def test_byte_bpe_has_one_worker_a_core(spark):
    made = P.byte_bpe(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_exact_copies_go_whole(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text LIKE '%\n%'").orderBy("doc_id").limit(30).collect()]
    rows = [(1000 * k + i, t, "en", "s", len(t)) for k in range(3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = P.near_duplicates(spark, saved(P.line_dedup(spark, docs, SF), "copies"), SF).collect()
    assert left and all(r["doc_id"] < 1000 for r in left)  # of each planted copy nothing is left
    assert {r["doc_id"] for r in left} == {
        r["doc_id"] for r in P.near_duplicates(spark, saved(P.line_dedup(spark, docs.filter("doc_id < 1000"), SF), "once"), SF).collect()
    }


def test_line_dedup_by_chunks_and_what_they_leave(spark):
    from test_ops import RNG, WORD, WORDS, brute_passages

    from ledgerloom.llm.op7_line_dedup import repeated_chunks

    own = [WORDS(9) for _ in range(60)]
    block = "\n".join(own[:16])
    rows = [(1, f"{WORDS(8)}\n\n{block}\n\n{WORDS(8)}"), (2, f"{WORDS(7)}\n\n{block}\n\n{WORDS(7)}"), (90, "\n".join(own)), (91, "\n".join(own))]
    for k in range(24):  # passages of each length between foreign lines, most too short for a whole chunk
        at = RNG.randrange(16, 60 - 10)
        rows.append((100 + k, "\n".join([WORDS(8), *own[at : at + 2 + k % 9], WORDS(8)])))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    left = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, SF).collect()}
    # a found chunk takes the equal blank lines beside it along
    assert left[2] == "\n".join([rows[1][1].split("\n")[0], rows[1][1].split("\n")[-1]])
    words = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    assert {i: words(t) for i, t in left.items()} == {i: words(t) for i, _, t in brute_passages(rows) if words(t)}
    # chunks are what finds passages: the ranges they give are lost whole
    ranges = repeated_chunks(docs).collect()
    texts = dict(rows)
    assert {2, 91} <= {r["key"] for r in ranges}
    for r in ranges:
        lines = texts[r["key"]].split("\n")
        assert not set(lines[r["place"] : r["end"] + 1]) & set(left.get(r["key"], "-").split("\n"))


def test_line_dedup_keeps_one_of_rows_with_one_id(spark):
    from test_ops import WORDS

    lines = [WORDS(9) for _ in range(12)]
    block = "\n".join(lines)
    rows = [(5, "\n".join([WORDS(5)] * 40 + [block])), (5, "\n".join([*(WORDS(6) for _ in range(30)), block])), (5, "\n".join(lines[3:5])), (6, block), (6, block)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = [(r["doc_id"], r["text"].split("\n")) for r in P.line_dedup(spark, docs, SF).collect()]
    assert all(any(x in own for _, own in left) for x in lines) and all(i == 5 for i, _ in left)


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "s", 0),
        (2, text, None, None, None),
        (2, text, None, None, None),
        (None, text, "en", "s", 1),
        (3, text, "en", "s", 1)
    ]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in P.STAGES:
            docs = saved(stage(spark, docs, SF), "odd")
    assert docs.count() == 0
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES:
        docs = saved(stage(spark, docs, SF), "odd")
    assert sorted(map(repr, [r["doc_id"] for r in docs.collect()])) == ["2", "2", "None"]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (6, a + " more"), (6, b + " more"), (None, a), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert sorted([(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, SF).collect()], key=repr) == sorted([(3, a), (5, b), (None, a), (7, None)], key=repr)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.lit("x") for n in ("text_hash", "own", "note")})
    for name, stage in P.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), "clash")
        assert {"text_hash", "own", "note"} <= set(docs.columns) and docs.count() > 0
