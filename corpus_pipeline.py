"""Stages that turn `documents` into encoded training text.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns rows with the columns of
documents; the last returns ids.  `run` writes each stage's rows to the shared folder and reads them again, so that an
executor's loss costs no earlier stage.  Null texts are rejected by the first stage; rows with a null doc_id pass the
near-duplicate stage, as they can't be named as members of a group; repeated rows go or stay together there; an empty
table gives an empty result.  Columns besides those of documents are carried along by all stages but the last, but for
those named like a stage's measures (n_words, n_removed, leaks and the like), which a stage replaces and drops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import discard, scratch, spread_join, work_path
from ledgerloom.llm.op2_decontamination import with_leaks
from ledgerloom.llm.op3_ngram_join import with_near_duplicates
from ledgerloom.llm.op5_quality_rules import with_quality
from ledgerloom.llm.op7_line_dedup import with_whole_dedup
from ledgerloom.llm.op8_byte_bpe import round_trip


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """docs' own columns, with text (and n_chars, where it is one of them) replaced."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return docs.withColumns(new).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that the rules reject."""
    return _with_text(with_quality(docs).filter("kept"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go and the repeated passages between them, and documents that nothing but such made up, as copies of two lines or more are."""
    left = with_whole_dedup(docs).filter((F.col("n_removed") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, docs.columns, "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows are told apart by doc_id and text.  Of rows with the group's smallest doc_id the one with the smallest hash of its
    text stays; repeated rows all do, as nothing tells them apart.
    """
    found = with_near_duplicates(docs.select("doc_id", "text"))
    members = found.filter("class_id IS NOT NULL AND doc_id IS NOT NULL")
    first = members.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("__first"))
    others = spread_join(members, first, ["component_id"], ["doc_id"]).filter((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("__first")))
    others = others.select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    return docs.withColumn("__hash", F.xxhash64("text")).join(others.hint("shuffle_hash"), ["doc_id", "__hash"], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_leaks(docs, items).filter(F.size("leaks") == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether the ids decode to the text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = round_trip(docs, path, pattern)
    same = F.col("decoded") == F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    return both.select("doc_id", "lang", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram join", near_duplicates),
    ("decontamination", decontamination),
    ("byte bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, path = docs, work_path(spark, name.replace(" ", "-"))
        with scratch(spark):  # a stage's own tables end with it
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        docs.saved_path = path
        discard(before)
    return docs


#: SQL expresses neither the embedding's recall nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None
