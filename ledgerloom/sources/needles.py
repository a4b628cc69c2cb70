"""Substring joins: which texts hold which needles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of needles that go to the tasks at a time.
MAX_NEEDLE_BYTES = 8 << 20


def _held(texts: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """texts with `__needle`, a row for each needle that the text holds: one pass of an automaton over each text."""
    shared = texts.sparkSession.sparkContext.broadcast(needles)
    out = T.StructType([*texts.schema.fields, T.StructField("__needles", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = ahocorasick.Automaton(), [n for n in shared.value if n == ""]
        for n in shared.value:
            if n:
                automaton.add_word(n, n)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column(text).to_pylist():
                some = {n for _, n in automaton.iter(t)} if t and len(automaton) else set()
                found.append([] if t is None else always + sorted(some))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=out.names)

    return texts.mapInArrow(run, out).withColumn("__needle", F.explode("__needles")).drop("__needles")


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, most: int = MAX_NEEDLE_BYTES) -> DataFrame:
    """texts joined with the needles they hold (JN18, JN23).

    A stated set of needles runs against all texts in blocks: their size is measured first, and beyond `most` bytes
    they go in as many parts, one pass over the texts for each, so that what is sent to the tasks outgrows the bound by
    no more than its share.
    """
    size = needles.agg(F.sum(F.octet_length(needle))).first()[0] or 0
    parts = -(-size // most) or 1
    other = texts.select(*[c for c in texts.columns if c == text or c not in needles.columns])

    def one(i: int) -> DataFrame:
        own = needles.filter(F.pmod(F.xxhash64(needle), F.lit(parts)) == i)
        words = [r[0] for r in own.select(needle).distinct().filter(F.col(needle).isNotNull()).toLocalIterator()]
        return _held(other, text, words).join(F.broadcast(own), F.col("__needle") == F.col(needle)).drop("__needle")

    return reduce(DataFrame.union, [one(i) for i in range(parts)])
