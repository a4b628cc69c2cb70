"""Filter interaction audit: what each filter removes at each place of each order, from one pass over the documents.

The subsets of filters already applied form a lattice whose edges (subset, next filter) are 80 for five filters.  What a
filter removes at a step depends on the edge alone, not on how its subset was ordered, so the 600 steps of the 120 orders
are paths over 80 summed edges.  Documents that are alike in part, failed filters and labels contribute alike to every
edge; they are counted first, and each such count then contributes to the 80 edges.

1. Each document gets the filters A to D that its text fails, and a digest of its text (SHA-256).
2. E, identical to the text of a smaller doc_id, needs no text at hand: documents alike in digest, part and labels are
   counted with their smallest doc_id; of one digest all fail but those with the smallest doc_id of all.  Both sums are
   formed before the shuffle, so a text that a third of all documents share costs a few rows a task.
3. Edges are joined to the steps (600 rows) on (subset, filter).

Null texts count as empty, so they equal each other and empty ones.  A null lang is the empty part.  A null doc_id is
neither smaller nor larger than another: such rows fail E never, make no others fail, and have no labels.  Repeated rows
with one doc_id count each and don't fail E by each other.  Of several labels of a doc_id one that says so is enough.
Texts of any length are read whole.  An empty table has no parts, so no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_filters(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A's the lowest."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    few = F.size(words) < 100
    repetitive = 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)
    symbols = text.rlike(r"[#$%&*|]")
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, repetitive, capitals, symbols))), F.lit(0))


def alike(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of a part fail exactly these filters and have these labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        failed_filters(text).alias("fails"),
    )
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    named = read.filter("id IS NOT NULL").join(known, "id", "left").select("id", "part", "digest", "fails", flag("good"), flag("toxic"))
    group = ["digest", "part", "fails", "good", "toxic"]
    by_id = named.groupBy(*group, "id").count()
    by_text = by_id.groupBy(*group).agg(F.min(F.struct("id", "count")).alias("first"), F.sum("count").alias("n"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.id") == smallest, F.col("first.count")).otherwise(F.lit(0))  # those of the smallest doc_id
    both = F.array(
        F.struct(F.col("fails"), F.col("passing").alias("n")),
        F.struct((F.col("fails") + (1 << FILTERS.index("E"))).alias("fails"), (F.col("n") - F.col("passing")).alias("n")),
    )
    split = by_text.withColumn("passing", first).select("part", "good", "toxic", F.explode(both).alias("row")).select("part", "row.fails", "good", "toxic", "row.n")
    nameless = read.filter("id IS NULL").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return split.union(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counted: DataFrame) -> DataFrame:
    """(part, subset, filter, the measures, weighted): sums over the 80 edges; subset has a bit for each filter applied before.

    weighted is removed times the number of orders that pass over the edge.
    """
    n = len(FILTERS)
    every = [(subset, i) for i in range(n) for subset in range(1 << n) if not subset >> i & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(i).alias("place"), F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())).alias("orders")) for s, i in every]))
    seen = counted.withColumn("edge", edge).select("part", "fails", "good", "toxic", "n", "edge.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("place"))
    passed = F.col("fails").bitwiseAND(F.col("subset")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return seen.groupBy("part", "subset", "place").agg(
        count(passed & ~fails).alias("kept"),
        count(passed & fails).alias("removed"),
        count(~passed & fails).alias("redundant"),
        count(F.col("fails") == bit).alias("unique_fails"),
        count(passed & fails & F.col("good")).alias("good_lost"),
        count(passed & fails & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(passed & fails, F.col("n") * F.col("orders")).otherwise(F.lit(0))).alias("weighted"),
    )


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, subset, place): the 600 steps of all orders."""
    rows = [
        ("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k])
        for order in permutations(range(len(FILTERS))) for k in range(len(FILTERS))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, place int")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, the measures, shapley): a row for each part, order and step."""
    summed = edges(alike(docs, labels))
    shapley = F.sum("weighted").over(Window.partitionBy("part", "place")).alias("shapley")  # 16 edges
    each = summed.select("part", "subset", "place", *MEASURES, shapley)
    paths = each.join(F.broadcast(steps(docs.sparkSession)), ["subset", "place"])
    return paths.select("part", "filter_order", "step", *MEASURES, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order of the five filters and step: what is kept and lost there."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return audited(read("documents"), read("labels"))


#: Every document passes through every order, step by step.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs
), failing AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.toxic = 1) AS toxic
  FROM words
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), places AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f,
    '[' || substr(filter_order, 1, CAST(step AS INTEGER) - 1) || '_]' AS before
  FROM orders, range(1, 6) r(step)
), walked AS (
  SELECT part, filter_order, step, f, fails, good, toxic,
    NOT regexp_matches(fails, before) AS there, contains(fails, f) AS bad
  FROM failing, places
), summed AS (
  SELECT part, filter_order, step, f,
    count(*) FILTER (there AND NOT bad) AS kept,
    count(*) FILTER (there AND bad) AS removed,
    count(*) FILTER (NOT there AND bad) AS redundant,
    count(*) FILTER (fails = f) AS unique_fails,
    count(*) FILTER (there AND bad AND good) AS good_lost,
    count(*) FILTER (there AND bad AND toxic) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
