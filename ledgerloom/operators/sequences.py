"""Ordered computation within groups: numbering, islands, ranges, first and last occurrences, alignment of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], signature: list[str]) -> DataFrame:
    """df with `island`: the number of the run of equal signatures a row belongs to in its group (WN5, WN6)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    s = F.struct(*signature)
    return df.withColumn("__new", F.when(F.lag(s).over(w).eqNullSafe(s), 0).otherwise(1)).withColumn("island", F.sum("__new").over(w)).drop("__new")


def merged_runs(df: DataFrame, keys: list[str], order: list[str], signature: list[str], **aggregates: Column) -> DataFrame:
    """One row for each run of equal signatures."""
    return islands(df, keys, order, signature).groupBy(*keys, "island", *signature).agg(*[c.alias(n) for n, c in aggregates.items()])


def ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Each group's integers as ranges `1-3,5` (WN7), runs found by a window and written in order."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = df.select(*keys, number).distinct().withColumn("__run", F.col(number) - F.row_number().over(w)).groupBy(*keys, "__run").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("__r")).select(
        *keys,
        F.array_join(F.transform("__r", lambda r: r["t"]), ",").alias("ranges")
    )


def running_numbers(df: DataFrame, keys: list[str], order: list[str], kind: str, equation: str = "equation") -> DataFrame:
    """df with `number`: the running number of a row among its kind; `(n)` for equations, null for a null kind (WN1)."""
    n = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order)).cast("string")
    return df.withColumn("number", F.when(F.col(kind).isNull(), None).when(F.col(kind) == equation, F.concat(F.lit("("), n, F.lit(")"))).otherwise(n))


def heading_numbers(df: DataFrame, keys: list[str], order: list[str], level: str, depth: int = 4) -> DataFrame:
    """df with `number` 1, 1.1, 1.1.1: a heading counts within the headings above it (WN2)."""
    names = []
    for k in range(1, depth + 1):
        # counted since the last heading of each higher level: those counters partition the rows
        w = Window.partitionBy(*keys, *names).orderBy(*order)
        df = df.withColumn(f"__l{k}", F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(w))
        names.append(f"__l{k}")
    number = F.array_join(F.slice(F.array(*[F.col(n).cast("string") for n in names]), 1, F.col(level)), ".")
    return df.withColumn("number", number).drop(*names)


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the first stays (WN3)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def last_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last stays (WN4)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def ambiguity(df: DataFrame, keys: list[str], confidence: str, tie: str, gap: float = 0.05, least: float = 0.3) -> DataFrame:
    """The best candidate of each group, and whether the second is too near (WN13, SO5)."""
    top = Window.partitionBy(*keys).orderBy(F.desc(confidence), tie)
    ranked = df.withColumn("__n", F.row_number().over(top)).filter("__n <= 2")
    both = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("__n") == 1, F.col(tie))).alias(tie),
        F.max(F.when(F.col("__n") == 1, F.col(confidence))).alias(confidence),
        F.max(F.when(F.col("__n") == 2, F.col(confidence))).alias("__second")
    )
    return both.withColumn("ambiguous", F.coalesce((F.abs(F.col(confidence) - F.col("__second")) < gap) & (F.col(confidence) > least), F.lit(False))).drop("__second")


def carried_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, span, text) with `covered`: whether a cell of an earlier row reaches down to its place (WN10).

    A cell of span n covers its column in the n - 1 rows below; spans are exploded, so no table is held in one place.
    """
    reach = cells.filter("span > 1").select(
        *keys,
        "col",
        F.explode(F.sequence(F.col("row") + 1, F.col("row") + F.col("span") - 1)).alias("row")
    ).distinct().withColumn("__hit", F.lit(True))
    return cells.join(reach, [*keys, "row", "col"], "left").withColumn("covered", F.coalesce("__hit", F.lit(False))).drop("__hit")


def logical_width(span: Column) -> Column:
    """Aggregate: a row's cells' spans, of at least one each, summed; at least one (AG24)."""
    return F.greatest(F.coalesce(F.sum(F.greatest(span, F.lit(1))), F.lit(0)), F.lit(1)).cast("long")
