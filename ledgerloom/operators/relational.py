"""Reporting over business tables: joins with conditions, conditional sums, snapshots after writes, paging.

Groups are formed with aggregates that combine before the shuffle, so that a hot key costs one row a task; windows stand
only where an order within the group is the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_counts(left: DataFrame, right: DataFrame, key: str, item: str, on: Column | None = None) -> DataFrame:
    """left's keys with n (matching rows of right, 0 without any) and latest (largest item); `on` narrows right without losing left rows."""
    narrowed = right if on is None else right.filter(on)  # a condition on right in ON is a filter below the join
    counts = narrowed.groupBy(key).agg(F.count(item).alias("n"), F.max(item).alias("latest"))
    return left.select(key).distinct().join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def signed_sum(kind: Column, quantity: Column, plus: str, minus: str) -> Column:
    """Sum of quantities, negative for `minus` kinds, 0 for all but `plus`; never below 0, also of no rows."""
    return F.greatest(F.coalesce(F.sum(F.when(kind == plus, quantity).when(kind == minus, -quantity).otherwise(F.lit(0))), F.lit(0)), F.lit(0)).cast("long")


def with_fallback(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, used): first's value where it has rows, else second's."""
    a, b = first.select(key, F.col(value).alias("__a"), F.lit(1).alias("__f")), second.select(key, F.col(value).alias("__b"))
    both = a.join(b, key, "full")
    return both.select(
        key,
        F.when(F.col("__f") == 1, F.col("__a")).otherwise(F.col("__b")).alias(value),
        F.when(F.col("__f") == 1, "first").otherwise("second").alias("used")
    )


def best_per_group(df: DataFrame, keys: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """The row of each group with the largest (or smallest) order columns, which should end in a unique one."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    best = df.groupBy(*keys).agg((F.max(row) if largest else F.min(row)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def nth_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n-th row of each group in `order` (Spark keeps n rows a group before it shuffles)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") == n).drop("__n")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page `number` (from 1) of at most 100 rows; `order` should end in a unique column."""
    size = max(1, min(size, 100))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def filtered(df: DataFrame, conditions: dict[str, object | None]) -> DataFrame:
    """Equality filters for those values that aren't None."""
    return reduce(lambda d, c: d.filter(F.col(c[0]) == F.lit(c[1])), [(k, v) for k, v in conditions.items() if v is not None], df)


def upserted(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with delta's rows instead of those with the same key, and its new ones."""
    columns = [c for c in base.columns if c != key]
    both = base.select(key, F.struct(*columns).alias("__old")).join(delta.select(key, F.struct(*columns).alias("__new")), key, "full")
    return both.select(key, F.coalesce("__new", "__old").alias("__row")).select(key, "__row.*")


def added(base: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """Balances after additive upserts."""
    return base.select(key, value).union(delta.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def extended(until: Column, now: Column, days: Column) -> Column:
    """An expiry extended by days from where it stands, or from now if it has passed or there is none."""
    return F.greatest(F.coalesce(until, now), now) + F.make_dt_interval(days)


def patched(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """base with patches' values wherever they aren't null."""
    columns = [c for c in patches.columns if c != key]
    met = base.join(patches.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def got_or_created(wanted: DataFrame, existing: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A row of existing for each wanted key; those missing get the defaults."""
    met = wanted.select(key).distinct().join(existing.withColumn("__there", F.lit(True)), key, "left")
    return met.select(key, *[F.when(F.col("__there"), F.col(c)).otherwise(v).alias(c) for c, v in defaults.items()])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def optional_filters(df: DataFrame, equal: dict[str, object], time: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """df filtered by the values and bounds that are given, both bounds included, compared as timestamps (FLT7, Z2 corrected)."""
    for column, wanted in equal.items():
        if wanted is not None:
            df = df.filter(F.col(column) == F.lit(wanted))
    at = F.col(time).cast("timestamp_ntz")
    if since is not None:
        df = df.filter(at >= F.lit(since).cast("timestamp_ntz"))
    return df if until is None else df.filter(at <= F.lit(until).cast("timestamp_ntz"))


def code_expired(until: Column, now: Column) -> Column:
    """Whether a code can't be redeemed any more: its end lies before now; without an end it never does (Z15)."""
    return F.coalesce(until < now, F.lit(False))


def entitled(until: Column, now: Column) -> Column:
    """Whether an entitlement holds: up to and including its end, or without one (Z15)."""
    return F.coalesce(until >= now, F.lit(True))
