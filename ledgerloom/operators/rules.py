"""Rules, detection and gates: lookups in small rule tables, weighted scores, penalties, checks, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.sequences import ambiguity, last_occurrence


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table written in code; its size is that of the code, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows, which is counted first; else as it is, for a join of any size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def registry(rules: DataFrame) -> DataFrame:
    """Rules (name, priority, position, output): of one name the last by priority and position holds (RL1, SRC15)."""
    return last_occurrence(rules, ["name"], ["priority", "position"])


def applied(rows: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """rows with output, source and accepted: what the rule of that name says, else a fallback to inline text (RL2, JN15)."""
    met = rows.join(small(rules.select(F.col("name").alias("__n"), F.col("output").alias("__o"))), F.col(name) == F.col("__n"), "left")
    hit = F.col("__n").isNotNull()
    return met.withColumn("output", F.coalesce("__o", F.lit("InlineText"))).withColumn("source", F.when(hit, "Loaded").otherwise("Fallback")).withColumn("accepted", hit).drop("__n", "__o")


def mapped(blocks: DataFrame, kind: str, rules: DataFrame) -> DataFrame:
    """blocks with (rule_id, element, diagnostic): by the first rule (kind, rule_id, element, position) of their kind, else map.missing to w:p with a diagnostic (JN14)."""
    first = rules.groupBy(F.col("kind").alias("__k")).agg(F.min_by(F.struct("rule_id", "element"), "position").alias("__r"))
    met = blocks.join(small(first), F.col(kind) == F.col("__k"), "left")
    missing = F.when(F.col("__r").isNull(), F.concat(F.lit("no mapping rule for "), F.coalesce(F.col(kind), F.lit("null"))))
    return met.withColumns(
        {"rule_id": F.coalesce("__r.rule_id", F.lit("map.missing")), "element": F.coalesce("__r.element", F.lit("w:p")), "diagnostic": missing}
    ).drop("__k", "__r")


def routed(output: Column) -> Column:
    """The block an output becomes; null where the raw fallback stays (RL4)."""
    return F.when(output == "Heading", "heading").when(
        output.isin("Paragraph", "Citation", "MetadataField", "AuthorList", "Affiliation", "KeywordList"),
        "paragraph"
    ).when(output == "Verbatim", "raw")


def weighted_scores(signals: DataFrame, keys: list[str], profiles: DataFrame) -> DataFrame:
    """(keys, profile_id, confidence): weights of matched signals (kind, value), at most 1 (JN11, AG8).

    Values match whatever their case, but count once for each spelling (Z6).
    """
    own = signals.select(*keys, "kind", "value").distinct()
    met = own.join(
        small(profiles.select("profile_id", F.col("kind").alias("__k"), F.lower("value").alias("__v"), "weight")),
        (F.col("kind") == F.col("__k")) & (F.lower("value") == F.col("__v"))
    )
    return met.groupBy(*keys, "profile_id").agg(F.least(F.round(F.sum("weight"), 6), F.lit(1.0)).alias("confidence"))


def detected(scores: DataFrame, keys: list[str], least: DataFrame, default: str = "generic") -> DataFrame:
    """The best profile of each group that reaches its own least confidence, else the default; ties go to the smaller id (SO5, Z5)."""
    sure = scores.join(small(least), "profile_id").filter(F.col("confidence") >= F.col("min_confidence"))
    picked = sure.groupBy(*keys).agg(F.min_by("profile_id", F.struct(-F.col("confidence"), "profile_id")).alias("picked"))
    top = ambiguity(scores, keys, "confidence", "profile_id")
    return top.join(picked, keys, "left").withColumn("picked", F.coalesce("picked", F.lit(default)))


def penalty_score(unsupported: Column, warnings: Column, macros: Column) -> Column:
    """100 less 18 for each unsupported feature, 6 a warning, 2 a macro up to 12; custom macros are one more warning (AG9)."""
    w = warnings + F.when(macros > 0, 1).otherwise(0)
    return (100 - F.least(F.lit(100), 18 * unsupported + 6 * w + F.least(F.lit(12), 2 * macros))).cast("long")


def checks(df: DataFrame, keys: list[str], named: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row for each check (name, severity, passed) of each row; null counts as failed (Q9, Q13)."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(c, F.lit(False)).alias("passed")) for n, (s, c) in named.items()])
    return df.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def gate(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Failed if an error check fails, PassedWithWarnings if a warning does; the exit code is 1 or 0 (Q13; layers of checks have codes of their own, quality.exit_codes)."""
    fails = lambda s: F.count_if((F.col("severity") == s) & ~F.col("passed"))
    n = checked.groupBy(*keys).agg(fails("error").alias("errors"), fails("warning").alias("warnings"), F.count("*").alias("total"))
    status = F.when(F.col("errors") > 0, "Failed").when(F.col("warnings") > 0, "PassedWithWarnings").otherwise("Passed")
    return n.select(
        *keys,
        status.alias("status"),
        (F.col("total") - F.col("errors")).alias("passed_checks"),
        F.when(F.col("errors") > 0, 1).otherwise(0).alias("exit_code")
    )


def grade(whole: Column, exit_code: Column, size: Column, paragraphs: Column, residue: Column, score: Column, unresolved: Column) -> Column:
    """The ladder of grades, first match wins (Q14)."""
    return (
        F.when(~whole, "F").when(exit_code != 0, "D").when((size < 20480) | (paragraphs < 20), "D").when(residue > 80, "D").when((score < 60) | (residue > 25), "C").when(unresolved > 20, "C").when((score >= 80) & (residue <= 5) & (unresolved == 0), "A").otherwise("B")
    )


def issues(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in order."""
    return F.filter(F.array(*[F.when(c, n) for n, c in flags.items()]), lambda x: x.isNotNull())


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; 255 if their sizes differ (AG18)."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 255.0).when(F.size(a) == 0, 0.0).otherwise(total / F.size(a))


def ssim(a: Column, b: Column, top: float = 255.0) -> Column:
    """Global structural similarity of two arrays by population moments, within 0 and 1 (AG17, Q11)."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = F.size(a).cast("double")
    ma, mb = total(a) / n, total(b) / n
    va, vb = total(F.transform(a, lambda x: x * x)) / n - ma * ma, total(F.transform(b, lambda x: x * x)) / n - mb * mb
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    below = (ma * ma + mb * mb + c1) * (va + vb + c2)
    return F.when(below == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 * ma * mb + c1) * (2 * cov + c2) / below)))


def folded_kind(kind: Column, identity: str = "Text", mixed: str = "Mixed") -> Column:
    """Aggregate: the one kind besides the identity, Mixed if there are more, the identity if there is none (AG19)."""
    other = F.when(kind != identity, kind)
    return F.when(F.count(other) == 0, identity).when(F.min(other) != F.max(other), mixed).otherwise(F.min(other))
