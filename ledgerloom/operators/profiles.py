r"""Projects of markup sources: signals, profiles, compatibility, rules by macro name.

Sources are rows (project, path, text).  Everything found in them leaves its row as small values and is grouped by project;
the rule tables stand in code, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import profile_tables as P
from ledgerloom.operators.rules import penalty_score, routed, rule_table, small

SOURCE_EXTENSIONS = ["tex", "sty", "cls", "ltx"]


def sources_of(files: DataFrame) -> DataFrame:
    """Source files with comments cut: files of other kinds and without text go (FLT8, ST6)."""
    return files.filter(T.extension_is(F.col("path"), SOURCE_EXTENSIONS) & F.col("text").isNotNull()).withColumn("text", T.without_comments(F.col("text")))


def _names(text: Column, command: str, group: int = 2) -> Column:
    r"""Groups of \command[options]{arguments}: 1 the options, 2 the arguments (ST8, ST9)."""
    return F.regexp_extract_all(text, F.lit(r"\\" + command + r"(?![A-Za-z@])\s*(?:\[([^\]]*)\]\s*)?\{([^{}]*)\}"), F.lit(group))


def _listed(arguments: Column) -> Column:
    return F.flatten(F.transform(arguments, T.split_keys))


def signals_of(sources: DataFrame) -> DataFrame:
    r"""sources' (project, path) with (kind, value, line): classes, their options, packages, styles, macros (RL6).

    A macro counts where its name stands, even as the beginning of a longer one (Z21); lines count from 1.
    """
    text = F.col("text")
    compact = F.regexp_replace(text, r"[ \t\n\f\r]", "")
    line_of = lambda what: F.when(F.instr(text, what) > 0, F.regexp_count(F.substring_index(text, what, 1), F.lit("\n")) + 1)
    entry = lambda kind, what: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), line_of(what).cast("long").alias("line"))
    found = F.concat(
        F.transform(_names(text, "documentclass"), entry("documentclass", r"\documentclass")),
        F.transform(_listed(_names(text, "documentclass", 1)), entry("documentclass_option", r"\documentclass")),
        F.transform(_listed(_names(text, "(?:usepackage|RequirePackage)")), entry("package", r"\usepackage")),
        F.transform(_names(text, "bibliographystyle"), entry("bibliographystyle", r"\bibliographystyle")),
        *[
            F.when(
                F.contains(compact, F.lit("\\" + m)),
                F.array(entry("macro", "\\" + m)(F.lit(m)))
            ).otherwise(F.array().cast("array<struct<kind: string, value: string, line: bigint>>")) for m in P.SIGNAL_MACROS
        ],
    )
    return sources.select("project", "path", F.explode(found).alias("s")).select("project", "path", "s.*")


def profile_signals(spark: SparkSession) -> DataFrame:
    """(profile_id, kind, value, weight) of all profiles."""
    return rule_table(spark, [(p, *s) for p, signals in P.SIGNALS.items() for s in signals], "profile_id string, kind string, value string, weight double")


def compatibility_issues(sources: DataFrame, profiles: DataFrame, lenient: frozenset[str] = frozenset()) -> DataFrame:
    r"""(project, code, feature, severity), once for each code and feature (RL7, JN16, AG10, AG11).

    profiles (project, profile_id) says which profile a project has; those without take any class and package.  `lenient`
    names the switches of LENIENT under which an unsupported feature is a warning.
    """
    spark, text = sources.sparkSession, F.col("text")
    kinds = {
        "class": _listed(_names(text, "documentclass")),
        "package": _listed(_names(text, "(?:usepackage|RequirePackage)")),
        "environment": F.regexp_extract_all(text, F.lit(r"\\begin\{([A-Za-z*]+)\}"), F.lit(1))
    }
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("feature"))
    entries = F.concat(*[F.transform(v, entry(k)) for k, v in kinds.items()])
    features = sources.select("project", F.explode(F.array_distinct(entries)).alias("f")).select("project", "f.*").distinct()

    def eased(kind: str, name: str, code: str, severity: str) -> tuple[str, str, str, str]:
        warned = any(name in P.LENIENT[s] and not (s == "minted_package" and kind == "environment") for s in lenient)
        return (kind, name, code.replace("unsupported", "limited"), "W") if warned else (kind, name, code, severity)

    rules = rule_table(spark, [eased(*r) for r in P.ISSUES], "kind string, feature string, code string, severity string")
    general = features.join(rules, ["kind", "feature"])
    own = features.join(profiles.select("project", "profile_id"), "project")
    packages = rule_table(spark, P.PROFILE_PACKAGES, "profile_id string, feature string, severity string")
    by_profile = own.filter("kind = 'package'").join(packages, ["profile_id", "feature"]).withColumn(
        "code",
        F.when(F.col("severity") == "U", "profile_unsupported_package").otherwise("profile_limited_package")
    )
    classes = rule_table(spark, [(p, [c.lower() for c in cs]) for p, cs in P.PROFILE_CLASSES.items()], "profile_id string, classes array<string>")
    refused = [n for k, n, _, _ in P.ISSUES if k == "class"]
    mismatched = own.filter(
        (F.col("kind") == "class") & ~F.col("feature").isin(refused)
    ).join(classes, "profile_id").filter(~F.array_contains("classes", F.lower("feature")))
    mismatched = mismatched.withColumn("code", F.lit("profile_document_class_mismatch")).withColumn("severity", F.lit("W"))
    macros = macro_counts(sources).filter("macros > 0").select(
        "project",
        F.lit("custom_macros").alias("code"),
        F.lit("custom macros").alias("feature"),
        F.lit("W").alias("severity")
    )
    columns = ["project", "code", "feature", "severity"]
    return general.select(columns).union(by_profile.select(columns)).union(mismatched.select(columns)).union(macros).distinct()


def macro_counts(sources: DataFrame) -> DataFrame:
    r"""(project, macros): definitions by \def, \command or \newcommand."""
    found = F.regexp_count("text", F.lit(r"\\(?:def|command|newcommand)(?![A-Za-z])"))
    return sources.groupBy("project").agg(F.sum(found).alias("macros"))


def compatibility_scores(sources: DataFrame, issues: DataFrame) -> DataFrame:
    """(project, unsupported, warnings, macros, score) of every project with sources (AG9)."""
    n = issues.groupBy("project").agg(
        F.count_if(F.col("severity") == "U").alias("unsupported"),
        F.count_if((F.col("severity") == "W") & (F.col("code") != "custom_macros")).alias("w")
    )
    met = macro_counts(sources).join(n, "project", "left").na.fill(0, ["unsupported", "w"])
    return met.select(
        "project",
        "unsupported",
        (F.col("w") + (F.col("macros") > 0).cast("int")).alias("warnings"),
        "macros",
        penalty_score(F.col("unsupported"), F.col("w"), F.col("macros")).alias("score")
    )


def rule_registry(spark: SparkSession, profile_rules: DataFrame | None = None) -> DataFrame:
    """(profile_id, name, output, origin) for each profile with rules of its own and for null, any other profile (RL1, SRC15).

    Of one name the last holds: built-in rules come first, then the journal's, then those of the profile's file,
    `profile_rules` (profile_id, name, semantic, position); unknown semantics are inline text.
    """
    builtin = rule_table(spark, P.builtin_rows(), "name string, output string")
    journal = rule_table(spark, P.journal_rows(), "profile_id string, name string, arity int, output string")
    known = journal.select("profile_id").distinct()
    if profile_rules is not None:
        known = known.union(profile_rules.select("profile_id")).distinct()
    known = known.union(spark.range(1).select(F.lit(None).cast("string").alias("profile_id")))
    rows = known.withColumn("one", F.lit(1)).join(builtin.withColumn("one", F.lit(1)), "one").select(
        "profile_id",
        "name",
        "output",
        F.lit("builtin").alias("origin"),
        F.lit(0).alias("rank"),
        F.lit(0).alias("position")
    )
    rows = rows.union(journal.select("profile_id", "name", "output", F.lit("journal"), F.lit(1), F.lit(0)))
    if profile_rules is not None:
        output = F.lit("InlineText")
        for semantic, o in P.SEMANTICS.items():
            output = F.when(F.col("semantic") == semantic, o).otherwise(output)
        rows = rows.union(profile_rules.select("profile_id", "name", output, F.lit("profile"), F.lit(2), "position"))
    last = Window.partitionBy("profile_id", "name").orderBy(F.desc("rank"), F.desc("position"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("profile_id", "name", "output", "origin")


def macro_of(text: Column) -> Column:
    r"""(name, arity) of a block that is a macro call, null for environments and all else; arity counts the braces that open."""
    t = F.trim(text)
    name = F.regexp_extract(t, r"^\\([A-Za-z]+)", 1)
    arity = F.length(t) - F.length(F.translate(t, "{", ""))
    return F.when((name != "") & (arity > 0) & ~t.startswith(r"\begin{"), F.struct(name.alias("name"), arity.alias("arity")))


def resolved_fallbacks(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """blocks (…, profile_id, kind, text) with kind replaced for raw fallbacks that a rule makes a block of, and decision (RL5, RL2, RL4, JN15).

    Blocks of other kinds pass as they are.  A raw block's macro is looked up in its profile's rules, or in those of any
    other profile if that has none; a miss is audited as Fallback and stays raw, as does a hit that makes no block.
    """
    raw = F.col("kind") == "raw"
    profiles = small(registry.select(F.col("profile_id").alias("__p")).filter("__p IS NOT NULL").distinct())
    met = blocks.filter(raw).withColumn("__m", macro_of(F.col("text"))).join(profiles, F.col("profile_id") == F.col("__p"), "left")
    rules = small(registry.select(F.col("profile_id").alias("__q"), F.col("name").alias("__n"), F.col("output").alias("__o")))
    met = met.join(rules, F.col("__p").eqNullSafe(F.col("__q")) & (F.col("__m.name") == F.col("__n")), "left")
    made = met.withColumn("decision", F.when(F.col("__o").isNotNull(), "Loaded").when(F.col("__m").isNotNull() | F.trim("text").startswith(r"\begin{"), "Fallback"))
    made = made.withColumn("kind", F.coalesce(routed(F.col("__o")), F.lit("raw")))
    columns = [c for c in blocks.columns if c != "kind"] + ["kind", "decision"]
    return made.select(columns).union(blocks.filter(~raw | raw.isNull()).withColumn("decision", F.lit(None).cast("string")).select(columns))


def rule_usage(registry: DataFrame, resolved: DataFrame) -> DataFrame:
    """(profile_id, builtin_rules, journal_rules, profile_rules, unknown_macros): rules by origin, and distinct macros without one (AG15, SE3, Z7 corrected)."""
    of = lambda o: F.count_if(F.col("origin") == o).alias(f"{o}_rules")
    rules = registry.filter("profile_id IS NOT NULL").groupBy("profile_id").agg(of("builtin"), of("journal"), of("profile"))
    unknown = resolved.filter("decision = 'Fallback'").select("profile_id", macro_of(F.col("text"))["name"].alias("name")).groupBy("profile_id").agg(F.count_distinct("name").alias("unknown_macros"))
    return rules.join(unknown, "profile_id", "left").na.fill(0, ["unknown_macros"])


def known_profiles(files: DataFrame) -> DataFrame:
    """(id, path, min_confidence) of profile files (path, text: JSON): of one id the file with the largest path holds (SRC14)."""
    spec = F.from_json("text", "id string, aliases array<string>, detection struct<min_confidence: double>", {"mode": "FAILFAST"})
    rows = files.select("path", spec.alias("s")).filter(F.col("s.id").isNotNull())
    last = rows.groupBy(F.col("s.id").alias("id")).agg(F.max_by("s", "path").alias("s"), F.max("path").alias("path"))
    return last.select(
        "id",
        "path",
        F.col("s.detection.min_confidence").alias("min_confidence"),
        F.coalesce("s.aliases", F.array().cast("array<string>")).alias("aliases")
    )
