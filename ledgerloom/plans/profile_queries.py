"""Queries over projects of markup sources, written around the parts: a project a size, a file a part.

The SQL works on the numbers the sources are written from, so that it does not repeat how they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import profile_tables as P
from ledgerloom.operators import profiles as R
from ledgerloom.operators.rules import detected, weighted_scores
from ledgerloom.plans.registry import query, table

CLASSES = "article IEEEtran acl nature springer beamer ctexart rjthesis elsarticle llncs ieeetran".split()
OPTIONS = "conference journal aclang 10pt".split()
PACKAGES = "amsmath tikz biblatex minted listings algorithm2e tabularx longtable natbib pstricks subcaption ctex xeCJK".split()
ENVIRONMENTS = "equation tikzpicture minted lstlisting figure".split()
MACROS = "IEEEkeywords cvprfinalcopy aclfinalcopy corres affiliation institute unknownmacro".split()
PROFILE_IDS = "jos-paper tacl cvpr nature springer chinese-academic medical-journal generic".split()


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    packages = F.concat_ws(",  ", _pick(PACKAGES, k % 13), _pick(PACKAGES, F.floor(k / 7) % 13))
    text = F.concat(
        F.lit("% \\usepackage{pstricks}\n\\documentclass"), F.when(
            k % 3 != 0,
            F.concat(F.lit("["), _pick(OPTIONS, k % 4), F.lit(", twoside]"))
        ).otherwise(""), F.lit("{"), _pick(CLASSES, k % 11),
        F.lit("}\n\\usepackage[x]{"), packages, F.lit("} % and \\begin{minted}\n"), F.when(k % 5 == 0, F.lit("\\newcommand{\\a}{b}\\def\\c{50\\% d}\n")).otherwise(""),
        F.lit("\\"), _pick(MACROS, k % 7), F.lit("{x}\\begin{"), _pick(ENVIRONMENTS, F.floor(k / 3) % 5), F.lit("}\n\\bibliographystyle{"), F.when(k % 2 == 0, "naturemag").otherwise("plain"), F.lit("}\n"),
    )
    extension = _pick([".tex", ".STY", ".png", ".ltx"], k % 4)
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("project"), F.concat(F.lit("src/"), k, extension).alias("path"), text.alias("text"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("project")).distinct().withColumn("profile_id", _pick(PROFILE_IDS, F.col("project") % 8))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v) + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_FILES_SQL = f"""f AS (SELECT p_partkey AS k, p_size::BIGINT AS project, {_sql_list(PROFILE_IDS)}[p_size % 8 + 1] AS profile_id FROM part),
src AS (SELECT *, {_sql_list(CLASSES)}[k % 11 + 1] AS class, [{_sql_list(PACKAGES)}[k % 13 + 1], {_sql_list(PACKAGES)}[k // 7 % 13 + 1]] AS packages, {_sql_list(ENVIRONMENTS)}[k // 3 % 5 + 1] AS environment, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS macros FROM f WHERE k % 4 <> 2)"""
_ISSUES_SQL = f"""{_FILES_SQL}, feats AS (SELECT DISTINCT project, profile_id, 'class' AS kind, class AS feature FROM src UNION SELECT project, profile_id, 'package', unnest(packages) FROM src UNION SELECT project, profile_id, 'environment', environment FROM src),
iss AS (SELECT project, code, f.feature, severity FROM feats f JOIN (VALUES {_values(P.ISSUES)}) i(kind, feature, code, severity) ON f.kind = i.kind AND f.feature = i.feature
UNION SELECT project, CASE severity WHEN 'U' THEN 'profile_unsupported_package' ELSE 'profile_limited_package' END, f.feature, severity FROM feats f JOIN (VALUES {_values(P.PROFILE_PACKAGES)}) p(profile_id, feature, severity) ON f.profile_id = p.profile_id AND f.feature = p.feature WHERE kind = 'package'
UNION SELECT project, 'profile_document_class_mismatch', feature, 'W' FROM feats f WHERE kind = 'class' AND feature NOT IN ('beamer', 'standalone') AND profile_id IN (SELECT p FROM (VALUES {_values([(p,) for p in P.PROFILE_CLASSES])}) t(p))
  AND NOT EXISTS (SELECT 1 FROM (VALUES {_values([(p, c) for p, cs in P.PROFILE_CLASSES.items() for c in cs])}) c(p, c) WHERE c.p = f.profile_id AND lower(c.c) = lower(f.feature))
UNION SELECT project, 'custom_macros', 'custom macros', 'W' FROM src WHERE macros > 0)"""


@query(f"WITH {_ISSUES_SQL} SELECT * FROM iss")
def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile can't carry over of each project, once for each code and feature (RL7, JN16, AG10, AG11, FLT8, ST6)."""
    return R.compatibility_issues(R.sources_of(_files(spark, sf_dir)), _profiles(spark, sf_dir))


@query(f"""WITH {_ISSUES_SQL}, n AS (SELECT s.project, m, coalesce(u, 0) AS u, coalesce(w, 0) AS w FROM (SELECT project, sum(macros) AS m FROM src GROUP BY project) s
LEFT JOIN (SELECT project, count(*) FILTER (severity = 'U') AS u, count(*) FILTER (severity = 'W') AS w FROM iss GROUP BY project) i ON i.project = s.project)
SELECT project, u::BIGINT AS unsupported, w::BIGINT AS warnings, m::BIGINT AS macros, greatest(0, 100 - 18 * u - 6 * w - least(12, 2 * m))::BIGINT AS score FROM n""")
def project_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each project (AG9)."""
    sources = R.sources_of(_files(spark, sf_dir))
    return R.compatibility_scores(sources, R.compatibility_issues(sources, _profiles(spark, sf_dir)))


_SIGNALS_SQL = f"""{_FILES_SQL}, sig AS (SELECT project, 'documentclass' AS kind, class AS value FROM src UNION SELECT project, 'documentclass_option', unnest([{_sql_list(OPTIONS)}[k % 4 + 1], 'twoside']) FROM src WHERE k % 3 <> 0
UNION SELECT project, 'package', unnest(packages) FROM src UNION SELECT project, 'bibliographystyle', CASE WHEN k % 2 = 0 THEN 'naturemag' ELSE 'plain' END FROM src
UNION SELECT project, 'macro', m FROM src JOIN (VALUES {_values([(m,) for m in P.SIGNAL_MACROS])}) t(m) ON starts_with({_sql_list(MACROS)}[k % 7 + 1], m))"""


@query(f"WITH {_SIGNALS_SQL} SELECT project, kind, value FROM sig")
def project_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each project; a macro's name also counts as the beginning of another (RL6, ST9, Z21)."""
    return R.signals_of(R.sources_of(_files(spark, sf_dir))).select("project", "kind", "value").distinct()


@query(f"""WITH {_SIGNALS_SQL}, w(profile_id, kind, value, weight) AS (VALUES {_values([(p, *s) for p, ss in P.SIGNALS.items() for s in ss])}),
c AS (SELECT project, profile_id, least(round(sum(weight), 6), 1.0)::DOUBLE AS confidence FROM sig JOIN w ON sig.kind = w.kind AND lower(sig.value) = lower(w.value) GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS n, lead(confidence) OVER o AS second FROM c WINDOW o AS (PARTITION BY project ORDER BY confidence DESC, profile_id)),
k AS (SELECT project, arg_min(profile_id, n) AS picked FROM r WHERE confidence >= {P.MIN_CONFIDENCE} GROUP BY project)
SELECT r.project, profile_id, confidence, coalesce(abs(confidence - second) < 0.05 AND confidence > 0.3, false) AS ambiguous, coalesce(picked, 'generic-article') AS picked FROM r LEFT JOIN k ON k.project = r.project WHERE n = 1""")
def project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile each project's signals speak for (RL6, JN11, AG8, SO5, WN13, Z6, Z22: generic where none is sure)."""
    signals = R.signals_of(R.sources_of(_files(spark, sf_dir))).select("project", "kind", "value")
    least = R.rule_table(spark, [(p, P.MIN_CONFIDENCE) for p in P.SIGNALS], "profile_id string, min_confidence double")
    return detected(weighted_scores(signals, ["project"], R.profile_signals(spark)), ["project"], least, default="generic-article")


#: profile_id, name, semantic, position: rules a profile's file adds, the last of a name holds
FILE_RULES = [
    ("nature", "maketitle", "metadata", 0),
    ("nature", "textbf", "heading", 1),
    ("nature", "textbf", "paragraph", 2),
    ("tacl", "oddity", "strange", 0),
    ("medical-journal", "abstractx", "paragraph", 0)
]
_REGISTRY_SQL = f"""file(profile_id, name, semantic, pos) AS (VALUES {_values(FILE_RULES)}), journal(profile_id, name, output) AS (VALUES {_values([(p, n, o) for p, n, _, o in P.journal_rows()])}),
builtin(name, output) AS (SELECT DISTINCT * FROM (VALUES {_values(P.builtin_rows())})), sem(semantic, output) AS (VALUES {_values(list(P.SEMANTICS.items()))}), ids AS (SELECT profile_id FROM file UNION SELECT profile_id FROM journal UNION SELECT NULL),
allr AS (SELECT profile_id, name, output, 'builtin' AS origin, 0 AS rank FROM ids, builtin UNION ALL SELECT *, 'journal', 1 FROM journal UNION ALL SELECT profile_id, name, coalesce(output, 'InlineText'), 'profile', 2 + pos FROM file LEFT JOIN sem ON file.semantic = sem.semantic),
reg AS (SELECT profile_id, name, arg_max(output, rank) AS output, arg_max(origin, rank) AS origin FROM allr GROUP BY profile_id, name)"""


def _registry(spark: SparkSession) -> DataFrame:
    return R.rule_registry(spark, R.rule_table(spark, FILE_RULES, "profile_id string, name string, semantic string, position int"))


@query(f"WITH {_REGISTRY_SQL} SELECT coalesce(profile_id, '-') AS profile_id, name, output, origin FROM reg")
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules each profile ends up with (RL1, SRC15, WN4)."""
    return _registry(spark).withColumn("profile_id", F.coalesce("profile_id", F.lit("-")))


NAMES = "citet textbf quad paragraph maketitle affil keywords oddity zhabstract strangeone footnotemark begin".split()
def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.when(F.col("event_type") == "view", "paragraph").otherwise("raw")
    call = F.concat(F.lit(" \\"), _pick(NAMES, e % 12), F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("{"), F.col("event_type"), F.lit("}"))))
    return table(spark, sf_dir, "events").select(
        "event_id",
        _pick([*PROFILE_IDS, "unheard-of"], F.col("user_id") % 9).alias("profile_id"),
        kind.alias("kind"),
        call.alias("text")
    )


_BLOCKS_SQL = f"""{_REGISTRY_SQL}, b AS (SELECT event_id, {_sql_list([*PROFILE_IDS, "unheard-of"])}[user_id % 9 + 1] AS profile_id, event_type = 'view' AS done, {_sql_list(NAMES)}[event_id % 12 + 1] AS name, event_id % 5 <> 0 AS called FROM events),
m AS (SELECT b.*, r.output FROM b LEFT JOIN ids i ON i.profile_id = b.profile_id LEFT JOIN reg r ON r.profile_id IS NOT DISTINCT FROM i.profile_id AND r.name = b.name AND NOT done AND called AND b.name <> 'begin'),
d AS (SELECT event_id, profile_id, name, CASE WHEN done THEN 'paragraph' WHEN output = 'Heading' THEN 'heading' WHEN output IN ('Paragraph', 'Citation', 'MetadataField', 'AuthorList', 'Affiliation', 'KeywordList') THEN 'paragraph' ELSE 'raw' END AS kind,
CASE WHEN output IS NOT NULL THEN 'Loaded' WHEN NOT done AND called THEN 'Fallback' END AS decision FROM m)"""


@query(f"WITH {_BLOCKS_SQL} SELECT profile_id, kind, coalesce(decision, '-') AS decision, count(*) AS n, sum(event_id)::BIGINT AS ids FROM d GROUP BY ALL")
def fallbacks_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks that rules make paragraphs or headings of, all others as they are (RL5, RL2, RL4, JN14, JN15)."""
    done = R.resolved_fallbacks(_blocks(spark, sf_dir), _registry(spark)).withColumn("decision", F.coalesce("decision", F.lit("-")))
    return done.groupBy("profile_id", "kind", "decision").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""WITH {_BLOCKS_SQL} SELECT g.profile_id, count(*) FILTER (origin = 'builtin') AS builtin_rules, count(*) FILTER (origin = 'journal') AS journal_rules, count(*) FILTER (origin = 'profile') AS profile_rules,
(SELECT count(DISTINCT name) FROM d WHERE d.profile_id = g.profile_id AND decision = 'Fallback' AND name <> 'begin') AS unknown_macros FROM reg g WHERE g.profile_id IS NOT NULL GROUP BY g.profile_id""")
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by where they come from, and macros without one (AG15, SE3, Z7)."""
    registry = _registry(spark)
    return R.rule_usage(registry, R.resolved_fallbacks(_blocks(spark, sf_dir), registry))
