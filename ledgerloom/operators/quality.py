"""Quality of converted documents: counts of their parts, layers of checks against thresholds, coverage, gates, traceability.

A document is a row of metrics; checks come out in long form, a row each: (keys, layer, name, severity, passed).  Null
metrics fail their checks.  XML is read by patterns inside the row, so nothing but counts leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.rules import checks

# fixed values: thresholds of the layers
THRESHOLDS = {
    "tables": 5,
    "images": 8,
    "captions": 6,
    "char_ratio": 0.75,
    "page_width": 10433,
    "page_height": 14742,
    "pdf_bytes": 5 * 1024 * 1024,
    "fonts": 2,
    "markers": 1.0,
    "sections": 1.0,
    "ssim": 0.95,
    "pixel_diff": 3.0,
    "page_tolerance": 0.20,
    "paragraphs_a_page": 6
}
#: Labels a paper has in all its forms; titles and addresses of a paper at hand come with the call.
MARKERS = ["摘要", "关键词", "Abstract", "Key words", "表 1", "表 5", "图 1", "图 8", "算法 1", "References"]
SECTIONS = ["1 引言", "2 相关工作", "3 系统总体设计", "4 关键算法", "5 系统实现", "6 实验与分析", "7 结束语"]


def _count(xml: Column, pattern: str) -> Column:
    return F.regexp_count(xml, F.lit(pattern)).cast("long")


def _attribute(xml: Column, tag: str, name: str) -> Column:
    found = F.regexp_extract(xml, rf'<w:{tag}\b[^>]*\bw:{name}="([^"]*)"', 1)
    return F.when(found != "", found)


def part_metrics(document: Column, styles: Column) -> dict[str, Column]:
    """Metrics of a document's main part and its styles (AG16, AG22, Q9, Q15).

    Elements, captions of tables and how many stay with what follows, page, margins and columns, fonts and borders,
    rows that may not be split, superscripts, and the indent of the style `Reference`.
    """
    paragraphs = F.regexp_extract_all(document, F.lit(r"(?s)<w:p(?:\s[^>]*)?>.*?</w:p>"), F.lit(0))
    tables = F.regexp_extract_all(document, F.lit(r"(?s)<w:tbl>.*?</w:tbl>"), F.lit(0))
    caption = lambda p: p.rlike(r'<w:pStyle w:val="[^"]*Caption"')
    of = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    border = lambda side, kind: lambda t: t.rlike(rf'(?s)<w:tblBorders>.*?<w:{side} [^>]*w:val="{kind}"')
    reference = F.regexp_extract(styles, r'(?s)<w:style [^>]*w:styleId="Reference".*?</w:style>', 0)
    return {
        "tables": _count(document, r"<w:tbl>"), "images": _count(document, r"<w:drawing[ />]"), "paragraphs": F.size(paragraphs).cast("long"),
        "captions": of(paragraphs, caption), "captions_kept": of(paragraphs, lambda p: caption(p) & F.contains(p, F.lit("<w:keepNext/>"))),
        "images_kept": of(
            paragraphs,
            lambda p: F.contains(p, F.lit("<w:drawing")) & F.contains(p, F.lit("<w:keepNext/>"))
        ), "kept_with_next": _count(document, r"<w:keepNext/>"),
        "inside_rules": of(tables, border("insideV", "single")), "open_sides": of(tables, lambda t: border("left", "nil")(t) & border("right", "nil")(t)),
        "rows": _count(document, r"<w:tr[ >]"), "rows_whole": _count(document, r"<w:cantSplit/>"),
        "fonts": F.size(F.array_distinct(F.regexp_extract_all(document, F.lit(r'<w:rFonts [^>]*w:ascii="([^"]*)"'), F.lit(1)))).cast("long"),
        "superscripts": _count(document, r'<w:vertAlign w:val="superscript"/>'), "leaked_markup": _count(document, r"\\[A-Za-z]+|\[[htbp!]+\]"),
        "page_width": _attribute(document, "pgSz", "w").try_cast("long"), "page_height": _attribute(document, "pgSz", "h").try_cast("long"),
        "margins": F.regexp_count(
            F.regexp_extract(document, r"<w:pgMar\b[^>]*", 0),
            F.lit(r'w:(?:top|bottom|left|right)="[1-9]')
        ).cast("long"), "columns": F.coalesce(_attribute(document, "cols", "num").try_cast("long"), F.lit(1)),
        "reference_left": _attribute(reference, "ind", "left").try_cast("long"), "reference_hanging": _attribute(reference, "ind", "hanging").try_cast("long"),
    }


def structural_layer(metrics: DataFrame, keys: list[str], t: dict = THRESHOLDS) -> DataFrame:
    """Checks of a document's parts (Q9); `docx_chars` and `oracle_chars` are lengths of normal forms (ST1)."""
    c = F.col
    ratio = F.when(c("oracle_chars") == 0, 0.0).otherwise(c("docx_chars") / c("oracle_chars"))
    named = {
        "tables": ("critical", c("tables") >= t["tables"]), "images": ("critical", c("images") == t["images"]), "captions": ("major", c("captions") >= t["captions"]),
        "page_size": (
            "critical",
            (c("page_width") == t["page_width"]) & (c("page_height") == t["page_height"])
        ), "margins": ("major", c("margins") == 4), "columns": ("major", c("columns") == 1),
        "reference_indent": ("major", (c("reference_left") == 420) & (c("reference_hanging") == 420)), "char_ratio": ("major", ratio >= t["char_ratio"]),
    }
    return checks(metrics, keys, named).withColumn("layer", F.lit("structural"))


def extended_layer(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Further checks of a document's parts that all of a kind have what they should (Q15)."""
    c = F.col
    all_of = lambda n, total: (c(total) > 0) & (c(n) == c(total))
    named = {
        "captions_stay_with_tables": ("major", all_of("captions_kept", "captions")), "images_stay_with_captions": ("major", all_of("images_kept", "images")), "rows_not_split": ("major", all_of("rows_whole", "rows")),
        "table_rules": ("major", all_of("inside_rules", "tables")), "table_sides_open": ("major", all_of("open_sides", "tables")), "superscripts": ("major", c("superscripts") > 0), "no_leaked_markup": ("critical", c("leaked_markup") == 0),
        "fonts": ("major", c("fonts") >= THRESHOLDS["fonts"]),
    }
    return checks(metrics, keys, named).withColumn("layer", F.lit("structural"))


def pdf_layer(metrics: DataFrame, keys: list[str], t: dict = THRESHOLDS) -> DataFrame:
    """Checks of a print (pages, paragraphs, pdf_bytes, fonts, has_unicode); pages may be off by a fifth of what the paragraphs take (Q10, MA3)."""
    c = F.col
    expected = F.greatest(c("paragraphs") / t["paragraphs_a_page"], F.lit(1.0))
    named = {
        "pages": ("major", F.abs(c("pages") - expected) / expected <= t["page_tolerance"]),
        "size": ("major", c("pdf_bytes") < t["pdf_bytes"]),
        "fonts": ("critical", c("fonts") >= t["fonts"]),
        "unicode": ("critical", c("has_unicode"))
    }
    return checks(metrics, keys, named).withColumn("layer", F.lit("structural"))


def coverage(texts: DataFrame, keys: list[str], sides: list[str], markers: list[str] = MARKERS) -> DataFrame:
    """(keys, marker, one boolean a side): which markers each side's text holds, all in their normal form (Q7, JN18).

    The markers are a stated list; normal forms are made once a row.
    """
    normal = texts.select(*keys, *[F.coalesce(T.normalize(F.col(s)), F.lit("")).alias(s) for s in sides])
    hit = lambda m: F.struct(F.lit(m).alias("marker"), *[F.contains(F.col(s), T.normalize(F.lit(m))).alias(f"in_{s}") for s in sides])
    return normal.select(*keys, F.explode(F.array(*[hit(m) for m in markers])).alias("h")).select(*keys, "h.*")


def coverage_ratio(covered: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """(keys, hits, total, ratio): markers that all of the sides hold (AG13, Q7; Q8 with the sections and two sides)."""
    everywhere = F.count_if(F.expr(" AND ".join(f"in_{s}" for s in sides)))
    n = covered.groupBy(*keys).agg(everywhere.alias("hits"), F.count("*").alias("total"))
    return n.withColumn("ratio", F.col("hits") / F.greatest("total", F.lit(1)))


def textual_layer(ratios: DataFrame, keys: list[str], t: dict = THRESHOLDS) -> DataFrame:
    """Checks of (keys, docx_ratio, print_ratio, markers, sections), shares of texts' lengths and of markers held (Q7, Q8)."""
    c = F.col
    named = {
        "docx_ratio": ("critical", c("docx_ratio") >= t["char_ratio"]),
        "print_ratio": ("critical", c("print_ratio") >= t["char_ratio"]),
        "markers": ("critical", c("markers") >= t["markers"]),
        "sections": ("major", c("sections") >= t["sections"])
    }
    return checks(ratios, keys, named).withColumn("layer", F.lit("textual"))


def visual_layer(pages: DataFrame, keys: list[str], t: dict = THRESHOLDS) -> DataFrame:
    """Checks over pages (keys, ssim, diff), both sides' pages paired before: that all pass, by either measure (Q11)."""
    n = pages.groupBy(*keys).agg(
        F.avg((F.col("ssim") >= t["ssim"]).cast("double")).alias("ssim_rate"),
        F.avg((F.col("diff") <= t["pixel_diff"]).cast("double")).alias("diff_rate")
    )
    return checks(
        n,
        keys,
        {"ssim_pass_rate": ("critical", F.col("ssim_rate") >= 1.0), "diff_pass_rate": ("major", F.col("diff_rate") >= 1.0)}
    ).withColumn("layer", F.lit("visual"))


def exit_codes(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passed, failed_checks, exit_code): 1 if a structural or textual check fails, 2 if a visual one does, else 0 (Q12, AG12)."""
    fails = lambda *layers: F.bool_or(F.col("layer").isin(*layers) & ~F.col("passed"))
    n = checked.groupBy(*keys).agg(fails("structural", "textual").alias("a"), fails("visual").alias("b"), F.count_if(~F.col("passed")).alias("failed_checks"))
    return n.select(*keys, (~F.col("a") & ~F.col("b")).alias("passed"), "failed_checks", F.when(F.col("a"), 1).when(F.col("b"), 2).otherwise(0).alias("exit_code"))


def compile_gate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Up to ten checks of a compilation; those about styles, detection and rules are made where there is something to check (Q13).

    metrics: score, min_score, unresolved, raw_blocks, max_raw_blocks, bytes, style_entries, confidence, unknown_macros,
    backend, requested_backend, equations, equation_fallbacks.
    """
    c = F.col
    entry = lambda name, severity, passed, when=None: F.when(
        F.lit(True) if when is None else when,
        F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"))
    )
    rows = [
        entry("compatibility_score", "error", c("score") >= c("min_score")), entry("unresolved_references", "warning", c("unresolved") == 0), entry(
            "raw_fallback_blocks",
            "error",
            c("raw_blocks") <= c("max_raw_blocks")
        ),
        entry("docx_non_empty", "error", c("bytes") > 0), entry("style_coverage", "info", F.lit(True), c("style_entries") > 0), entry(
            "profile_confidence",
            "warning",
            c("confidence") >= 0.80,
            c("confidence").isNotNull()
        ),
        entry("runtime_fallback", "warning", F.lit(False), c("unknown_macros") > 0), entry("backend_fallback", "warning", c("backend") == c("requested_backend")),
        entry(
            "equation_fallback",
            "warning",
            (c("equations") == 0) | (c("equation_fallbacks") < c("equations"))
        ), entry("journal_detection", "info", F.lit(True), c("confidence").isNotNull()),
    ]
    return metrics.select(*keys, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c")).select(*keys, "c.*")


def reference_rollup(events: DataFrame, labels: DataFrame, references: DataFrame, citations: DataFrame, keys: list[str], key: str = "key") -> DataFrame:
    """(keys, events, labels, edges, citations, unresolved): the counts of a project's report (AG14); references name labels by `key`."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    edges = references.join(labels.select(*keys, key).distinct().withColumn("hit", F.lit(1)), [*keys, key], "left")
    out = count(events, "events")
    for other in (count(labels, "labels"), count(edges.filter("hit = 1"), "edges"), count(citations, "citations"), count(edges.filter("hit IS NULL"), "unresolved")):
        out = out.join(other, keys, "full")
    return out.na.fill(0, ["events", "labels", "edges", "citations", "unresolved"])


def traceability(blocks: DataFrame, nodes: DataFrame, parts: DataFrame, prints: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """One row a project over its five artifacts (Q16, AG21).

    blocks (kind, rule_ids), nodes (kind, rule_ids), parts (metrics of the document), prints (text), checked (passed).
    """
    maps = lambda df, name, values: df.select(*keys, F.explode(values).alias("k")).groupBy(*keys, "k").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)
    )
    out = blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "raw").alias("raw_fallback"))
    for other in (
        maps(blocks, "block_kinds", F.array("kind")), maps(blocks, "block_rules", F.col("rule_ids")), nodes.groupBy(*keys).agg(F.count("*").alias("nodes")), maps(nodes, "node_rules", F.col("rule_ids")),
        parts, prints.select(*keys, F.length(T.normalize(F.col("text"))).alias("print_chars")), checked.groupBy(*keys).agg(
            F.bool_and("passed").alias("passed"),
            F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed_checks")
        ),
    ):
        out = out.join(other, keys, "left")
    return out.na.fill(0, ["nodes"])


def confident(rows: DataFrame, confidence: str = "confidence", least: float = 0.7) -> DataFrame:
    """Classifications from outside that are sure enough to hold (RL3; who makes them is the caller's)."""
    return rows.filter(F.col(confidence) >= least)
