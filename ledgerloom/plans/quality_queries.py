"""Queries over documents' parts and texts: metrics, layers of checks, exit codes, coverage, the compile gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import quality as Q
from ledgerloom.operators import rules as R
from ledgerloom.operators.sequences import logical_width
from ledgerloom.plans.registry import query, table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document part for each conversation: a paragraph a turn, a table a user's turn, a drawing an assistant's."""
    n, role = F.col("turn"), F.col("role")
    text = T.xml_escaped(F.regexp_replace("text", r"[\\\[\]]", " "))
    paragraph = F.concat(
        F.lit("<w:p><w:pPr><w:pStyle w:val=\""), F.when(role == "user", "TableCaption").otherwise("Body"), F.lit("\"/>"), F.when(n % 3 != 2, "<w:keepNext/>").otherwise(""), F.lit("</w:pPr><w:r><w:rPr><w:rFonts w:ascii=\""),
        F.when(F.length("text") % 2 == 0, "Times").otherwise("Courier"), F.lit("\"/>"), F.when(role == "system", "<w:vertAlign w:val=\"superscript\"/>").otherwise(""), F.lit("</w:rPr><w:t>"), text, F.lit("</w:t>"),
        F.when(role == "assistant", "<w:drawing/>").otherwise(""), F.lit("</w:r></w:p>"),
        F.when(
            role == "user",
            F.concat(
                F.lit("<w:tbl><w:tblPr><w:tblBorders><w:left w:val=\"nil\"/><w:right w:val=\"nil\"/><w:insideV w:val=\""),
                F.when(n % 4 == 1, "single").otherwise("nil"),
                F.lit("\"/></w:tblBorders></w:tblPr><w:tr><w:trPr><w:cantSplit/></w:trPr></w:tr></w:tbl>")
            )
        ).otherwise(""),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", paragraph.alias("p")))), lambda x: x["p"]), "")
    c = F.col("conv_id")
    section = F.concat(
        F.lit("<w:sectPr><w:pgSz w:w=\"10433\" w:h=\""),
        F.when(c % 2 == 0, "14742").otherwise("16838"),
        F.lit("\"/><w:pgMar w:top=\"10\" w:bottom=\"10\" w:left=\"5\" w:right=\""),
        c % 3,
        F.lit("\"/>"),
        F.when(c % 5 == 0, "<w:cols w:num=\"2\"/>").otherwise(""),
        F.lit("</w:sectPr>")
    )
    styles = F.concat(
        F.lit("<w:style w:styleId=\"Reference\"><w:pPr><w:ind w:left=\"420\" w:hanging=\""),
        F.when(c % 7 == 0, "0").otherwise("420"),
        F.lit("\"/></w:pPr></w:style>")
    )
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        body.alias("body"),
        F.sum(F.length(T.normalize(F.col("text")))).alias("docx_chars"),
        F.sum(F.length("text")).alias("oracle_chars")
    )
    return parts.select("conv_id", F.concat(F.col("body"), section).alias("document"), styles.alias("styles"), "docx_chars", "oracle_chars")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("conv_id", *[v.alias(k) for k, v in Q.part_metrics(F.col("document"), F.col("styles")).items()], "docx_chars", "oracle_chars")


_METRICS_SQL = f"""m AS (SELECT conv_id, count(*) FILTER (role = 'user') AS tables, count(*) FILTER (role = 'assistant') AS images, count(*) AS paragraphs, count(*) FILTER (role = 'user') AS captions, count(*) FILTER (role = 'user' AND turn % 3 <> 2) AS captions_kept,
count(*) FILTER (role = 'assistant' AND turn % 3 <> 2) AS images_kept, count(*) FILTER (turn % 3 <> 2) AS kept_with_next, count(*) FILTER (role = 'user' AND turn % 4 = 1) AS inside_rules, count(*) FILTER (role = 'user') AS open_sides, count(*) FILTER (role = 'user') AS rows, count(*) FILTER (role = 'user') AS rows_whole,
count(DISTINCT length(text) % 2) AS fonts, count(*) FILTER (role = 'system') AS superscripts, 0::BIGINT AS leaked_markup, 10433::BIGINT AS page_width, CASE WHEN conv_id % 2 = 0 THEN 14742 ELSE 16838 END::BIGINT AS page_height, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 4 END::BIGINT AS margins,
CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS columns, 420::BIGINT AS reference_left, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 420 END::BIGINT AS reference_hanging,
sum(length(regexp_replace(translate(text, '{T.DASHES}{T.QUOTES}', '--''''""'), '[{T.WHITE}]', '', 'g')))::BIGINT AS docx_chars, sum(length(text))::BIGINT AS oracle_chars FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_METRICS_SQL} SELECT * FROM m")
def part_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fonts, borders and what stays with the next paragraph, of each document part (AG16, AG22)."""
    return _metrics(spark, sf_dir)


_CHECKS_SQL = f"""{_METRICS_SQL}, k AS (SELECT conv_id, 'structural' AS layer, unnest(['tables', 'images', 'captions', 'page_size', 'margins', 'columns', 'reference_indent', 'char_ratio', 'captions_stay_with_tables', 'images_stay_with_captions', 'rows_not_split', 'table_rules', 'table_sides_open', 'superscripts', 'no_leaked_markup', 'fonts', 'pages', 'size', 'fonts', 'unicode']) AS name,
unnest([tables >= 5, images = 8, captions >= 6, page_width = 10433 AND page_height = 14742, margins = 4, columns = 1, reference_left = 420 AND reference_hanging = 420, docx_chars >= 0.75 * oracle_chars, captions > 0 AND captions_kept = captions, images > 0 AND images_kept = images, rows > 0, tables > 0 AND inside_rules = tables, tables > 0,
superscripts > 0, true, fonts >= 2, abs(conv_id % 4 + 1 - greatest(paragraphs / 6.0, 1.0)) / greatest(paragraphs / 6.0, 1.0) <= 0.2, oracle_chars * 1000 < 5242880, fonts >= 2, conv_id % 11 <> 0]) AS passed FROM m)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    prints = m.withColumns({"pages": F.col("conv_id") % 4 + 1, "pdf_bytes": F.col("oracle_chars") * 1000, "has_unicode": F.col("conv_id") % 11 != 0})
    return Q.structural_layer(m, ["conv_id"]).unionByName(Q.extended_layer(m, ["conv_id"])).unionByName(Q.pdf_layer(prints, ["conv_id"]))


@query(f"WITH {_CHECKS_SQL} SELECT * FROM k")
def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of parts and prints, one row each (Q9, Q10, Q15, MA3)."""
    return _checked(spark, sf_dir).select("conv_id", "layer", "name", "passed")


_VISUAL_SQL = """p AS (SELECT a.vec_id // 8 AS conv_id, list_transform(a.embedding, lambda x: x::DOUBLE * 100 + 100) AS v, list_transform(b.embedding, lambda x: x::DOUBLE * 100 + 100) AS w, len(a.embedding)::DOUBLE AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT conv_id, list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))) / n AS diff FROM p), vis AS (SELECT conv_id, bool_and(diff <= 3) AS passed FROM d GROUP BY conv_id)"""


@query(f"""WITH {_CHECKS_SQL}, {_VISUAL_SQL}, s AS (SELECT conv_id, bool_or(NOT passed AND conv_id % 3 <> 0) AS a, count(*) FILTER (NOT passed AND conv_id % 3 <> 0) AS failed FROM k GROUP BY conv_id)
SELECT s.conv_id, NOT a AND coalesce(vis.passed, true) AS passed, failed + CASE WHEN vis.passed THEN 0 WHEN vis.passed IS NULL THEN 0 ELSE 1 END AS failed_checks, CASE WHEN a THEN 1 WHEN NOT coalesce(vis.passed, true) THEN 2 ELSE 0 END AS exit_code FROM s LEFT JOIN vis ON vis.conv_id = s.conv_id""")
def layer_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of all layers: 1 for a structural failure, 2 for a visual one alone (Q11, Q12, AG12); every third document's structural checks count as passed."""
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100 + 100).alias("v"))
    pages = scaled.join(scaled.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    pages = pages.select(F.floor(F.col("vec_id") / 8).alias("conv_id"), F.lit(1.0).alias("ssim"), R.mean_abs_difference(F.col("v"), F.col("w")).alias("diff"))
    known = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    structural = _checked(spark, sf_dir).withColumn("passed", F.col("passed") | (F.col("conv_id") % 3 == 0))
    visual = Q.visual_layer(pages.join(known, "conv_id", "left_semi"), ["conv_id"])
    return Q.exit_codes(structural.unionByName(visual), ["conv_id"])


MARKERS = ["the", "a", "model", "-", "  ", "“", "que", "der", "0", "1", ".", ",", "?", "!", "ing", "en", "of", "and", "is", "e r", "th e", "zz"]
SECTIONS = ["the", "of", "and", "in", "to", "is", "a"]
_SIDES_SQL = f"""s AS (SELECT conv_id, {
    ', '.join(
        f"regexp_replace(translate(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = '{r}'), ''), '{T.DASHES}{T.QUOTES}', '--''''" + '""' + f"'), '[{T.WHITE}]', '', 'g') AS {r}" for r in ("system", "user", "assistant")
    )
} FROM conversations GROUP BY conv_id)"""
_NORMAL_MARKERS = [m.translate(str.maketrans("–—‘’“”", "--''\"\"")).replace(" ", "") for m in MARKERS]


def _sql_strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH {_SIDES_SQL}, h AS (SELECT conv_id, list_filter({_sql_strings(_NORMAL_MARKERS)}, lambda m: contains(system, m) AND contains(user, m) AND contains(assistant, m)) AS hit, list_filter({_sql_strings(SECTIONS)}, lambda m: contains(user, m) AND contains(assistant, m)) AS sections FROM s)
SELECT conv_id, len(hit)::BIGINT AS hits, len(hit) / 22.0::DOUBLE AS ratio, len(sections)::BIGINT AS section_hits, len(sections) / 7.0::DOUBLE AS section_ratio FROM h""")
def marker_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22 markers on three sides and seven sections on two, all in normal form (Q7, Q8, AG13, JN18)."""
    side = lambda r: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]),
        " "
    ).alias(r)
    sides = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[side(r) for r in ("system", "user", "assistant")])
    both = Q.coverage_ratio(Q.coverage(sides, ["conv_id"], ["system", "user", "assistant"], MARKERS), ["conv_id"], ["system", "user", "assistant"])
    sections = Q.coverage_ratio(Q.coverage(sides, ["conv_id"], ["user", "assistant"], SECTIONS), ["conv_id"], ["user", "assistant"])
    return both.select("conv_id", "hits", "ratio").join(sections.select("conv_id", F.col("hits").alias("section_hits"), F.col("ratio").alias("section_ratio")), "conv_id")


@query("""WITH m AS (SELECT doc_id, length(text) AS n, doc_id % 101 AS score, doc_id % 3 AS unresolved, doc_id % 7 AS raw, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 11) / 10.0 END AS confidence, doc_id % 5 AS unknown FROM documents),
c AS (SELECT doc_id, (score < 60)::INT + (raw > 4)::INT + (n = 0)::INT AS e, (unresolved > 0)::INT + coalesce((confidence < 0.8)::INT, 0) + (unknown > 0)::INT + (doc_id % 2 = 1)::INT + (doc_id % 6 <> 0 AND doc_id % 6 <= doc_id % 9)::INT AS w,
6 + (doc_id % 8 > 0)::INT + 2 * (confidence IS NOT NULL)::INT + (unknown > 0)::INT AS total FROM m) SELECT doc_id, CASE WHEN e > 0 THEN 'Failed' WHEN w > 0 THEN 'PassedWithWarnings' ELSE 'Passed' END AS status, (total - e)::BIGINT AS passed_checks FROM c""")
def compile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks of a compilation, some of them only where there is something to check (Q13, AG12)."""
    d = F.col("doc_id")
    metrics = table(spark, sf_dir, "documents").select(
        "doc_id", (d % 101).alias("score"), F.lit(60).alias("min_score"), (d % 3).alias("unresolved"), (d % 7).alias("raw_blocks"), F.lit(4).alias("max_raw_blocks"), F.length("text").alias("bytes"), (d % 8).alias("style_entries"),
        F.when(d % 4 != 0, (d % 11) / 10.0).alias("confidence"), (d % 5).alias("unknown_macros"), F.when(d % 2 == 1, "raster").otherwise("native").alias("backend"), F.lit("native").alias("requested_backend"), (d % 6).alias("equations"), (d % 9).alias("equation_fallbacks"),
    )
    return R.gate(Q.compile_gate(metrics, ["doc_id"]), ["doc_id"]).select("doc_id", "status", "passed_checks")


@query("""WITH l AS (SELECT source, lang, doc_id % 40 AS key FROM documents WHERE doc_id % 5 = 0), r AS (SELECT source, lang, doc_id % 60 AS key FROM documents WHERE doc_id % 5 = 1), c AS (SELECT source, lang FROM documents WHERE doc_id % 5 = 2),
k AS (SELECT DISTINCT * FROM l), e AS (SELECT r.source, r.lang, k.key IS NOT NULL AS hit FROM r LEFT JOIN k ON k.source = r.source AND k.lang = r.lang AND k.key = r.key), g AS (SELECT DISTINCT source, lang FROM documents)
SELECT g.source, g.lang, (SELECT count(*) FROM documents d WHERE d.source = g.source AND d.lang = g.lang) AS events, (SELECT count(*) FROM l WHERE l.source = g.source AND l.lang = g.lang) AS labels, (SELECT count(*) FROM e WHERE e.source = g.source AND e.lang = g.lang AND hit) AS edges,
(SELECT count(*) FROM c WHERE c.source = g.source AND c.lang = g.lang) AS citations, (SELECT count(*) FROM e WHERE e.source = g.source AND e.lang = g.lang AND NOT hit) AS unresolved FROM g""")
def reference_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, labels, edges, citations and unresolved references of each project (AG14, GR3)."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    some = lambda i, most: docs.filter(F.col("doc_id") % 5 == i).withColumn("key", F.col("doc_id") % most)
    return Q.reference_rollup(docs, some(0, 40), some(1, 60), some(2, 60), ["source", "lang"])


@query("SELECT l_orderkey, greatest(sum(greatest(l_linenumber - 2, 1)), 1)::BIGINT AS width FROM lineitem GROUP BY l_orderkey")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical width of each row of cells: their spans of at least one, summed (AG24)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(logical_width(F.col("l_linenumber") - 2).alias("width"))
