"""Queries over documents' structure: blocks, indexes, trees, layouts, assets; and filters of lists.

Documents are written around conversations, a block a turn; the SQL works on the turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import graph as G
from ledgerloom.operators import quality as Q
from ledgerloom.operators import relational as R
from ledgerloom.operators import rules as L
from ledgerloom.operators import syntax as S
from ledgerloom.operators import tree as T
from ledgerloom.plans.registry import query, table
from ledgerloom.sources.files import bib_texts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn")
    block = (
        F.when(F.col("role") == "user", F.concat(F.lit("\\begin{itemize} % list\n\\item u"), n, F.lit("\n \\item[x] \\cite{a, k"), n, F.lit("}\\end{itemize}\n\n")))
        .when(
            F.col("role") == "assistant",
            F.concat(
                F.lit("\\begin{tabular}{cc}a & b"),
                n,
                F.lit(" \\\\ \\hline \\\\ & \\\\ c & d\\\\\\end{tabular}\n\n\\includegraphics[width=1cm]{fig"),
                n % 2,
                F.lit("}\n\n")
            )
        )
        .otherwise(F.concat(F.lit("plain "), n, F.lit(" \\sectionmark{no}\n\n\\subsection{S"), n, F.lit("}\n")))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "")
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))
    return docs.select(
        "conv_id",
        F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n\\section{C}\n"), F.col("body"), F.lit("\\end{document} tail")).alias("text")
    )


@query("""WITH b AS (SELECT conv_id, unnest(CASE role WHEN 'user' THEN ['list'] WHEN 'assistant' THEN ['table', 'paragraph'] ELSE ['paragraph', 'heading'] END) AS kind, unnest(CASE role WHEN 'user' THEN [2] WHEN 'assistant' THEN [2, 0] ELSE [0, 0] END) AS items FROM conversations UNION ALL SELECT DISTINCT conv_id, 'heading', 0 FROM conversations)
SELECT conv_id, kind, count(*) AS n, sum(items)::BIGINT AS items FROM b GROUP BY ALL""")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, lists, tables and paragraphs of each document; empty table rows and commands like a heading's don't count (GR4, Z17, Z20)."""
    blocks = S.block_tree(_documents(spark, sf_dir), ["conv_id"])
    held = F.count(F.when(F.col("kind").isin("item", "row"), 1)).over(Window.partitionBy("conv_id", F.coalesce("parent", "block")))
    top = blocks.withColumn("items", held).filter("parent IS NULL")
    return top.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.sum("items").alias("items"))


@query(
    """WITH h AS (SELECT conv_id, 'subsection' AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE role = 'system' UNION ALL SELECT DISTINCT conv_id, 'section', 1 FROM conversations) SELECT conv_id, max(number)::BIGINT AS most, count(*) AS n FROM h GROUP BY conv_id"""
)
def numbering_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers of each document's headings (GR5, WN1)."""
    blocks = S.block_tree(_documents(spark, sf_dir), ["conv_id"]).filter("parent IS NULL").select("conv_id", "pos", "kind", "name")
    return T.numbering_index(blocks, ["conv_id"]).groupBy("conv_id").agg(F.max("number").cast("long").alias("most"), F.count("*").alias("n"))


@query(
    """SELECT DISTINCT conv_id, 'graphic' AS kind, 'fig' || turn % 2 AS target FROM conversations WHERE role = 'assistant' UNION ALL SELECT DISTINCT conv_id, 'citation', unnest(['a', 'k' || turn]) FROM conversations WHERE role = 'user'"""
)
def resource_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphics and cited keys that each document names (GR5)."""
    return T.resource_index(_documents(spark, sf_dir), ["conv_id"]).select("conv_id", "kind", "target")


@query(
    """SELECT conv_id, count(*) FILTER (role = 'user') + count(*) FILTER (role = 'assistant') + 1 AS environments, 0::BIGINT AS errors, true AS lossless FROM conversations GROUP BY conv_id"""
)
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document with their nesting: environments opened, closing marks that fit nothing, and whether all tokens joined are the text (GR9)."""
    docs = _documents(spark, sf_dir)
    leaves = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("node", "text"))))
    found = S.syntax_tree(docs, ["conv_id"]).groupBy("conv_id").agg(
        F.count_if(F.col("kind") == "environment").alias("environments"),
        F.count_if("error").alias("errors"),
        F.array_join(F.transform(leaves, lambda x: x["text"]), "").alias("joined"),
    )
    return docs.join(found, "conv_id").select("conv_id", "environments", "errors", (F.col("joined") == F.col("text")).alias("lossless"))


@query("""SELECT 'c' || c_custkey AS node, 2 AS depth, (r_regionkey || '/' || n_nationkey || '/' || c_custkey) AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey || '/' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 0, r_regionkey::VARCHAR FROM region""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers in the order a visitor meets them (GR6)."""
    node = lambda name, letter, key, parent: table(spark, sf_dir, name).select(
        F.lit(1).alias("tree"),
        F.concat(F.lit(letter), key).alias("node"),
        parent.alias("parent"),
        F.col(key).cast("long").alias("pos")
    )
    nodes = node("region", "r", "r_regionkey", F.lit(None).cast("string")).union(
        node("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"))
    ).union(node("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey")))
    return T.visited(nodes).select("node", "depth", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


_LAYOUT_SQL = """e AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = 'view' THEN event_id % 9 END AS page FROM events),
p AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS now, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS summed FROM e)"""


def _layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    node = F.to_json(
        F.struct(
            F.lit("node").alias("type"),
            e.cast("string").alias("id"),
            F.when(e % 4 == 0, "rule").when(e % 4 == 1, "text").otherwise("odd").alias("kind"),
            F.round("value", 2).alias("width")
        )
    )
    page = F.to_json(F.struct(F.lit("summary").alias("type"), (e % 9).cast("int").alias("page")))
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") == "view", page).when(e % 10 == 0, "# note").when(e % 10 == 1, "  ").otherwise(node).alias("value")
    )


@query(
    f"""WITH {_LAYOUT_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'text' ELSE 'other' END AS kind, coalesce(now, -1)::INT AS page, coalesce(summed, -1)::INT AS last_page, round(value, 2) AS width FROM p WHERE event_type <> 'view' AND event_id % 10 > 1"""
)
def layout_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of layouts with the page named last before them, and with the last page of their file (GR8, SRC6, WN11, Z9)."""
    lines = _layout_lines(spark, sf_dir)
    own = T.layout_nodes(lines, ["user_id"], "event_id")
    other = T.layout_nodes(lines, ["user_id"], "event_id", as_summed_up=True).select("event_id", F.col("page").alias("last_page"))
    return own.join(other, "event_id").select(
        "event_id",
        "kind",
        F.coalesce("page", F.lit(-1)).alias("page"),
        F.coalesce("last_page", F.lit(-1)).alias("last_page"),
        "width"
    )


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'img/' WHEN l_partkey % 3 = 1 THEN 'old/' ELSE '' END || 'p' || l_partkey % 500 || '.png' AS path FROM lineitem), a AS (SELECT DISTINCT 'img/p' || p_partkey % 300 || '.png' AS path FROM part),
n AS (SELECT string_split(path, '/')[-1] AS name, min(path) AS path FROM a GROUP BY 1) SELECT l_orderkey, l_linenumber, f.path, coalesce(a.path, n.path) AS asset FROM f LEFT JOIN a ON a.path = f.path LEFT JOIN n ON n.name = string_split(f.path, '/')[-1]""")
def figure_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with their assets, by full path, else by file name (JN21)."""
    k = F.col("l_partkey")
    path = F.concat(F.when(k % 3 == 0, "img/").when(k % 3 == 1, "old/").otherwise(""), F.lit("p"), k % 500, F.lit(".png"))
    assets = table(spark, sf_dir, "part").select(F.concat(F.lit("img/p"), F.col("p_partkey") % 300, F.lit(".png")).alias("path"))
    return G.aliased(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path")), assets)


@query("""WITH t AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'src' ELSE '' END AS base, 'f' || o_custkey % 400 AS target FROM orders), f AS (SELECT DISTINCT (CASE WHEN p_partkey % 2 = 0 THEN 'src/' ELSE '' END) || 'f' || p_partkey % 350 || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.tex' ELSE '.ltx' END AS path FROM part),
c AS (SELECT base, target, CASE WHEN base = '' THEN target ELSE base || '/' || target END AS p FROM t) SELECT base, target, CASE WHEN p IN (SELECT path FROM f) THEN p WHEN p || '.tex' IN (SELECT path FROM f) THEN p || '.tex' WHEN p || '.ltx' IN (SELECT path FROM f) THEN p || '.ltx' END AS path FROM c""")
def include_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first existing of the files an include may mean (JN22, SE2)."""
    o, p = F.col("o_custkey"), F.col("p_partkey")
    targets = table(spark, sf_dir, "orders").select(F.when(o % 2 == 0, "src").otherwise("").alias("base"), F.concat(F.lit("f"), o % 400).alias("target")).distinct()
    files = table(spark, sf_dir, "part").select(
        F.concat(F.when(p % 2 == 0, "src/").otherwise(""), F.lit("f"), p % 350, F.when(p % 3 == 0, "").when(p % 3 == 1, ".tex").otherwise(".ltx")).alias("path")
    )
    return G.first_existing(targets, files, [".tex", ".ltx"])


MAPPINGS = [("user", "map.quote", "w:p", 1), ("assistant", "map.table", "w:tbl", 2), ("assistant", "map.late", "w:sdt", 3)]


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'map.quote' WHEN 'assistant' THEN 'map.table' ELSE 'map.missing' END AS rule_id, CASE role WHEN 'assistant' THEN 'w:tbl' ELSE 'w:p' END AS element, CASE WHEN role = 'system' THEN 'no mapping rule for system' END AS diagnostic FROM conversations"""
)
def mapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the first mapping rule of their kind; without one they become paragraphs, with a diagnostic (JN14)."""
    rules = spark.createDataFrame(MAPPINGS, "kind string, rule_id string, element string, position int").coalesce(1)
    return L.mapped(table(spark, sf_dir, "conversations"), "role", rules).select("conv_id", "turn", "rule_id", "element", "diagnostic")


@query(
    """SELECT c_custkey, c_name AS name, n_name AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE n_name END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def merged_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps merged, a document's own entries before those of its includes (SE4, MP1)."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(
        F.col("c_custkey") % 2 == 0,
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("label"), F.lit("own"))
    ).otherwise(F.create_map(F.lit("name"), F.col("c_name")))
    other = F.create_map(F.lit("name"), F.lit("hidden"), F.lit("nation"), F.col("n_name"), F.lit("label"), F.col("n_name"))
    m = G.merged_maps(own, other)
    return customers.select("c_custkey", *[F.element_at(m, k).alias(k) for k in ("name", "nation", "label")])


@query(
    """SELECT p_partkey, round(p_size * 40 * 9525.0 * s)::BIGINT AS cx, round(p_size * 20 * 9525.0 * s)::BIGINT AS cy, round(p_size * 56.6929133858)::BIGINT AS twips FROM (SELECT *, least(1.0::DOUBLE, 5274310 / (p_size * 40 * 9525.0::DOUBLE)) AS s FROM part)"""
)
def image_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images fitted to the width of the text, and lengths in twips (MA4)."""
    extent = X.fitted_extent(F.col("p_size") * 40, F.col("p_size") * 20)
    return table(spark, sf_dir, "part").select("p_partkey", extent["cx"].alias("cx"), extent["cy"].alias("cy"), X.twips(F.col("p_size")).alias("twips"))


@query(
    """SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100"""
)
def feedback_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list under the filters that are given: type and dates, both included (FLT7, SO4, Z2)."""
    rows = R.optional_filters(table(spark, sf_dir, "events"), {"event_type": "purchase", "user_id": None}, "ts", "2024-01-05", "2024-01-20 12:00:00")
    return R.page(rows, [F.desc("ts"), F.col("event_id")], 2, 100).select("event_id", "user_id")


@query(
    """SELECT item_id, 'k' || item_id AS key, 'A. B, C D. T ' || length(text) || ' “x”. J, ' || item_id || CASE WHEN item_id % 2 = 0 THEN '(3)' ELSE '' END || ': 1–9. 2020.' AS text FROM benchmark"""
)
def bib_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography entries as plain citations (SRC10)."""
    i = F.col("item_id")
    source = F.concat(
        F.lit("@article{k"),
        i,
        F.lit(", author = {A. B and C D.}, title = \"{T} "),
        F.length("text"),
        F.lit(" ``x''\", journal = {J}, volume = "),
        i,
        F.when(i % 2 == 0, ", number = {3}").otherwise(""),
        F.lit(", pages = {1--9}, year = 2020}")
    )
    return bib_texts(table(spark, sf_dir, "benchmark").select("item_id", source.alias("text")))


@query("""WITH c AS (SELECT conv_id, count(*) AS blocks, count(*) FILTER (role = 'system') AS raw_fallback, count(*) * 2 AS nodes, count(*) FILTER (turn % 2 = 0) AS even, sum(length(text))::BIGINT AS chars, bool_and(role <> 'system' OR turn > 0) AS passed, array_to_string(list_sort(list('t' || turn) FILTER (role = 'system' AND turn <= 0)), ',') AS failed FROM conversations GROUP BY conv_id)
SELECT conv_id, blocks, raw_fallback, nodes, coalesce(even, 0) AS even_rules, chars, passed, coalesce(failed, '') AS failed FROM c""")
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five artifacts of each project in one row (Q16, AG21)."""
    c = table(spark, sf_dir, "conversations")
    blocks = c.select(
        "conv_id",
        F.when(F.col("role") == "system", "raw").otherwise("block").alias("kind"),
        F.when(F.col("turn") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")).alias("rule_ids")
    )
    nodes = blocks.union(blocks)
    parts = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    prints = c.filter("turn = 0").select("conv_id", "text")
    checked = c.select("conv_id", F.concat(F.lit("t"), "turn").alias("name"), ((F.col("role") != "system") | (F.col("turn") > 0)).alias("passed"))
    found = Q.traceability(blocks, nodes, parts, prints, checked, ["conv_id"])
    even = F.coalesce(F.try_element_at("block_rules", F.lit("even")), F.lit(0))
    return found.select("conv_id", "blocks", "raw_fallback", "nodes", even.alias("even_rules"), "chars", "passed", F.array_join("failed_checks", ",").alias("failed"))
