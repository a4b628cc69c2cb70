r"""Queries over documents of random depth: lossless trees, nested blocks, macros.

Documents are written around tables whose rows decide what opens, closes and is called; the SQL works on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.macros import macros_defined, macros_expanded
from ledgerloom.operators import syntax as S
from ledgerloom.operators.algorithms import algorithm_rows
from ledgerloom.operators.graph import discovered
from ledgerloom.plans.registry import query, table
from ledgerloom.sources.files import mapping_rules, mapping_trees


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, text): a document for each user; views open a list, errors close one, also where none is open."""
    kind, i = F.col("event_type"), F.col("event_id")
    piece = (
        F.when(kind == "view", F.concat(F.lit("\\begin{itemize} \\item v"), i, F.lit(" ")))
        .when(kind == "error", F.lit("\\end{itemize}\n"))
        .when(kind == "click", F.concat(F.lit("{c"), i, F.lit("} % note }\n")))
        .when(kind == "signup", F.concat(F.lit("\\item s"), i, F.lit(" ")))
        .otherwise("\n\n")
    )
    events = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", piece.alias("piece")).alias("e"))
    pieces = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["piece"])
    return events.groupBy("user_id").agg(F.array_join(pieces, "").alias("text"))


# How deep a walk stands that goes up by views and down by errors but never below zero: its sum less the lowest sum so far.
_WALK_SQL = """WITH w AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM w),
e AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM d)"""


@query(
    f"""{_WALK_SQL} SELECT user_id, count(*) FILTER (event_type = 'view') AS environments, count(*) FILTER (event_type = 'error' AND before = 0) AS stray,
    arg_max(depth, event_id)::BIGINT AS unclosed, count(*) FILTER (event_type = 'click') AS groups, true AS lossless FROM e GROUP BY user_id"""
)
def nested_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments of documents of random depth, closing marks that close nothing, what is never closed, and whether the leaves join to the text (GR9)."""
    docs = _event_documents(spark, sf_dir)
    leaves = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("node", "text"))))
    found = S.syntax_tree(docs, ["user_id"]).groupBy("user_id").agg(
        F.count_if(F.col("kind") == "environment").alias("environments"),
        F.count_if(F.col("kind") == "error").alias("stray"),
        F.count_if(F.col("error") & (F.col("kind") == "environment")).alias("unclosed"),
        F.count_if(F.col("kind") == "group").alias("groups"),
        F.array_join(F.transform(leaves, lambda x: x["text"]), "").alias("joined"),
    )
    same = (F.col("joined") == F.col("text")).alias("lossless")
    return docs.join(found, "user_id").select("user_id", "environments", "stray", "unclosed", "groups", same)


@query(
    f"""{_WALK_SQL} SELECT user_id, depth::BIGINT AS level, count(*) FILTER (event_type = 'view') AS lists, count(*) AS items
    FROM e WHERE event_type IN ('view', 'signup') AND depth > 0 GROUP BY user_id, depth"""
)
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and items of documents of random depth by how many lists are around them (GR4)."""
    blocks = S.block_tree(_event_documents(spark, sf_dir), ["user_id"])
    level = F.when(F.col("kind") == "list", F.col("level"))
    list_of = F.when(F.col("kind") == "item", F.col("parent")).otherwise(F.col("block"))
    own = blocks.filter(F.col("kind").isin("list", "item")).withColumn("level", F.max(level).over(Window.partitionBy("user_id", list_of)))
    return own.groupBy("user_id", F.col("level").cast("long").alias("level")).agg(
        F.count_if(F.col("kind") == "list").alias("lists"), F.count_if(F.col("kind") == "item").alias("items")
    )


@query(
    f"""{_WALK_SQL}, f AS (SELECT *, count(*) FILTER (event_type IN ('view', 'error', 'purchase') OR event_type = 'signup' AND depth > 0) OVER (PARTITION BY user_id ORDER BY event_id) AS stretch FROM e)
    SELECT user_id, event_id, depth::BIGINT AS level FROM (
        SELECT user_id, event_id, depth, event_type FROM f WHERE event_type IN ('view', 'signup', 'click') QUALIFY row_number() OVER (PARTITION BY user_id, stretch ORDER BY event_id) = 1)"""
)
def nested_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph of documents of random depth, by the number it begins with, and how many lists are around it (GR4)."""
    blocks = S.block_tree(_event_documents(spark, sf_dir), ["user_id"])
    lists = blocks.filter("kind = 'list'").select("user_id", F.col("block").alias("list"), F.col("level").alias("of"))
    items = blocks.filter("kind = 'item'").select("user_id", F.col("block").alias("item"), F.col("parent").alias("list")).join(lists, ["user_id", "list"])
    own = blocks.filter("kind = 'paragraph'").select("user_id", F.col("parent").alias("item"), F.regexp_extract("text", r"^\D*(\d+)", 1).cast("long").alias("event_id"))
    found = own.join(items, ["user_id", "item"], "left")
    return found.select("user_id", "event_id", F.coalesce("of", F.lit(0)).cast("long").alias("level"))


def _letters(x: Column) -> Column:
    return F.translate(x.cast("string"), "0123456789", "abcdefghij")


def _macro_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, text): a macro for each customer that calls the one of half its rank; in every fifth nation the first calls the third.

    Customers in debt are defined twice, the right body last; definitions stand in the order of names, calls behind them.
    """
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_name", rank.alias("r"))
    r, name = F.col("r"), _letters(F.col("r"))
    call = lambda x: F.concat(F.lit("\\"), _letters(x))
    onward = F.when(r > 1, call(F.floor(r / 2))).when(F.col("c_nationkey") % 5 == 0, call(F.lit(3))).otherwise("")
    define = lambda command, body: F.concat(F.lit(f"\\{command}{{\\"), name, F.lit("}{"), body, F.lit("}\n"))
    old = F.when(F.col("c_acctbal") < 0, define("newcommand", F.lit("\\textbf{old} {body}"))).otherwise("")
    made = F.concat(old, define("renewcommand", F.concat(F.lit("{"), F.col("c_custkey"), F.lit("}"), onward)))
    entry = F.struct("c_name", "r", made.alias("made"), F.concat(r.cast("string"), F.lit(":"), call(r), F.lit(";\n")).alias("call"))
    pieces = lambda field: F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e[field]), "")
    return c.groupBy("c_nationkey").agg(F.concat(pieces("made"), pieces("call")).alias("text"))


@query(
    r"""WITH RECURSIVE c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_nationkey % 5 = 0 AND count(*) OVER (PARTITION BY c_nationkey) >= 3 AS cyclic FROM customer),
    walk(c_nationkey, r, k, line) AS (
        SELECT c_nationkey, r, r, '' FROM c
        UNION ALL
        SELECT w.c_nationkey, w.r, CASE WHEN c.cyclic AND w.k IN (1, 3) THEN 0 ELSE w.k // 2 END,
            w.line || CASE WHEN c.cyclic AND w.k IN (1, 3) THEN '\' || translate(w.k::VARCHAR, '0123456789', 'abcdefghij') ELSE '{' || c.c_custkey || '}' END
        FROM walk w JOIN c ON c.c_nationkey = w.c_nationkey AND c.r = w.k)
    SELECT c_nationkey, r::INTEGER AS r, line FROM walk WHERE k = 0"""
)
def macro_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call of chained macros becomes; calls of macros on a cycle stay (ST22)."""
    docs = _macro_documents(spark, sf_dir)
    line = F.explode(F.split(F.trim(macros_expanded(F.col("text"))), r";\s*")).alias("line")
    found = docs.select("c_nationkey", line).filter("line <> ''")
    parts = F.split("line", ":")
    return found.select("c_nationkey", parts[0].cast("int").alias("r"), parts[1].alias("line"))


@query(
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, n AS macros, CASE WHEN c_nationkey % 5 = 0 AND n >= 3 THEN 2 ELSE 0 END::BIGINT AS cyclic FROM c"""
)
def macro_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many macros each document defines, and how many of them lead back to themselves (ST22)."""
    found = _macro_documents(spark, sf_dir).select("c_nationkey", F.explode(macros_defined(F.col("text"))).alias("m"))
    return found.groupBy("c_nationkey").agg(F.count("*").alias("macros"), F.count_if("m.cyclic").alias("cyclic"))


@query(
    f"""{_WALK_SQL} SELECT user_id, (CASE WHEN event_type = 'view' THEN before ELSE depth END)::BIGINT AS indent, count(*) FILTER (event_type = 'click') AS statements, count(*) FILTER (event_type = 'view') AS conditions
    FROM e WHERE event_type IN ('view', 'click') GROUP BY ALL"""
)
def algorithm_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and conditions of algorithms of random depth by their indent (ST35)."""
    kind, i = F.col("event_type"), F.col("event_id")
    piece = (
        F.when(kind == "view", F.concat(F.lit("\\If{$v_"), i, F.lit("$}\n{")))
        .when(kind == "error", "}\n")
        .when(kind == "click", F.concat(F.lit("c \\leftarrow "), i, F.lit("\\; \\tcp*{note "), i, F.lit("}\n")))
        .otherwise(" ")
    )
    events = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", piece.alias("piece")).alias("e"), (kind == "view").cast("int").alias("opens"))
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["piece"]), ""), F.repeat(F.lit("}"), F.sum("opens").cast("int")))
    lines = events.groupBy("user_id").agg(body.alias("body")).select("user_id", F.explode(algorithm_rows(F.col("body"))).alias("l"))
    note = F.regexp_extract("l.code", r"(\d+);$", 1) == F.regexp_extract("l.comment", r"note (\d+)$", 1)
    own = lines.filter((F.col("l.keyword") == "If") | F.col("l.keyword").isNull())
    return own.groupBy("user_id", F.col("l.indent").cast("long").alias("indent")).agg(
        F.count_if(F.col("l.keyword").isNull() & note).alias("statements"), F.count_if(F.col("l.keyword") == "If").alias("conditions")
    )


@query(
    """SELECT p_brand AS brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS position, 'p' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'block' ELSE 'inline' END AS rule_type,
    p_size::BIGINT AS size, p_partkey % 3 AS tags, coalesce('t' || nullif(p_partkey % 3, 0) || ' # no', '') AS last_tag FROM part"""
)
def mapping_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of nested mapping files, a file for each brand (SRC16)."""
    p = F.col("p_partkey")
    tags = F.when(p % 3 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(p % 3, F.lit(1))), lambda k: F.concat(F.lit('    - "t'), k, F.lit(' # no"\n'))), ""))
    source = F.when(p % 2 == 0, "source_ast_kind: A # b").otherwise("source_inline_kind: 'C: d'")
    entry = F.concat(F.lit("  - id: p"), p, F.lit("\n    "), source, F.lit("\n    size: {n: "), F.col("p_size"), F.lit(", of: [x, y]}\n    tags:\n"), tags, F.lit("\n"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("es"))
    texts = parts.select("path", F.concat(F.lit("# rules\nrules:\n"), F.array_join(F.transform("es", lambda e: e["e"]), "")).alias("text"))
    rules = mapping_rules(mapping_trees(texts))
    tags_of = F.coalesce(F.expr("try_variant_get(rule, '$.tags', 'array<string>')"), F.array().cast("array<string>"))
    return rules.select(
        F.col("path").alias("brand"), "position", "id", "rule_type", F.expr("try_variant_get(rule, '$.size.n', 'bigint')").alias("size"),
        F.size(tags_of).cast("long").alias("tags"), F.coalesce(F.try_element_at(tags_of, F.lit(-1)), F.lit("")).alias("last_tag"),
    )


@query(
    """WITH c AS (SELECT c_nationkey AS project, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    name AS (SELECT *, CASE WHEN r % 3 = 0 THEN 'sub/f' || r ELSE 'f' || r || '.tex' END AS path, floor(log2(r))::INTEGER AS depth FROM c)
    SELECT project, path, 'file' AS kind, depth FROM name
    UNION ALL SELECT project, CASE WHEN k % 3 = 0 THEN 'sub/' ELSE '' END || 'f' || k, 'missing', depth + 1 FROM name, (SELECT unnest([0, 1]) AS s), LATERAL (SELECT 2 * r + s AS k) WHERE k > n
    UNION ALL SELECT project, 'gone' || r, 'missing', depth + 1 FROM name WHERE r % 7 = 0
    UNION ALL SELECT project, path, 'cycle', depth FROM name WHERE project % 5 = 0 AND n >= 6 AND r IN (1, 3, 6)"""
)
def include_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each project's first one leads to, by their texts; includes of no file, and files in cycles (GR1, JN22)."""
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), rank.alias("r"))
    r, sub = F.col("r"), lambda k: F.when(k % 3 == 0, "sub/").otherwise("")
    target = lambda k: F.concat(sub(k), F.lit("f"), k)
    own = F.concat(target(r), F.when(r % 3 == 0, "").otherwise(".tex"))
    gone = F.when(r % 7 == 0, F.concat(F.lit(" \\include{gone"), r, F.lit("}"))).otherwise("")
    back = F.when((F.col("project") % 5 == 0) & (r == 6), "\\input{f1}\\input{f1}").otherwise("")
    text = F.concat(F.lit("% \\input{no}\n\\input{"), target(2 * r), F.lit("} text \\include{"), target(2 * r + 1), F.lit("}"), gone, back)
    files = c.select("project", own.alias("path"), text.alias("text"))
    return discovered(files, c.filter("r = 1").select("project", F.lit("f1.tex").alias("path")), [".tex"])
