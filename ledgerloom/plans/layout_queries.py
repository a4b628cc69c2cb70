"""Queries of the event, layout and tree families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import sequences as S
from ledgerloom.plans.registry import query, table

_SCAN = """scan AS (SELECT page_id, u.pos::BIGINT AS pos, u.tag FROM (SELECT page_id, unnest(list_transform(list_zip(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), range(len(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))), lambda z: {'tag': z[1], 'pos': z[2]})) AS u FROM pages))"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("pos", "tag")
    ).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_SCAN}, named AS (SELECT tag AS label, 0 AS source, page_id, pos FROM scan UNION ALL SELECT role, 1, conv_id, turn FROM conversations UNION ALL SELECT 'p', 1, conv_id, turn FROM conversations)
SELECT label, source, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY source, page_id, pos) AS n FROM named) WHERE n = 1""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a scan and of an event log together: of one label the first holds, the scan before the log, pages in order (SE1, SE4, SO7)."""
    turns = table(spark, sf_dir, "conversations")
    log = lambda label: turns.select(label.alias("label"), F.lit(1).alias("source"), F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"))
    scan = _scan(spark, sf_dir).select(F.col("tag").alias("label"), F.lit(0).alias("source"), "page_id", "pos")
    return S.first_occurrence(scan.unionByName(log(F.col("role"))).unionByName(log(F.lit("p"))), ["label"], ["source", "page_id", "pos"])


@query("""WITH d AS (SELECT a.conv_id, a.turn, a.role AS left_role, b.role AS right_role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn WHERE a.role <> b.role),
t AS (SELECT count(*) AS total FROM d) SELECT conv_id, turn, left_role, right_role, total FROM d, t ORDER BY conv_id, turn LIMIT 80""")
def bounded_differences(spark: SparkSession, sf_dir: str, most: int = 80) -> DataFrame:
    """The first differences in full, and the total of all beside them (SO6, Z11)."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("left_role"))
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("left_role").alias("right_role"))
    d = a.join(b, ["conv_id", "turn"]).filter("left_role <> right_role")
    top = d.orderBy("conv_id", "turn").limit(most).withColumn("k", F.lit(1))
    return top.join(d.agg(F.count("*").alias("total")).withColumn("k", F.lit(1)), "k").drop("k")


@query("""WITH g AS (SELECT event_id, (event_id * 7919) % 1048576 AS flags, event_type FROM events) SELECT event_id, coalesce(name, 'font' || (event_id % 9)) AS font,
CASE WHEN flags & 524288 <> 0 THEN flags & 65535 WHEN flags & 255 < 128 THEN flags & 255 ELSE -1 END AS code FROM g LEFT JOIN (VALUES (0, 'serif'), (1, 'sans'), (2, 'mono')) f(id, name) ON f.id = event_id % 9""")
def glyph_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs with their fonts, named by number where unknown, and their characters: flag 19, else ASCII, else -1 (JN17, GR7)."""
    fonts = F.broadcast(spark.createDataFrame([(0, "serif"), (1, "sans"), (2, "mono")], "id int, name string").coalesce(1))
    flags = F.col("event_id") * 7919 % 1048576
    code = F.when(flags.bitwiseAND(524288) != 0, flags.bitwiseAND(65535)).when(flags.bitwiseAND(255) < 128, flags.bitwiseAND(255)).otherwise(-1)
    met = table(spark, sf_dir, "events").select(
        "event_id",
        code.alias("code"),
        (F.col("event_id") % 9).alias("font_id")
    ).join(fonts, F.col("font_id") == F.col("id"), "left")
    return met.select("event_id", F.coalesce("name", F.concat(F.lit("font"), "font_id")).alias("font"), "code")


@query(
    """SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_and(value >= 0) AS all_positive, bool_or(value > 120) AS any_large, array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') AS kinds FROM events GROUP BY user_id"""
)
def template_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of many files folded by or and and, and the sorted set of what they name (RL8, AG10)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("any_error"),
        F.bool_and(F.col("value") >= 0).alias("all_positive"),
        F.bool_or(F.col("value") > 120).alias("any_large"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    )


@query(
    """SELECT conv_id, count(*) FILTER (length(trim(text)) > 0) AS blocks, count(*) AS nodes, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS leaves FROM conversations GROUP BY conv_id"""
)
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of blocks and lines: top-level blocks alone, all nodes, leaves that aren't blank (AG23, GR6, FLT10, AR1)."""
    trees = table(spark, sf_dir, "conversations").select("conv_id", F.col("text"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("children"))
    return trees.groupBy("conv_id").agg(F.count_if(F.length(F.trim("text")) > 0).alias("blocks"), F.count("*").alias("nodes"), F.sum(F.size("children")).alias("leaves"))


@query(
    """SELECT page_id, len(u)::BIGINT AS n_features, u[1] AS first_feature FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS u FROM pages)"""
)
def json_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array column written and read again (JS1, JS2, SNK10)."""
    features = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))
    stored = table(spark, sf_dir, "pages").select("page_id", F.to_json(features).alias("features"))
    read = F.from_json("features", "array<string>")
    return stored.select("page_id", F.size(read).cast("long").alias("n_features"), F.get(read, F.lit(0)).alias("first_feature"))


@query(
    f"WITH {_SCAN} SELECT page_id, pos, tag, CASE WHEN tag IN ('h1', 'title') THEN 'heading' WHEN tag IN ('p', 'li') THEN 'paragraph' WHEN tag IN ('ul', 'ol') THEN 'list' WHEN tag IN ('a', 'b', 'br') THEN 'inline' ELSE 'raw' END AS block, row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) AS number FROM scan"
)
def block_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as flat nodes: the block each becomes, raw for unknown ones, and its number among its kind (GR4, GR5, GR8, PRJ5, WN1)."""
    block = F.when(F.col("tag").isin("h1", "title"), "heading").when(F.col("tag").isin("p", "li"), "paragraph").when(F.col("tag").isin("ul", "ol"), "list").when(F.col("tag").isin("a", "b", "br"), "inline").otherwise("raw")
    numbered = S.running_numbers(_scan(spark, sf_dir), ["page_id"], ["pos"], "tag")
    return numbered.select("page_id", "pos", "tag", block.alias("block"), F.col("number").cast("long").alias("number"))
