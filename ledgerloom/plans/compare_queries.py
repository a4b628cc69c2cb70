"""Queries of the comparison and markup families; those without SQL are held against brute force and golden rows in tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import markup as M
from ledgerloom.functions import text as T
from ledgerloom.functions.macros import macros_expanded
from ledgerloom.operators import compare as C
from ledgerloom.plans.registry import query, table
from ledgerloom.sources.files import bbl_items, bib_entries


@query()
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each turn to the one before it (Q2)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(C.similarity(F.col("before"), F.col("text")), 6).alias("similarity"))


@query()
def doc_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation aligned with the next, paragraph by paragraph (Q1, Q3, Q6, SE5)."""
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p")
    ).select("conv_id", F.transform("p", lambda x: x["text"]).alias("left"))
    pairs = docs.join(docs.select((F.col("conv_id") - 1).alias("conv_id"), F.col("left").alias("right")), "conv_id")
    return C.compared(pairs, "left", "right").select("conv_id", *C.op_counts())


_LCS_SQL = """l(x, y, i, j, v) AS (
    SELECT x, y, 0, unnest(range(length(y) + 1)), 0 FROM xy
    UNION ALL
    SELECT x, y, i, j, max(best) OVER (PARTITION BY x, y ORDER BY j) FROM (
        SELECT x, y, i + 1 AS i, j, greatest(v, CASE WHEN j > 0 AND substr(x, i + 1, 1) = substr(y, j, 1) THEN lag(v) OVER (PARTITION BY x, y ORDER BY j) + 1 ELSE 0 END) AS best
        FROM l WHERE i < length(x))),
likeness AS (SELECT x, y, v / greatest(length(x), length(y)) AS similarity FROM l WHERE i = length(x) AND j = length(y))"""
_BARE_SQL = "replace(p_name, ' ', '')"


@query(
    f"""WITH RECURSIVE n AS (SELECT p_partkey, {_BARE_SQL} || p_size AS x, lead({_BARE_SQL} || p_size) OVER (ORDER BY p_partkey) AS y FROM part),
    xy AS (SELECT DISTINCT x, y FROM n WHERE y IS NOT NULL), {_LCS_SQL}
    SELECT p_partkey, round(similarity, 6) AS similarity FROM n JOIN likeness USING (x, y)"""
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each part's name and size to the next part's (Q2)."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" (", "p_name", "p_size").alias("x"))  # brackets and blanks don't count
    following = named.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return named.join(following, "p_partkey").select("p_partkey", F.round(C.similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE n AS (SELECT substr(p_brand, 7)::INTEGER AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_name || ' ' || p_size % 10 AS t, {_BARE_SQL} || p_size % 10 AS x FROM part),
    size AS (SELECT a.g, a.c AS m, b.c AS n FROM (SELECT g, count(*) AS c FROM n GROUP BY g) a JOIN (SELECT g - 1 AS g, count(*) AS c FROM n GROUP BY g) b USING (g)),
    t(g, i, j, v) AS (
        SELECT g, m, unnest(range(n + 1)), 0 FROM size
        UNION ALL
        SELECT g, i, j, max(best) OVER (PARTITION BY g ORDER BY j DESC) FROM (
            SELECT t.g, t.i - 1 AS i, t.j, greatest(v, CASE WHEN a.t = b.t THEN lag(v) OVER (PARTITION BY t.g ORDER BY t.j DESC) + 1 ELSE 0 END) AS best
            FROM t JOIN n a ON a.g = t.g AND a.k = t.i - 1 LEFT JOIN n b ON b.g = t.g + 1 AND b.k = t.j)),
    walk(g, s, i, j, kind) AS (
        SELECT g, -1, 0, 0, '' FROM size
        UNION ALL
        SELECT g, s + 1, i + (kind <> 'insert')::INT, j + (kind <> 'delete')::INT, kind FROM (
            SELECT w.g, s, w.i, w.j, CASE WHEN a.t = b.t THEN 'equal' WHEN coalesce(d.v, -1) >= coalesce(e.v, -1) THEN 'delete' ELSE 'insert' END AS kind
            FROM walk w JOIN size z ON z.g = w.g LEFT JOIN n a ON a.g = w.g AND a.k = w.i LEFT JOIN n b ON b.g = w.g + 1 AND b.k = w.j
            LEFT JOIN t d ON d.g = w.g AND d.i = w.i + 1 AND d.j = w.j LEFT JOIN t e ON e.g = w.g AND e.i = w.i AND e.j = w.j + 1
            WHERE w.i < m OR w.j < z.n)),
    ops AS (SELECT g, s, kind, CASE WHEN kind <> 'insert' THEN i - 1 END AS a, CASE WHEN kind <> 'delete' THEN j - 1 END AS b FROM walk WHERE s >= 0),
    near AS (SELECT *, lead(kind) OVER w AS other, coalesce(a, lead(a) OVER w) AS a2, coalesce(b, lead(b) OVER w) AS b2 FROM ops WINDOW w AS (PARTITION BY g ORDER BY s)),
    pairs AS (SELECT near.*, p.x, q.x AS y FROM near LEFT JOIN n p ON p.g = near.g AND p.k = a2 LEFT JOIN n q ON q.g = near.g + 1 AND q.k = b2),
    xy AS (SELECT DISTINCT x, y FROM pairs WHERE kind IN ('delete', 'insert') AND other IN ('delete', 'insert') AND kind <> other), {_LCS_SQL},
    good AS (SELECT pairs.*, similarity, kind <> other AND kind <> 'equal' AND other <> 'equal' AND similarity >= 0.82 AS is_good FROM pairs LEFT JOIN likeness USING (x, y)),
    runs AS (SELECT *, s - max(CASE WHEN is_good THEN NULL ELSE s END) OVER (PARTITION BY g ORDER BY s) AS place, min(s) OVER (PARTITION BY g) AS least FROM good),
    taken AS (SELECT *, coalesce(is_good, false) AND coalesce(place, s + 1) % 2 = 1 AS pairs_up FROM runs),
    kept AS (SELECT *, coalesce(lag(pairs_up) OVER (PARTITION BY g ORDER BY s), false) AS gone FROM taken)
    SELECT g AS brand, row_number() OVER (PARTITION BY g ORDER BY s) - 1 AS pos, CASE WHEN pairs_up THEN 'modified' ELSE kind END AS kind,
        coalesce(CASE WHEN pairs_up THEN a2 ELSE a END, -1)::BIGINT AS left_place, coalesce(CASE WHEN pairs_up THEN b2 ELSE b END, -1)::BIGINT AS right_place,
        CASE WHEN pairs_up THEN round(similarity, 6) WHEN kind = 'equal' THEN 1.0 END AS similarity
    FROM kept WHERE NOT gone"""
)
def name_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's part names aligned with the next brand's: equal, modified, deleted, inserted, in order (Q1-3, Q6, JN19, SE5)."""
    parts = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand"), F.struct("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size") % 10).alias("name")).alias("p"))
    lists = parts.groupBy("brand").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["name"]).alias("names"))
    pairs = lists.join(lists.select((F.col("brand") - 1).alias("brand"), F.col("names").alias("following")), "brand")
    found = C.compared(pairs, "names", "following").select("brand", F.posexplode("ops").alias("pos", "o"))
    place = lambda side: F.coalesce(F.col(f"o.{side}"), F.lit(-1)).cast("long").alias(f"{side}_place")
    return found.select("brand", F.col("pos").cast("long").alias("pos"), "o.kind", place("left"), place("right"), F.round("o.similarity", 6).alias("similarity"))


_RUN_SQL = r"""list_transform(string_split(text, ' '), lambda w: concat_ws('|', regexp_matches(w, '^[A-Z]'), ends_with(w, ','), CASE WHEN ends_with(w, '.') THEN 'single' ELSE '-' END,
CASE WHEN regexp_matches(w, '^[0-9]') THEN 'superscript' ELSE '-' END, CASE WHEN length(w) > 8 THEN '28' ELSE '24' END, CASE WHEN contains(w, '-') THEN 'Courier' ELSE 'Times' END, CASE WHEN regexp_matches(w, '[^ -~]') THEN 'Song' ELSE '-' END))"""


@query(rf"""WITH p AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '[\x09-\x0D ]+', ' ', 'g'), '^ | $', '', 'g') AS t, {_RUN_SQL} AS runs FROM conversations),
q AS (SELECT p.conv_id, p.turn, p.role <> n.role AS restyled, p.t = n.t AS same, p.runs AS a, n.runs AS b, least(len(p.runs), len(n.runs)) AS k FROM p JOIN p n ON n.conv_id = p.conv_id AND n.turn = p.turn + 2),
d AS (SELECT *, a[1:k] <> b[1:k] AS differs, list_sort(a) <> list_sort(b) AS resigned FROM q)
SELECT conv_id, turn, CASE WHEN NOT differs AND len(a) <> len(b) AND resigned AND same THEN 'SplitOnly' WHEN restyled OR differs THEN 'Real' WHEN same THEN 'SplitOnly' ELSE 'None' END AS kind, restyled::INT + resigned::INT AS changes FROM d""")
def format_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs whose words are runs: the kind of change to the next turn of the role, and how many fields changed (Q4, Q5)."""

    def run(w: Column) -> Column:
        either = lambda c, yes, no=None: F.when(c, yes).otherwise(F.lit(no).cast("string"))
        fields = {
            "text": w,
            "style": F.lit(None).cast("string"),
            "bold": w.rlike("^[A-Z]"),
            "italic": F.endswith(w, F.lit(",")),
            "underline": either(F.endswith(w, F.lit(".")), "single"),
            "vert_align": either(w.rlike("^[0-9]"), "superscript")
        }
        fields |= {
            "size": either(F.length(w) > 8, "28", "24"),
            "font_ascii": either(F.contains(w, F.lit("-")), "Courier", "Times"),
            "font_east_asia": either(w.rlike("[^ -~]"), "Song")
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    runs = F.transform(F.split("text", " "), run)
    p = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.struct(F.col("role").alias("style"), F.lit(False).alias("has_drawing"), F.col("text"), runs.alias("runs")).alias("p")
    )
    pairs = p.join(p.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("p").alias("q")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", C.format_kind(F.col("p"), F.col("q")).alias("kind"), F.size(C.format_changes(F.col("p"), F.col("q"))).alias("changes"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '<[^<>]*>', '', 'g'), '[ \\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS title FROM pages"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one heading of each page as text (ST20, ST36)."""
    title = F.regexp_replace(F.regexp_extract("html", r"<h1[^>]*>(.*?)</h1>", 1), "<[^<>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(title, r"[ \x09-\x0D]+", " ")).alias("title"))


def _as_markup(text: Column) -> Column:  # the tables hold no markup of this kind: it is put around their text
    head = F.regexp_replace(text, r"[\\{}$%~#&_^\n]", " ")
    return F.concat(
        F.lit("\\newcommand{\\me}{engine} % note\n\\section{"),
        F.col("lang"),
        F.lit("} \\textbf{\\emph{"),
        head,
        F.lit("}} by \\me, see \\ref{fig:1} and $\\alpha$")
    )


_WHITE_SQL = f"[{T.WHITE}]+"
_HEAD_SQL = r"(SELECT doc_id, lang, regexp_replace(text, '[\\{}$%~#&_^\n]', ' ', 'g') AS h FROM documents)"


@query(f"""SELECT doc_id, trim(regexp_replace(lang || ' ' || h || ' by engine, see fig:1 and α', '{_WHITE_SQL}', ' ', 'g')) AS plain FROM {_HEAD_SQL}""")
def latex_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole marked-up texts to plain text, macros expanded first (ST20, ST22)."""
    return table(spark, sf_dir, "documents").select("doc_id", M.plain_text(macros_expanded(_as_markup(F.col("text")))).alias("plain"))


@query(
    f"""SELECT doc_id, trim(regexp_replace(lang || ' ' || replace(replace(replace(replace(h, '``', '“'), chr(39) || chr(39), '”'), '---', '—'), '--', '–') || ' by engine, see 7 and α', '{_WHITE_SQL}', ' ', 'g')) AS plain FROM {_HEAD_SQL}"""
)
def latex_plain_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole marked-up texts to plain text by all steps, with references resolved (ST12)."""
    empty, labels = F.create_map().cast("map<string, bigint>"), F.create_map(F.lit("fig:1"), F.lit("7"))
    return table(spark, sf_dir, "documents").select("doc_id", M.latex_text(macros_expanded(_as_markup(F.col("text"))), empty, labels).alias("plain"))


@query(
    """SELECT item_id, 'k' || item_id AS key, 'T ' || length(text) AS title, CASE WHEN item_id >= 10 THEN 'J' || item_id ELSE 'P' END AS venue, 2 AS n_authors FROM benchmark"""
)
def bib_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written around the items' numbers and read again (SRC8, ST37, ST38)."""
    venue = F.when(F.col("item_id") >= 10, F.concat(F.lit("journal = \"J"), F.col("item_id"), F.lit("\""))).otherwise(F.lit("publisher = P"))
    source = F.concat(
        F.lit("% note\n@Article{k"),
        F.col("item_id"),
        F.lit(",\n title = {T {"),
        F.length("text"),
        F.lit("}},\n author = {A. B and C D},\n year = 2020,\n "),
        venue,
        F.lit("\n}")
    )
    entries = bib_entries(table(spark, sf_dir, "benchmark").select("item_id", source.alias("text")))
    return entries.select("item_id", "key", "title", "venue", F.size("authors").alias("n_authors"))


@query("SELECT item_id, 'k' || item_id AS key, 2 AS number, 'Second, ' || length(text) || '.' AS text FROM benchmark")
def bbl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""The second \bibitem of a list (SRC9)."""
    source = F.concat(F.lit("\\bibitem[x]{a} First.\n\\bibitem{k"), F.col("item_id"), F.lit("} Second,\n "), F.length("text"), F.lit(".\n\\end{thebibliography}"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(bbl_items(source)).alias("b"))
    return items.filter("b.number = 2").select("item_id", "b.key", "b.number", "b.text")


_LINES_SQL = rf"""(SELECT doc_id, i, line FROM (SELECT doc_id, lang, source, unnest(range(len(lines))) AS i, unnest(list_transform(lines, lambda l: trim(regexp_replace(regexp_replace(l, '[\\{{}}@%"]', ' ', 'g'), '[{T.WHITE}\x1c-\x1f]+', ' ', 'g')))) AS line
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)) WHERE line <> '')"""


def _clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, line): each document's lines, without marks that bibliographies give a meaning."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r'[\\{}@%"]', " "), rf"[{T.WHITE}\x1c-\x1f]+", " "))
    lines = F.transform(F.split("text", "\n", -1), clean)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "line")).filter("line <> ''")


@query(
    f"""SELECT doc_id, 'k' || i AS key, line AS title, CASE i % 4 WHEN 0 THEN 'Proc ' || i WHEN 1 THEN 'J ' || i WHEN 2 THEN 'P' END AS venue,
    array_to_string(list_transform(range(i % 3), lambda j: 'A ' || j), ';') AS authors, CASE WHEN i % 5 > 0 THEN (1990 + i % 30)::VARCHAR END AS year FROM {_LINES_SQL} WHERE i % 7 <> 6"""
)
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographies with an entry for each line of a document: its text in nested braces, quotes or open to the end (SRC8, ST37, ST38, Z8)."""
    i, line = F.col("i"), F.col("line")
    title = F.when(i % 2 == 0, F.concat(F.lit("{"), F.regexp_replace(line, "^(.)(.*)$", "{$1}$2"), F.lit("}"))).otherwise(F.concat(F.lit('"'), line, F.lit('"')))
    names = F.array_join(F.transform(F.when(i % 3 > 0, F.sequence(F.lit(0), i % 3 - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.lit("A "), j)), " and ")
    venues = {0: F.concat(F.lit(", booktitle = {Proc "), i, F.lit("}, journal = {no}")), 1: F.concat(F.lit(', JOURNAL = "J '), i, F.lit('"')), 2: F.lit(", publisher = P")}
    venue = F.when(i % 4 == 0, venues[0]).when(i % 4 == 1, venues[1]).when(i % 4 == 2, venues[2]).otherwise("")
    fields = F.concat(F.lit("\n Title = "), title, F.lit(",\n author={"), names, F.lit("}"), venue, F.when(i % 5 > 0, F.concat(F.lit(", year = "), 1990 + i % 30)).otherwise(""))
    # every seventh entry has no title and goes
    entry = F.concat(F.lit("% note @x{y}\n@article{k"), i, F.lit(","), F.when(i % 7 == 6, F.lit(" year = 1")).otherwise(fields), F.lit("\n}\n"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda x: x["e"]), "")
    found = bib_entries(_clean_lines(spark, sf_dir).groupBy("doc_id").agg(entries.alias("text")))
    return found.select("doc_id", "key", "title", "venue", F.array_join("authors", ";").alias("authors"), "year")


@query(f"SELECT doc_id, 'k' || i AS key, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number, line AS text FROM {_LINES_SQL}")
def bibliography_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Formatted bibliographies with an item for each line of a document, numbered in order (SRC9)."""
    item = F.concat(F.lit("\\bibitem"), F.when(F.col("i") % 2 == 0, "[x]").otherwise(""), F.lit("{k"), F.col("i"), F.lit("}\n  "), F.col("line"), F.lit("\n"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("t")))), lambda x: x["t"]), "")
    docs = _clean_lines(spark, sf_dir).groupBy("doc_id").agg(F.concat(items, F.lit("\\end{thebibliography} rest")).alias("text"))
    found = docs.select("doc_id", F.explode(bbl_items(F.col("text"))).alias("b"))
    return found.select("doc_id", "b.key", F.col("b.number").cast("long").alias("number"), "b.text")
