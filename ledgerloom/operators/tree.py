r"""Tokens, indexes, layouts and trees of rows (tree, node, parent, pos), which are walked a level at a time.

Trees and blocks of marked-up documents are made by `syntax`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import markup as M
from ledgerloom.functions import text as T
from ledgerloom.operators.lineage import cut

_TOKENS = {
    "comment": r"%[^\n]*",
    "begin": r"\\begin\{[A-Za-z*]+\}",
    "end": r"\\end\{[A-Za-z*]+\}",
    "command": r"\\(?:[A-Za-z@]+\*?|[\s\S])",
    "open": r"\{",
    "close": r"\}",
    "math": r"\$\$?",
    "space": r"\s+",
    "text": r"[^%\\{}$\s]+|\\\z"
}


def tokens(x: Column) -> Column:
    """Array of (kind, text): the text's tokens, which joined are the text again (GR9)."""
    pieces = F.regexp_extract_all(x, F.lit("|".join(_TOKENS.values())), F.lit(0))
    kind = lambda p: F.coalesce(*[F.when(p.rlike(rf"^(?:{pattern})$"), name) for name, pattern in _TOKENS.items()], F.lit("text"))
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("kind"), p.alias("text")))


# fixed values: what environments become
BLOCKS = {
    "list": "itemize enumerate description list", "table": "tabular array", "captioned": "figure table algorithm", "equation": "equation align gather",
    "theorem": "theorem proof proposition lemma corollary definition remark example",
}


def numbering_index(blocks: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """(keys, pos, kind, number): running numbers of the blocks of each kind that are numbered (GR5, WN1)."""
    numbered = blocks.filter(F.col("kind").isin("captioned", "equation", "theorem", "heading"))
    return numbered.select(*keys, order, "kind", F.row_number().over(Window.partitionBy(*keys, "kind", "name").orderBy(order)).alias("number"))


def resource_index(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    r"""(keys, kind, target, pos): graphics, includes, cited keys and bibliographies that a document names, first occurrences in order (GR5)."""
    kinds = {"graphic": "includegraphics", "include": "(?:input|include)", "citation": "cite[a-z]*", "bibliography": "bibliography"}
    listed = lambda k, v: F.flatten(F.transform(v, T.split_keys)) if k in ("citation", "bibliography") else v
    entry = lambda k: lambda v, i: F.struct(F.lit(k).alias("kind"), v.alias("target"), i.alias("pos"))
    found = F.concat(*[F.transform(listed(k, T.command_arguments(F.col(text), c)), entry(k)) for k, c in kinds.items()])
    rows = documents.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*")
    return rows.groupBy(*keys, "kind", "target").agg(F.min("pos").alias("pos"))


def visited(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """nodes (tree, node, parent, pos, ...) with (depth, path) of those that a root, a node without parent, leads to (GR6).

    Ordered by path they are in the order a visitor meets them: lists and table cells before what follows them.  One join
    a level, each level kept; a node in a cycle is never reached.
    """
    columns = nodes.columns
    level = cut(nodes.filter(F.col("parent").isNull()).withColumns({"depth": F.lit(0), "path": F.array("pos")}))
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select(F.col(tree), F.col("node").alias("parent"), F.col("path").alias("__path"))
        level = cut(
            nodes.join(above, [tree, "parent"]).withColumns({"depth": F.lit(depth), "path": F.concat("__path", F.array("pos"))}).select(*columns, "depth", "path")
        )
        found = found.union(level)
    return found


NODE = "type string, id string, kind string, page int, x double, y double, width double, height double, text string, font string, path string"


def layout_nodes(lines: DataFrame, keys: list[str], order: str, line: str = "value", as_summed_up: bool = False) -> DataFrame:
    """(keys, order, id, kind, page, x, y, width, height, text, font, path) of the node lines of layouts (GR8, SRC6).

    Blank lines, # lines and headers are skipped, anything else that is no JSON is an error.  Nodes are on the page named
    last before them; with `as_summed_up` all are on the last page that their file names anywhere (Z9).
    """
    rows = lines.filter((F.trim(line) != "") & ~F.trim(line).startswith("#")).select(*keys, order, F.from_json(F.trim(line), NODE, {"mode": "FAILFAST"}).alias("n"))
    w = Window.partitionBy(*keys).orderBy(order)
    page = F.last("n.page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if as_summed_up else w)
    kind = F.when(F.col("n.kind").isin("text", "rule", "image", "box"), F.col("n.kind")).otherwise("other")
    fields = [F.col(f"n.{c}") for c in ("x", "y", "width", "height", "text", "font", "path")]
    return rows.withColumn("page", page).filter(F.col("n.type") == "node").select(*keys, order, "n.id", kind.alias("kind"), "page", *fields)


def front_matter(x: Column, title: str = "title", author: str = "author", institute: str = "institute") -> Column:
    r"""(title, authors, institutes, abstract, keywords) of a document's head; authors stand between \and (ST36)."""
    split = lambda v, by: F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), by), lambda a: T.collapsed(M.plain_text(a))), lambda a: a != "")
    abstract = F.regexp_extract(x, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)
    keywords = F.coalesce(M.command_argument(x, "keywords"), M.command_argument(x, "IEEEkeywords"), F.lit(""))
    return F.struct(
        M.plain_text(M.command_argument(x, title)).alias("title"),
        split(M.command_argument(x, author), r"\\and(?![A-Za-z])").alias("authors"),
        split(M.command_argument(x, institute), r"\\and(?![A-Za-z])|\\\\").alias("institutes"),
        F.nullif(M.plain_text(abstract), F.lit("")).alias("abstract"),
        split(keywords, "[,;]").alias("keywords")
    )


def biographies(x: Column) -> Column:
    r"""Array of (name, text) of the biographies at a document's end (ST36)."""
    pattern = r"(?s)\\begin\{(?:IEEE)?biography\}(?:\[[^\]]*\])?\{([^{}]*)\}(.*?)\\end\{(?:IEEE)?biography\}"
    found = lambda g: F.regexp_extract_all(x, F.lit(pattern), F.lit(g))
    return F.zip_with(found(1), found(2), lambda n, t: F.struct(T.collapsed(n).alias("name"), T.collapsed(t).alias("text")))
