"""Readers of archives, folders, event lines, documents and bibliographies, and partitioned writers.

Bytes are parsed inside tasks, a file a row; nothing is opened on the driver, so any store Spark reads will do.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from ledgerloom.operators.compare import RUN
from ledgerloom.operators.lineage import cut

EVENT = "type string, level int, text string, label string, path string, caption string, latex string, display boolean, keys array<string>, key string, kind string, macro string, schema string"
BIB = ArrayType(StructType([StructField("entry_type", StringType()), StructField("key", StringType()), StructField("fields", MapType(StringType(), StringType()))]))
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path relative and with forward slashes, content) of all files below a folder (SRC4)."""
    root = path.rstrip("/") + "/"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", root, 2), -1).alias("path"), "content")


def zip_entries(archives: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """(archive, path, content) of every entry; a broken archive or a name with .. is an error (SRC3, SRC11)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for archive, data in zip(f["archive"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for entry in z.infolist():  # an entry at a time
                        if ".." in entry.filename.split("/"):
                            raise ValueError(f"{archive}: unsafe name {entry.filename}")
                        if not entry.is_dir():
                            yield pd.DataFrame({"archive": [archive], "path": [entry.filename], "content": [z.read(entry)]})

    return archives.select(F.col(name).alias("archive"), F.col(content).alias("content")).mapInPandas(run, "archive string, path string, content binary")


def event_lines(lines: DataFrame, schema: str = EVENT, line: str = "value") -> DataFrame:
    """Events of JSON lines; blank lines, # lines and headers without a type are skipped, anything else that is no JSON is an error (SRC5, Z10)."""
    rows = lines.select(F.trim(line).alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    return rows.select(F.from_json("v", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*").filter(F.col("type").isNotNull())


def last_page(nodes: DataFrame, keys: list[str], order: str, page: str = "page") -> DataFrame:
    """nodes with the last page known so far (SRC6, WN11, Z9 corrected)."""
    return nodes.withColumn(page, F.last(page, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order)))


def paragraphs_of(xml: bytes) -> list[dict]:
    """Paragraphs with their runs and the formats of those; a switch without a value is on."""
    out = []
    for i, p in enumerate(ET.fromstring(xml).iter(f"{_W}p")):
        style, runs = p.find(f"{_W}pPr/{_W}pStyle"), []
        for r in p.iter(f"{_W}r"):
            props = {c.tag.removeprefix(_W): c for c in (r.find(f"{_W}rPr") if r.find(f"{_W}rPr") is not None else [])}
            value = lambda tag, name="val", props=props: props[tag].get(f"{_W}{name}") if tag in props else None
            switch = lambda tag, props=props: tag in props and (props[tag].get(f"{_W}val") or "true").lower() not in ("0", "false", "off", "none")
            runs.append(
                {
                    "text": "".join(t.text or "" for t in r.iter(f"{_W}t")), "style": value("rStyle"), "bold": switch("b"), "italic": switch("i"),
                    "underline": (value("u") or "single") if "u" in props else None, "vert_align": value("vertAlign"), "size": value("sz"),
                    "font_ascii": value("rFonts", "ascii") or value("rFonts", "hAnsi"), "font_east_asia": value("rFonts", "eastAsia"),
                }
            )
        out.append(
            {
                "index": i,
                "style": style.get(f"{_W}val") if style is not None else None,
                "text": "".join(r["text"] for r in runs),
                "has_drawing": next(p.iter(f"{_W}drawing"), None) is not None,
                "runs": runs
            }
        )
    return out


def docx_paragraphs(entries: DataFrame) -> DataFrame:
    """(archive, index, style, text, has_drawing, runs) of the document part of each archive (SRC12)."""
    kind = f"archive string, index int, style string, text string, has_drawing boolean, runs array<{RUN}>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for archive, xml in zip(f["archive"], f["content"]):
                yield pd.DataFrame([{"archive": archive, **p} for p in paragraphs_of(xml)], columns=["archive", "index", "style", "text", "has_drawing", "runs"])

    return entries.filter(F.col("path") == "word/document.xml").select("archive", "content").mapInPandas(run, kind)


def _balanced(s: str, at: int) -> int:
    """Where the brace at `at` closes; the end if it doesn't."""
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "{" and s[i - 1] != "\\") - (s[i] == "}" and s[i - 1] != "\\")
        if depth == 0:
            return i
    return len(s)


def bib_entries_of(source: str) -> list[dict]:
    """Entries of a bibliography: values in nested braces, quotes or bare; an unclosed entry ends with the text (SRC8)."""
    source, out = re.sub(r"(?m)^\s*%.*$", "", source), []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,?", source):
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        end = _balanced(source, source.index("{", m.start()))
        body, at, fields = source[m.end() : end], 0, {}
        while f := re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*").match(body, at):
            v = f.end()
            if body[v : v + 1] == "{":
                close = _balanced(body, v)
                value, at = body[v + 1 : close], close + 1
            elif body[v : v + 1] == '"':
                close = body.find('"', v + 1)
                close = len(body) if close < 0 else close
                value, at = body[v + 1 : close], close + 1
            else:
                bare = re.compile(r"[^,\n}]*").match(body, v)
                value, at = bare[0].strip(), bare.end()
            fields.setdefault(f[1].lower(), re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip())
        out.append({"entry_type": m[1].lower(), "key": m[2], "fields": fields})
    return out


@F.pandas_udf(BIB)
def _bib(x: pd.Series) -> pd.Series:
    return pd.Series([bib_entries_of(s or "") for s in x])


def bib_entries(sources: DataFrame, text: str = "text") -> DataFrame:
    """One row an entry: entry_type, key, title, authors, year, venue; entries without a title go (SRC8, SRC10, ST37, ST38, Z8)."""
    f = F.col("e.fields")
    get = lambda k: F.try_element_at(f, F.lit(k))
    rows = sources.select(*[c for c in sources.columns if c != text], F.explode(_bib(text)).alias("e"))
    venue = F.coalesce(get("booktitle"), get("journal"), get("publisher"))
    authors = F.filter(F.transform(F.split(F.coalesce(get("author"), F.lit("")), r"\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(
        *[c for c in rows.columns if c != "e"],
        "e.entry_type",
        "e.key",
        get("title").alias("title"),
        authors.alias("authors"),
        get("year").alias("year"),
        venue.alias("venue")
    ).filter(F.col("title").isNotNull())


def bib_texts(sources: DataFrame, text: str = "text") -> DataFrame:
    """(…, key, text) of each entry as a plain citation: authors, title, venue with volume, number and pages, year (SRC10).

    Authors stand as they are given, joined by commas; parts that an entry lacks are left out with their marks.
    """
    f = F.col("e.fields")
    get = lambda k: F.nullif(F.trim(F.regexp_replace(F.coalesce(F.try_element_at(f, F.lit(k)), F.lit("")), "[{}]", "")), F.lit(""))
    quoted = lambda x: F.replace(F.replace(x, F.lit("``"), F.lit("“")), F.lit("''"), F.lit("”"))
    authors = F.array_join(F.transform(F.split(get("author"), r"\s+and\s+"), lambda a: F.trim(a)), ", ")
    issue = F.concat(get("volume"), F.coalesce(F.concat(F.lit("("), get("number"), F.lit(")")), F.lit("")))
    venue = F.nullif(F.concat_ws(", ", F.coalesce(get("journal"), get("booktitle")), issue), F.lit(""))
    pages = F.replace(get("pages"), F.lit("--"), F.lit("–"))
    venue = F.nullif(F.concat_ws(": ", venue, pages), F.lit(""))
    dotted = lambda x: F.concat(x, F.lit("."))
    rows = sources.select(*[c for c in sources.columns if c != text], F.explode(_bib(text)).alias("e"))
    return rows.select(
        *[c for c in rows.columns if c != "e"],
        "e.key",
        F.concat_ws(" ", authors, dotted(quoted(get("title"))), dotted(venue), dotted(get("year"))).alias("text")
    )


def bbl_items(x: Column) -> Column:
    r"""Items of a formatted bibliography, in order: key, number, text (SRC9)."""
    found = lambda g: F.regexp_extract_all(x, F.lit(r"(?s)\\bibitem(?:\[[^\]]*\])?\{([^{}]*)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\z)"), F.lit(g))
    return F.transform(
        F.arrays_zip(found(1).alias("k"), found(2).alias("t")),
        lambda p, i: F.struct(p["k"].alias("key"), (i + 1).alias("number"), F.trim(F.regexp_replace(p["t"], r"\s+", " ")).alias("text"))
    )


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header, however many segments stand before it; markers may have fill bytes in front."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5 : at + 9])[::-1] if at + 9 <= len(data) else None
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:  # no length
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _image_size(data: bytes | None) -> tuple[int, int] | None:
    if data is not None and data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    return _jpeg_size(data) if data is not None and data[:3] == b"\xff\xd8\xff" else None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _image_sizes(content: pd.Series) -> pd.DataFrame:
    found = [_image_size(x) or (None, None) for x in content]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")


def image_size(content: Column) -> Column:
    """(width, height) of a PNG or JPEG, from its headers; null for anything else (SRC18)."""
    size = _image_sizes(content)
    return F.when(size["width"].isNotNull(), size)


def write_artifacts(df: DataFrame, path: str, by: str) -> None:
    """Files kept by job; a second write adds to them (SNK1, SNK7, SNK12)."""
    df.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def inserted(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """df appended to the table at `path`; returned are the rows written, read back (SNK1)."""
    batch = uuid.uuid4().hex
    df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(df.schema).parquet(f"{path}/batch={batch}")


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's place in `order`, from 0: rows are dealt by ranges of the order and numbered within, and a range's
    first number is the sum of the counts before it, of which there is one for each partition.
    """
    within = (1 << 33) - 1  # of monotonically_increasing_id
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy(part.alias("__part")).count().withColumn("__start", F.coalesce(before, F.lit(0))).select("__part", "__start")
    met = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return met.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit(within))).drop("__id", "__part", "__start")


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, value): the lines of a Markdown table of a report's rows, header first (SNK9, ST32)."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.range(2).select(
        F.col("id").alias("n"),
        F.when(F.col("id") == 0, row([F.lit(c) for c in df.columns])).otherwise(row([F.lit("---")] * len(df.columns))).alias("value")
    )
    body = numbered(df, order, "__n").select((F.col("__n") + 2).cast("long").alias("n"), row([cell(c) for c in df.columns]).alias("value"))
    return head.union(body)


def registry_json(rules: DataFrame, order: list[str]) -> DataFrame:
    """One row, value: the rules or audit records as one JSON array in order; their number is that of the rules (SNK10)."""
    rows = rules.select(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rules.columns if c not in order]).alias("r"))
    return rows.agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value"))


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, output, position) of a JSON array of rules; of one name the last holds, see rules.registry (SRC15)."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "array<struct<name: string, output: string>>", {"mode": "FAILFAST"})
    return text.select(F.posexplode(entries).alias("position", "r")).select("r.name", "r.output", "position")


_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#&*!|>'"%@`\[\]{},-][^#]*?|-[^\s#][^#]*?))\s*:(?=\s|$)""")


def _scalar(text: str) -> object:
    """A value as JSON has it: quoted text, a flow list or map, null, a truth value, a number, or plain text without its comment."""
    text = text.strip()
    if text[:1] == '"':
        stop = re.match(r'"(?:[^"\\]|\\.)*"', text)
        return json.loads(stop[0]) if stop else text
    if text[:1] == "'":
        stop = re.match(r"'(?:[^']|'')*'", text)
        return stop[0][1:-1].replace("''", "'") if stop else text
    if text[:1] in ("[", "{"):
        return _flow(text)[0]
    text = re.sub(r"\s+#.*$|^#.*$", "", text).strip()
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?(?:0|[1-9][0-9]*)", text):
        return int(text)
    return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else text


_FLOW = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[\[\]{},]|:(?=\s|$)|(?:[^\[\]{},:\s]|:(?=\S)|\s+(?=[^\[\]{},:\s]))+)""")


def _flow(text: str) -> tuple[object, int]:
    """A list or map in brackets, and where it ends; what is open stands on a stack."""
    at, stack, out = 0, [], None
    while m := _FLOW.match(text, at):
        at, token = m.end(), m[1]
        if token in "[{":
            stack.append([token, [], None])
        elif token in "]}":
            made = stack.pop()
            value = made[1] if made[0] == "[" else dict(made[1])
            if not stack:
                return value, at
            _put(stack[-1], value)
        elif token == ":":
            stack[-1][2] = stack[-1][1].pop() if stack[-1][0] == "[" else stack[-1][2]
        elif token != ",":
            _put(stack[-1], _scalar(token))
    return out, at


def _put(open_one: list, value: object) -> None:
    """A value of an open list; of an open map a key first and then its value."""
    if open_one[0] == "[":
        open_one[1].append(value)
    elif open_one[2] is None:
        open_one[2] = value
    else:
        open_one[1].append((open_one[2], value))
        open_one[2] = None


def mapping_tree(text: str) -> object:
    """What a file of nested maps and lists says: an indentation parser for YAML without anchors, tags and several documents.

    Deeper lines belong to the key or dash before them; a list may stand as deep as its key.  Blocks of text after `|` keep
    their lines and after `>` fold them.  Of a key that stands twice the last value holds.  Lines that are none of this are
    part of the text before them.
    """
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.replace("\t", "  ").splitlines()]
    root: dict = {"value": None}
    stack: list[tuple[int, object, object]] = [(-1, root, "value")]  # indent, container, where in it the next value goes
    k = 0
    while k < len(lines):
        indent, line = lines[k]
        k += 1
        if not line or line[0] == "#" or line in ("---", "..."):
            continue
        while stack[-1][0] >= indent and not (stack[-1][0] == indent and (line == "-" or line.startswith("- ")) and stack[-1][2] is not None and isinstance(stack[-1][1], dict)):
            stack.pop()
        while True:
            _, holder, slot = stack[-1]
            if line == "-" or line.startswith("- "):
                if not isinstance(holder[slot], list):
                    holder[slot] = []
                holder[slot].append(None)
                stack.append((indent, holder[slot], len(holder[slot]) - 1))
                rest = line[1:].lstrip()
                indent, line = indent + len(line) - len(rest), rest
                if line and line[0] != "#":
                    continue
            elif m := _KEY.match(line):
                key = json.loads(f'"{m[1]}"') if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3].strip()
                if not isinstance(holder[slot], dict):
                    holder[slot] = {}
                holder[slot][key] = None
                stack.append((indent, holder[slot], key))
                rest = line[m.end() :].strip()
                if rest[:1] in ("|", ">"):
                    body = []
                    while k < len(lines) and (not lines[k][1] or lines[k][0] > indent):
                        body.append(lines[k])
                        k += 1
                    least = min((i for i, x in body if x), default=0)
                    held = [" " * (i - least) + x if x else "" for i, x in body]
                    while held and not held[-1]:
                        held.pop()
                    holder[slot][key] = ("\n" if rest[0] == "|" else " ").join(held) + ("" if rest[1:2] == "-" else "\n")
                elif rest and rest[0] != "#":
                    holder[slot][key] = _scalar(rest)
            else:
                value = _scalar(line)
                holder[slot] = f"{holder[slot]} {value}" if isinstance(holder[slot], str) else value
            break
    return root["value"]


@F.pandas_udf(StringType())
def _mapping_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(mapping_tree(t), ensure_ascii=False))


def mapping_trees(files: DataFrame) -> DataFrame:
    """(path, tree) of files (path, text): nested maps and lists as a variant, all keys kept (SRC16)."""
    return files.select("path", F.parse_json(_mapping_json("text")).alias("tree"))


def mapping_tree_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, tree) of the mapping files at a path (SRC16)."""
    return mapping_trees(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def mapping_rules(files: DataFrame) -> DataFrame:
    """(path, position, id, source_kind, target_kind, style, rule_type, rule) of mapping files (SRC16).

    A rule's type is its own, or else `inline` where it names an inline source, `resource` where it has a relationship rule,
    and `block` otherwise; rule is the whole entry, with the keys that nothing here knows.
    """
    rules = files.select("path", F.expr("posexplode(cast(try_variant_get(tree, '$.rules', 'array<variant>') AS array<variant>))").alias("position", "rule"))
    get = lambda k: F.try_variant_get("rule", f"$.{k}", "string")
    kind = F.coalesce(get("source_ast_kind"), get("source_inline_kind"), F.lit(""))
    related = F.try_variant_get("rule", "$.relationship_rule", "variant").isNotNull()
    guessed = F.when(get("source_inline_kind").isNotNull(), "inline").when(related, "resource").otherwise("block")
    return rules.select("path", "position", get("id").alias("id"), kind.alias("source_kind"), get("target_render_node").alias("target_kind"), get("style_from_profile").alias("style"), F.coalesce(get("rule_type"), guessed).alias("rule_type"), "rule")


def mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """(position, rule) of a mapping file that is a list, or has one under `rules`; rule is a map of its flat values (SRC16)."""
    tree = mapping_tree_file(spark, path).select(F.expr("coalesce(try_variant_get(tree, '$.rules', 'array<variant>'), try_variant_get(tree, '$', 'array<variant>'))").alias("rules"))
    return tree.select(F.posexplode("rules").alias("position", "r")).select("position", F.expr("try_variant_get(r, '$', 'map<string, string>')").alias("rule"))


def write_report(df: DataFrame, path: str, form: str = "json", order: list[str] | None = None) -> None:
    """Report rows as JSON lines, as CSV with a header, which spreadsheets open, or as a Markdown table, whose files are in order (SNK8, SNK9, SNK10)."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        markdown_lines(df, order or df.columns).orderBy("n").select("value").write.mode("overwrite").text(path)
