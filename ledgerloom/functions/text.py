"""Column functions over text: normal forms, ratios, comments, links, codes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by name, ASCII and other, so that engines agree on it.
WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WHITE_CHARACTERS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NBSP, DASHES, QUOTES, QUOTE_FORMS = "\u00a0", "\u2013\u2014", "\u2018\u2019\u201c\u201d", "''\"\""
CODE_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(x: Column) -> Column:
    """Dashes and quotes to their ASCII forms, all white space deleted (ST1)."""
    return F.translate(x, DASHES + QUOTES + WHITE_CHARACTERS, "--" + QUOTE_FORMS)


def collapsed(x: Column) -> Column:
    """White space runs to one space, ends trimmed (ST2, ST18)."""
    return F.trim(F.regexp_replace(x, f"[{WHITE}]+", " "))


def canonical(x: Column) -> Column:
    """Without white space and round brackets, ASCII or full width (ST3)."""
    return F.regexp_replace(x, f"[{WHITE}()\\x{{FF08}}\\x{{FF09}}]", "")


def preview(x: Column, n: int) -> Column:
    """At most n characters of the collapsed text, with dots if there were more (ST4)."""
    c = collapsed(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def char_ratio(a: Column, b: Column) -> Column:
    """Length of normalized a over that of b, 0 if b is empty (ST5, Z1)."""
    lb = F.length(normalize(b))
    return F.when(lb == 0, 0.0).otherwise(F.length(normalize(a)) / lb)


def without_comments(x: Column, keep_escaped: bool = True, whole_lines: bool = False, join_lines: bool = False) -> Column:
    """Lines cut at their first % that an even number of backslashes precedes (ST6, ST7).

    The variants: any % cuts where not `keep_escaped`; lines that are comments as a whole go with their line end under
    `whole_lines`; and under `join_lines` a comment takes the line end and the next line's indent with it.
    """
    if not keep_escaped:
        return F.regexp_replace(x, r"%[^\n]*", "")
    if whole_lines:
        x = F.regexp_replace(x, r"(?m)^[ \t]*%[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(x, r"(?m)(?<!\\)((?:\\\\)*)%[^\n]*" + (r"(?:\n[ \t]*)?" if join_lines else ""), "$1")


def split_keys(x: Column) -> Column:
    """Comma-separated keys, trimmed, empty ones dropped (ST11)."""
    return F.filter(F.transform(F.split(x, ","), lambda k: F.trim(k)), lambda k: k != "")


def label_kind(key: Column) -> Column:
    """What a label's prefix says it names (ST25)."""
    kinds = {
        "figure": ("fig:", "figure:"),
        "table": ("tab:", "table:", "tbl:"),
        "equation": ("eq:", "equation:"),
        "algorithm": ("alg:", "algorithm:"),
        "theorem": ("thm:", "theorem:"),
        "proposition": ("prop:", "proposition:"),
        "section": ("sec:", "section:")
    }
    out = None
    for kind, prefixes in kinds.items():
        hit = reduce(lambda a, b: a | b, [F.lower(key).startswith(p) for p in prefixes])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def posix_path(x: Column) -> Column:
    """Slashes forward, no ./ and no doubled slashes (ST26)."""
    return F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1"), "/{2,}", "/")


def extension_is(path: Column, extensions: list[str]) -> Column:
    """Whether a path ends in one of the extensions, whatever their case (FLT8)."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(extensions)


def code_normal(x: Column) -> Column:
    """A typed code without white space and dashes, upper case, look-alike letters as digits (ST27)."""
    return F.translate(F.upper(F.regexp_replace(x, r"[\s-]", "")), "OIL", "011")


def code_valid(normal: Column, prefix: str, least: int = 20) -> Column:
    """Whether a normalized code has its prefix, length and checksum (ST27, HS3)."""
    body = F.substr(normal, F.lit(1), F.length(normal) - 2)
    return normal.startswith(prefix) & (F.length(normal) >= least) & (code_checksum(body) == F.right(normal, F.lit(2)))


def code_grouped(x: Column) -> Column:
    """Groups of four with dashes between (ST28)."""
    return F.regexp_replace(x, "(.{4})(?=.)", "$1-")


def code_preview(x: Column) -> Column:
    """First eight and last four characters of a code of more than twelve (ST29)."""
    c = F.replace(x, F.lit("-"))
    return F.when(F.length(c) <= 12, c).otherwise(F.concat(F.left(c, F.lit(8)), F.lit("****"), F.right(c, F.lit(4))))


def code_checksum(body: Column) -> Column:
    """Two base-32 digits of a text's SHA-256: its first ten bits (HS3, HS4)."""
    bits = F.conv(F.substring(F.sha2(body.cast("binary"), 256), 1, 4), 16, 10).cast("int")
    digit = lambda v: F.substr(F.lit(CODE_ALPHABET), v + 1, F.lit(1))
    return F.concat(digit(F.shiftright(bits, 11)), digit(F.shiftright(bits, 6).bitwiseAND(31)))


def peppered(code: Column, pepper: str) -> Column:
    """SHA-256 of pepper:code (HS2)."""
    return F.sha2(F.concat_ws(":", F.lit(pepper), code), 256)


def xml_escaped(x: Column) -> Column:
    """With &, <, > and quotes as entities (ST32)."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def paragraph_boundaries(x: Column) -> Column:
    """Two and more blank lines as one (ST19)."""
    return F.regexp_replace(x, r"\n(?:[ \t]*\n){2,}", "\n\n")


def command_arguments(x: Column, command: str) -> Column:
    r"""Arguments of \command{..} without nested braces, options skipped (ST8, ST9)."""
    return F.regexp_extract_all(x, F.lit(r"\\" + command + r"(?![A-Za-z@])\s*(?:\[[^\]]*\]\s*)*\{([^{}]*)\}"), F.lit(1))


def commands_with_options(x: Column, command: str) -> Column:
    r"""Array of (options, argument) of \command[..]{..}; options is null without brackets (ST9)."""
    pattern = r"\\" + command + r"(?![A-Za-z@])\s*(?:\[([^\]]*)\]\s*)?\{([^{}]*)\}"
    found = lambda g: F.regexp_extract_all(x, F.lit(pattern), F.lit(g))
    bracketed = F.transform(found(0), lambda m: m.rlike(r"^\\[A-Za-z@]+\s*\["))
    both = F.arrays_zip(found(1).alias("o"), found(2).alias("a"), bracketed.alias("b"))
    return F.transform(both, lambda p: F.struct(F.when(p["b"], p["o"]).alias("options"), p["a"].alias("argument")))


def same_word(a: Column, b: Column) -> Column:
    """Whether two names are equal but for the case of A-Z (ST24)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(a, upper, upper.lower()) == F.translate(b, upper, upper.lower())


def fitted_extent(width: Column, height: Column, most: int = 5_274_310, dots: int = 96) -> Column:
    """(cx, cy) in EMU of an image of so many pixels, scaled down to the width that the text has (MA4)."""
    emu = lambda n: (n * (914_400 // dots)).cast("double")
    share = F.least(F.lit(1.0), most / F.greatest(emu(width), F.lit(1.0)))
    return F.struct(F.round(emu(width) * share).cast("long").alias("cx"), F.round(emu(height) * share).cast("long").alias("cy"))


def twips(millimetres: Column) -> Column:
    """Twentieths of a point in so many millimetres (MA4)."""
    return F.round(millimetres * 56.6929133858).cast("long")


def residue_count(x: Column) -> Column:
    """Marks that markup leaves in text: commands, math, tags, entities (ST33)."""
    return F.regexp_count(x, F.lit(r"\\[A-Za-z]+|\$[^$\n]+\$|</?[A-Za-z][^<>]*>|&[a-z]+;"))


def compressed_ranges(numbers: Column) -> Column:
    """An array of integers as sorted ranges: 1-3,5 (WN7)."""
    s = F.array_sort(F.array_distinct(numbers))
    step = lambda a, n: F.when(F.size(a) == 0, F.array(F.struct(n.alias("lo"), n.alias("hi")))).when(
        F.element_at(a, -1)["hi"] + 1 == n,
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["lo"].alias("lo"), n.alias("hi"))))
    ).otherwise(F.concat(a, F.array(F.struct(n.alias("lo"), n.alias("hi")))))
    ranges = F.aggregate(s, F.array().cast("array<struct<lo: bigint, hi: bigint>>"), lambda a, n: step(a, n.cast("long")))
    one = lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat_ws("-", r["lo"], r["hi"]))
    return F.array_join(F.transform(ranges, one), ",")


_WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"


def display_width(x: Column) -> Column:
    """Columns a text takes: two for each wide character (ST31)."""
    return F.length(x) + F.regexp_count(x, F.lit(_WIDE))


def without_wide_spaces(x: Column) -> Column:
    """Spaces between two wide characters dropped (ST31)."""
    return F.regexp_replace(x, f"(?<={_WIDE})[ ]+(?={_WIDE})", "")


def wrapped(x: Column, width: int) -> Column:
    """Words filled greedily into lines of at most `width` columns; a longer word has a line of its own (WN12)."""
    state = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(s: Column, w: Column) -> Column:
        longer = F.concat(s["line"], F.lit(" "), w)
        full = display_width(longer) > width
        empty = s["line"] == ""
        lines = F.when(~empty & full, F.concat(s["lines"], F.array(s["line"]))).otherwise(s["lines"])
        return F.struct(lines.alias("lines"), F.when(empty | full, w).otherwise(longer).alias("line"))

    return F.aggregate(
        F.filter(F.split(collapsed(x), " "), lambda w: w != ""),
        state,
        step,
        lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"])))
    )
