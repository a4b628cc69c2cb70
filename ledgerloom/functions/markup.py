r"""Column functions over TeX-like markup: commands to text, macros, references, math, styled runs.

Nested arguments are taken off from the inside, as many rounds as the text's braces are deep: each round replaces commands
whose argument holds no braces.  Escaped braces don't count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

STYLED = ["textbf", "textit", "emph", "texttt", "textsf", "underline", "mathbf", "mathrm"]
# fixed values: what commands stand for in math
SYMBOLS = dict(
    pm="±", rightarrow="→", leftarrow="←", infty="∞", leq="≤", geq="≥", ll="≪", gg="≫", times="×", cdot="·", emptyset="∅",
    alpha="α", beta="β", theta="θ", mu="μ", pi="π", rho="ρ", tau="τ", phi="φ", varphi="φ", xi="ξ", omega="ω",
    ldots="…", dots="…", notin="∉", subset="⊂", supset="⊃", cup="∪", cap="∩", to="→", Rightarrow="⇒", Leftarrow="⇐", Leftrightarrow="⇔",
    neg="¬", neq="≠", approx="≈", equiv="≡", sim="∼", propto="∝", mapsto="↦", langle="⟨", rangle="⟩", lfloor="⌊", rfloor="⌋", lceil="⌈", rceil="⌉",
    epsilon="varepsilon",
) | {"in": "∈"}
SCRIPT_LETTERS = {"H": "ℋ", "L": "ℒ", "P": "℘"}
MATH_FONTS = ["mathrm", "textbf", "textit", "text", "mathbf", "mathit", "mathcal", "mathbb", "mathsf", "mathtt"]
# fixed values: font and size commands without a trace in text
DROPPED = "xiaowuhao wuhao xiaosihao sihao small centering noindent song kai hei fs par allowbreak songti kaishu fangsong heiti lishu".split()
ESCAPED = {r"\%": "%", r"\&": "&", r"\_": "_", r"\#": "#", r"\$": "$"}
#: Styles of runs and the letters that mark them on the way.
RUN_STYLES = {"textbf": ("B", "bold"), "textit": ("I", "italic"), "emph": ("E", "emphasis"), "texttt": ("T", "code"), "mathrm": ("M", "upright")}
_OPEN, _CLOSE, _SET_OPEN, _SET_CLOSE, _MARK = "\ufff0", "\ufff1", "\ue010", "\ue011", "\x01"


def pieced(x: Column, pattern: str, group: int, made: Callable[[Column, Column], Column]) -> Column:
    """x with each match of the pattern replaced by made(match, group of it), in one pass."""
    def changed(y: Column) -> Column:
        found = lambda g: F.regexp_extract_all(y, F.lit(pattern), F.lit(g))
        new = F.zip_with(found(0), found(group), made)
        return F.array_join(F.zip_with(F.split(y, pattern, -1), new, lambda s, m: F.concat(s, F.coalesce(m, F.lit("")))), "")

    return T.let(x, changed)


def brace_depth(x: Column) -> Column:
    """How deep a text's braces are nested; escaped ones don't count (ST10)."""
    braces = F.split(F.regexp_replace(x, r"\\[\s\S]|[^{}\\]+", ""), "")
    step = lambda a, c: F.struct(
        (a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
        F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(0)).alias("most")
    )
    return F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def _closing(x: Column, at: Column, opens: str, closes: str, escapes: bool) -> Column:
    """Place, from 0, of what closes the mark at place `at`; null if there is none or nothing opens there."""
    tail = F.split(F.substr(x, at + 1), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("i"), F.lit(False).alias("escaped"))

    def step(a: Column, c: Column) -> Column:
        free = ~a["escaped"] if escapes else F.lit(True)
        depth = a["depth"] + F.when(free & (c == opens), 1).when(free & (c == closes), -1).otherwise(0)
        end = F.when(a["end"].isNull() & free & (c == closes) & (depth == 0), a["i"]).otherwise(a["end"])
        return F.struct(depth.alias("depth"), end.alias("end"), (a["i"] + 1).alias("i"), ((c == "\\") & ~a["escaped"]).alias("escaped"))

    return F.when(F.substr(x, at + 1, F.lit(1)) == opens, at + F.aggregate(tail, start, step, lambda a: a["end"]))


def matching_brace(x: Column, at: Column) -> Column:
    """Place of the brace that closes the one at `at`, counted from 0; escaped braces don't count (ST10)."""
    return _closing(x, at, "{", "}", True)


def matching_bracket(x: Column, at: Column) -> Column:
    """Place of the square bracket that closes the one at `at`, counted from 0 (ST10)."""
    return _closing(x, at, "[", "]", False)


def command_argument(x: Column, command: str) -> Column:
    r"""The argument of the first \command{..}, with all braces in it; null without one (ST13)."""
    match = F.regexp_substr(x, F.lit(r"\\" + command + r"(?![A-Za-z@])[ \t]*\{"))
    at = F.instr(x, match) + F.length(match) - 2
    return F.when(match.isNotNull(), F.substr(x, at + 2, matching_brace(x, at) - at - 1))


def _protected(x: Column) -> Column:
    """Escaped braces as characters of their own."""
    changed = lambda y: F.regexp_replace(F.regexp_replace(y, r"(?<!\\)((?:\\\\)*)\\\{", "$1" + _OPEN), r"(?<!\\)((?:\\\\)*)\\\}", "$1" + _CLOSE)
    return T.let(x, lambda y: F.when(F.contains(y, F.lit("\\{")) | F.contains(y, F.lit("\\}")), changed(y)).otherwise(y))


def _restored(x: Column, opens: str = "\\{", closes: str = "\\}") -> Column:
    return F.replace(F.replace(x, F.lit(_OPEN), F.lit(opens)), F.lit(_CLOSE), F.lit(closes))


_KEPT = "\ufff2\ufff3"


def _kept_aside(x: Column) -> Column:
    r"""\{ and \} as characters of their own, to come back as plain braces."""
    return F.replace(F.replace(x, F.lit("\\{"), F.lit(_KEPT[0])), F.lit("\\}"), F.lit(_KEPT[1]))


def _from_inside(x: Column, change: Callable[[Column], Column]) -> Column:
    return T.let(x, lambda y: F.aggregate(F.array_repeat(F.lit(0), brace_depth(y)), y, lambda z, _: change(z)))


def replaced_command(x: Column, command: str, by: str = "$1") -> Column:
    r"""\command{arg} replaced by `by` ($1 is the argument), the innermost first, however deep (ST13)."""
    pattern = rf"\\{command}\*?(?![A-Za-z@])\s*(?:\[[^\]]*\])?\{{([^{{}}]*)\}}"
    # innermost braces of other commands are put out of the way, so that what holds them is innermost in the next round
    # looking back from the brace, so that it is only done there
    other = rf"\{{(?<!\\{command}\*?\s{{0,4}}(?:\[[^\]]{{0,99}}\])?\{{)([^{{}}]*)\}}"
    aside = lambda y: F.regexp_replace(y, other, f"{_SET_OPEN}$1{_SET_CLOSE}")
    made = _from_inside(_protected(x), lambda y: aside(F.regexp_replace(y, pattern, by)))
    return _restored(F.replace(F.replace(made, F.lit(_SET_OPEN), F.lit("{")), F.lit(_SET_CLOSE), F.lit("}")))


def clean_math(x: Column) -> Column:
    """Math as text: fonts off, symbols as characters, other commands as their names, grouping braces off; those of sub- and superscripts stay (ST16)."""
    x = F.translate(F.replace(_protected(x), F.lit("\\,"), F.lit(" ")), "~", " ")
    for letter, script in SCRIPT_LETTERS.items():
        x = F.replace(x, F.lit(f"\\mathcal{{{letter}}}"), F.lit(script))
    fonts = rf"\\(?:{'|'.join(MATH_FONTS)})(?![A-Za-z])\s*\{{([^{{}}]*)\}}"
    scripts = lambda y: F.regexp_replace(y, r"([_^])\{([^{}]*)\}", f"$1{_SET_OPEN}$2{_SET_CLOSE}")
    x = _from_inside(x, lambda y: F.regexp_replace(F.regexp_replace(scripts(y), fonts, "$1"), r"(?<![_^A-Za-z])\{([^{}]*)\}", "$1"))
    table = F.create_map(*[F.lit(v) for kv in SYMBOLS.items() for v in kv])
    x = pieced(x, r"\\([A-Za-z]+)", 1, lambda m, name: F.coalesce(F.try_element_at(table, name), name))
    x = F.regexp_replace(x, r"\{([^{}]*)\}", "$1")
    x = F.replace(F.replace(x, F.lit(_SET_OPEN), F.lit("{")), F.lit(_SET_CLOSE), F.lit("}"))
    return T.collapsed(_restored(x, "{", "}"))


#: Display math stays; inline math between dollars or in \\( \\).
_MATH = r"\$\$|\\\[|\$([^$]+)\$|\\\(((?:(?!\\\))[\s\S])*)\\\)"


def math_text(x: Column) -> Column:
    """Inline math as text without its marks; display math stays (ST16)."""
    inner = lambda m: F.when(m.startswith("$"), F.substr(m, F.lit(2), F.length(m) - 2)).otherwise(F.substr(m, F.lit(3), F.length(m) - 4))
    return pieced(x, _MATH, 0, lambda m, _: F.when(m.isin("$$", "\\["), m).otherwise(clean_math(inner(m))))


def math_parts(x: Column) -> Column:
    r"""Array of (kind, text): `text` and `math` parts; $$..$$ is text, empty math goes, a mark without its end is text (ST21)."""
    parts = F.regexp_extract_all(x, F.lit(r"\$\$(?:(?!\$\$)[\s\S])*\$\$|\$\$|\$[^$]*\$|\$[^$]*\z|\\\((?:(?!\\\))[\s\S])*\\\)|\\\([^$]*|(?:(?!\\\()[^$])+"), F.lit(0))
    dollar = lambda p: p.rlike(r"^\$[^$]*\$$") & (F.length(p) > 1) & (p != "$$")
    bracket = lambda p: p.startswith("\\(") & p.endswith("\\)")
    one = lambda p: F.when(dollar(p), F.struct(F.lit("math").alias("kind"), F.substr(p, F.lit(2), F.length(p) - 2).alias("text"))).when(
        bracket(p),
        F.struct(F.lit("math").alias("kind"), F.substr(p, F.lit(3), F.length(p) - 4).alias("text"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), p.alias("text")))
    return F.filter(F.transform(parts, one), lambda p: p["text"] != "")


def citations_resolved(x: Column, numbers: Column) -> Column:
    r"""\cite{a,b} by the numbers of a map as ranges, [1-2,4]; keys without one are dropped, [?] where none has one (JN12, ST20)."""

    def ranges(m: Column, keys: Column) -> Column:
        own = F.filter(F.transform(T.split_keys(keys), lambda k: F.try_element_at(numbers, k)), lambda n: n.isNotNull())
        return F.when(F.size(own) == 0, "[?]").otherwise(F.concat(F.lit("["), T.compressed_ranges(own), F.lit("]")))

    return pieced(x, r"\\cite[A-Za-z]*\*?\s*(?:\[[^\]]*\])?\{([^{}]*)\}", 1, ranges)


def latex_text(x: Column, cites: Column, labels: Column, marked: bool = False) -> Column:
    """A marked-up text as plain text, in the order of ST12; with `marked`, styles stay as marks for `styled_runs`.

    cites maps keys to numbers, labels to texts.
    """
    x = F.replace(T.without_comments(x), F.lit("\r"), F.lit("\n"))
    x = F.replace(F.replace(x, F.lit("\\\\"), F.lit(" ")), F.lit("\\,"), F.lit(" "))
    x = _kept_aside(x)
    x = references_resolved(citations_resolved(x, cites), labels)
    x = math_text(replaced_command(x, "label", ""))
    x = replaced_command(x, "footnote", "（注：$1）")
    for command, (letter, _) in RUN_STYLES.items():
        x = replaced_command(x, command, f"{_MARK}{letter}$1{_MARK}{letter}" if marked else "$1")
    x = replaced_command(x, "(?:url|nolinkurl|rjrare)")
    x = F.regexp_replace(F.regexp_replace(x, r"\\item\s*\[([^\]]*)\]", "$1 "), r"\\item(?![A-Za-z])", "")
    for raw, char in (("``", "“"), ("''", "”"), ("---", "—"), ("--", "–"), *ESCAPED.items(), ("~", " ")):
        x = F.replace(x, F.lit(raw), F.lit(char))
    x = F.regexp_replace(x, rf"\\(?:{'|'.join(DROPPED)})(?![A-Za-z])", "")
    x = F.regexp_replace(x, r"\\fontsize\s*\{[^{}]*\}\s*\{[^{}]*\}\s*(?:\\selectfont)?", "")
    x = F.regexp_replace(x, r"\\[hv]space\*?\s*\{[^{}]*\}", " ")
    x = F.regexp_replace(x, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", "")
    x = F.regexp_replace(x, r"(?<![_^])\{([^{}]*)\}", "$1")
    return T.collapsed(F.translate(x, _KEPT, "{}"))


def styled_runs(x: Column) -> Column:
    """Array of (style, text) of a text of `latex_text(.., marked=True)`; inside a style the outermost holds (ST14)."""
    parts = F.regexp_extract_all(x, F.lit(r"\x01([BIETM])([\s\S]*?)\x01\1|[^\x01]+"), F.lit(0))
    style = F.create_map(*[F.lit(v) for letter, name in RUN_STYLES.values() for v in (letter, name)])
    bare = lambda p: F.regexp_replace(p, r"\x01[BIETM]", "")
    runs = F.transform(
        parts,
        lambda p: F.struct(F.when(p.startswith(_MARK), F.try_element_at(style, F.substring(p, 2, 1))).otherwise("plain").alias("style"), bare(p).alias("text"))
    )
    return F.filter(runs, lambda r: r["text"] != "")


def plain_text(x: Column) -> Column:
    """Markup to plain text: comments, math, styles, links, leftover commands, white space (ST17, ST20)."""
    x = _kept_aside(replaced_command(math_text(T.without_comments(x)), "label", ""))
    x = replaced_command(x, "(?:" + "|".join(STYLED) + ")")
    x = F.regexp_replace(x, r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", "")
    x = reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), ESCAPED.items(), x)
    return T.collapsed(F.translate(x, f"~{_KEPT}{{}}", " {}"))


def references_resolved(x: Column, numbers: Column) -> Column:
    r"""\ref{key} by a map's number, ?? where it has none; several keys are one key (ST20, JN13, Z13)."""

    def number(m: Column, key: Column) -> Column:
        own = F.coalesce(F.try_element_at(numbers, key), F.lit("??"))
        return F.when(m.startswith("\\eqref"), F.concat(F.lit("("), own, F.lit(")"))).otherwise(own)

    return pieced(x, r"\\(?:eq)?ref\{([^{}]*)\}", 1, number)


def script_runs(x: Column) -> Column:
    """Text cut into (style, text) runs at ^{..} and _{..} (ST15)."""
    pieces = F.regexp_extract_all(x, F.lit(r"[\^_]\{[^{}]*\}|[^\^_]+|[\^_]"), F.lit(0))
    style = lambda p: F.when(p.startswith("^{"), "superscript").when(p.startswith("_{"), "subscript").otherwise("normal")
    return F.transform(pieces, lambda p: F.struct(style(p).alias("style"), F.regexp_replace(p, r"^[\^_]\{([^{}]*)\}$", "$1").alias("text")))


def multi_cell(x: Column) -> Column:
    r"""(n, text) of \multicolumn or \multirow, (1, text) of any other cell (ST34)."""
    n = F.regexp_extract(x, r"\\multi(?:column|row)\{(\d+)\}", 1)
    inner = F.regexp_extract(x, r"\\multi(?:column|row)\{\d+\}\{[^{}]*\}\{([^{}]*)\}", 1)
    return F.struct(F.when(n != "", n.try_cast("int")).otherwise(1).alias("n"), F.trim(F.when(n != "", inner).otherwise(x)).alias("text"))


def width_ratio(options: Column) -> Column:
    r"""Share of the line in an option list such as width=.7\textwidth; null without any (MA5)."""
    share = F.regexp_extract(options, r"(?:^|,)\s*width\s*=\s*([0-9]*\.?[0-9]*)\s*\\(?:text|line|column)width", 1)
    return F.when(options.rlike(r"width\s*=\s*\\(?:text|line|column)width"), 1.0).otherwise(F.when(share != "", share.try_cast("double")))
