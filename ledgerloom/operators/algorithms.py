r"""Lines of algorithms (ST35): logic lines, loops and conditions with their bodies, comments, guides, inputs and outputs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerloom.functions.markup import MATH_FONTS, SYMBOLS

_LINE = ArrayType(
    StructType(
        [
            StructField("indent", IntegerType()),
            StructField("guides", ArrayType(IntegerType())),
            StructField("end_guides", ArrayType(IntegerType())),
            StructField("code", StringType()),
            StructField("comment", StringType()),
            StructField("keyword", StringType()),
        ]
    )
)
_HEAD = StructType(
    [
        StructField("io", ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))),
        StructField("caption", StringType()),
        StructField("label", StringType()),
    ]
)
# fixed values: what commands in front of an algorithm stand for
IO_KINDS = {"KwIn": "Input", "KwOut": "Output", "KwData": "Data", "KwResult": "Result"}
_META = re.compile(r"\\(KwIn|KwOut|KwData|KwResult|KwBody|caption|label)\{")
_SETTINGS = re.compile(r"\\(?:SetAlgoLined|DontPrintSemicolon)\b")
_KEYWORD = re.compile(r"\s*\\(ForEach|If|For|While|Return)(?=[{ \t]|\Z)")
_TOKEN = re.compile(r"\\;|\\tcp\*?(?:\[[^\]\n]*\])?[ \t]*\{|\\[A-Za-z]+\*?|\\[\s\S]?|[{}\n]|[^\\{}\n]+")
_NOTE = re.compile(r"[ \t]*\\tcp\*?(?:\[[^\]\n]*\])?[ \t]*\{")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?")


def _partners(text: str) -> dict[int, int]:
    """Where each brace that is closed is closed; escaped ones count, too."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _plain(text: str) -> str:
    """Code as text: symbols as characters, fonts, dollars, braces and the marks of scripts off, white space as one space."""
    x = text.replace(r"\;", ";")
    x = re.sub(rf"\\(?:{'|'.join(MATH_FONTS)})(?![A-Za-z])", "", x)
    x = _COMMAND.sub(lambda m: SYMBOLS.get(m[1], m[1]), x)
    x = re.sub(r"[_^](?=[{\w])", "", x)
    return re.sub(r"\s+", " ", re.sub(r"[${}\\]", "", x)).strip()


def _without_meta(text: str) -> str:
    out, at, partner = [], 0, _partners(text)
    for m in _META.finditer(text):
        if m.start() >= at and (stop := partner.get(m.end() - 1)) is not None:
            out.append(text[at : m.start()])
            at = stop + 1
    return _SETTINGS.sub("", "".join([*out, text[at:]]))


def _logic_line(body: str, at: int, stop: int, partner: dict[int, int]) -> tuple[str, str, int]:
    r"""(text, comment, where the next begins): up to a \;, the line's end or a brace that nothing opened; groups stay whole."""
    parts, comment = [], ""
    while at < stop:
        m = _TOKEN.match(body, at, stop)
        piece, at = m[0], m.end()
        if piece.startswith("\\tcp"):
            end = partner.get(m.end() - 1)
            if end is not None and end < stop:
                comment, at = body[m.end() : end], end + 1
            continue
        if piece == "\n":
            break
        if piece == "{" and (end := partner.get(m.start())) is not None and end < stop:
            piece, at = body[m.start() : end + 1], end + 1
        parts.append(piece)
        if piece == "}":
            break
        if piece == r"\;":
            if not comment and (m := _NOTE.match(body, at, stop)) and (end := partner.get(m.end() - 1)) is not None and end < stop:
                comment, at = body[m.end() : end], end + 1
            break
    return "".join(parts), comment, at


def algorithm_lines(body: str) -> list[dict]:
    """Rows of an algorithm's body, in order; what a loop or a condition holds is a step in, and an `end` closes it.

    Guides start anew in each body.  What is still to be read stands on a stack, so depth costs no calls.
    """
    partner, out = _partners(body), []

    def line(depth: int, code: str, comment: str = "", keyword: str | None = None, opens: bool = False) -> dict:
        return {"indent": depth, "guides": [0], "end_guides": [0] if opens else [], "code": code, "comment": _plain(comment), "keyword": keyword}

    todo: list[tuple] = [(0, len(body), 0)]
    while todo:
        item = todo.pop()
        if isinstance(item[0], dict):
            out.append(item[0])
            continue
        at, stop, depth = item
        while at < stop and body[at].isspace():
            at += 1
        if at >= stop:
            continue
        start = at
        text, comment, at = _logic_line(body, at, stop, partner)
        todo.append((at, stop, depth))
        found = _KEYWORD.match(text)
        if found and found[1] != "Return":
            first = body.find("{", start, stop)
            end = partner.get(first, stop) if first >= 0 else start
            condition = body[first + 1 : end] if first >= 0 else ""
            inner = end + 1
            while inner < stop and body[inner].isspace():
                inner += 1
            out.append(line(depth, f"{found[1]} ({_plain(condition)})", comment, found[1], opens=True))
            todo.append((line(depth, "end", keyword="End"),))
            if first >= 0 and inner < stop and body[inner] == "{":
                close = min(partner.get(inner, stop), stop)
                if inner >= at:  # the body begins on a later line
                    todo[-2] = (close + 1, stop, depth)
                todo.append((inner + 1, close, depth + 1))
        elif found:
            first = text.find("{")
            value = text[first + 1 : _partners(text).get(first, len(text))] if first >= 0 else text[found.end() :].replace(r"\;", "")
            out.append(line(depth, f"return {_plain(value)}" + (";" if r"\;" in text else ""), comment, "Return"))
        elif code := _plain(_without_meta(text)):
            out.append(line(depth, code if code[-1] in ";," else code + ";", comment))
    return out


def algorithm_head(body: str) -> dict:
    """Inputs and outputs in order, caption and label, of those that begin a line."""
    out: dict = {"io": [], "caption": None, "label": None}
    for row in body.splitlines():
        row = row.strip()
        m = re.match(r"\\([A-Za-z]+)\s*\{", row)
        stop = _partners(row).get(m.end() - 1) if m else None
        if stop is None:
            continue
        value = row[m.end() : stop]
        if m[1] in IO_KINDS:
            out["io"].append({"kind": IO_KINDS[m[1]], "text": _plain(value)})
        elif m[1] == "caption":
            out["caption"] = _plain(value)
        elif m[1] == "label":
            out["label"] = value
    return out


@F.pandas_udf(_LINE)
def algorithm_rows(body: pd.Series) -> pd.Series:
    r"""Array of (indent, guides, end_guides, code, comment, keyword) of an algorithm's body (ST35)."""
    return body.map(lambda b: None if b is None else algorithm_lines(b))


@F.pandas_udf(_HEAD)
def algorithm_inputs(body: pd.Series) -> pd.DataFrame:
    r"""(io, caption, label) of an algorithm's body: \KwIn and its like with what they stand for (ST35)."""
    return pd.DataFrame([algorithm_head(b or "") for b in body], columns=["io", "caption", "label"])
