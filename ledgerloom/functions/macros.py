r"""Macro expansion (ST22): definitions with bodies of balanced braces, expanded to a fixed point."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_CALL = re.compile(r"%[^\n]*|\\(?:([A-Za-z@]+)|[\s\S])")
_DEFINITION = re.compile(r"\\(?:(?:re|provide)?newcommand|providecommand|DeclareRobustCommand)\*?[ \t]*(?:\{[ \t]*\\([A-Za-z@]+)[ \t]*\}|\\([A-Za-z@]+))[ \t]*(?:\[[0-9]\][ \t]*)?(?:\[[^\]\n]*\][ \t]*)?\{|\\def[ \t]*\\([A-Za-z@]+)[^{}\\\n]*\{")
_BRACE = re.compile(r"%[^\n]*|\\[\s\S]|[{}]")
#: Characters that a body may grow to; the call of one that would outgrow it stays.
MAX_BODY = 1 << 20


def _partners(text: str) -> dict[int, int]:
    """Where each brace that is closed is closed; escaped braces and comments don't count."""
    out, stack = {}, []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            stack.append(m.start())
        elif m[0] == "}" and stack:
            out[stack.pop()] = m.start()
    return out


def _definitions(text: str) -> tuple[dict[str, str], list[tuple[int, int]]]:
    """Bodies by name, the last of a name; and where the definitions stand."""
    bodies, spans, partner, at = {}, [], _partners(text), 0
    while m := _CALL.search(text, at):
        at = m.end()
        if m[1] and (d := _DEFINITION.match(text, m.start())) and (stop := partner.get(d.end() - 1)):
            bodies[d[1] or d[2] or d[3]] = text[d.end() : stop]
            at = stop + 1
            spans.append((m.start(), at + (text[at : at + 1] == "\n")))
    return bodies, spans


def _replaced(text: str, bodies: dict[str, str]) -> str:
    """Calls of known names replaced; comments stay."""
    return _CALL.sub(lambda m: bodies.get(m[1], m[0]) if m[1] else m[0], text)


def resolved(bodies: dict[str, str]) -> dict[str, str | None]:
    """Each body with the calls in it replaced, to a fixed point; None for a name that its own body leads back to, or that outgrows MAX_BODY.

    Bodies are taken in the order of their dependencies: those that call nothing first (Kahn).  What is never free of
    unresolved calls is on a cycle or leads to one; of those, names on no cycle keep the calls of the names that are.
    """
    uses = {n: {m[1] for m in _CALL.finditer(b) if m[1] in bodies} for n, b in bodies.items()}
    used_by: dict[str, set[str]] = {n: set() for n in bodies}
    for n, names in uses.items():
        for x in names:
            used_by[x].add(n)
    out: dict[str, str | None] = {}
    left = {n: len(names) for n, names in uses.items()}
    ready = [n for n, k in left.items() if not k]

    def settle() -> None:
        while ready:
            n = ready.pop()
            if n in out:
                continue
            calls = Counter(m[1] for m in _CALL.finditer(bodies[n]))
            size = len(bodies[n]) + sum(len(out[x] or "") * calls[x] for x in uses[n])
            out[n] = _replaced(bodies[n], {x: out[x] for x in uses[n] if out[x] is not None}) if size <= MAX_BODY else None
            free(n)

    def free(n: str) -> None:
        for x in used_by[n]:
            left[x] -= 1
            if not left[x]:
                ready.append(x)

    settle()
    behind = {n for n in bodies if n not in out}
    for n in _on_cycles({x: uses[x] & behind for x in behind}):
        out[n] = None
        free(n)
    settle()
    return out


def _on_cycles(edges: dict[str, set[str]]) -> list[str]:
    """Nodes of a graph that lie on a cycle."""

    def reaches_itself(start: str) -> bool:
        seen, todo = set(), list(edges[start])
        while todo:
            n = todo.pop()
            if n == start:
                return True
            if n not in seen:
                seen.add(n)
                todo += edges[n]
        return False

    return sorted(n for n in edges if reaches_itself(n))


def expanded_text(text: str) -> tuple[str, list[dict]]:
    """The text with definitions taken out and calls replaced; and its macros."""
    if "\\" not in text:
        return text, []
    bodies, spans = _definitions(text)
    if not bodies:
        return text, []
    made = resolved(bodies)
    parts, at = [], 0
    for start, stop in spans:
        parts.append(text[at:start])
        at = stop
    body = "".join([*parts, text[at:]])
    known = {n: b for n, b in made.items() if b is not None}
    return _replaced(body, known), [{"name": n, "body": bodies[n], "expanded": made[n], "cyclic": made[n] is None} for n in sorted(bodies)]


_MACRO = StructType([StructField("name", StringType()), StructField("body", StringType()), StructField("expanded", StringType()), StructField("cyclic", BooleanType())])


@F.pandas_udf(StringType())
def macros_expanded(x: pd.Series) -> pd.Series:
    r"""A text with its macros' calls replaced by their bodies, to a fixed point, and their definitions taken out (ST22).

    \newcommand, \renewcommand, \providecommand and \def with bodies of balanced braces; the last definition of a name
    holds throughout.  Calls of names on a cycle stay, and so do arguments.  Comments are left alone.
    """
    return x.map(lambda t: None if t is None else expanded_text(t)[0])


@F.pandas_udf(ArrayType(_MACRO))
def macros_defined(x: pd.Series) -> pd.Series:
    """Array of (name, body, expanded, cyclic) of a text's macros, by name; expanded is null where the name is cyclic (ST22)."""
    return x.map(lambda t: None if t is None else expanded_text(t)[1])
