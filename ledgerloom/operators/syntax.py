r"""Marked-up documents as rows: lossless trees (GR9) and nested blocks (GR4).

A document is read once, in time proportional to its length, by a small stack machine inside a task; what leaves the task
are rows, so what follows (counts, joins, walks over levels) is Spark's.  Null texts count as empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.tree import BLOCKS

_SCAN = re.compile(
    r"(?P<comment>%[^\n]*)|\\begin[ \t]*\{(?P<begin>[^{}\n]*)\}|\\end[ \t]*\{(?P<end>[^{}\n]*)\}|(?P<command>\\(?:[A-Za-z@]+\*?|[\s\S]))"
    r"|(?P<open>\{)|(?P<close>\})|(?P<math>\$\$?)|(?P<paragraph>[ \t]*\n[ \t]*\n\s*)|(?P<space>\s+)|(?P<text>[^%\\{}$\s]+|\\\Z)"
)
# fixed values: environments whose body is no markup
VERBATIM = "verbatim lstlisting minted comment".split()
#: Rows a task sends at a time.
_SEND_ROWS = 20_000

NODE = "node int, parent int, pos int, kind string, name string, text string, error boolean"


def parsed(text: str) -> dict[str, list]:
    r"""Columns of a text's nodes, parents before children, in the text's order; the leaves' texts joined are the text.

    Inner nodes are the root, groups and environments; their marks are leaves of kind `mark` within them.  Recovery is
    local: a brace closes the innermost node only if that is a group; an \end closes the innermost environment of its name
    and whatever is open in it.  Marks that close nothing are leaves of kind `error`; nodes closed by another's mark or by
    the end of the text are errors, too, and lose nothing.
    """
    out: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}
    children: list[int] = []

    def add(parent: int | None, kind: str, name: str | None = None, piece: str | None = None, error: bool = False) -> int:
        node = len(children)
        pos = 0
        if parent is not None:
            pos = children[parent]
            children[parent] += 1
        children.append(0)
        for column, value in zip(out.values(), (node, parent, pos, kind, name, piece, error)):
            column.append(value)
        return node

    stack, opened = [(add(None, "root"), "")], Counter()
    at = 0
    while at < len(text):
        m = _SCAN.match(text, at)
        at, kind, piece, top = m.end(), m.lastgroup, m[0], stack[-1][0]
        if kind == "open":
            stack.append((add(top, "group"), "{"))
            add(stack[-1][0], "mark", None, piece)
        elif kind == "begin":
            name = m["begin"].strip()
            stack.append((add(top, "environment", name), name))
            opened[name] += 1
            add(stack[-1][0], "mark", None, piece)
            if name.rstrip("*") in VERBATIM and (stop := text.find(f"\\end{{{name}}}", at)) > at:
                add(stack[-1][0], "verbatim", None, text[at:stop])
                at = stop
        elif kind == "close":
            if stack[-1][1] == "{":
                add(stack.pop()[0], "mark", None, piece)
            else:
                add(top, "error", None, piece, True)
        elif kind == "end":
            name = m["end"].strip()
            if not opened[name]:
                add(top, "error", name, piece, True)
                continue
            while stack[-1][1] != name:
                node, mark = stack.pop()
                out["error"][node] = True
                opened[mark] -= mark != "{"
            opened[name] -= 1
            add(stack.pop()[0], "mark", None, piece)
        else:
            add(top, kind, piece[1:] if kind == "command" else None, piece)
    for node, _ in stack[1:]:
        out["error"][node] = True
    return out


def _rows(documents: DataFrame, keys: list[str], text: str, schema: str, read: Callable[[str], dict[str, list]]) -> DataFrame:
    """keys and the columns of schema: what `read` makes of each text."""
    names, kinds = [c.split()[0] for c in schema.split(", ")], {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {n: [] for n in names}
            of: list[int] = []
            for k, value in enumerate(batch.column(len(keys)).to_pylist()):
                columns = read(value or "")
                of += [k] * len(columns[names[0]])
                for n in names:
                    held[n] += columns[n]
                if len(of) >= _SEND_ROWS:
                    yield from send(batch, of, held)
                    of, held = [], {n: [] for n in names}
            yield from send(batch, of, held)

    def send(batch: pa.RecordBatch, of: list[int], held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(of), _SEND_ROWS):
            own = batch.take(pa.array(of[i : i + _SEND_ROWS]))
            columns = [pa.array(held[n][i : i + _SEND_ROWS], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *columns], names=[*keys, *names])

    wide = documents.select(*keys, F.col(text).cast("string").alias("__text"))
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[: len(keys)])
    return wide.mapInArrow(run, f"{made}, {schema}")


def syntax_tree(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, node, parent, pos, kind, name, text, error): every node of every document, as `parsed` says (GR9)."""
    return _rows(documents, keys, text, NODE, parsed)


# -- blocks ------------------------------------------------------------------------------------------------------------

BLOCK = "block int, parent int, pos int, kind string, name string, level int, text string, caption string"
_KIND = {name: kind for kind, names in BLOCKS.items() for name in names.split()} | dict.fromkeys(VERBATIM, "code")
#: Environments that only group what is in them, and blocks whose body stays markup.
_CLEAR = set("document minipage center flushleft flushright quote quotation abstract".split())
_OPAQUE = {"equation", "code", "raw"}
#: How many groups after \begin{..} are arguments.
_ARGUMENTS = {"tabular": 1, "tabular*": 2, "array": 1, "minipage": 1, "list": 2}
_HEADINGS = "part chapter section subsection subsubsection paragraph subparagraph".split()
_RULES = set("hline toprule midrule bottomrule cline cmidrule".split())


#: An element of a container: ("text", piece), ("group", node), ("environment", node), ("command", name), ("break", "").
Element = tuple[str, int | str]


class _Lowering:
    """One document's blocks; containers wait in a queue, so that depth costs no call stack."""

    def __init__(self, text: str):
        self.nodes = parsed(text)
        kinds, names, parents = self.nodes["kind"], self.nodes["name"], self.nodes["parent"]
        self.within: list[list[int]] = [[] for _ in kinds]
        self.end = list(range(1, len(kinds) + 1))  # behind the last node within each
        for node in range(len(kinds) - 1, 0, -1):
            self.end[parents[node]] = max(self.end[parents[node]], self.end[node])
        for node in range(1, len(kinds)):
            self.within[parents[node]].append(node)
        self.made: list[dict] = []
        self.children: list[list[int]] = []
        self.roots: list[int] = []
        self.queue: list[tuple[int | None, int, list[Element]]] = []  # block, lists around it, what it holds
        start = next((i for i, (k, n) in enumerate(zip(kinds, names)) if k == "environment" and n == "document"), 0)
        self.queue.append((None, 0, self.elements(start)))
        while self.queue:
            self.flow(*self.queue.pop())

    def source(self, start: int, stop: int) -> str:
        """The markup of the nodes from start to stop, without comments."""
        return "".join(p for k, p in zip(self.nodes["kind"][start:stop], self.nodes["text"][start:stop]) if p and k != "comment")

    def argument(self, group: int) -> str:
        return re.sub(r"\s+", " ", self.source(group, self.end[group])[1:].removesuffix("}")).strip()

    def elements(self, node: int) -> list[Element]:
        """What an inner node holds, without its marks and arguments; environments that only group are looked into."""
        out: list[Element] = []
        todo: list[int | None] = self.inside(node)[::-1]
        while todo:
            x = todo.pop()
            if x is None:
                out.append(("break", ""))
                continue
            kind, name, piece = self.nodes["kind"][x], self.nodes["name"][x], self.nodes["text"][x]
            if kind == "environment" and name.rstrip("*") in _CLEAR:
                todo += [None, *self.inside(x)[::-1], None]
            elif kind in ("environment", "group"):
                out.append((kind, x))
            elif kind == "command":
                out.append((kind, name))
            elif kind == "paragraph" or kind == "error" and name:
                out.append(("break", ""))
            elif kind not in ("comment", "error"):
                out.append(("text", " " if kind == "space" else piece))
        return out

    def inside(self, node: int) -> list[int]:
        """An environment's children between its marks, behind its arguments."""
        own = [x for x in self.within[node] if self.nodes["kind"][x] != "mark"]
        name = self.nodes["name"][node] or ""
        groups, i = _ARGUMENTS.get(name, _ARGUMENTS.get(name.rstrip("*"), 0)), 0
        while i < len(own) and groups:
            kind, piece = self.nodes["kind"][own[i]], self.nodes["text"][own[i]]
            if kind == "group":
                groups -= 1
            elif not (kind == "space" or piece and piece[0] == "["):
                break
            i += 1
        return own[i:]

    def add(self, parent: int | None, kind: str, name: str | None = None, level: int | None = None, text: str | None = None) -> int:
        block = len(self.made)
        self.made.append({"parent": parent, "kind": kind, "name": name, "level": level, "text": text, "caption": None})
        self.children.append([])
        (self.roots if parent is None else self.children[parent]).append(block)
        return block

    def flow(self, parent: int | None, lists: int, held: list[Element]) -> None:
        """Makes the blocks of a container."""
        text: list[str] = []
        captioned = parent is not None and self.made[parent]["kind"] == "captioned"

        def flush() -> None:
            if line := re.sub(r"\s+", " ", "".join(text)).strip():
                self.add(parent, "paragraph", text=line)
            text.clear()

        i = 0
        while i < len(held):
            kind, value = held[i]
            i += 1
            bare = value.rstrip("*") if kind == "command" else ""
            if kind == "break":
                flush()
            elif kind == "environment":
                flush()
                self.environment(parent, lists, value)
            elif bare in _HEADINGS or bare == "label" or bare == "caption" and captioned:
                at = next((k for k in range(i, len(held)) if not (held[k][0] == "text" and (held[k][1].isspace() or held[k][1][0] == "["))), i)
                if at < len(held) and held[at][0] == "group":
                    argument, i = self.argument(held[at][1]), at + 1
                    if bare == "caption":
                        self.made[parent]["caption"] = argument
                    elif bare != "label":
                        flush()
                        self.add(parent, "heading", bare, _HEADINGS.index(bare), argument)
            elif kind == "group":
                text.append(self.source(value, self.end[value]))
            else:
                text.append(f"\\{value}" if kind == "command" else value)
        flush()

    def environment(self, parent: int | None, lists: int, node: int) -> None:
        name = self.nodes["name"][node]
        kind = _KIND.get(name.rstrip("*"), "raw")
        if kind in _OPAQUE:
            marks = [x for x in self.within[node] if self.nodes["kind"][x] == "mark"]
            stop = marks[-1] if len(marks) > 1 else self.end[node]
            self.add(parent, kind, name, text=self.source(marks[0] + 1, stop).strip())
        elif kind == "list":
            block = self.add(parent, kind, name, lists + 1)
            items: list[list[Element]] = []
            for x in self.elements(node):
                if x == ("command", "item"):
                    items.append([])
                elif items:
                    items[-1].append(x)
            for held in items:
                label, held = self.label(held)
                self.queue.append((self.add(block, "item", label), lists + 1, held))
        elif kind == "table":
            block = self.add(parent, kind, name)
            for row in self.rows(self.elements(node)):
                line = self.add(block, "row")
                for held in row:
                    self.queue.append((self.add(line, "cell"), lists, held))
        else:
            self.queue.append((self.add(parent, kind, name), lists, self.elements(node)))

    @staticmethod
    def label(held: list[Element]) -> tuple[str | None, list[Element]]:
        """The label in brackets that an item begins with, and the rest."""
        start = next((k for k, x in enumerate(held) if x[0] != "text" or not x[1].isspace()), len(held))
        if start < len(held) and held[start][0] == "text" and held[start][1][0] == "[":
            for stop in range(start, len(held)):
                if held[stop][0] not in ("text", "command"):
                    break
                if held[stop][0] == "text" and "]" in held[stop][1]:
                    inner = "".join(v if k == "text" else f"\\{v}" for k, v in held[start : stop + 1])
                    name, _, rest = inner[1:].partition("]")
                    return name, [*([("text", rest)] if rest else []), *held[stop + 1 :]]
        return None, held

    @staticmethod
    def rows(held: list[Element]) -> list[list[list[Element]]]:
        r"""A table's rows of cells, without rules and without rows whose cells are empty."""
        out: list[list[list[Element]]] = [[[]]]
        ruled = 0
        for kind, value in held:
            if kind == "command" and value == "\\":
                out.append([[]])
            elif kind == "command" and value in _RULES:
                ruled = value in ("cline", "cmidrule")
                continue
            elif kind == "group" and ruled:
                pass  # which columns a rule is under
            elif kind == "text" and "&" in value:
                first, *rest = value.split("&")
                out[-1][-1] += [("text", first)] if first else []
                out[-1] += [[("text", part)] if part else [] for part in rest]
            else:
                out[-1][-1].append((kind, value))
            ruled = ruled and kind == "text"
        full = lambda x: x[0] != "break" and (x[0] != "text" or not x[1].isspace())
        return [row for row in out if any(full(x) for cell in row for x in cell)]

    def columns(self) -> dict[str, list]:
        """The blocks in document order, parents first."""
        order, todo = [], [(x, None, k) for k, x in enumerate(self.roots)][::-1]
        while todo:
            block, parent, pos = todo.pop()
            number = len(order)
            order.append((number, parent, pos, *[self.made[block][c] for c in ("kind", "name", "level", "text", "caption")]))
            todo += [(x, number, k) for k, x in enumerate(self.children[block])][::-1]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return dict(zip(names, map(list, zip(*order)))) if order else {n: [] for n in names}


def lowered(text: str) -> dict[str, list]:
    r"""Columns of a text's blocks, in its order, parents before what they hold.

    Headings, paragraphs, lists with items, tables with rows and cells, captioned environments, equations, theorems, code;
    any other environment stays raw.  Items, cells, captioned environments and theorems hold blocks of their own, to any
    depth; a list's level says how many lists are around it, itself included.  Blank lines end paragraphs.  An item's label
    is its name.  A stray \end ends a paragraph, and stray braces go.  Rows whose cells are empty go (Z17); a command that only begins like a heading's is none (Z20).  Where
    there is a document environment, only what is in it is lowered.
    """
    return _Lowering(text).columns()


def block_tree(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, block, parent, pos, kind, name, level, text, caption): every block of every document, as `lowered` says (GR4)."""
    return _rows(documents, keys, text, BLOCK, lowered)
