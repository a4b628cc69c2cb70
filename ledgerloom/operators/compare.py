"""Comparison of documents: alignment of paragraphs, similarity of texts, kinds of format changes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ledgerloom.functions import text as T

SIMILAR = 0.82
OPS = "array<struct<kind: string, left: int, right: int, similarity: double>>"


class _Columns:
    """Where each element of a sequence stands, as bits of an integer; the masks of frequent elements are remembered."""

    def __init__(self, items: list | str):
        self.size, self.places = len(items), {}
        for i, x in enumerate(items):
            self.places.setdefault(x, []).append(i)
        self.masks: dict = {}

    def mask(self, x: object) -> int:
        if (known := self.masks.get(x)) is not None:
            return known
        places = self.places.get(x, ())
        if len(places) < 8:
            return sum(1 << i for i in places)
        bits = bytearray(self.size // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        out = int.from_bytes(bits, "little")
        if len(places) * 64 > self.size:  # at most 64 such elements
            self.masks[x] = out
        return out


def _next_row(row: int, mask: int, full: int) -> int:
    """The bits after one more element: of the first k bits as many are zero as a longest common subsequence with the first k elements is long."""
    met = row & mask
    return ((row + met) | (row - met)) & full


def lcs_length(a: list | str, b: list | str) -> int:
    """Length of a longest common subsequence, a row of bits at a time."""
    columns = _Columns(b)
    row = full = (1 << len(b)) - 1
    for x in a:
        row = _next_row(row, columns.mask(x), full)
    return len(b) - row.bit_count()


def similarity_of(a: str, b: str) -> float:
    """lcs / longer length of canonical texts; 1 for two empty ones (Q2)."""
    return 1.0 if a == b else lcs_length(a, b) / max(len(a), len(b))


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity_of(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two texts; 0 without comparing where lengths alone keep it below `least`."""
    x, y = T.canonical(a), T.canonical(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(F.least(F.length(x), F.length(y)) < least * longest, 0.0).otherwise(_similarity(x, y))


def aligned(left: list[str], right: list[str]) -> list[tuple]:
    """(kind, left, right) in order: equal, delete or insert; of ways of equal length a deletion comes first (Q1).

    A row of bits tells how long the common subsequences of the rest of `left` with every rest of `right` are.  Every
    so-many-th row is kept and those between are made again when the way comes there, so a pair of n paragraphs each takes
    n ** 1.5 / 4 bytes, and n * n / 32 steps of a machine word.
    """
    m, n = len(left), len(right)
    columns, full = _Columns(right[::-1]), (1 << n) - 1
    step = max(1, int(m**0.5))
    kept, row = {m: full}, full
    for i in range(m - 1, -1, -1):
        row = _next_row(row, columns.mask(left[i]), full)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}  # of one stretch

    def row_of(i: int) -> int:
        if i not in rows:
            rows.clear()
            end = min(m, (i // step + 1) * step)
            row = rows[end] = kept[end]
            for k in range(end - 1, i // step * step - 1, -1):
                row = rows[k] = _next_row(row, columns.mask(left[k]), full)
        return rows[i]

    def length(i: int, rest: int) -> int:
        """Of left from i with the last `rest` elements of right."""
        return rest - (row_of(i) & ((1 << rest) - 1)).bit_count()

    ops, i, j = [], 0, 0
    best = length(0, n)
    while i < m and j < n:
        if left[i] == right[j]:
            ops.append(("equal", i, j))
            i, j, best = i + 1, j + 1, best - 1
        elif not row_of(i) >> (n - j - 1) & 1 or length(i + 1, n - j) == best:  # an insertion would lose one, or a deletion loses none
            ops.append(("delete", i, None))
            i += 1
        else:
            ops.append(("insert", None, j))
            j += 1
    return ops + [("delete", k, None) for k in range(i, m)] + [("insert", None, k) for k in range(j, n)]


def differences(left: list[str], right: list[str]) -> list[dict]:
    """Alignment with a neighbouring deletion and insertion of similar text as one modification (Q3, JN19)."""
    ops, out, k = aligned(left, right), [], 0
    canon = lambda x: "".join(c for c in x if not c.isspace() and c not in "()（）")
    while k < len(ops):
        kind, i, j = ops[k]
        other = ops[k + 1] if k + 1 < len(ops) else ("", None, None)
        if {kind, other[0]} == {"delete", "insert"}:
            a, b = (i, other[2]) if kind == "delete" else (other[1], j)
            s = similarity_of(canon(left[a]), canon(right[b]))
            if s >= SIMILAR:
                out.append({"kind": "modified", "left": a, "right": b, "similarity": s})
                k += 2
                continue
        out.append({"kind": kind, "left": i, "right": j, "similarity": 1.0 if kind == "equal" else None})
        k += 1
    return out


def compared(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with `ops` for two arrays of paragraphs: a pair of documents is a row, so Spark deals the pairs out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ops=[differences(list(a), list(b)) for a, b in zip(f[left], f[right])])

    return pairs.mapInPandas(run, pairs.select("*", F.lit(None).cast(OPS).alias("ops")).schema)


def op_counts(ops: str = "ops") -> list[Column]:
    """How many operations of each kind there are (Q6)."""
    count = lambda kind: F.size(F.filter(ops, lambda o: o["kind"] == kind)).cast("long").alias(kind)
    return [count(kind) for kind in ("equal", "modified", "delete", "insert")]


#: What a run's format is made of; a run's colour and text don't count.
RUN_ATTRIBUTES = ("style", "bold", "italic", "underline", "vert_align", "size", "font_ascii", "font_east_asia")
RUN = "struct<text: string, style: string, bold: boolean, italic: boolean, underline: string, vert_align: string, size: string, font_ascii: string, font_east_asia: string>"
PARAGRAPH = f"struct<style: string, has_drawing: boolean, text: string, runs: array<{RUN}>>"


def run_signature(runs: Column) -> Column:
    """Formats of a paragraph's runs with their counts, sorted (AG7)."""
    text = lambda r, a: F.coalesce(r[a].cast("string"), F.lit("-"))
    short = {"bold": "b", "italic": "i", "underline": "u", "vert_align": "va", "size": "sz"}
    parts = lambda r: [F.concat(F.lit(f"{short.get(a, a)}="), text(r, a)) for a in RUN_ATTRIBUTES[:6]]
    fonts = lambda r: F.concat(F.lit("font="), text(r, "font_ascii"), F.lit("/"), text(r, "font_east_asia"))
    keys = F.transform(runs, lambda r: F.concat_ws(";", *parts(r), fonts(r)))
    counted = lambda ks: F.transform(
        F.array_sort(F.array_distinct(ks)),
        lambda k: F.concat(k, F.lit(" x"), F.size(F.filter(ks, lambda x: x == k)).cast("string"))
    )
    return F.array_join(T.let(keys, counted), "; ")


def format_changes(left: Column, right: Column) -> Column:
    """Array of (field, left, right) of what differs between two paragraphs: style, drawing, the runs' signature (Q4)."""
    side = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    entry = lambda name, a, b: F.when(~a.eqNullSafe(b), F.struct(F.lit(name).alias("field"), side(a).alias("left"), side(b).alias("right")))
    runs = entry("runs", run_signature(left["runs"]), run_signature(right["runs"]))
    fields = F.array(entry("paragraph.style", left["style"], right["style"]), entry("paragraph.has_drawing", left["has_drawing"], right["has_drawing"]), runs)
    return F.filter(fields, lambda x: x.isNotNull())


def format_kind(left: Column, right: Column) -> Column:
    """Real, SplitOnly or None for two paragraphs (PARAGRAPH); runs are compared up to the shorter list (Q4, Q5)."""
    unlike = lambda a, b: ~reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in RUN_ATTRIBUTES])
    shorter = F.least(F.size(left["runs"]), F.size(right["runs"]))
    differs = F.exists(F.zip_with(F.slice(left["runs"], 1, shorter), F.slice(right["runs"], 1, shorter), unlike), lambda x: x)
    same_text = T.collapsed(left["text"]).eqNullSafe(T.collapsed(right["text"]))
    split = ~differs & (F.size(left["runs"]) != F.size(right["runs"])) & (run_signature(left["runs"]) != run_signature(right["runs"])) & same_text
    real = ~left["style"].eqNullSafe(right["style"]) | (left["has_drawing"] != right["has_drawing"]) | differs
    return F.when(split, "SplitOnly").when(real, "Real").when(same_text, "SplitOnly").otherwise("None")


# fixed values: tags that go with all they hold, and attributes that go
NOISE_TAGS = {t.lower() for t in "w:proofErr w:noProof w:commentRangeStart w:commentRangeEnd w:commentReference w:smartTag w:smartTagPr".split()}
NOISE_ATTRIBUTES = {"w:legacy", "w:dirty", "w:placeholder"}


def canonical_xml(xml: str | None) -> str | None:
    """A part without noise: dropped tags with their content, dropped attributes, the others sorted, texts trimmed (HS6).

    What follows broken XML is left out.
    """
    if xml is None:
        return None
    out, skipped = [], []
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        if skipped or name.lower() in NOISE_TAGS:
            skipped.append(name)
            return
        kept = sorted((k, v) for k, v in attributes.items() if "rsid" not in k.lower() and k.lower() not in NOISE_ATTRIBUTES)
        out.append("<" + name + "".join(f' {k}="{v}"' for k, v in kept) + ">")

    def end(name: str) -> None:
        if skipped:
            skipped.pop()
        else:
            out.append(f"</{name}>")

    def text(data: str) -> None:
        if not skipped:
            out.append(data.strip())

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.buffer_text = start, end, text, True
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return "".join(out)


@F.pandas_udf(StringType())
def _canonical(x: pd.Series) -> pd.Series:
    return x.map(canonical_xml)


def content_fingerprint(xml: Column) -> Column:
    """64 bits of a part's canonical XML: equal for parts that differ in noise alone (HS6)."""
    return F.xxhash64(_canonical(xml))
