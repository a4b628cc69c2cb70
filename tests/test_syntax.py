"""Trees, blocks and macros against plain Python."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions.macros import MAX_BODY, expanded_text, macros_defined, macros_expanded, resolved
from ledgerloom.operators import syntax as S
from ledgerloom.operators.tree import visited

PIECES = ["{", "}", "\\begin{a}", "\\end{a}", "\\begin{itemize}", "\\end{itemize}", "\\item ", "x", " ", "\n\n", "% c }\n", "$", "\\{", "\\", "&", "\\\\", "\\begin{tabular}{c}", "\\end{tabular}", "[l]", "\\begin{verbatim}", "\\end{verbatim}"]


def columns(rows):
    return list(zip(*rows.values()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_leaves_join_to_the_text(text):
    found = S.parsed(text)
    assert "".join(x for x in found["text"] if x) == text
    inner = [k in ("root", "group", "environment") for k in found["kind"]]
    assert all(i == (t is None) for i, t in zip(inner, found["text"]))
    seen = {}
    for node, parent, pos in zip(found["node"], found["parent"], found["pos"]):
        assert (parent is None) == (node == 0) and (parent is None or inner[parent] and parent < node)
        assert pos == seen.get(parent, 0)
        seen[parent] = pos + 1
    blocks = S.lowered(text)
    assert all(p is None or p < b for b, p in zip(blocks["block"], blocks["parent"]))


@pytest.mark.parametrize("text, errors", [("{a}", []), ("{a", ["group"]), ("}a}", ["error", "error"]), ("\\begin{a}{x\\end{a}\\end{b}", ["group", "error"]), ("{\\begin{a}}\\end{a}}", ["error"]), ("", [])])
def test_recovery(text, errors):
    found = S.parsed(text)
    assert [k for k, e in zip(found["kind"], found["error"]) if e] == errors


def test_time_is_in_proportion():
    text = "\\begin{itemize}\\item {x {y}} $m$ " * 30_000  # 1 MB, 30,000 lists deep
    began = time.thread_time()
    found = S.lowered(text)
    assert max(x or 0 for x in found["level"]) == 30_000 and time.thread_time() - began < 30


def test_blocks():
    text = (
        "before \\begin{document}\\section*{One {x}}\npara % no\n\n\\begin{minipage}{3cm}\\begin{figure}\\caption[s]{A {b}}\\label{q}x\\end{figure}\\end{minipage}\\begin{align*}y & z\\end{align*}"
        "\\begin{odd}z\\end{odd}\\sectionmark{q}\\begin{tabular}{cc} a & b\\\\ \\hline\\\\ & \\\\ \\cline{1-2} c \\& d & \\begin{itemize}\\item[k] e\\end{itemize}\\end{tabular}\\end{document}after"
    )
    found = [(r[0], r[1], *r[3:]) for r in columns(S.lowered(text))]
    assert found == [
        (0, None, "heading", "section", 2, "One {x}", None),
        (1, None, "paragraph", None, None, "para", None),
        (2, None, "captioned", "figure", None, None, "A {b}"),
        (3, 2, "paragraph", None, None, "x", None),
        (4, None, "equation", "align*", None, "y & z", None),
        (5, None, "raw", "odd", None, "z", None),
        (6, None, "paragraph", None, None, "\\sectionmark{q}", None),
        (7, None, "table", "tabular", None, None, None),
        (8, 7, "row", None, None, None, None),
        (9, 8, "cell", None, None, None, None),
        (10, 9, "paragraph", None, None, "a", None),
        (11, 8, "cell", None, None, None, None),
        (12, 11, "paragraph", None, None, "b", None),
        (13, 7, "row", None, None, None, None),
        (14, 13, "cell", None, None, None, None),
        (15, 14, "paragraph", None, None, "c \\& d", None),
        (16, 13, "cell", None, None, None, None),
        (17, 16, "list", "itemize", 1, None, None),
        (18, 17, "item", "k", None, None, None),
        (19, 18, "paragraph", None, None, "e", None),
    ]


def test_a_list_in_a_list_is_one_block():
    found = S.lowered("\\begin{itemize}\\item a \\begin{itemize} \\item b\\item c\\end{itemize} tail \\item d\\end{itemize} after")
    assert [(k, level) for k, level, p in zip(found["kind"], found["level"], found["parent"]) if p is None] == [("list", 1), ("paragraph", None)]
    assert [t for t in found["text"] if t] == ["a", "b", "c", "tail", "d", "after"]


def test_rows_of_many_documents(spark):
    texts = [(1, "a {b}", "k"), (2, None, "k"), (None, "\\begin{itemize}\\item x", "k"), (1, "a {b}", "k"), (4, "", "k")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, node string")
    rows = S.syntax_tree(docs, ["doc_id"]).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["kind"] == "root") == ["1", "1", "2", "4", "None"]
    blocks = S.block_tree(docs.drop("node"), ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["kind"]) for r in blocks) == [("1", "paragraph")] * 2 + [("None", "item"), ("None", "list"), ("None", "paragraph")]
    tree = S.syntax_tree(docs.filter("text IS NOT NULL AND doc_id IS NULL"), ["doc_id"]).withColumnRenamed("doc_id", "tree").fillna(0, ["tree"])
    assert visited(tree).count() == tree.count() and tree.count() > 4  # in the order a visitor meets them, from the root
    assert S.syntax_tree(docs.limit(0), ["doc_id"]).count() == 0


def plainly_expanded(bodies, text, calls=(), depth=0):
    """Calls replaced one at a time; a name that leads back to itself is left."""

    def leads_back(start):
        seen, todo = set(), [start]
        while todo:
            for x in re.findall(r"\\([a-z]+)", bodies.get(todo.pop(), "")):
                if x == start:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return False

    cyclic = {n for n in bodies if leads_back(n)}
    while True:
        changed = re.sub(r"\\([a-z]+)", lambda m: bodies[m[1]] if m[1] in bodies and m[1] not in cyclic else m[0], text)
        if changed == text:
            return text, cyclic
        text = changed


def test_macros_against_plain_replacement():
    rng = random.Random(4)
    for _ in range(200):
        names = rng.sample(["a", "b", "c", "d", "ab", "me"], 5)
        bodies = {n: "{" + "".join(rng.choice(["\\", "x\\"]) + rng.choice([*names, "textbf", "zz"]) + rng.choice([" ", "{q}"]) for _ in range(rng.randrange(3))) + "}." for n in names}
        call = "".join(f"\\{rng.choice([*names, 'abc'])};" for _ in range(6))
        text = "".join(rng.choice([f"\\newcommand{{\\{n}}}{{old}}", ""]) + rng.choice([f"\\renewcommand{{\\{n}}}{{{b}}}", f"\\def\\{n}{{{b}}}\n", f"\\newcommand*\\{n}[2]{{{b}}}"]) for n, b in bodies.items())
        expected, cyclic = plainly_expanded(bodies, call)
        assert expanded_text(text + call)[0] == expected
        assert {n for n, b in resolved(bodies).items() if b is None} == cyclic


@pytest.mark.parametrize(
    "text, plain",
    [
        ("\\newcommand{\\X}{hello} \\X world", " hello world"),
        ("\\newcommand{\\X}{hi} \\Xtra there", " \\Xtra there"),
        ("\\newcommand{\\me}{\\textbf{big} engine} by \\me.", " by \\textbf{big} engine."),
        ("\\newcommand{\\me}{old}\\def\\me{new \\x$}\\me, \\meet", "new \\x$, \\meet"),
        ("\\newcommand{\\open}{ \\open", "\\newcommand{\\open}{ \\open"),
        ("% \\def\\a{x}\n\\a", "% \\def\\a{x}\n\\a"),
        ("\\def\\a{\\}}\\a", "\\}"),
        ("", ""),
    ],
)
def test_macro_cases(text, plain):
    assert expanded_text(text)[0] == plain


def test_bodies_that_double_stay_bounded():
    chain = "".join(f"\\def\\{'a' * i}{{\\{'a' * (i + 1)}\\{'a' * (i + 1)}}}" for i in range(1, 60)) + f"\\def\\{'a' * 60}{{xy}}"
    text, macros = expanded_text(chain + "\\a \\" + "a" * 58)
    assert len(text) < 4 * MAX_BODY and text.endswith(" xyxyxyxy") and max(len(m["expanded"] or "") for m in macros) <= MAX_BODY


def test_macro_columns(spark):
    rows = spark.createDataFrame([("\\def\\a{x}\\a",), (None,), ("plain",)], "x string")
    found = rows.select(macros_expanded("x").alias("t"), macros_defined("x").alias("m")).collect()
    assert [r["t"] for r in found] == ["x", None, "plain"]
    assert [None if r["m"] is None else [tuple(m) for m in r["m"]] for r in found] == [[("a", "x", "x", False)], None, []]
