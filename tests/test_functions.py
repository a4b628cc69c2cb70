"""Golden rows of text, markup, comparison, graph and rule functions, and edge cases."""

import io
import itertools
import json
import random
import struct
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import markup as M
from ledgerloom.functions import text as T
from ledgerloom.operators import algorithms as A
from ledgerloom.operators import compare as C
from ledgerloom.operators import profiles as P
from ledgerloom.operators import quality as Q
from ledgerloom.operators import tree as N
from ledgerloom.operators import graph as G
from ledgerloom.operators import relational as R
from ledgerloom.operators import rules as L
from ledgerloom.operators import sequences as S
from ledgerloom.sources import files
from ledgerloom.sources.needles import contained
from ledgerloom.streaming import jobs


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_normalize(spark):
    assert value(spark, T.normalize(F.col("x")), x="摘要 网络— 1 引言 “Hello”") == '摘要网络-1引言"Hello"'


@pytest.mark.parametrize(("a", "b", "ratio"), [("one two", "onetwo", 1.0), ("abc", "", 0.0), ("", "abc", 0.0), ("ab", "abcd", 0.5)])
def test_char_ratio(spark, a, b, ratio):
    assert value(spark, T.char_ratio(F.col("a"), F.col("b")), a=a, b=b) == ratio


def test_preview(spark):
    assert value(spark, T.preview(F.col("x"), 5), x=" ab \n cdef ") == "ab cd..."
    assert value(spark, T.preview(F.col("x"), 9), x="ab  c") == "ab c"


@pytest.mark.parametrize(("line", "left"), [("a % b", "a "), (r"a \% b", r"a \% b"), (r"a \\% b", r"a \\"), ("%", ""), ("a", "a")])
def test_comments(spark, line, left):
    assert value(spark, T.without_comments(F.col("x")), x=line) == left


@pytest.mark.parametrize(("numbers", "text"), [([5, 1, 2, 4, 7, 2], "1-2,4-5,7"), ([3], "3"), ([], "")])
def test_compressed_ranges(spark, numbers, text):
    df = spark.createDataFrame([(numbers,)], "n array<int>")
    assert df.select(T.compressed_ranges(F.col("n"))).first()[0] == text


@pytest.mark.parametrize(
    ("key", "kind"),
    [
        ("Section:intro", "section"),
        ("sec:2", "section"),
        ("prop:q", "proposition"),
        ("theorem:main", "theorem"),
        ("TBL:sizes", "table"),
        ("equation:9", "equation"),
        ("FIG:map", "figure"),
        ("algorithm:sort", "algorithm"),
        ("figure", "unknown"),
        ("", "unknown")
    ]
)
def test_label_kind(spark, key, kind):
    assert value(spark, T.label_kind(F.col("x")), x=key) == kind


def test_codes(spark):
    assert value(spark, T.code_normal(F.col("x")), x=" ab-oil 1") == "AB0111"
    assert value(spark, T.code_grouped(F.col("x")), x="ABCDEFGHI") == "ABCD-EFGH-I"
    assert value(spark, T.code_grouped(F.col("x")), x="ABCDEFGH") == "ABCD-EFGH"
    assert value(spark, T.code_preview(F.col("x")), x="ABCD-EFGH-IJKL-MN") == "ABCDEFGH****KLMN"
    body = "XYZ" + "A" * 20
    check = value(spark, T.code_checksum(F.col("x")), x=body)
    assert value(spark, T.code_valid(F.col("x"), "XYZ"), x=body + check)
    assert not value(spark, T.code_valid(F.col("x"), "XYZ"), x=body + ("00" if check != "00" else "01"))


def test_paths_and_commands(spark):
    assert value(spark, T.posix_path(F.col("x")), x="a\\.\\b//c") == "a/b/c"
    assert value(spark, T.extension_is(F.col("x"), ["tex", "sty"]), x="a/b.TEX")
    assert value(spark, T.command_arguments(F.col("x"), "cite"), x=r"\cite[p.~3]{a, b} \citep{c} \cite {d}") == ["a, b", "d"]
    assert value(spark, T.split_keys(F.col("x")), x=" a, ,b ") == ["a", "b"]
    assert value(spark, T.xml_escaped(F.col("x")), x='<a&"b">') == "&lt;a&amp;&quot;b&quot;&gt;"
    assert value(spark, T.paragraph_boundaries(F.col("x")), x="a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"


def test_braces_and_arguments(spark):
    assert [value(spark, M.matching_brace(F.col("x"), F.lit(i)), x="[x{y{z}w}") for i in (2, 4, 0)] == [8, 6, None]
    assert value(spark, M.matching_brace(F.col("x"), F.lit(0)), x="{q\\} r}") == 6 and value(spark, M.matching_brace(F.col("x"), F.lit(0)), x="{open") is None
    assert value(spark, M.matching_bracket(F.col("x"), F.lit(1)), x="p[q[r]s]t") == 7
    assert value(spark, M.brace_depth(F.col("x")), x="{p{q{r}}}\\{ {s}") == 3
    assert value(spark, M.command_argument(F.col("x"), "head"), x="\\header{no} \\head {on{e} \\} two} rest") == "on{e} \\} two"
    assert value(spark, M.command_argument(F.col("x"), "head"), x="nothing") is None
    nested = "".join(f"\\textbf{{{c}" for c in "abcdefghij") + "}" * 10
    assert value(spark, M.replaced_command(F.col("x"), "textbf"), x=nested) == "abcdefghij"  # deeper than any fixed number of rounds
    assert value(spark, M.replaced_command(F.col("x"), "note", "<$1>"), x="\\note{p \\b{q} \\{ r}") == "<p \\b{q} \\{ r>"


def test_math(spark):
    clean = lambda x: value(spark, M.clean_math(F.col("x")), x=x)
    assert [
        clean(r"{\beta}"),
        clean(r"S=\{a_1,\ldots\}"),
        clean(r"\mathbf{V}\leq\sigma"),
        clean(r"x_{i-1}^{\mathrm{up}}"),
        clean(r"\mathcal{L}~z")
    ] == ["β", "S={a_1,…}", "V≤sigma", "x_{i-1}^{up}", "ℒ z"]
    assert value(spark, M.math_text(F.col("x")), x=r"p $\pi$ q \(r \in s\) $$t$$") == "p π q r ∈ s $$t$$"
    parts = lambda x: [tuple(r) for r in value(spark, M.math_parts(F.col("x")), x=x)]
    assert parts(r"p $q$ r $$s$$ \(t\)") == [("text", "p "), ("math", "q"), ("text", " r "), ("text", "$$s$$"), ("text", " "), ("math", "t")]
    assert parts("p $$ q $r") == [("text", "p "), ("text", "$$"), ("text", " q "), ("text", "$r")] and parts("") == []


def test_latex_text(spark):
    cites, labels = F.create_map(F.lit("p"), F.lit(1), F.lit("q"), F.lit(2), F.lit("r"), F.lit(5)), F.create_map(F.lit("sec:1"), F.lit("4"))
    text = "\\textbf{Big \\emph{deal}} ``said'' -- \\footnote{see \\textit{this}} 7\\% \\{set\\} \\ref{sec:1} \\citep{q,p,x,r} \\cite{none} % gone\n\\item[1.] first \\item next\\hspace{1em}\\odd{kept} \\label{sec:1}end"
    plain = "Big deal “said” – （注：see this） 7% {set} 4 [1-2,5] [?] 1. first next kept end"
    assert value(spark, M.latex_text(F.col("x"), cites, labels), x=text) == plain
    runs = value(spark, M.styled_runs(M.latex_text(F.col("x"), cites, labels, marked=True)), x=text)
    assert "".join(r["text"] for r in runs) == plain and [(r["style"], r["text"]) for r in runs if r["style"] != "plain"] == [("bold", "Big deal"), ("italic", "this")]


def test_markup(spark):
    assert value(spark, M.plain_text(F.col("x")), x="\\textbf{a \\emph{b}} 5\\% $\\alpha$ \\noindent c~d % note") == "a b 5% α c d"
    numbers = F.create_map(F.lit("fig:1"), F.lit("3"))
    assert value(spark, M.references_resolved(F.col("x"), numbers), x="see \\ref{fig:1}, \\ref{a,b}, \\eqref{fig:1}") == "see 3, ??, (3)"
    assert [tuple(r) for r in value(spark, M.script_runs(F.col("x")), x="a^{2}b_{i}")] == [("normal", "a"), ("superscript", "2"), ("normal", "b"), ("subscript", "i")]
    assert tuple(value(spark, M.multi_cell(F.col("x")), x="\\multicolumn{3}{c}{ab }")) == (3, "ab")
    assert tuple(value(spark, M.multi_cell(F.col("x")), x=" q ")) == (1, "q")
    assert value(spark, M.width_ratio(F.col("x")), x="height=3, width=.7\\textwidth") == 0.7
    assert value(spark, M.width_ratio(F.col("x")), x="width=\\linewidth") == 1.0


def brute_lcs(a, b):
    if not a or not b:
        return 0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(0, 14))) for _ in range(2))
        assert C.lcs_length(a, b) == brute_lcs(a, b)
        ops = C.aligned(list(a), list(b))
        assert sum(k == "equal" for k, _, _ in ops) == brute_lcs(a, b)
        assert [i for _, i, _ in ops if i is not None] == list(range(len(a)))
        assert [j for _, _, j in ops if j is not None] == list(range(len(b)))


def test_alignment_takes_deletions_first_and_little_memory():
    def by_table(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(reversed(range(len(a))), reversed(range(len(b)))):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            kind = "equal" if a[i] == b[j] else "delete" if table[i + 1][j] >= table[i][j + 1] else "insert"
            out.append((kind, None if kind == "insert" else i, None if kind == "delete" else j))
            i, j = i + (kind != "insert"), j + (kind != "delete")
        return out + [("delete", k, None) for k in range(i, len(a))] + [("insert", None, k) for k in range(j, len(b))]

    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        assert C.aligned(a, b) == by_table(a, b)
    left = [rng.randrange(3000) for _ in range(12_000)]
    right = [x if rng.random() < 0.7 else -1 for x in left]
    tracemalloc.start()
    found = C.aligned(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and sum(k == "equal" for k, _, _ in found) == C.lcs_length(left, right)


def test_similarity(spark):
    assert value(spark, C.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert value(spark, C.similarity(F.col("a"), F.col("b")), a="a (b)", b="ab") == 1.0
    assert value(spark, C.similarity(F.col("a"), F.col("b")), a="abcd", b="abxd") == 0.75


def test_modified_pair():
    found = C.differences(["same", "the quick brown fox"], ["same", "the quick brown fix", "new"])
    assert [(d["kind"], d["left"], d["right"]) for d in found] == [("equal", 0, 0), ("modified", 1, 1), ("insert", None, 2)]


def test_format_kind(spark):
    kind = C.PARAGRAPH
    run = lambda b=False, **k: ("x", None, b, False, k.get("u"), k.get("va"), k.get("sz"), k.get("font"), k.get("east"))
    p = lambda bolds: ("s", False, "t", [run(b) for b in bolds])
    pairs = [(p([False]), p([False, False])), (p([False]), p([True])), (p([True]), ("other", False, "t", [run(True)]))]
    pairs += [(p([False]), ("s", False, "t", [run(**{k: "v"})])) for k in ("u", "va", "sz", "font", "east")] + [
        (p([False]), ("s", True, "t", [run()])),
        (p([False]), ("s", False, " t\n", [run()])),
        (p([False]), ("s", False, "u", [run()]))
    ]
    df = spark.createDataFrame(pairs, f"l {kind}, r {kind}").coalesce(1)
    assert [r[0] for r in df.select(C.format_kind(F.col("l"), F.col("r"))).collect()] == ["SplitOnly", "Real", "Real"] + ["Real"] * 6 + ["SplitOnly", "None"]
    changes = df.select(C.format_changes(F.col("l"), F.col("r")).alias("c")).collect()
    assert [[x["field"] for x in r["c"]] for r in changes] == [["runs"], ["runs"], ["paragraph.style"]] + [["runs"]] * 5 + [["paragraph.has_drawing"], [], []]


def test_fingerprints(spark):
    part = '<w:p xmlns:w="u" w:rsidR="{}" b="2" a="1"><w:proofErr><w:t>no</w:t></w:proofErr><w:t> hi </w:t>{}</w:p>'
    rows = [part.format("00A1", ""), part.format("FF", "").replace('b="2" a="1"', 'a="1" b="2"'), part.format("00A1", "<w:t>more</w:t>"), None]
    found = [
        r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(C.content_fingerprint(F.col("x"))).collect()
    ]
    assert found[0] == found[1] != found[2]
    assert C.canonical_xml(rows[0]) == '<w:p a="1" b="2" xmlns:w="u"><w:t>hi</w:t></w:p>'


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in G.include_levels(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}  # a diamond is no cycle
    cycle = edges.union(spark.createDataFrame([("e", "a")], "parent string, child string"))
    with pytest.raises(ValueError, match="cycle"):
        G.include_levels(cycle, roots, most=8)


def test_heading_numbers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 3, 1, 2, 4])], "d int, pos int, level int")
    assert [r["number"] for r in S.heading_numbers(df, ["d"], ["pos"], "level").orderBy("pos").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1", "2.1.0.1"]


def test_first_last_and_ambiguity(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 3, None)], "k string, pos int, v string")
    assert {tuple(r) for r in S.first_occurrence(df, ["k"], ["pos"]).collect()} == {("k", 1, "a"), ("j", 3, None)}
    assert {tuple(r) for r in S.last_occurrence(df, ["k"], ["pos"]).collect()} == {("k", 2, "b"), ("j", 3, None)}
    scores = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.78), (2, "a", 0.9), (3, "a", 0.2), (3, "b", 0.2)], "d int, p string, c double")
    assert {r["d"]: (r["p"], r["ambiguous"]) for r in S.ambiguity(scores, ["d"], "c", "p").collect()} == {1: ("a", True), 2: ("a", False), 3: ("a", False)}


def test_relational(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "k int, s string, n int")
    patch = spark.createDataFrame([(1, None, 7), (3, "z", 1)], "k int, s string, n int")
    assert {tuple(r) for r in R.patched(base, patch, "k").collect()} == {(1, "a", 7), (2, None, 6)}
    assert {tuple(r) for r in R.upserted(base, patch, "k").collect()} == {(1, None, 7), (2, None, 6), (3, "z", 1)}
    assert [r["k"] for r in R.page(base, [F.col("k")], 0, 1000).collect()] == [1, 2]
    assert R.page(base, [F.col("k")], 2, 1).first()["k"] == 2
    empty = base.limit(0)
    assert R.upserted(empty, empty, "k").count() == 0
    sums = base.select(F.lit("refund").alias("t"), "n").agg(R.signed_sum(F.col("t"), F.col("n"), "reserve", "refund").alias("v"))
    assert sums.first()["v"] == 0


def test_rules(spark):
    score = lambda u, w, m: value(spark, L.penalty_score(F.lit(u), F.lit(w), F.lit(m)))
    assert [score(0, 0, 0), score(1, 0, 0), score(0, 1, 3), score(9, 9, 9)] == [100, 82, 82, 0]
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, L.mean_abs_difference(vec(1, 2), vec(2, 4))) == 1.5
    assert value(spark, L.mean_abs_difference(vec(1), vec(2, 4))) == 255.0
    assert value(spark, L.ssim(vec(1, 2, 3), vec(1, 2, 3))) == pytest.approx(1.0)
    kinds = spark.createDataFrame([(1, "Text"), (1, "A"), (2, "A"), (2, "B"), (3, "Text")], "p int, k string")
    assert {r["p"]: r["v"] for r in kinds.groupBy("p").agg(L.folded_kind(F.col("k")).alias("v")).collect()} == {1: "A", 2: "Mixed", 3: "Text"}
    signals = spark.createDataFrame([(1, "m", "A"), (1, "m", "a"), (1, "m", "a")], "d int, kind string, value string")
    profiles = spark.createDataFrame([("p", "m", "a", 0.3)], "profile_id string, kind string, value string, weight double")
    assert L.weighted_scores(signals, ["d"], profiles).first()["confidence"] == 0.6


def test_contained_in_parts(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "def"), (3, None)], "id int, t string")
    needles = spark.createDataFrame([("abc",), ("def",), ("zz",)], "n string")
    assert {(r["id"], r["n"]) for r in contained(texts, "t", needles, "n", most=3).collect()} == {(1, "abc"), (1, "def"), (2, "def")}
    assert contained(texts, "t", needles.limit(0), "n").count() == 0


def test_bibliography(spark):
    source = '@book{a, title = {A {Nested} Title}, author = "X Y and Z", publisher={P}, year = 1999}\n% @x{c}\n@article{b, author={Q}}\n@misc{d, title={Open'
    df = files.bib_entries(spark.createDataFrame([(source,), (None,)], "text string"))
    assert [tuple(r) for r in df.collect()] == [("book", "a", "A Nested Title", ["X Y", "Z"], "1999", "P"), ("misc", "d", "Open", [], None, None)]


def test_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/main.tex", "x")
        z.writestr(
            "word/document.xml",
            '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Hi</w:t></w:r><w:r><w:t> there</w:t></w:r></w:p></w:document>'
        )
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "x.zip").write_bytes(buffer.getvalue())
    found = files.folder(spark, str(tmp_path / "in"))
    assert found.first()["path"] == "sub/x.zip"
    entries = files.zip_entries(found)
    assert {r["path"] for r in entries.collect()} == {"a/main.tex", "word/document.xml"}
    p = files.docx_paragraphs(entries).first()
    assert (p["style"], p["text"], [r["bold"] for r in p["runs"]]) == ("H1", "Hi there", [True, False])
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    sizes = spark.createDataFrame([(png,), (b"no",)], "c binary").select(files.image_size(F.col("c")).alias("s")).collect()
    assert [tuple(sizes[0]["s"]), sizes[1]["s"]] == [(640, 480), None]
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 300, 200) + b"\x03" * 20
    assert tuple(value(spark, files.image_size(F.col("c")), c=bytearray(jpeg))) == (200, 300)
    assert value(spark, files.image_size(F.col("c")), c=bytearray(b"\xff\xd8\xff\xd9")) is None
    rows = spark.createDataFrame([("j1", 1), ("j2", 2)], "job string, n int")
    files.write_artifacts(rows, str(tmp_path / "out"), "job")
    files.write_artifacts(rows, str(tmp_path / "out"), "job")
    assert spark.read.parquet(str(tmp_path / "out")).filter("job = 'j1'").count() == 2


def test_event_lines(spark):
    lines = spark.createDataFrame([('{"type": "heading", "level": 1}',), ("",), ("# note",), ('{"schema": "v2"}',), ('{"type": "x", "schema": "v2"}',)], "value string")
    assert [r["type"] for r in files.event_lines(lines).collect()] == ["heading", "x"]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.event_lines(spark.createDataFrame([("{broken",)], "value string")).collect()


def test_streams(spark, tmp_path):
    from conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    jobs.run_to_table(jobs.job_states(stream), "states", "complete", str(tmp_path / "c1"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(spark.table("states"), jobs.job_states(events))
    jobs.run_to_table(jobs.usage_windows(stream), "windows", "append", str(tmp_path / "c2"))
    batch = jobs.usage_windows(events)
    closed = batch.filter(F.col("start") < spark.table("windows").agg(F.max("start")).first()[0])
    assert spark.table("windows").join(closed, ["start", "event_type", "n"]).count() == closed.count() > 0


def test_wide_text(spark):
    assert value(spark, T.display_width(F.col("x")), x="a摘要b") == 6
    assert value(spark, T.without_wide_spaces(F.col("x")), x="摘 要 a 要") == "摘要 a 要"
    assert value(spark, T.wrapped(F.col("x"), 7), x="aa bb  cc dddddddddd e") == ["aa bb", "cc", "dddddddddd", "e"]
    assert value(spark, T.wrapped(F.col("x"), 7), x="") == []


def test_includes(spark):
    targets = spark.createDataFrame([("", "a"), ("d", "b"), ("", "none")], "base string, target string")
    paths = spark.createDataFrame([("a.tex",), ("a",), ("d/b.tex",)], "path string")
    assert {(r["target"], r["path"]) for r in G.first_existing(targets, paths, [".tex"]).collect()} == {("a", "a"), ("b", "d/b.tex"), ("none", None)}
    rows = [(1, "main", "x \\input{a} y \\include{b}"), (1, "a", "A\\input{b}$1"), (1, "b", "B\\n"), (2, "main", "\\input{main}")]
    out = {(r["project"], r["path"]): r["text"] for r in G.spliced(spark.createDataFrame(rows, "project int, path string, text string")).collect()}
    assert out[1, "main"] == "x AB\\n$1 y B\\n" and out[2, "main"] == "\\input{main}"


def test_carried_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, 3, "a"), (1, 1, 0, 1, "b"), (1, 2, 1, 1, "c"), (1, 3, 0, 1, "d")], "t int, row int, col int, span int, text string")
    assert [r["covered"] for r in S.carried_rows(cells, ["t"]).orderBy("row").collect()] == [False, True, False, False]


def test_comment_variants(spark):
    text = "a % x\n  % whole\n b\\% c %y\n   d"
    strip = lambda **k: value(spark, T.without_comments(F.col("x"), **k), x=text)
    assert strip() == "a \n  \n b\\% c \n   d"
    assert strip(keep_escaped=False) == "a \n  \n b\\\n   d"
    assert strip(whole_lines=True) == "a \n b\\% c \n   d"
    assert strip(join_lines=True) == "a b\\% c d"


def test_options_and_names(spark):
    found = value(spark, T.commands_with_options(F.col("x"), "documentclass"), x="\\documentclass[a, b]{c} \\documentclass{d} \\documentclass[]{e}")
    assert [tuple(r) for r in found] == [("a, b", "c"), (None, "d"), ("", "e")]
    assert value(spark, T.same_word(F.lit("TikZ"), F.lit("tikz"))) and not value(spark, T.same_word(F.lit("É"), F.lit("é")))
    assert tuple(value(spark, T.fitted_extent(F.lit(1000), F.lit(500)))) == (5274310, 2637155) and tuple(value(spark, T.fitted_extent(F.lit(96), F.lit(48)))) == (914400, 457200)


def test_algorithm_rows(spark):
    body = "\\KwIn{s}\n\\While{$a < b$}{\n a $+$ 1\\; \\tcp*{step}\n \\If{c}{ d }\n}\n\\Return{a}\\;"
    rows = [(r["indent"], r["code"], r["comment"], r["keyword"]) for r in value(spark, A.algorithm_rows(F.col("x")), x=body)]
    assert rows == [
        (0, "While (a < b)", "", "While"),
        (1, "a + 1;", "step", None),
        (1, "If (c)", "", "If"),
        (2, "d;", "", None),
        (1, "end", "", "End"),
        (0, "end", "", "End"),
        (0, "return a;", "", "Return")
    ]


def test_algorithm_cases(spark):
    rows = A.algorithm_lines(r"\KwIn{x}" + "\n" + r"\KwOut{y}" + "\n" + r"\Return{x + 1}")
    assert [(r["code"], r["keyword"]) for r in rows] == [("return x + 1", "Return")]
    rows = A.algorithm_lines(r"\KwIn{L}" + "\n" + r"\ForEach{$l \in L$}{$a = $l\;\Return{$a$}\}")
    assert [(r["indent"], r["code"], r["keyword"]) for r in rows] == [(0, "ForEach (l ∈ L)", "ForEach"), (1, "a = l;", None), (1, "return a", "Return"), (0, "end", "End")]
    (row,) = A.algorithm_lines(r"a = b \tcp*{test comment}")
    assert row["comment"] == "test comment" and row["code"] == "a = b;"
    (row,) = A.algorithm_lines(r"A \leftarrow TopK(H, K) \tcp*{by $w_p$ the first $K$}")
    assert row["comment"] == "by wp the first K" and row["code"] == "A ← TopK(H, K);"
    loop = "\n".join([r"\For{$i$}", "{", r"  \If{a}{x\; y,", r" z} \tcp*{why}", "}", "last"])
    assert [(r["indent"], r["code"], r["comment"], r["guides"], r["end_guides"]) for r in A.algorithm_lines(loop)] == [
        (0, "For (i)", "", [0], [0]),
        (1, "If (a)", "why", [0], [0]),
        (2, "x;", "", [0], []),
        (2, "y,", "", [0], []),
        (2, "z;", "", [0], []),
        (1, "end", "", [0], []),
        (0, "end", "", [0], []),
        (0, "last;", "", [0], []),
    ]
    deep = A.algorithm_lines(r"\If{a}{" * 5000 + "x" + "}" * 5000)
    assert max(r["indent"] for r in deep) == 5000 and len(deep) == 10_001
    head = value(spark, A.algorithm_inputs(F.col("x")), x="\n".join([r"\caption{On $x_1$}\label{a}", r" \KwIn{$A \cup B$}", r"\KwResult{r}", r"\label{alg:1}", r"\KwOut{open"]))
    assert ([tuple(i) for i in head["io"]], head["caption"], head["label"]) == ([("Input", "A ∪ B"), ("Result", "r")], "On x1", "alg:1")
    assert A.algorithm_lines("") == []


def test_front_matter(spark):
    text = "\\title{On \\emph{Things}}\\author{A B \\and C D}\\institute{X \\and Y}\\keywords{one, two; three}\\begin{abstract} short \\textbf{text}\\end{abstract}\\begin{IEEEbiography}{A B}was born.\\end{IEEEbiography}"
    assert [
        x if isinstance(x, (str, type(None))) else list(x) for x in value(spark, N.front_matter(F.col("x")), x=text)
    ] == ["On Things", ["A B", "C D"], ["X", "Y"], "short text", ["one", "two", "three"]]
    assert [tuple(r) for r in value(spark, N.biographies(F.col("x")), x=text)] == [("A B", "was born.")]


def test_visited_leaves_cycles_alone(spark):
    rows = [(1, "a", None, 0), (1, "b", "a", 1), (1, "c", "a", 0), (1, "d", "c", 5), (1, "x", "y", 0), (1, "y", "x", 0)]
    found = N.visited(spark.createDataFrame(rows, "tree int, node string, parent string, pos int")).orderBy("path").collect()
    assert [(r["node"], r["depth"]) for r in found] == [("a", 0), ("c", 1), ("d", 2), ("b", 1)]


def test_includes_that_are_not_there(spark):
    edges, nodes = spark.createDataFrame([("a", "b"), ("b", "z")], "parent string, child string"), spark.createDataFrame([("a",), ("b",)], "node string")
    with pytest.raises(ValueError, match="b -> z"):
        G.include_levels(edges, nodes.filter("node = 'a'"), nodes=nodes)
    long = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "parent string, child string")
    rows = [(1, str(i), f"{i} \\input{{{i + 1}}}") for i in range(20)] + [(1, "20", "end")]  # deeper than any fixed number of rounds
    assert {r["path"]: r["text"] for r in G.spliced(spark.createDataFrame(rows, "project int, path string, text string")).collect()}["0"].endswith("19 end")
    assert long.count() == 20


def test_quality_layers(spark):
    checked = spark.createDataFrame(
        [(1, "structural", "x", True), (1, "visual", "y", False), (2, "textual", "x", False), (2, "visual", "y", False), (3, "textual", "x", True)],
        "d int, layer string, name string, passed boolean"
    )
    assert {r["d"]: (r["passed"], r["exit_code"]) for r in Q.exit_codes(checked, ["d"]).collect()} == {1: (False, 2), 2: (False, 1), 3: (True, 0)}
    sides = spark.createDataFrame([(1, "a – b “c”", "a-b\"c\""), (2, "a", None)], "d int, left string, right string")
    ratios = Q.coverage_ratio(Q.coverage(sides, ["d"], ["left", "right"], ["a—b", "c ”"]), ["d"], ["left", "right"])
    assert {r["d"]: (r["hits"], r["ratio"]) for r in ratios.collect()} == {1: (2, 1.0), 2: (0, 0.0)}
    empty = spark.createDataFrame([(1, None, None)], "d int, confidence double, x string")
    assert Q.confident(empty).count() == 0


def test_rules_by_profile(spark):
    files = spark.createDataFrame(
        [
            (1, "a.TEX", "\\documentclass{Article}% \\usepackage{minted}\n\\usepackage{tikz,tikz}\\RequirePackage{biblatex}\\begin{minted}\\newcommand{\\a}{}\\define"),
            (1, "b.png", "\\usepackage{pgf}"),
            (1, "c.tex", None)
        ],
        "project int, path string, text string"
    )
    sources, profile = P.sources_of(files), spark.createDataFrame([(1, "jos-paper")], "project int, profile_id string")
    issues = lambda **k: {(r["code"], r["feature"], r["severity"]) for r in P.compatibility_issues(sources, profile, **k).collect()}
    shared = {("unsupported_environment", "minted", "U"), ("limited_package", "biblatex", "W"), ("custom_macros", "custom macros", "W")}
    assert issues() == shared | {("unsupported_package", "tikz", "U")} and issues(lenient=frozenset(["tikz", "minted_package"])) == shared | {("limited_package", "tikz", "W")}
    score = P.compatibility_scores(sources, P.compatibility_issues(sources, profile)).first()
    assert (score["unsupported"], score["warnings"], score["macros"], score["score"]) == (2, 2, 1, 100 - 36 - 12 - 2)
    signals = {
        (r["kind"], r["value"], r["line"]) for r in P.signals_of(
            P.sources_of(spark.createDataFrame([(1, "m.tex", "x\n\\affiliation{a}\n\\documentclass[b, c]{d}")], "project int, path string, text string"))
        ).collect()
    }
    assert signals == {("documentclass", "d", 3), ("documentclass_option", "b", 3), ("documentclass_option", "c", 3), ("macro", "affil", 2)}
    specs = spark.createDataFrame(
        [("1.json", '{"id": "p", "detection": {"min_confidence": 0.5}}'), ("2.json", '{"id": "p", "aliases": ["q"], "detection": {"min_confidence": 0.9}}')],
        "path string, text string"
    )
    assert [(r["id"], r["path"], r["min_confidence"], r["aliases"]) for r in P.known_profiles(specs).collect()] == [("p", "2.json", 0.9, ["q"])]


def test_rule_and_mapping_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text('[{"name": "a", "output": "Ignore"}, {"name": "b", "output": "Heading"}, {"name": "a", "output": "Verbatim"}]')
    rules = files.rule_file(spark, str(tmp_path / "rules.json")).withColumn("priority", F.lit(0))
    assert {r["name"]: r["output"] for r in L.registry(rules).collect()} == {"a": "Verbatim", "b": "Heading"}
    (tmp_path / "map.yaml").write_text("rules:\n  - kind: heading # top\n    rule_id: 'map.h'\n    element: \"w:p\"\n  - kind: table\n    element: w:tbl\n")
    assert [
        r["rule"] for r in files.mapping_file(spark, str(tmp_path / "map.yaml")).orderBy("position").collect()
    ] == [{"kind": "heading", "rule_id": "map.h", "element": "w:p"}, {"kind": "table", "element": "w:tbl"}]


def test_nested_mapping_files(spark, tmp_path):
    text = """# head
schema_version: "0.1"   # quoted
target: docx
rules:
  - id: map.heading
    source_ast_kind: Heading
    target_render_node: 'It''s'
    run_properties:
      vertical_align: superscript
      sizes: [1, 2.5, "a, b", {k: v, w: [x]}]
    validation: {required_text: true, media: null}
    note: |
      two
        lines

    odd key: plain # comment
  - id: map.cite
    source_inline_kind: Citation
    list:
    - a
    -   b: 1
        c: 2
    -
      - deep
  - id: map.image
    relationship_rule:
      type: image
    folded: >-
      one
      two
empty:
url: http://x.y/z#part
"""
    plain = {
        "schema_version": "0.1",
        "target": "docx",
        "rules": [
            {
                "id": "map.heading", "source_ast_kind": "Heading", "target_render_node": "It's",
                "run_properties": {"vertical_align": "superscript", "sizes": [1, 2.5, "a, b", {"k": "v", "w": ["x"]}]},
                "validation": {"required_text": True, "media": None}, "note": "two\n  lines\n", "odd key": "plain",
            },
            {"id": "map.cite", "source_inline_kind": "Citation", "list": ["a", {"b": 1, "c": 2}, ["deep"]]},
            {"id": "map.image", "relationship_rule": {"type": "image"}, "folded": "one two"},
        ],
        "empty": None,
        "url": "http://x.y/z#part",
    }
    assert files.mapping_tree(text) == plain
    assert files.mapping_tree("") is None and files.mapping_tree("- 1\n- [a]\n") == [1, ["a"]]
    (tmp_path / "map.yaml").write_text(text)
    tree = files.mapping_tree_file(spark, str(tmp_path / "map.yaml"))
    rules = files.mapping_rules(tree).orderBy("position").collect()
    assert [(r["id"], r["source_kind"], r["target_kind"], r["rule_type"]) for r in rules] == [
        ("map.heading", "Heading", "It's", "block"), ("map.cite", "Citation", None, "inline"), ("map.image", "", None, "resource"),
    ]
    assert json.loads(rules[0]["rule"].toJson())["validation"] == {"required_text": True, "media": None}


def test_images_with_many_segments(spark):
    segment = b"\xff\xe2" + struct.pack(">H", 6) + b"abcd"
    frame = b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, 300, 200) + bytes(4)
    rows = [b"\xff\xd8\xff\xe0" + struct.pack(">H", 2) + segment * 500 + frame, b"\xff\xd8" + segment * 3, b"\x89PNG", None, b""]
    found = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(rows)], "i int, c binary").select("i", files.image_size(F.col("c")).alias("s")).orderBy("i").collect()
    assert [r["s"] and tuple(r["s"]) for r in found] == [(200, 300), None, None, None, None]


def test_rows_are_numbered_over_partitions(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(300)).alias("k"), "id").repartition(7)
    found = files.numbered(rows, ["k", "id"]).collect()
    assert [(r["k"], r["id"]) for r in sorted(found, key=lambda r: r["n"])] == sorted((r["k"], r["id"]) for r in found)
    assert sorted(r["n"] for r in found) == list(range(1000))
    assert files.numbered(rows.limit(0), ["k"]).count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c"), (1, None)], "n int, t string")
    assert {
        tuple(r) for r in files.inserted(spark, rows, str(tmp_path / "t")).collect()
    } == {(2, "b|c"), (1, None)} and files.inserted(spark, rows.limit(1), str(tmp_path / "t")).count() == 1
    files.write_report(rows, str(tmp_path / "md"), "markdown", ["n"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| n | t |", "| --- | --- |", "| 1 |  |", "| 2 | b\\|c |"]
    files.write_report(rows, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert files.registry_json(rows, ["n"]).first()[0] == '[{"n":1},{"n":2,"t":"b|c"}]'


def test_streams_to_files(spark, tmp_path):
    from conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for _ in range(2):  # a second run finds nothing new
        jobs.run_to_files(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    jobs.run_to_snapshots(jobs.job_states(stream), str(tmp_path / "states"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "states")).select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_boundaries_of_validity(spark):
    """Codes are expired strictly before now, entitlements are valid up to and including it (Z15)."""
    from ledgerloom.operators import relational

    until, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz")
    assert value(spark, relational.code_expired(until, now)) is False and value(spark, relational.entitled(until, now)) is True
    assert value(
        spark,
        relational.code_expired(F.lit(None).cast("timestamp_ntz"), now)
    ) is False and value(spark, relational.entitled(F.lit(None).cast("timestamp_ntz"), now)) is True
