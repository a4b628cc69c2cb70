"""Every query with SQL against DuckDB on the same tables; the others must run with stable columns."""

import pytest

from conftest import SF
from ledgerloom.plans import ORACLE_SQL, QUERIES


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).toPandas()) > 0  # all columns computed


def test_doc_align_against_plain_python(spark):
    from ledgerloom.operators.compare import differences

    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    texts = {}
    for r in turns:
        texts.setdefault(r["conv_id"], []).append(r["text"])
    for r in QUERIES["doc_align"](spark, SF).collect():
        ops = [d["kind"] for d in differences(texts[r["conv_id"]], texts[r["conv_id"] + 1])]
        assert [r[k] for k in ("equal", "modified", "delete", "insert")] == [ops.count(k) for k in ("equal", "modified", "delete", "insert")]


def test_format_diff_compares_whole_texts(spark, tmp_path):
    turns = [(1, 0, "user", "one two three"), (1, 1, "assistant", "a"), (1, 2, "user", "one two four"), (1, 4, "user", "one two four")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["turn"]: r["kind"] for r in QUERIES["format_diff"](spark, str(tmp_path)).collect()} == {0: "None", 2: "SplitOnly"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["conv_id", "n", "latest"]


def plain_alignment(a, b):
    """(equal, delete, insert) by the definition: a longest common subsequence, deletions before insertions on ties."""
    from functools import cache

    @cache
    def longest(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + longest(i + 1, j + 1) if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

    i = j = 0
    ops = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            ops.append("=")
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest(i + 1, j) >= longest(i, j + 1)):
            ops.append(("-", a[i]))
            i += 1
        else:
            ops.append(("+", b[j]))
            j += 1
    return ops


def plain_similarity(a, b):
    a, b = ("".join(c for c in x if not c.isspace() and c not in "()\uff08\uff09") for x in (a, b))
    if a == b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(a), len(b))


def test_comparisons_against_the_definition(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(r["text"])
    for r in QUERIES["lcs_similarity"](spark, SF).collect():
        assert r["similarity"] == pytest.approx(plain_similarity(turns[r["conv_id"]][r["turn"] - 1], turns[r["conv_id"]][r["turn"]]), abs=1e-6)
    for r in QUERIES["doc_align"](spark, SF).collect():
        ops, count, k = plain_alignment(turns[r["conv_id"]], turns[r["conv_id"] + 1]), {"equal": 0, "modified": 0, "delete": 0, "insert": 0}, 0
        while k < len(ops):
            one, other = ops[k], ops[k + 1] if k + 1 < len(ops) else "="
            if one != "=" and other != "=" and one[0] != other[0] and plain_similarity(one[1], other[1]) >= 0.82:
                count["modified"] += 1
                k += 1
            else:
                count["equal" if one == "=" else "delete" if one[0] == "-" else "insert"] += 1
            k += 1
        assert {n: r[n] for n in count} == count
