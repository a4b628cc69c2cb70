"""The ten operators against brute force, round trips and SQL, with null, empty, long, repeated and clashing rows."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerloom.llm import op2_decontamination as op2
from ledgerloom.llm import op10_toxicity as op10
from ledgerloom.llm import queries
from ledgerloom.llm._components import components
from ledgerloom.llm._shared import PLAIN_WORDS, work_path
from ledgerloom.llm.op1_substring_dedup import factor_documents
from ledgerloom.llm.op3_ngram_join import with_class_links, with_near_duplicates
from ledgerloom.llm.op4_token_ids import pack, read_token_files, unpack, word_encoder, write_token_files
from ledgerloom.llm.op5_quality_rules import with_quality
from ledgerloom.llm.op6_pii import with_surrogates
from ledgerloom.llm.op7_line_dedup import with_line_dedup, with_passage_dedup
from ledgerloom.llm.op8_byte_bpe import codec, decode_ids, encode_texts, ids_as_array
from ledgerloom.llm.op9_license_scan import license_words, with_licenses

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, kept int, score string, labels int, key int, block int, n int, hash int, place int, clean_text int, leaks int, n_lines int, sid int"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefgh", k=RNG.randrange(2, 7))) for _ in range(400)]
WORDS = lambda n: " ".join(RNG.choices(VOCABULARY, k=n))


@functools.cache
def corpus():
    """Texts with copies, near copies, shared passages, and all odd cases."""
    base, passage = [WORDS(60) for _ in range(6)], WORDS(30)
    texts = base + [
        base[0],
        base[0],
        base[1] + " more",
        base[2].upper(),
        WORDS(20) + " " + passage,
        passage + "\n" + WORDS(9),
        WORDS(8000) + " " + passage,
        "",
        "  \n ",
        "one two",
        "ONE two",
        "a\x1cb   c d",
        "é" * 40
    ]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return rows + [(3, base[2]), (3, base[2]), (None, base[4]), (None, None), (50, None), (-7, base[5] + " tail")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def test_word_hashes_tell_words_apart():
    words = [w.encode() for _, t in corpus() for w in WORD.findall(t or "")]
    assert len(set(PLAIN_WORDS.of(b" ".join(words)).tolist())) == len(set(words))
    assert all(len(PLAIN_WORDS.of((t or "").encode())) == len(WORD.findall(t or "")) for _, t in corpus())


def brute_windows(rows, size=13):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, np.inf), np.inf if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (np.inf if i is None else i):
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def test_op1(odd, empty):
    found = factor_documents(odd)
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()], key=repr) == brute_windows(corpus())
    assert all(f["length"] >= 13 for r in found.collect() for f in r["factors"])
    assert factor_documents(empty).count() == 0


def edit_distance_to_best_stretch(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_op2_recall_against_brute_force(spark):
    items = [(i, WORDS(n)) for i, n in enumerate([8, 16, 25, 40, 60, 3])]
    rows = []
    for k in range(60):
        words = items[k % 5][1].split()
        for _ in range(RNG.randrange(0, op2.allowed(len(words)) + 2)):
            p = RNG.randrange(len(words))
            words[p : p + 1] = RNG.choice([[], ["zz"], [words[p], "yy"]])
        rows.append((k, f"{WORDS(50)} {' '.join(words)} {WORDS(40)}"))
    true = {(d, i) for d, t in rows for i, x in items[:5] if edit_distance_to_best_stretch(x.split(), t.split()) <= op2.allowed(len(x.split()))}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (op2.MAX_ITEM_WORDS, 30):  # in one part and in several
        found = op2.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, most=most).collect()
        got = {(r["doc_id"], r["item_id"]) for r in found}
        assert got <= true and len(got) >= 0.95 * len(true)
        assert all(r["distance"] <= op2.allowed(len(items[r["item_id"]][1].split())) for r in found)


def test_op2_recall_wherever_the_edits_are():
    """As many edits as the bound allows: at random, at one end, in the middle, in any stretch, spread evenly, half at the start and half in the middle."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(3000)]
    draw = lambda n: rng.choices(vocabulary, k=n)
    total = 0
    for m in (6, 12, 24, 30, 60, 120, 200, 400):
        k, items = op2.allowed(m), [draw(m) for _ in range(40)]
        index = op2.ItemIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
        for places in (
            lambda: rng.sample(range(m), k),
            lambda: range(k),
            lambda: range(m - k, m),
            lambda: range((m - k) // 2, (m + k) // 2),
            lambda: [x + p for p in [rng.randrange(m - k + 1)] for x in range(k)],
            lambda: [int((j + 0.5) * m / k) for j in range(k)],
            lambda: [*range(k // 2), *range(m // 2, m // 2 + k - k // 2)],
        ):
            texts = []
            for w in items:
                changed = list(w)
                for p in places():
                    changed[p] = f"zz{rng.randrange(99)}"
                texts.append(" ".join(draw(30) + changed + draw(30)).encode())
            found = sum(any(leak[0] == i for leak in leaks) for i, leaks in enumerate(index.leaks(texts)))
            assert found >= 0.9 * len(items), (m, found)
            total += len(items)
    assert total > 1000


#: Two words that share a hash by the fixed keys.
ALIKE = "wsdoylrvzhgblglbluqilibtwobysyki", "jbrhbszpibdpvpkdxocssyzlqkqdvads"


def test_words_made_to_share_a_hash_are_told_apart(spark):
    rest = WORDS(12)
    rows = [(1, ALIKE[0]), (2, ALIKE[1]), (3, f"{rest} {ALIKE[0]}"), (4, f"{ALIKE[1]} {rest}"), (5, f"{rest} {ALIKE[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = with_near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert len({r["class_id"] for r in found}) == 5
    items = spark.createDataFrame([(1, f"one two three {ALIKE[0]}")], "item_id long, text string")  # four words: no edits
    texts = spark.createDataFrame([(1, f"x one two three {ALIKE[1]}"), (2, f"one two three {ALIKE[0].upper()} y")], "doc_id long, text string")
    assert [r["doc_id"] for r in op2.find_leaks(texts, items).collect()] == [2]


def test_op2_edges(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, corpus()[3][1]), (2, None), (3, ""), (None, "x " * 20)], "item_id long, text string")
    assert [(r["doc_id"], r["n_words"], r["distance"]) for r in op2.find_leaks(odd, benchmark).collect()] == [(4, 60, 0)]
    assert op2.find_leaks(empty, benchmark).count() == op2.find_leaks(odd, benchmark.limit(0)).count() == 0
    assert "text" in op2.with_leaks(odd, benchmark).columns


def brute_components(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[p : p + 5]) for p in range(len(w) - 4)})
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted([(i, len(sets[k]), smallest.get(find(k), i)) for k, (i, _) in enumerate(rows)], key=repr)


def test_op3(spark, odd, empty):
    found = with_near_duplicates(odd)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()], key=repr) == brute_components(corpus())
    assert with_near_duplicates(empty).count() == 0


def test_op3_chains_and_a_hot_group(spark, monkeypatch):
    from ledgerloom.llm import op3_ngram_join as op3

    monkeypatch.setattr(op3, "AT_ONCE", 3)
    monkeypatch.setattr(op3, "LEADERS", 2)
    words = WORDS(400).split()
    chain = [(i, " ".join(words[i * 6 : i * 6 + 90])) for i in range(40)]  # each links with its neighbours alone
    other = WORDS(50)
    hot = [(100 + i, other + " " + WORDS(1 + i % 9)) for i in range(60)]
    line = WORDS(12)
    unlike = [(200 + i, line + " " + WORDS(8)) for i in range(30)]
    rows = chain + hot + unlike
    RNG.shuffle(rows)
    found = with_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r)[:2] + (r["component_id"],) for r in found.collect()], key=repr) == brute_components(rows)


def brute_links(rows):
    """(n, n, overlap, links, links) of each link between different sets, the smaller set first."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = set()
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.add(frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[p : p + 5]) for p in range(len(w) - 4)}))
    sets = sorted(sets - {frozenset()}, key=len)
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    count = lambda x: sum(x in link for link in links)
    return [(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), count(a), count(b)) for a, b in links]


def test_op3_all_links(spark, odd, empty):
    words, other = WORDS(400).split(), WORDS(50)
    rows = [(i, " ".join(words[i * 6 : i * 6 + 90])) for i in range(40)] + [(100 + i, other + " " + WORDS(1 + i % 9)) for i in range(60)] + [(300, other), (301, other)]
    for df, own in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, corpus())):
        found, true = with_class_links(df).collect(), brute_links(own)
        ends = lambda n, m, o, x, y: (o, *sorted([(n, x), (m, y)]))  # noqa: E731  the order of sets of one size is that of their ids
        assert sorted(ends(*tuple(r)[2:]) for r in found) == sorted(ends(*x) for x in true) and true
        assert len({frozenset((r["class_a"], r["class_b"])) for r in found}) == len(found)
    assert {c for r in found for c in (r["class_a"], r["class_b"])} <= {r["class_id"] for r in with_near_duplicates(odd).collect()}
    assert with_class_links(empty).count() == 0


def test_components_on_a_long_path(spark):
    order = list(range(200))
    RNG.shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199) if i != 99], "a int, b int")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len(roots) == 200 and all(roots[x] == min(order[:100]) for x in order[:100]) and all(roots[x] == min(order[100:]) for x in order[100:])


def test_op4_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = pack(values[:n])
        assert unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values[:n].tolist()


def whole_ids(text):
    tokenizer = word_encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_op4_word_encoder_on_odd_words():
    text = "Don't <|endoftext|> İstanbul ǅ ß STRASSE É é é ﬁ Ａ １２ a1b2 x.y,z!! ... it'S Ⅷ ª ʰ ÑANDÚ ſ K 日本語  x y z q <b>A</b> \x1cq \x85 don't. end."
    encoder = word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(encoder.encode([text.encode()])[0], encoder.kind).tolist() == whole_ids(text)[:-1]


def test_op4_words_with_marks_are_learnt_by_their_parts():
    from ledgerloom.llm.op4_token_ids import WordEncoder

    encoder, calls = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    library = encoder.tokenizer

    class Counted:
        def encode(self, text, **settings):
            calls.append(text)
            return library.encode(text, **settings)

    encoder.tokenizer = Counted()
    stems, marks = ["word", "Straße", "era", "naïveté", "ÉTÉ", "it's", "a1"], ["", ".", ",", "***", ".%%%", ",$$$", "&&&", "-)", "\\", "]}", "|>", "'", "'.", "<b>", "\u0307,"]
    odd = ["İ,", "aİ.", "É,", "x\u0338=", "=\u0338", "×,", "日本,", "ß!", "ǅ?", "***", "...a", "<|endoftext|>,", "a<|endoftext|>", "Ⅷ.", "²,", "ª.", "e\u0301."]
    texts = [" ".join(a + b for a in stems for b in marks), None, "", " \x0b\x1cq ", "\n".join(odd), "a\u00a0, b\u2003."]
    end = np.array([1], encoder.kind).tobytes()
    whole = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for rows in (pa.array(texts), pa.array(["foreign", *texts, "foreign"]).slice(1, len(texts))):
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode_column(rows, end).to_pylist()] == whole
    calls.clear()
    encoder.encode([" ".join(f"{a}{b}{m}" for a in "abcdefgh" for b in ("qwz", "éa", "né") for m in ("***", ".%%%", ",")).encode()])
    assert len(calls) <= 3  # the library's whole pipeline sees none of these words, but their marks


def test_op4_files(spark, odd, empty):
    path = work_path(spark, "test")
    write_token_files(odd, public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    found = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_token_files(spark, path).collect()]
    assert sorted(found, key=repr) == sorted([(i, whole_ids(t)) for i, t in corpus()], key=repr)
    write_token_files(empty, public_tokenizers.path("word_bpe_49k.json"), path + "-empty", end_id=1)
    assert read_token_files(spark, path + "-empty").count() == 0


def test_op4_query(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_token_ids"](spark, SF).collect()}
    start = 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = np.array(whole_ids(doc["text"]), "<u4")
        assert tuple(rows[doc["doc_id"]]) == (doc["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5_edges(odd, empty):
    rows = with_quality(odd).collect()
    assert len(rows) == len(corpus()) and all(r["n_words"] == len(WORD.findall(r["text"] or "")) for r in rows)
    assert all(r["clean_text"] is None and not r["kept"] for r in rows if r["text"] is None)
    assert with_quality(empty).count() == 0


def test_op5_lines(spark):
    good = "\n".join(f"{WORDS(14)}." for _ in range(5))
    bad = "home | about | contact | help\nBUY NOW ALL OF YOU\n### $$$ &&& go\nwhat!! now?? oh!!\nClick here to sign up."
    row = with_quality(spark.createDataFrame([(1, good + "\n\n" + bad)], "doc_id long, text string")).first()
    assert row["clean_text"] == good + "\n" and row["kept"]
    assert not with_quality(spark.createDataFrame([(1, good + "\n" + "\n".join([bad] * 9))], "doc_id long, text string")).first()["kept"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    from test_queries import rows

    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_op6(spark, odd, empty):
    texts = [
        "Mail Bob.Smith19@Mail2.example.com or BOB.SMITH19@MAIL2.EXAMPLE.COM. Call +1 (286) 555-5136 or 1-286-555-5136. IP 10.2.3.4, card 4111111111111111.",
        'Mrs. Anna Smith met Mr. Smith; Smith left. Госпожа Иванова. token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" bob.smith19@mail2.example.com',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = [r["clean_text"] for r in with_surrogates(df, "k").orderBy("doc_id").collect()]
    assert not re.search("smith|555-5136|10\\.2\\.3\\.4|411111|f33e61|Anna|Иванова", a + b, re.I)
    first, second = re.findall(r"[\w.]+@[\w.]+\w", a)
    assert second == first.upper() and first.lower() in b  # one entity, one surrogate, in its own case
    phones = re.findall(r"\+?1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}", a)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    card = re.search(r"\b9\d{15}\b", a)[0]
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    surname = re.search(r"Mrs\. \S+ (\S+) met Mr\. (\S+); (\S+) left", b).groups()
    assert len(set(surname)) == 1 and re.search("Госпожа [А-я]+а\\.", b)
    assert [r["clean_text"] for r in with_surrogates(df, "k").orderBy("doc_id").collect()] == [a, b] != [
        r["clean_text"] for r in with_surrogates(df, "other").orderBy("doc_id").collect()
    ]
    kept = with_surrogates(odd, "k")
    assert kept.filter("NOT clean_text <=> text").count() == 0 and kept.count() == len(corpus())
    assert with_surrogates(empty, "k").count() == 0


def test_op6_keeps_entities_distinct(spark, monkeypatch):
    from ledgerloom.llm import op6_pii as op6

    # all of 30 numbers draw one surrogate at first: every round but one of them draws again
    monkeypatch.setattr(
        op6,
        "surrogate",
        lambda key, kind, form, attempt: F.concat(F.lit("9"), F.when(attempt < 3, F.lit("0")).otherwise(F.concat(form, attempt.cast("string"))))
    )
    df = spark.createDataFrame([("ssn", str(i)) for i in range(30)] + [("ssn", "90")], "kind string, form string")
    rows = op6.distinct_surrogates(df, "k").collect()
    assert len(rows) == len({r["surrogate"] for r in rows}) == 31 and not {r["surrogate"] for r in rows} & {str(i) for i in range(30)} - {"90"} and "90" not in {r["surrogate"] for r in rows}


def test_op7(spark, odd, empty):
    lines = [WORDS(9) for _ in range(12)]
    block = "\n".join(lines)
    rows = [
        (1, WORDS(5) + "\n" + block + "\n" + WORDS(5)),
        (2, WORDS(6) + "\n" + WORDS(3) + "\n" + block),
        (3, block + "\n"),
        (3, block + "\n"),
        (None, block),
        (4, None),
        (5, "")
    ]
    out = {(r["doc_id"], r["text"]): r for r in with_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[None, block]["n_removed"] == 0 and out[1, rows[0][1]]["n_removed"] >= 6
    kept = out[2, rows[1][1]]["clean_text"].split("\n")
    assert [x for x in rows[1][1].split("\n") if x in kept] == kept and out[2, rows[1][1]]["n_removed"] == 14 - len(kept)
    assert out[4, None]["clean_text"] is None and out[5, ""]["clean_text"] == ""
    assert with_line_dedup(odd).count() == len(corpus()) and with_line_dedup(empty).count() == 0


def test_op6_bare_surnames_in_any_case(spark):
    text = "Mr McDonald met Ms O'Brien and Dr. Smith. McDonald, MCDONALD and O'Brien spoke; SMITH, Smith's and smithy left with mcdonald. Госпожа Иванова; ИВАНОВА. Mr Smith-Jones, Smith-Jones."
    out = with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["clean_text"]
    assert not re.search(r"mcdonald|o'brien|smith(?!y)|иванова", out, re.I) and "smithy" in out
    first, second, third, again, upper, other, cried, plain = re.match(
        r"Mr (\S+) met Ms (\S+) and Dr\. (\S+)\. (\S+), (\S+) and (\S+) spoke; (\S+), (\S+)'s",
        out
    ).groups()
    assert (again, upper, other, cried, plain) == (first, first.upper(), second, third.upper(), third)
    name, same = re.search(r"Mr (\S+), (\S+)\.$", out).groups()
    assert name == same


def test_op6_one_name_with_and_without_titles(spark):
    texts = ["Dr Anna Smith came. Anna Smith left with Mrs Anna Smith.", "Prof. Hans Weber met Herr Hans Weber and Mr Hans Weber."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = [r["clean_text"] for r in with_surrogates(df, "k").orderBy("doc_id").collect()]
    assert len({m.lower() for m in re.match(r"Dr (\w+ \w+) came\. (\w+ \w+) left with Mrs (\w+ \w+)\.$", a).groups()}) == 1
    assert len(set(re.match(r"Prof\. (\w+ \w+) met Herr (\w+ \w+) and Mr (\w+ \w+)\.$", b).groups())) == 1
    assert not re.search("anna|smith came|hans|weber", a + b, re.I)


def test_op6_addresses_of_marks_end(spark):
    from ledgerloom.llm import op6_pii as op6

    forms = ["--@--.example", "_@-.com", "_@-.net", "_@-.org"]
    known, more = spark.createDataFrame([("email", f) for f in forms], "kind string, form string"), []
    for attempt in range(3):
        more.append({r["s"] for r in known.select(op6.surrogate("k", F.col("kind"), F.col("form"), F.lit(attempt)).alias("s")).collect()})
    assert not more[0] & more[1] and not more[1] & more[2] and "--@--.example" in more[0]  # so that the loop comes to an end
    rows = op6.distinct_surrogates(known, "k").collect()
    assert len({r["surrogate"] for r in rows}) == len(rows) == 4 and not {r["surrogate"] for r in rows} & set(forms)


def brute_passages(rows, least=2):
    """What is left of each row's lines, by the definition, and how many went."""
    stretches, first = [], {}
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [p for p, x in enumerate(lines) if WORD.search(x)]
        stretches.append([(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(at, at[least - 1 :])])
        for a, _, s in stretches[-1]:
            first[s] = min(first.get(s, (np.inf, 0)), (-np.inf if i is None else i, a))
    out = []
    for (i, t), own in zip(rows, stretches):
        gone = {p for a, b, s in own if first[s] < (-np.inf if i is None else i, a) for p in range(a, b + 1)}
        out.append((i, len(gone), None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)))
    return sorted(out, key=repr)


def test_op7_passages(spark, odd, empty):
    own, rows = [WORDS(9) for _ in range(60)], []
    for k, n in enumerate([2, 3, 4, 5, 7, 10] * 4):  # passages of each length between foreign lines
        at = RNG.randrange(60 - n)
        gap = "\n\n" if k % 4 == 3 else "\n"
        rows += [(k, gap.join([WORDS(8), *own[at : at + n], WORDS(8)]))]
    rows += [
        (90, "\n".join(own)),
        (91, "\n".join(own)),
        (92, "\n" + "\n".join(own[:2]) + "\n"),
        (None, "\n".join(own[5:9])),
        (None, "\n".join(own[20:22] * 2)),
        (93, "a\na\na"),
        (93, "b\nc"),
        (94, "b\nc\n\nd"),
        (95, own[3]),
        (96, "")
    ]
    RNG.shuffle(rows)
    found = with_passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["n_removed"], r["clean_text"]) for r in found], key=repr) == brute_passages(rows)
    assert {r["doc_id"]: r["clean_text"] for r in found}[91] == "" and all(r["n_lines"] == len(r["text"].split("\n")) for r in found)
    assert sorted([(r["doc_id"], r["n_removed"], r["clean_text"]) for r in with_passage_dedup(odd).collect()], key=repr) == brute_passages(corpus())
    assert with_passage_dedup(empty).count() == 0


def test_op7_passages_query(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_passage_dedup"](spark, SF).collect()}
    for i, gone, kept in brute_passages([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]):
        assert (rows[i]["n_removed"], rows[i]["kept_sha256"]) == (gone, brute_digest(kept))


def test_op8_against_the_library(spark, odd, empty):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = codec(path, public_tokenizers.PATTERN)
    texts = [t or "" for _, t in corpus()] + ["x" * 3000, "ab" * 5000, "\x1c \x85   \n\n ", "日本語 'tis we'll 12345 !!! \U0001f600" * 30, "a" * 70000 + " b" * 40000]
    texts += ["word is " * 1500 + "A" * 100000, "word is " * 1500 + "日本" * 40000, "word is " * 1500 + " " * 100000]  # words, then a long run without a cut
    for t in texts:
        ids = np.frombuffer(tree.encode(t), "<u4")
        assert ids.tolist() == library.encode_ordinary(t) and tree.decode(ids) == t.encode()
    both = decode_ids(encode_texts(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert both.filter(F.col("decoded") != F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).count() == 0
    assert encode_texts(empty, path, public_tokenizers.PATTERN).count() == 0
    row = encode_texts(spark.createDataFrame([("hello world",)], "text string"), path, public_tokenizers.PATTERN).select(ids_as_array().alias("a")).first()
    assert row["a"] == library.encode_ordinary("hello world")


def test_op8_round_trip_is_one_pass_that_leaves_workers_empty(spark, odd):
    from ledgerloom.llm.op8_byte_bpe import op8_byte_bpe, round_trip

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    once = round_trip(odd.repartition(8), path, pattern).select("text", "token_ids", "decoded")
    twice = decode_ids(encode_texts(odd, path, pattern), path, pattern).select("text", "token_ids", "decoded")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    made = op8_byte_bpe(spark, SF)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    made.collect()

    def held(batches):
        for batch in batches:
            tree = codec(path, pattern)
            caches = tree.packed, tree.parts, tree.windows, tree.stable
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, caches)) + sum(c.held for c in caches)])], names=["n"])

    assert [r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()] == [0] * 8


def brute_base(text):
    words = license_words((text or "").encode())
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    hits = [(p, label) for p in range(len(words)) for k, label in phrases.items() if [w.decode() for w in words[p : p + len(k)]] == list(k)]
    at = [p for p, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def test_op9(spark, odd, empty):
    extra = [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the (MIT) License!",
        "all rights  reserved; ALL-RIGHTS-RESERVED cc BY",
        "general public licenses",
        "under the new MIT License for all",
        "we saw an apache with no licence",
        WORDS(500) + " Licensed under CC BY-NC 4.0. " + WORDS(50)
    ]
    rows = corpus() + [(100 + i, t) for i, t in enumerate(extra)]
    out = with_licenses(frame(spark, rows)).collect()
    assert all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(r["text"]) for r in out)
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert [labels[100 + i] for i in range(7)] == ["apache-2.0", "mit", "cc-by,reserved", "", labels[104], "", "cc-by,cc-by-nc-4.0"]
    assert all(0 <= r["score"] <= 1 for r in out) and with_licenses(empty).count() == 0


def test_op10_held_out(spark):
    from itertools import count

    mean = ["idiot", "scumbag", "worthless"]
    ids, rows, labels = count(), [], []
    for k in range(700):
        toxic = k % 5 == 0
        words = WORDS(60).split()
        for _ in range(3 * toxic):
            words.insert(RNG.randrange(60), RNG.choice(mean))
        i = next(ids)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows + [(None, None), (9999, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, intercept = op10.train_weights(docs, known)
    out = op10.with_toxicity(docs, weights, intercept).join(known, "doc_id").withColumn("h", op10.is_held_out()).filter("h").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.98 * len(out)
    scores = op10.with_toxicity(docs.filter("doc_id IS NULL OR doc_id = 9999"), weights, intercept).collect()
    assert len(scores) == 2 and all(0 <= r["score"] <= 1 for r in scores)
    # no labels, or one class only
    for some in (known.limit(0), known.filter("toxic = 0")):
        w, b = op10.train_weights(docs, some)
        assert not w.any() and np.isfinite(b)


def brute_digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_query(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i, n, gone, kept in brute_windows(docs):
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (n, gone, brute_digest(kept))


def test_op6_against_plain_regular_expressions(spark):
    import regex

    from ledgerloom.llm import op6_pii as op6

    pattern = regex.compile(op6.PATTERN.replace(r"\p{Is", r"\p{"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    entity, shape = {}, lambda x: regex.sub(r"\p{L}+", "a", regex.sub("[0-9]", "0", x))
    for r in with_surrogates(docs, "k").collect():
        found = list(pattern.finditer(r["text"]))
        assert r["n_entities"] == len(found)
        at = 0
        names = any(m[0].split()[0].rstrip(".") in sum(op6.TITLES.values(), []) for m in found)
        for m in found if not names else ():  # what stands between entities stays
            rest = r["clean_text"][at:]
            gap = r["text"][found[found.index(m) - 1].end() if m is not found[0] else 0 : m.start()]
            assert rest.startswith(gap)
            other = pattern.match(r["clean_text"], at + len(gap))
            assert other and other[0] != m[0] and ("@" in m[0] or regex.match(op6.IP, m[0]) or shape(other[0]) == shape(m[0]) or regex.fullmatch(op6.SECRET, m[0]))
            same = m[0].lower() if "@" in m[0] or regex.fullmatch(op6.SECRET, m[0]) else m[0] if regex.fullmatch(op6.IP, m[0]) else regex.sub("[^0-9]", "", m[0])
            drawn = other[0].lower() if same == m[0].lower() else other[0] if same == m[0] else regex.sub("[^0-9]", "", other[0])
            assert entity.setdefault(same, drawn) == drawn
            at += len(gap) + len(other[0])
    assert len(set(entity.values())) == len(entity) > 10 and not set(entity) & set(entity.values())


def test_op6_formats_and_names_without_a_title(spark):
    text = "Anna Smith wrote joe@mail.a.co.uk; SMITH and Мария Иванова answered John Smith. Ἰ. " + "filler " * 20000 + "x@y.org"
    out = with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    clean = out["clean_text"]
    assert out["n_entities"] == 5 and not re.search("anna|smith|иванова|joe@", clean, re.I)
    assert re.search(r"\b[a-z]{3}@[a-z]{4}\.[a-z]\.[a-z]{2}\.example\b", clean) and clean.count("filler") == 20000
    first, surname = clean.split()[:2]
    assert first.endswith("lia") and clean.count(surname) == 2 and surname.upper() in clean


def test_op6_numbers_grow_where_all_are_taken(spark):
    from ledgerloom.llm import op6_pii as op6

    some = spark.createDataFrame([("phone", "10"), ("phone", "11"), ("ssn", "7"), ("ip", "1.2.3.4"), ("card", "4111111111111111")], "kind string, form string")
    late = {r["form"]: r["s"] for r in some.select("form", op6.surrogate("k", F.col("kind"), F.col("form"), F.lit(op6.LONGER + 2)).alias("s")).collect()}
    assert len(late["10"]) == len(late["11"]) == 5 and len(late["7"]) == 4 and late["1.2.3.4"].startswith("2001:db8:") and len(late["4111111111111111"]) == 19
    every = spark.createDataFrame([("ssn", str(i)) for i in range(10)], "kind string, form string")  # all numbers of one digit
    rows = op6.distinct_surrogates(every, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 10 and all(len(r["surrogate"]) > 1 for r in rows)
    assert spark.range(1).select(op6.written_like(F.lit("1-2"), F.lit("9876")).alias("w")).first()["w"] == "9-876"


def test_op2_recall_at_the_bound(spark):
    """At least 0.9 of more than 1,000 pairs that have as many edits as the bound allows, and nothing that isn't near enough."""
    rng = random.Random(11)
    words = lambda n: rng.choices(VOCABULARY, k=n)
    items = [(i, words([4, 7, 9, 12, 16, 20, 25, 33, 48, 90][i % 10])) for i in range(100)]
    rows, planted = [], []
    for k in range(1200):
        i, own = items[k % 100]
        changed = list(own)
        for _ in range(op2.allowed(len(own))):
            p = rng.randrange(len(changed))
            changed[p : p + 1] = rng.choice([[], ["zz"], [changed[p], "yy"]])
        rows.append((k, " ".join(words(30) + changed + words(20))))
        planted.append((k, i))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in op2.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    near = {(d, i): edit_distance_to_best_stretch(items[i][1], rows[d][1].split()) for d, i in planted}
    true = {p for p, n in near.items() if n <= op2.allowed(len(items[p[1]][1]))}
    assert len(true) > 1000 and len(true & set(found)) >= 0.9 * len(true)
    for (d, i), n in found.items():
        best = near.get((d, i)) if (d, i) in near else edit_distance_to_best_stretch(items[i][1], rows[d][1].split())
        assert best <= n <= op2.allowed(len(items[i][1]))


def test_op2_short_items_and_repeated_seeds(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "one two three")], "item_id long, text string")
    docs = [(1, "Alpha beta gamma delta epsilon zeta eta"), (2, "one two three " * 20000), (3, "one two four three"), (4, "alpha beta x delta epsilon zeta eta")]
    found = {tuple(r) for r in op2.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {(1, 1, 0, 7, 0), (2, 2, 0, 3, 0), (4, 1, 0, 7, 1)}


def thue_morse(n, a, b):
    word = "0"
    while len(word) < n:
        word += word.translate(str.maketrans("01", "10"))
    return word.translate(str.maketrans("01", a + b)), word.translate(str.maketrans("01", b + a))


def test_words_made_to_meet_in_a_hash_stay_apart(spark):
    one, two = thue_morse(2048, "a", "b")
    same = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([*same, one])), (2, " ".join([*same, two])), (3, one), (4, two)], "doc_id long, text string")
    assert {r["n_removed"] for r in factor_documents(docs).collect()} == {0}
    # 1 and 2 have 8 of 10 shingles in common, 3 and 4 none
    assert {r["doc_id"]: r["component_id"] for r in with_near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert op2.find_leaks(docs, spark.createDataFrame([(1, one)], "item_id long, text string")).select("doc_id").distinct().count() == 2


def test_op7_tells_rows_of_one_id_apart(spark):
    a, b = ("\n".join(WORDS(9) for _ in range(12)) for _ in range(2))
    for dedup in (with_line_dedup, with_passage_dedup):
        out = {(r["doc_id"], r["text"]): r for r in dedup(spark.createDataFrame([(1, a), (7, a), (7, b), (None, None)], "doc_id long, text string")).collect()}
        assert out[7, b]["clean_text"] == b and out[1, a]["clean_text"] == a and out[7, a]["n_removed"] == 12


def test_op7_chunks_have_two_lines_and_an_end(spark):
    from ledgerloom.llm.op7_line_dedup import MAX_LINES, chunks_of

    texts = ["\n".join(WORDS(6) for _ in range(300)), "\n".join(["same line"] * 100), "one\n\n\ntwo", "\n\n", ""]
    for text, row in zip(
        texts,
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(chunks_of(F.col("t")).alias("c")).collect()
    ):
        assert "\n".join(c["text"] for c in row["c"]) == text
        assert all(c["word_lines"] <= MAX_LINES + 1 for c in row["c"]) and (len(row["c"]) == 1 or all(c["word_lines"] >= 2 for c in row["c"]))


def test_op8_a_long_text_without_cuts_in_its_second_half(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "page text " * 100_000 + "".join(RNG.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_200_000))
    row = decode_ids(
        encode_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, public_tokenizers.PATTERN),
        path,
        public_tokenizers.PATTERN
    ).first()
    assert np.frombuffer(row["token_ids"], "<u4").tolist() == library.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()


def brute_labels(text):
    """Labels of all templates that verify anywhere, without an index."""
    from ledgerloom.llm import op9_license_scan as op9

    words, labels = license_words(text.encode()), set()
    for label, template, keys in op9.TEMPLATES:
        t, k = license_words(template.encode()), [license_words(x.encode()) for x in keys]
        if any(op9.has_keys(words, t, k, s) and op9.in_order(words, t, s) >= op9.MIN_SCORE for s in range(-2, len(words))):
            labels.add(label)
    return labels


def test_op9_labels_against_brute_force(spark):
    from ledgerloom.llm import op9_license_scan as op9

    rng, texts = random.Random(4), []
    for k in range(90):
        words = op9.TEMPLATES[k % len(op9.TEMPLATES)][1].split()
        for _ in range(len(words) // 12):  # a few words changed
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(f"{WORDS(rng.randrange(40))}. {' '.join(words)} {WORDS(rng.randrange(40))} the license of any person to use software")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    total = hit = 0
    for r in with_licenses(docs).collect():
        true, got = brute_labels(r["text"]), set(r["labels"].split(",")) - set(r["base_labels"].split(",")) - {""}
        assert got <= true
        total, hit = total + len(true - set(r["base_labels"].split(","))), hit + len(got)
    assert total > 60 and hit >= 0.95 * total


def test_op10_fit_against_plain_numpy(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(VOCABULARY[:60] + (["nasty"] * 9 if i % 4 == 0 else []), k=40))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    weights, intercept = op10.train_weights(docs, labels)
    own = [(int(i % 4 == 0), op10.features_of(t.encode())) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n, counts = np.zeros(2, np.int64), np.zeros((2, 1 << op10.BITS), np.int64)
    for y, x in own:
        n[y] += 1
        counts[y, x] += 1
    ratio, keep = op10.log_ratios(n, counts)
    x = np.zeros((len(own), len(keep)))
    for r, (_, ids) in enumerate(own):
        x[r] = np.isin(keep, ids) * ratio[keep]
    y, w, b = np.array([y for y, _ in own]), np.zeros(len(keep)), 0.0
    for _ in range(20000):  # plain gradient descent
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.05 * (x.T @ gap + w) / len(y), b - 0.05 * gap.sum() / len(y)
    assert len(keep) and np.corrcoef(w * ratio[keep], weights[keep])[0, 1] > 0.99
    z = lambda w, b: 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(z(w, b) - z(weights[keep] / ratio[keep], intercept)).max() < 0.05


def test_op10_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    weights, intercept = op10.train_weights(odd, labels)
    out = op10.with_toxicity(odd, weights, intercept)
    assert out.count() == len(corpus()) and out.columns.count("score") == 1 and op10.with_toxicity(empty, weights, intercept).count() == 0
    assert {r["h"] for r in odd.filter("doc_id IS NULL").select(op10.is_held_out().alias("h")).collect()} == {False}
    many = spark.createDataFrame([(1, f"text {i % 3}") for i in range(300)], "doc_id long, text string")
    assert op10.training_rows(many, labels.filter("doc_id = 1")).count() == 1
    assert op10.train_weights(empty, labels)[0].any() == False  # noqa: E712


def test_op5_ties_and_languages(spark):
    good = "\n".join(f"{WORDS(10)}." for _ in range(5))
    lines = [
        "the design in spread more words empowered by terms of useful",
        "Cookies akzeptieren und weiter gehen bitte.",
        "Tous droits réservés par nous.",
        "leer más aquí ahora mismo.",
        "• one two three",
        "Heading",
        "read this and that…",
        "Fine."
    ]
    row = with_quality(spark.createDataFrame([(1, good + "\n" + "\n".join(lines))], "doc_id long, text string")).first()
    assert row["clean_text"] == good + "\n" + lines[0] + "\nFine." and row["kept"]
    fifty = with_quality(
        spark.createDataFrame(
            [(1, good), (2, good.replace(" ", "", 1)), (3, good + "\n" + "\n".join(["NOW BUY ALL OF IT HERE AND NOW MY FRIENDS"] * 5))],
            "doc_id long, text string"
        )
    ).orderBy("doc_id").collect()
    assert [r["kept"] for r in fifty[:2]] == [True, False] and fifty[2]["n_words"] == 100 and fifty[2]["kept_words"] == 50


def test_op4_other_vocabularies_go_through_the_library(tmp_path):
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    assert word_encoder(path).by_word
    other = json.load(open(path))
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"
    (tmp_path / "other.json").write_text(json.dumps(other))
    encoder = word_encoder(str(tmp_path / "other.json"))
    text = "a1b2 don't 12,5 end."
    assert not encoder.by_word
    assert np.frombuffer(encoder.encode([text.encode(), None])[0], encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_very_long_text_through_all_operators(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) + str(i) for i in range(90_000)]  # no word twice
    long, passage = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 90_000, 9)), " ".join(words[50_000:50_030])
    docs = spark.createDataFrame([(1, passage), (2, long), (3, long + "\ntail of it")], "doc_id long, text string")
    assert len(long) > 10 * 65_536
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert {i: r["n_removed"] for i, r in by_id(factor_documents(docs)).items()} == {1: 0, 2: 30, 3: 90_000}
    assert {i: r["component_id"] for i, r in by_id(with_near_duplicates(docs)).items()} == {1: 1, 2: 2, 3: 2}
    assert {
        r["doc_id"]: r["start"] for r in op2.find_leaks(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    } == {1: 0, 2: 50_000, 3: 50_000}
    path = work_path(spark, "test")
    write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    assert np.frombuffer(by_id(read_token_files(spark, path))[2]["ids"], "<u4").tolist() == whole_ids(long)
    assert by_id(with_quality(docs))[2]["n_words"] == 90_000 and by_id(with_licenses(docs))[2]["n_words"] == 90_000
    assert by_id(with_passage_dedup(docs))[3]["clean_text"] == by_id(with_line_dedup(docs))[3]["clean_text"] == "tail of it"
    assert by_id(with_surrogates(docs, "k"))[2]["clean_text"] == long
    assert len(by_id(op10.with_toxicity(docs, np.zeros(1 << op10.BITS, np.float32), 0.0))) == 3
