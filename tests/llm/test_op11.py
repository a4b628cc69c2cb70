"""Alignment against its definition: tokens of the two libraries on whole texts, and all overlapping occurrences."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from conftest import SF
from ledgerloom.llm import op11_tokenizer_alignment as op11

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, digest int, window int, side int, pairs int, copies int, n_a int"
RNG = random.Random(11)


def definition(rows):
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    one_bytes = {i: bytes(of[c] for c in t) for t, i in one.get_vocab().items() if all(c in of for c in t)}
    other_bytes = lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode()
    found, corpus = [], Counter()
    for i, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [one_bytes[x] for x in a], [other_bytes(x) for x in b]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            found.append((i, 0, 0, 0, "", []))
            continue
        spans = []
        for ids, token_bytes in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for x, t in zip(ids, token_bytes):
                out.append((at, at + len(t), x))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, k, m = [], 0, 0
        for cut in cuts:
            parts = []
            for which, start in ((0, k), (1, m)):
                stop = start
                while stop < len(spans[which]) and spans[which][stop][1] <= cut:
                    stop += 1
                parts.append((",".join(str(x) for _, _, x in spans[which][start:stop]), stop))
            (left, k), (right, m) = parts
            groups.append(f"{left}|{right}")
        links, first = [], 0
        for s, e, x in spans[0]:
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((x, spans[1][j][2]))
                j += 1
        corpus.update(set(links))
        found.append((i, len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    return sorted(((i, n_a, n_b, g, len(ls), sum(corpus[p] == best[p[0]] for p in ls), sum(corpus[p] for p in ls), h) for i, n_a, n_b, g, h, ls in found), key=repr)


def odd_texts():
    signs = ["a", "b", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "​", "́", "é", "ß", "中", "🎈", "'s", "1", "22", ".", "<s>", "<|endoftext|>", "▁", "᠎", "Ünd", " the"]
    made = ["".join(RNG.choices(signs, k=RNG.randrange(1, 40))) for _ in range(300)]
    return [*made, None, "", " ", "  ", " a", "a ", "a  b", "a\n b", "the ▁ end", "▁", "the end " * 20_000, "x" * 150_000, "ab" * 40_000 + " end", "\x00", "<unk> <s> </s> <0x41>"]


def rows_of(docs):
    return sorted((tuple(r) for r in op11.aligned(docs, ("byte_level", A), ("pieces", B), 32_000).collect()), key=repr)


def test_alignment_against_the_definition(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts())]
    rows += [rows[3], rows[3], (None, "the end"), (None, "the end"), (None, None), (5000, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7) for i, t in rows], SCHEMA).repartition(3)
    assert rows_of(docs) == definition(rows)


def test_windows_and_runs_are_joined(monkeypatch):
    text = "".join(RNG.choices("abcd efgh the", k=30_000))
    a, b = op11.byte_level(A), op11.pieces(B)
    whole = {}
    for window in (1 << 16, 64, 7):
        monkeypatch.setattr(op11, "WINDOW", window)
        state = op11.Sweep(a, b)
        rows = []
        for which, s in enumerate((a, b)):
            ids = np.frombuffer(s([text])[0], s.kind)
            ends = np.cumsum(s.sizes[ids])
            edges = np.searchsorted(ends, np.arange(window, ends[-1], window), "right").tolist()
            rows += [(w, which, int(ends[i - 1]) if i else 0, zstandard.compress(ids[i:j].tobytes())) for w, (i, j) in enumerate(zip([0, *edges], [*edges, len(ids)])) if j > i]
        held = 0
        for _, which, begins, ids in sorted(rows, key=lambda r: r[:2]):
            state.add(which, begins, ids)
            held = max(held, len(state.ids[0]) + len(state.ids[1]))
        whole[window] = state.result()
        assert window > 1000 or held < 200
    assert len(set(whole.values())) == 1


@pytest.mark.parametrize("kind", ["byte_level", "pieces"])
def test_word_by_word_as_the_library(kind):
    s = op11.side(kind, A if kind == "byte_level" else B)
    assert s.by_words
    texts = list(filter(None, odd_texts()))
    one, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    for text, ids in zip(texts, s(texts)):
        whole = one.encode(" " + text, add_special_tokens=False).ids if kind == "byte_level" else model.encode(text)
        assert ids is None and b"".join(s.token_bytes[i] for i in whole) != b" " + text.encode() or np.frombuffer(ids, s.kind).tolist() == whole


def test_settled_characters_and_tokens_as_the_library():
    """Every two neighbours below U+0250, and every token as a word, encoded by ranks as by the file's library."""
    one, s = Tokenizer.from_file(A), op11.byte_level(A)
    one.encode_special_tokens = True
    texts = ["".join(chr(a) + chr(b) for a in range(0x250))[:1300] + "a" for b in range(0x250)]
    texts += [t.decode() for t in s.token_bytes if t and t.decode(errors="ignore").encode() == t]
    assert len(texts) > 40_000
    library = [e.ids for e in one.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert s.encode(texts) == library


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert rows_of(docs) == []
