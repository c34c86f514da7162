"""Cross-tokenizer alignment against byte offsets of whole-text encodings."""

import hashlib
import json
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidewell.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "two  spaces   three", "\n", "\n\n x\n y \n", "tab\tand\rreturn", "naïve café — “quoted” … 東京 \U0001f600 é", "▁ mark", "<s> </s> <unk> <0x41> <|endoftext|>",
    "nul \x00 inside", "numbers 1234567890 and x=1;", "don't we're I'll", " no-break　wide", "﻿bom", "same words here", "same words here", " sep\u0085next",
]


def both(text):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    return t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)


def token_bytes():
    import sentencepiece

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = json.load(open(A, encoding="utf-8"))["model"]["vocab"]
    a = {i: bytes(letters[c] for c in w) for w, i in vocabulary.items() if all(c in letters for c in w)}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    b = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())}
    return a, b


def ends(ids, known):
    out, at = [], 0
    for i in ids:
        at += len(known[i])
        out.append(at)
    return out


def plain(rows):
    known_a, known_b = token_bytes()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = both(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(known_a[i] for i in a) != whole or b"".join(known_b[i] for i in b) != whole:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        end_a, end_b = ends(a, known_a), ends(b, known_b)
        shared = sorted(set(end_a) & set(end_b))
        links = [(x, y) for x, p in zip(a, end_a, strict=True) for y, q in zip(b, end_b, strict=True) if p == q] if len(a) < 2000 else [(a[end_a.index(s)], b[end_b.index(s)]) for s in shared]
        parts, before = [], 0
        for s in shared:
            own = [",".join(str(i) for i, e in zip(ids, es, strict=True) if before < e <= s) for ids, es in ((a, end_a), (b, end_b))]
            parts.append("|".join(own))
            before = s
        counts.update(links)
        docs.append((doc_id, len(a), len(b), links, hashlib.sha256(";".join(parts).encode()).hexdigest(), len(shared)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d in docs:
        links = d[3]
        out.append((d[0], d[1], d[2], d[5] if len(d) > 5 else 0, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), d[4]))
    return out


def test_query_is_the_plain_alignment(docs):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice([" ", "\n", "ab", "the ", "é", "xyz", "  ", "."]) for _ in range(200)) for _ in range(10)]
    rows = list(enumerate(texts))
    got = alignment.align(docs(texts), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))


@pytest.mark.parametrize("seed", range(3))
def test_chunks_have_the_ids_of_whole_texts(seed):
    rnd, pieces = random.Random(seed), alignment.Pieces(B)
    assert pieces.cut
    for _ in range(300):
        text = "".join(rnd.choice([" ", "\n", "a", "the", "The", "é", "\U0001f600", "   ", "\t", "x.y", "\x00", "　", "1"]) for _ in range(rnd.randint(1, 40)))
        import numpy as np

        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == pieces._ids(text), repr(text)


def test_transducer_on_any_cuts():
    rnd = random.Random(4)
    words = ["a", "b", "ab", "ba", "aab", "bab", "abab", "aa", "bb"]
    tokens = [w.encode() for w in words]
    machine = alignment.Transducer(tokens, tokens)

    def cut(text):
        ids = []
        while text:
            i = rnd.choice([k for k, w in enumerate(words) if text.startswith(w)])
            ids.append(i)
            text = text[len(words[i]) :]
        return ids

    for _ in range(300):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30)))
        a, b = cut(text), cut(text)
        known = dict(enumerate(tokens))
        end_a, end_b = ends(a, known), ends(b, known)
        shared = sorted(set(end_a) & set(end_b))
        assert machine.groups(a, b) == ([end_a.index(s) + 1 for s in shared], [end_b.index(s) + 1 for s in shared])
    states = len(machine.states)
    machine.clear()
    assert states > 1 and len(machine.states) == 1
    with pytest.raises(ValueError):
        machine.groups([0], [1])


def test_pairs_are_bounded_by_suffixes():
    assert alignment.pair_bound([b"ab", b"b", b"c"], [b"ab", b"b", b"b"]) == 9
    a, b = alignment.byte_level_tokens(A), alignment.Pieces(B).bytes
    assert len(a) == 50257 and len(b) == 32000 and alignment.pair_bound(a, b) < 1_000_000


def test_odd_rows_and_empty_tables(odd, empty):
    rows = alignment.align(odd, A, B).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["n_groups"] > 0) for r in rows}
    assert {(1, False), (2, False), (6, True), (None, True)} <= by
    assert all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in rows)
    assert alignment.align(empty, A, B).collect() == []


def test_a_task_holds_few_documents_pairs(monkeypatch):
    """However many rows a batch has, on the way out and when pairs are summed and looked up."""
    monkeypatch.setattr(alignment, "HELD", 8, raising=False)
    texts = [f"some words {i} of\none text" for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    made = list(alignment._align(A, B)([batch]))
    assert sum(x.num_rows for x in made) == len(texts) and max(x.num_rows for x in made) <= 8
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    sums = []
    for own in ([whole], made, [whole.slice(3)]):
        out = list(alignment._summed([x.select(["pairs", "times"]) for x in own]))
        sums.append(dict(zip(*(c.to_pylist() for c in pa.Table.from_batches(out).columns), strict=True)))
    pairs = Counter()
    for p, t in zip(whole["pairs"].to_pylist(), whole["times"].to_pylist(), strict=True):
        pairs.update(dict(zip(p, t, strict=True)))
    assert sums[0] == sums[1] == pairs and sum(sums[2].values()) < sum(pairs.values())

    known = [np.array(x, np.int64) for x in zip(*[(k, pairs[k], pairs[k] % 2) for k in sorted(pairs)], strict=True)]
    scored = list(alignment._scored(SimpleNamespace(value=known))([whole]))
    assert max(x.num_rows for x in scored) <= 8
    rows = pa.Table.from_batches(scored).to_pylist()
    for row, p, t in zip(rows, whole["pairs"].to_pylist(), whole["times"].to_pylist(), strict=True):
        assert (row["n_links"], row["n_best"], row["count_sum"]) == (sum(t), sum(n * (pairs[k] % 2) for k, n in zip(p, t, strict=True)), sum(n * pairs[k] for k, n in zip(p, t, strict=True)))


def test_counts_are_not_written(docs, monkeypatch):
    """Each file that is written on a local disk starts processes that set its rights; the counts go straight to the driver."""
    written, plainly = [], alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda df, label: written.append(label) or plainly(df, label))
    assert alignment.align(docs(["two words", "two words here"]), A, B).count() == 2
    assert written == ["aligned"]


def test_known_stretches_are_not_read_again():
    """The transducer doesn't read a stretch of text that it has read before."""
    alignment.aligner.cache_clear()
    machine, read = alignment.aligner(A, B).transducer, []
    plainly = machine.groups
    machine.groups = lambda a, b: read.append(len(a)) or plainly(a, b)
    texts = ["some words and words, some more\nand more", "some words and words, some more\nand more and words, some more", "some Words and"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    n_a = [n for x in alignment._align(A, B)([batch]) for n in x.column("n_a").to_pylist()]
    assert n_a == [len(both(text)[0]) for text in texts]
    # new are " some", " words", " and", " words,", " more" and "\nand" of the first text, nothing of the second, " Words" of the third
    assert read == [1 + 1 + 1 + 2 + 1 + 2, 1]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_give_the_rows_of_whole_texts(seed, monkeypatch):
    """However few stretches are kept, and where a side can't spell some of them."""
    monkeypatch.setattr(alignment, "STRETCHES", 20, raising=False)
    monkeypatch.setattr(alignment, "LONGEST", 5, raising=False)
    rnd, own, whole = random.Random(seed), alignment.Aligner(A, B), alignment.Aligner(A, B)
    whole.cut = False
    assert own.cut
    bits = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "​", "a", "the", "The.", "don't", "é", "ﬁ", "Ａ", "東京", "\U0001f600", "\x00", "<s>", "<0x41>", "<|endoftext|>", "▁", "word", "12"]
    none = 0
    for _ in range(600):
        few = rnd.sample(bits, rnd.randint(2, 10))
        text = "".join(rnd.choice(few) for _ in range(rnd.randint(0, 40)))
        got, plainly = own.align(text), whole.align(text)
        assert got[:3] == plainly[:3] and got[3].tolist() == plainly[3].tolist(), repr(text)
        none += bool(text) and not got[0]
        assert len(own.known) <= 20 + 40 and all(len(x) <= 5 for x in own.known)
    assert not whole.known and none
