"""Tokens of two tokenizers over the same bytes, against a loop over tokens."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import alignment, bpe

from .conftest import SCHEMA, prose, row

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "a", " a", "a ", "a  b", "a \n b", "\nfoo", "foo\n", "\n\n bar", "x\ty", "tab\t end", "▁", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x0A>", "é 世界 😀 12345 don't",
    "x" * 5000, "ab " * 3000, "\x00 \x1c a", "　wide   hard", "é ﬁ", " ", "\n", None, "",
]


def by_loop(texts):
    a_coder = Tokenizer.from_file(A)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = bpe.letters_of_bytes()
    names = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a_coder.get_vocab().items()}
    piece = lambda i: bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()
    held, counts = [], Counter()
    for text in texts:
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(names[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            held.append(([], [], [], []))
            continue
        ends = []
        for ids, sizes in ((a, [len(names[i]) for i in a]), (b, [len(piece(i)) for i in b])):
            at, out = 0, []
            for n in sizes:
                out.append((at, at + n))
                at += n
            ends.append(out)
        links, j = [], 0
        for i, (x, y) in enumerate(ends[0]):
            while ends[1][j][1] <= x:
                j += 1
            k = j
            while k < len(b) and ends[1][k][0] < y:
                links.append((a[i], b[k]))
                k += 1
        cuts = {y for _, y in ends[0]} & {y for _, y in ends[1]}
        groups, x, y = [], 0, 0
        for cut in sorted(cuts):
            x2, y2 = (next(i for i, s in enumerate(e) if s[1] == cut) + 1 for e in ends)
            groups.append((a[x:x2], b[y:y2]))
            x, y = x2, y2
        held.append((a, b, links, groups))
        counts.update(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for a, b, links, groups in held:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    return out


@pytest.mark.parametrize("most", [alignment.MOST_SENT, 0])
def test_digests_against_a_loop_over_tokens(spark, most):
    texts = [*ODD, *(prose(i, 50) for i in range(20)), prose(3, 50), prose(3, 50)]
    docs = spark.createDataFrame([row(i if i % 7 else None, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = alignment.digests(docs, A, B, most)
    assert found.columns == ["doc_id", *columns]
    expected = sorted((str(i if i % 7 else None), *x) for i, x in enumerate(by_loop(texts)))
    assert sorted((str(r.doc_id), *(r[c] for c in columns)) for r in found.collect()) == expected


def test_groups_hold_all_tokens_in_order(spark):
    texts = ["one two", None, "héllo  wörld", prose(5, 30)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    a_coder = Tokenizer.from_file(A)
    for r in alignment.groups(docs, A, B).collect():
        assert r.a == (a_coder.encode(" " + texts[r.doc_id]).ids if texts[r.doc_id] else [])
        assert len(r.a_ends) == len(r.b_ends) and (not r.a or (r.a_ends[-1] == len(r.a) and r.b_ends[-1] == len(r.b)))


def test_a_worker_that_forgets_its_words_and_slices_gives_the_same(monkeypatch):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    texts = [prose(i, 40) for i in range(6)]
    whole = aligner.align(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    again = [aligner.align([t]) for t in texts]
    assert [len(x.a) for x in again] == (whole.a_at[1:] - whole.a_at[:-1]).tolist()
    assert sum(int(x.groups_at[-1]) for x in again) == int(whole.groups_at[-1])


def test_empty_table(spark, none):
    assert alignment.digests(none, A, B).collect() == []
    assert alignment.pair_counts(alignment.written(alignment.linked(none, A, B))).select(F.col("pair")).collect() == []
