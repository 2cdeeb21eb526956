"""Operators against brute force, exact round trips and hand-worked cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import bpe, chat, ctph, langid, mixing, ngrams, pii, quality, simhash, substrings, toxicity

from .conftest import prose, row

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.load(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_matches_the_library(text):
    codec = bpe.Codec(VOCABULARY)
    ids = codec.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text


def test_bpe_long_words_and_specials():
    codec = bpe.Codec(VOCABULARY)
    for text in ("a" * 3000, "ab" * 900 + "é" * 500, "  x   y\n\n z ", "<|endoftext|>a<|endoftext|>", "don't 'LL we've  "):
        assert codec.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash_matches_brute_force(corpus):
    prints = {i: brute_simhash(t) for i, t in texts(corpus).items()}
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(corpus).collect()}
    assert found == {i: (prints[i], c) for i, c in brute_components(prints).items()}


def test_simhash_links_every_close_pair(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    every = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            for _ in range(12):
                every.add(b ^ sum(1 << p for p in r.sample(range(64), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(signed(x) for x in every)
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert labels == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def brute_removal(docs):
    first = {}
    words = {i: t.encode().split() for i, t in docs.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_match_brute_force(corpus, monkeypatch):
    want = brute_removal(texts(corpus))
    assert sum(n for _, n, _ in want.values()) > 300
    for frequent, spread in ((10**9, 10**9), (1, 10**9), (1, 1)):  # all by packed super-k-mers, all window by window, all spread
        monkeypatch.setattr(substrings, "FREQUENT", frequent)
        monkeypatch.setattr(substrings, "SPREAD", spread)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(corpus).collect()}
        assert got == want


def test_ctph_neighbours_match_brute_force(corpus):
    rows = sorted(texts(corpus).items(), reverse=True)
    want = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want[i] = (hashlib.sha256(edited.encode()).hexdigest(), ctph.fingerprint(t), ctph.fingerprint(edited))
    for ranges in (1, 5, 40):
        found = ctph.neighbour_fingerprints(corpus, ranges).collect()
        assert {r.doc_id: (r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in found} == want
    assert np.mean([r.near_edited for r in found]) > 0.6


def test_ctph_common_length_and_likeness():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    r = random.Random(1)
    for _ in range(50):
        a, b = ("".join(r.choice("ABCD") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert ctph._common(a, b) == lcs(a, b)
    text = prose(5, 400)
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(text[:900] + "Q" + text[900:])) > 0.8
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(prose(6, 400))) < 0.4
    assert ctph.likeness("3:AB:A", "48:AB:A") == 0.0


def test_chat_folds_events(spark):
    log = spark.createDataFrame(
        [
            (1, 0, 1, 0, "message", "user", "hi"),
            (1, 1, 1, 0, "delta", "assistant", "wro"), (1, 1, 1, 1, "delta", None, "ng"), (1, 1, 1, 2, "regenerate", None, None),
            (1, 1, 1, 3, "delta", None, "right"), (1, 1, 1, 4, "delta", None, " on"),
            (1, 2, 1, 0, "message", "user", "old"), (1, 2, 1, 1, "edit", None, "new"),
            (1, 3, 1, 0, "message", "user", "gone"), (1, 3, 1, 1, "delete", None, None),
            (2, 0, 1, 0, "message", "us: er", "\\h ### </turn>\n### assistant: x"), (2, 1, 1, 0, "message", "assistant", None),
        ],
        "conv_id long, turn long, message int, seq int, kind string, role string, text string",
    )
    read = {r.conv_id: r for r in chat.read_back(chat.format_conversations(log)).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", "hi"), ("assistant", "right on"), ("user", "new")]
    assert read[1].loss_text == "right on"
    assert [(t.role, t.text) for t in read[2].turns] == [("us: er", "\\h ### </turn>\n### assistant: x"), ("assistant", "")]
    assert read[2].loss_text == "" and read[2].formatted.count("</turn>") == 2


def test_chat_round_trip_of_odd_texts(spark):
    r = random.Random(2)
    parts = ["\\", "###", "</turn>", "#", "<", "b", "h", "t", "c", ":", " ", "\n", "turn>", "### assistant: "]
    rows = [(i, k, r.choice(["user", "assistant", "a:b", "\\c"]), "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(40) for k in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(chat.as_events(table)))
    got = {(x.conv_id, k): (t.role, t.text) for x in read.collect() for k, t in enumerate(x.turns)}
    assert got == {(i, k): (role, text) for i, k, role, text in rows}


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {k for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_measures_match_brute_force(spark):
    r = random.Random(4)
    made = ["".join(r.choices(["a ", "b ", "c\t", "d\n", "é# ", "|x\x0b", "\x0c", "  ", " y "], k=r.randint(0, 80))) for _ in range(150)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long, a long, b string, c string, d double, e string, f double, g int")
    for x in quality.measured(docs).select("doc_id", quality.n_words(quality.F.col("m")).alias("n"), "m.word_chars", "m.n_symbols", quality.n_dup_lines(quality.F.col("m")).alias("d"), quality.n_repeat_words(quality.F.col("m")).alias("r")).collect():
        assert (x.n, x.word_chars, x.n_symbols, x.d, x.r) == brute_measures(made[x.doc_id])


def test_quality_binomial_chance(spark):
    for n, k, p in ((10, 0, 0.1), (50, 2, 0.05), (2000, 40, 0.03), (300, 0, 0.001)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality._chance(quality.F.lit(n).cast("long"), quality.F.lit(k).cast("long"), quality.F.lit(p)).alias("c")).first().c
        assert abs(got - (want if k <= n * p else 1.0)) < 1e-9


def test_quality_thresholds_spare_good_documents(spark):
    good = [row(i, prose(i, 50)) for i in range(900)]
    bad = [row(1000 + i, " ".join(w + "###" for w in prose(i, 50).split())) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long, a long, b string, c string, d double, e string, f double, g int")
    labels = spark.createDataFrame([(x[0], int(x[0] < 1000)) for x in good + bad], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judged(docs, labels).where("kept").collect()}
    assert not kept & set(range(1000, 1100)) and len(kept) > 850
    few = quality.judged(docs.where("doc_id < 30 or doc_id >= 1000"), labels).where("kept").count()
    assert few == 130  # thirty good labels cannot prove a bound, so no cutoff is taken


def test_pii_base_spans():
    text = "a.b@c.de x@y 1.2.3.4 999.1.1.1 4111 1111 1111 1111 4111 1111 1111 1112 +1 (017) 555-7713 +12 1.2.3.4.5"
    spans = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert spans[0] == ("email", "a.b@c.de") and ("ip", "1.2.3.4") in spans and ("phone", "+1 (017) 555-7713") in spans
    assert not any(s == "999.1.1.1" for _, s in spans) and ("phone", "+12") not in spans


def test_pii_trees_learn_and_redact(spark):
    r = random.Random(5)
    rows = [row(i, f"{prose(i, 10)} token = \"{r.getrandbits(128):032x}\" {prose(i + 1, 5)} mail{i}@host.example.com 192.168.{i % 256}.{r.randint(0, 255)} {r.randint(100000, 999999999)} {prose(i, 3)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, b string, c string, d double, e string, f double, g int")
    model = pii.fit(docs)
    found = {x.doc_id: x for x in pii.find(docs, model).collect()}
    assert all(x.n_email == 1 and x.n_ip == 1 and "secret:" in x.spans for x in found.values())
    assert sum("number:" in x.spans for x in found.values()) < 20
    clean = pii.redact(docs, model).first()
    assert "[EMAIL]" in clean.text and "[SECRET]" in clean.text and "@" not in clean.text and clean.n_chars == len(clean.text)


def test_pii_boosting_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = pii.boost(x, y, np.arange(600) % 5 == 0)
    assert ((trees.chance(x) > 0.5) == (y > 0)).mean() > 0.95 and trees.threshold <= 1


def test_mixing_targets(spark):
    def level(sizes, weights):
        whole, target, capped = sum(sizes), [0.0] * len(sizes), set()
        while True:
            left = whole - sum(target[i] for i in capped)
            over = sum(w for i, w in enumerate(weights) if i not in capped)
            for i, w in enumerate(weights):
                if i not in capped:
                    target[i] = left * w / over if over else 0.0
            more = {i for i in range(len(sizes)) if i not in capped and target[i] > 3 * sizes[i]}
            if not more:
                return target
            for i in more:
                target[i] = 3.0 * sizes[i]
            capped |= more

    r = random.Random(6)
    for _ in range(5):
        sizes = [r.choice([0, 1, 5, 50, 1000]) * r.randint(1, 9) for _ in range(8)]
        rows = [(None if i == 7 else f"s{i}", s) for i, s in enumerate(sizes)]
        got = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = level(sizes, [mixing.WEIGHTS[i % 3] for i in range(8)])
        assert all(abs(got[s] - w) < 1e-6 * max(1, w) for (s, _), w in zip(rows, want))


def test_mixing_is_exact_and_repeatable(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    one = sorted(map(tuple, mixing.allotments(corpus).collect()))
    assert one == sorted(map(tuple, mixing.allotments(corpus.repartition(3)).collect()))
    taken, target = collections.Counter(), {}
    for _, source, _, size, _, goal, words in one:
        taken[source] += words
        target[source] = goal
        assert 0 <= words <= 3 * size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20_000)
    assert one == sorted(map(tuple, mixing.allotments(corpus).collect()))


def test_ngram_pieces_agree(monkeypatch):
    text = prose(8, 3000)
    whole = ngrams.counted(text, (1, 2, 3), 12)
    monkeypatch.setattr(ngrams, "_PIECE", 500)
    parts = ngrams.counted(text, (1, 2, 3), 12)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_langid_learns(corpus):
    model = langid.fit(corpus.where("doc_id < 30"))
    found = langid.predict(corpus.where("doc_id >= 30 and doc_id < 40"), model).collect()
    assert all(r.lang_pred == ("x" if r.doc_id % 2 else "y") and 0 <= r.score <= 1 for r in found)
    assert 0.2 <= model.temperature <= 10


def test_toxicity_learns(spark):
    bad = "zork"
    rows = [row(i, f"{prose(i, 30)} {bad if i % 3 == 0 else 'fine'} {prose(i + 1000, 30)}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, b string, c string, d double, e string, f double, g int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(180)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    high = [s for i, s in scores.items() if i >= 180 and i % 3 == 0]
    low = [s for i, s in scores.items() if i >= 180 and i % 3]
    assert np.mean([h > x for h in high for x in low]) > 0.95


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+_ 1250()\n", max_size=60))
def test_pii_base_spans_match_the_patterns(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    want = [(k, *m.span()) for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m.group())]
    assert pii.base_spans(text) == want


def test_pii_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000 + "a@" + "b" * 200_000 + " x" * 1000) == []
    assert pii.base_spans("0" * 10_000 + "1.2.3.4") == [("ip", 0, 10_007)]
