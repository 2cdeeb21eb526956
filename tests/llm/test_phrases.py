"""Collocations against a count over all pieces, by the sent and by the joined dictionary."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import phrases

from .conftest import SCHEMA, row

_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_count(rows, least, most):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(k == lang and inside(q) and n >= least and 100 * n >= 80 * a for (k, q), n in counts.items() if n >= least):
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


def made(seed, n):
    r = random.Random(seed)
    words = ["New", "york", "city", "Größe", "ab-c", "the", "of", "x\u00a0y", "z", "rare"]
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\x00 "]) for _ in range(r.randint(0, 120)))
        yield r.choice(["en", "de", None]), text + ("new york city " * 4 if i % 3 == 0 else "")


@pytest.mark.parametrize("most_words", [phrases.MOST_WORDS, 0])
def test_against_a_count(spark, most_words):
    rows = [*made(1, 500), ("en", None), ("fr", ""), ("fr", "one"), ("und", "a b " * 40), ("en", "long word " * 1500), ("en", "same same " * 700)]
    docs = spark.createDataFrame([row(i % 9 or None, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    found = phrases.collocations(docs, 30, 40, most_words)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = by_count(rows, 30, 40)
    assert len(expected) > 60
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_many_batches_and_small_memory_give_the_same(spark, monkeypatch):
    rows = list(made(2, 300))
    docs = spark.createDataFrame([row(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    expected = by_count(rows, 30, 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most_words", [phrases.MOST_WORDS, 0])
def test_texts_are_packed_once_and_in_ranges(spark, monkeypatch, most_words):
    """Ranges begin at keys of a sample, however common one pair is, so that not all texts are packed again to find where they begin."""
    monkeypatch.setattr(phrases, "SAMPLED", 2_000)
    monkeypatch.setattr(phrases, "BOUNDS", 20)
    monkeypatch.setattr(phrases, "LEAST_RANGE", 1_000)
    rows = [*made(5, 400), *(("en", f"of the {w} {x} ") for w in "bcdfghjklm" for x in "aeiou" for _ in range(40))]
    docs = spark.createDataFrame([row(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    packed = {n: getattr(phrases, n) for n in ("_packed_sent", "_packed_joined")}
    asked = []
    for n, f in packed.items():
        monkeypatch.setattr(phrases, n, lambda d, numbered, bounds, f=f: asked.append((d.count(), bounds, f(d, numbered, bounds))) or asked[-1][2])
    found = phrases.collocations(docs, 30, 2000, most_words)
    assert sorted(tuple(r) for r in found.collect()) == by_count(rows, 30, 2000)
    (sampled, _, _), (whole, bounds, keys) = asked
    assert sampled < whole / 2 and whole == len(rows) and len(bounds) == 3
    parts = {r.part: (r.a, r.b, r.n) for r in keys.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).collect()}
    assert sorted(parts) == [0, 1, 2, 3] and all(parts[i][1] < bounds[i] <= parts[i + 1][0] for i in range(3))
    assert max(n for _, _, n in parts.values()) < sum(n for _, _, n in parts.values()) / 2


def test_radix_sort_is_a_sort():
    r = np.random.default_rng(3)
    high, low = (r.integers(0, 1 << 62, 5000).astype(np.uint64) % np.uint64(m) for m in (97, 1 << 40))
    a, b, n = phrases.radix_sorted(high, low, np.arange(5000))
    order = np.lexsort((low, high))
    assert (a == high[order]).all() and (b == low[order]).all() and (n == order).all()


def test_memory_is_given_back_when_it_is_full(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 100)
    keys, rows, every = phrases._Keys(), [], Counter()
    r = np.random.default_rng(1)
    for _ in range(50):
        high, low = r.integers(0, 30, 40).astype(np.uint64), r.integers(0, 30, 40).astype(np.uint64)
        every.update(zip(high.tolist(), low.tolist()))
        rows += [x for b in keys.add(high, low) for x in b.to_pylist()]
    rows += [x for b in keys.rows() for x in b.to_pylist()]
    found = Counter()
    for x in rows:
        found[int.from_bytes(x["key"][:8], "big"), int.from_bytes(x["key"][8:], "big")] += x["n"]
    assert found == every


def peak_mb(make):
    """The most that is held while what is made is gone through, in MB, and its length."""
    tracemalloc.start()
    try:
        made = sum(1 if isinstance(x, bytes) else x.num_rows for x in make())
        return tracemalloc.get_traced_memory()[1] / 1e6, made
    finally:
        tracemalloc.stop()


def test_a_task_with_many_different_keys_holds_few():
    """Keys that hardly come again are passed on, not gathered: an executor's tasks share what its heap leaves of its memory."""
    r = np.random.default_rng(2)

    def batches():
        keys = phrases._Keys([bytes([i]) + bytes(15) for i in range(1, 50)])
        for _ in range(40):
            yield from keys.add(*(r.integers(0, 1 << 62, 100_000).astype(np.uint64) for _ in range(2)))
        yield from keys.rows()

    most, rows = peak_mb(batches)
    assert rows == 4_000_000 and most < 80  # of which pandas, loaded meanwhile, is 25


def test_a_task_holds_the_sent_dictionary_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(150_000)]
    numbered = spark.createDataFrame(pa.table({"lang": ["en"] * len(words), "word": words, "id": range(1, len(words) + 1)}))
    tasks = []
    monkeypatch.setattr(phrases, "_pieces", lambda docs: SimpleNamespace(mapInArrow=lambda task, _: tasks.append(task)))
    phrases._packed_sent(SimpleNamespace(sparkSession=spark), numbered, [])
    dictionary, size = peak_mb(lambda: {w.encode(): int(str(i)) for i, w in enumerate(words)})
    most, rows = peak_mb(lambda: tasks[0](iter([])))
    assert size == len(words) and rows == 0 and most < 1.7 * dictionary


def test_empty_table(spark, none):
    assert phrases.collocations(none).collect() == []
