from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, m string, score double, words string, target double, size int"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, "k", "m", 0.5, "w", 2.0, 3)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, white space only, one word, a very long text, ties, repeated rows, nulls in other columns."""
    long_text = prose(1, 30_000)
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, "word"), row(5, long_text), row(6, prose(2, 40)), row(7, prose(2, 40)),
        row(8, prose(3, 60), None, None), row(8, prose(3, 60), None, None), row(9, "ä ö ü ß é <|endoftext|> 😀", "de"), row(10, prose(4, 200) + "\n" + prose(4, 200)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose of two made-up languages with copies, near copies and shared passages."""
    rows = [row(i, prose(i, 80), "x" if i % 2 else "y", f"s{i % 3}") for i in range(40)]
    rows = [(*r[:1], r[1].replace("a", "ä") if r[2] == "y" else r[1], *r[2:]) for r in rows]
    passage = prose(99, 30)
    rows += [row(100 + i, f"{prose(200 + i, 20)} {passage} {prose(300 + i, 20)}", "x", "s1") for i in range(4)]
    base = prose(500, 120)
    rows += [row(200 + i, base if i < 3 else base + " extra", "x", "s2") for i in range(4)]
    return spark.createDataFrame(rows, SCHEMA)
