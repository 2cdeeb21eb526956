"""Pairs of spellings whose Indel ratio reaches a bound, by an equality join on their rarest q-grams; no pair is lost.

A ratio of at least t over lengths a and b allows D = (1 - t/100)(a + b) letters that only one spelling has. A letter that goes
takes two pairs of neighbours (bigrams) with it and one that comes parts one, so a lower bound on shared bigrams follows from the
lengths alone. Two sets that share so many have one in common among their first (size - bound + 1), whatever order both keep; the
order here is by frequency, rarest first, so these prefixes meet in small groups. Lengths for which the bound is not positive meet
by single letters, of which ratios ask at least t(a + b)/200 in common. Repeated grams are told apart by their number.

Each pair is scored once: at the first gram that both prefixes hold. The score itself is exact. Only how the most frequent grams
are ordered is sent to tasks; grams beyond those many come first, by name, which changes the order and no result.

Edge cases: a null spelling meets none; two empty ones are equal (100); spellings are compared as they are, so callers fold case;
repeated spellings are joined once and every result holds for all of their rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import fuzzy

#: Grams whose frequency is sent to every task.
MOST_GRAMS = 50_000


@lru_cache(maxsize=100_000)
def _lengths(a: int, least: float) -> tuple[int, int]:
    """The lengths with which one of ``a`` letters can reach the ratio."""
    return math.ceil(least * a / (200 - least) - 1e-9), math.floor((200 - least) * a / least + 1e-9)


def _shared(a: int, b: int, least: float) -> int:
    """A lower bound on the bigrams that spellings of these lengths share at the ratio."""
    apart = math.floor((1 - least / 100) * (a + b) + 1e-9)
    apart -= (apart - (a + b)) % 2  # letters of one only: as many as the lengths' sum, less twice those in common
    gone, come = (apart + a - b) // 2, (apart + b - a) // 2
    return max(a - 1 - 2 * gone - come, b - 1 - 2 * come - gone)


@lru_cache(maxsize=100_000)
def _least_shared(a: int, least: float) -> int:
    low, high = _lengths(a, least)
    return min((_shared(a, b, least) for b in range(low, high + 1)), default=0)


@lru_cache(maxsize=100_000)
def _ways(a: int, least: float) -> tuple[bool, bool]:
    """Whether a length meets others by bigrams, and whether it meets any by letters."""
    low, high = _lengths(a, least)
    pairs = [_least_shared(b, least) > 0 for b in range(low, high + 1)]
    own = _least_shared(a, least) > 0
    return own and any(pairs), not own or not all(pairs)


def _grams(name: str, q: int) -> list[str]:
    """The grams of a spelling, the n-th of equal ones with its number; letters and bigrams never mix."""
    seen: Counter = Counter()
    out = []
    for i in range(len(name) - q + 1):
        gram = name[i : i + q]
        seen[gram] += 1
        out.append(f"{q}{gram}{seen[gram]}")
    return out


def prefixes(name: str, least: float, counts: dict[str, int]) -> list[str]:
    """The grams under which a spelling is met, rarest first."""
    if not name:
        return ["0"]
    order = lambda g: (counts.get(g, 0), g)
    by_two, by_one = _ways(len(name), least)
    out = []
    if by_two:
        found = sorted(_grams(name, 2), key=order)
        out += found[: len(found) - _least_shared(len(name), least) + 1]
    if by_one:
        found = sorted(_grams(name, 1), key=order)
        low = _lengths(len(name), least)[0]
        out += found[: len(found) - max(1, math.ceil(least * (len(name) + low) / 200 - 1e-9)) + 1]
    return out


def alike(asked: DataFrame, known: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """(name, known, score) of different spellings (name) of both sides whose ratio is ``least`` or more; within one ``by``, if given."""
    if not 0 < least <= 100:
        raise ValueError("a ratio from above 0 to 100")
    group = F.col(by).cast("string") if by else F.lit("")
    left, right = (df.where(F.col("name").isNotNull()).select(group.alias("of"), F.col("name").cast("string").alias("name")).distinct() for df in (asked, known))
    spark = known.sparkSession

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: Counter = Counter()
            for name in batch.column(0).to_pylist():
                found.update([*_grams(name, 1), *_grams(name, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    common = right.select("name").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(MOST_GRAMS)
    shared = spark.sparkContext.broadcast({r["gram"]: r["n"] for r in common.collect()})

    def marked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            grams = [prefixes(name, least, shared.value) for name in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grams, pa.list_(pa.string()))], names=["of", "name", "grams"])

    sides = [df.mapInArrow(marked, "of string, name string, grams array<string>").withColumn("gram", F.explode("grams")) for df in (left, right)]
    met = sides[0].join(sides[1].toDF("of", "known", "known_grams", "gram"), ["of", "gram"])
    a, b = F.length("name"), F.length("known")
    near = (F.least(a, b) * 200 >= (a + b) * (least - 1e-9)) & (F.col("gram") == F.get(F.array_intersect("grams", "known_grams"), F.lit(0)))
    scored = met.where(near).select(*([F.col("of").alias(by)] if by else []), "name", "known").withColumn("score", fuzzy.ratio_of("name", "known"))
    return scored.where(F.col("score") >= least)
