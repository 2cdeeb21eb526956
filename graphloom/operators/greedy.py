"""Greedy clusters of alike names: seeds in order take all that are like them, without a fold over a document.

The greedy order picks a seed if no earlier seed is like it. That is settled in rounds: a name without an undecided earlier
neighbour is a seed, and what is like a seed is decided with it. The result is that of the fold, since a name waits only for its own
earlier neighbours; the number of rounds is the longest such chain of waiting, small for orders that do not follow the likeness.

Pairs come from equality joins and are scored once. Whole spellings meet by rare grams (``fuzzy_join``). For a spelling inside a
longer one, at most D letters of both differ within the stretch, so of D + 1 pieces of the shorter one stands in the longer as it is:
pieces meet the longer one's stretches of as many letters.

Edge cases: null names are left out; equal names are one node, and every row of a name has its result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import fuzzy
from graphloom.operators.fuzzy_join import alike
from graphloom.operators.plan import durable

#: Letters of a piece that are compared; a longer piece stands where its beginning stands.
MOST_LETTERS = 6
#: Bounds of the least likeness: below, pieces could be empty; above, a name inside another (0.95) is like none.
LOWEST, HIGHEST = 0.6, 0.95


def similarity(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if (a in b or b in a) and min(len(a), len(b)) >= 3:
        return 0.95
    return max(fuzzy.ratio(a, b), 0.95 * fuzzy.partial_ratio(a, b)) / 100.0


def pieces(name: str, least: float) -> list[str]:
    """The beginnings of the pieces of a name, one of which stands in every longer name that holds a stretch so like it.

    A part's ratio counts 0.95, so it has to reach least / 0.95; a stretch is no longer than the name.
    """
    size = len(name)
    apart = math.floor(2 * size * (1 - least / 0.95) + 1e-9)
    cuts = [size * i // (apart + 1) for i in range(apart + 2)]
    return list({name[a : min(b, a + MOST_LETTERS)] for a, b in zip(cuts, cuts[1:])})


def stretches(name: str) -> list[str]:
    return list({name[i : i + q] for q in range(1, MOST_LETTERS + 1) for i in range(len(name) - q + 1)})


def _lower(names: pd.Series) -> pd.Series:
    return names.str.lower()


def _grams(of: Callable[[str], list[str]]):  # noqa: ANN202
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [of(name) for name in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=["of", "low", "grams"])

    return batches


def like_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """(of, low, other): different lower-case names of one group (of, low) whose likeness is ``least`` or more, each pair once."""
    whole = alike(nodes.toDF("of", "name"), nodes.toDF("of", "name"), 100 * least, "of").select("of", F.col("name").alias("low"), F.col("known").alias("other"))
    kinds = "of string, low string, grams array<string>"
    short = nodes.mapInArrow(_grams(lambda n: pieces(n, least)), kinds).select("of", "low", F.explode("grams").alias("gram"))
    long = nodes.mapInArrow(_grams(stretches), kinds).select("of", F.col("low").alias("other"), F.explode("grams").alias("gram"))
    part = short.join(long, ["of", "gram"]).where((F.length("low") <= F.length("other")) & (F.col("low") != F.col("other"))).select("of", "low", "other")
    met = whole.unionByName(part).where("low <> other").select("of", F.least("low", "other").alias("low"), F.greatest("low", "other").alias("other")).distinct()

    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(a, b) for a, b in zip(x, y)], dtype="float64")

    return met.where(F.pandas_udf(scored, "double")("low", "other") >= least)


def seeds(rows: DataFrame, keys: list[str], name: str, order: Column, least: float = 0.85) -> DataFrame:
    """(of, low, seed): the lower-case seed that takes each name of a group, from rows with a name, group keys and an order."""
    if not LOWEST < least <= HIGHEST:
        raise ValueError(f"a likeness above {LOWEST}, at most {HIGHEST}")
    named = grouped(rows, keys, name).where(F.col("low").isNotNull())
    nodes = durable(named.groupBy("of", "low").agg(F.min(F.struct(order.alias("o"), F.col("low").alias("l"))).alias("at")))
    pairs = like_pairs(nodes.select("of", "low"), least)
    ends = pairs.join(nodes, ["of", "low"]).join(nodes.select("of", F.col("low").alias("other"), F.col("at").alias("other_at")), ["of", "other"])
    first = F.col("at") < F.col("other_at")
    edges = durable(ends.select("of", F.when(first, F.col("low")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("low")).alias("b"), F.least("at", "other_at").alias("at")))
    taken, open_ = [], edges.select("of", "a", "b")
    while not open_.isEmpty():
        waiting = open_.select("of", F.col("b").alias("a")).distinct()
        now = open_.join(open_.select("of", "a").distinct().join(waiting, ["of", "a"], "left_anti"), ["of", "a"], "left_semi").select("of", "b").distinct()
        taken.append(durable(now))
        gone = taken[-1]
        open_ = durable(open_.join(gone, ["of", "b"], "left_anti").join(gone.withColumnRenamed("b", "a"), ["of", "a"], "left_anti").select("of", "a", "b"))
    gone = reduce(DataFrame.unionByName, taken, edges.select("of", "b").where("false"))
    by = edges.join(gone.withColumnRenamed("b", "a"), ["of", "a"], "left_anti").groupBy("of", "b").agg(F.min_by("a", "at").alias("seed")).withColumnRenamed("b", "low")
    return nodes.select("of", "low").join(by, ["of", "low"], "left").select("of", "low", F.coalesce("seed", "low").alias("seed"))


def grouped(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with their group's keys as one string (of) and their lower-case name (low), by the rules that the likeness uses."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]
    return rows.withColumns({"of": F.to_json(F.array(*parts)), "low": F.pandas_udf(_lower, "string")(name)})
