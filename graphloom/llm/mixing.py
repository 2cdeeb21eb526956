"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents lie in the order of their keys; distributed prefix sums
of sizes say how many words stand before each; the source's budget cuts that order at exactly its number of words, after as
many whole epochs as the budget holds. No text is moved: only (id, source, size, key) is shuffled.

The order is made of buckets of the uniform keys, about ``BUCKET_ROWS`` rows each, however large a source is, and of blocks
of ``BLOCK`` buckets: running sums over a source's blocks, over a block's buckets and within each bucket. So a source with a
third of all rows spreads over as many tasks as its size asks for, and no task sees more than a list of blocks (one for some
two million rows). Rows without an id all have one key, and lie in the order of a hash of their texts: its first digits part
that key's bucket into ``PARTS``.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the sum of all sizes; a target stops at
``CAP`` times its source's size and the excess is shared again by weight. That is the level L at which targets
min(cap, L * weight) add up to the whole; it is found from running sums over the sources in the order in which they stop.

Edge cases: a null or empty text has size 0 and is taken 0 times. A null source is a source of its own. Sources of size 0
have target 0. Rows that repeat an id are mixed one by one, in the order of a hash of the text where keys are equal. Columns
other than doc_id, source and text are carried by ``mix`` only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, text_of, word_array, word_count

WEIGHTS, CAP, BUCKET_ROWS, BLOCK, PARTS = (5, 2, 1), 3, 500, 4096, 4096
_KEY_DIGITS = 13


def _key_of(name: Column, seed: str) -> Column:
    """Uniform in [0, 2^52): exact in a double, and the same from any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, _KEY_DIGITS), 16, 10).cast("long")


def _key(seed: str) -> Column:
    return _key_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)


def _part(seed: str) -> Column:
    """The place within a bucket that keeps the order of key, then text hash: only the key of rows without an id has several."""
    shared = _key_of(F.lit(""), seed)
    nth = F.when(F.col("doc_id").isNull(), 1 + F.conv(F.substring("tie", 1, 3), 16, 10).cast("int")).otherwise(PARTS + 1)
    return F.when(F.col("key") < shared, 0).when(F.col("key") == shared, nth).otherwise(PARTS + 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, rows, source_size, target) from rows (source, size)."""
    # One row a source: what the windows below gather in one task is the list of sources, not of documents.
    sources = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * cap).cast("double"))
    stops = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    running = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("stopped"),
        F.sum("weight").over(stops.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(stops).alias("nth"),
        F.sum("source_size").over(every).cast("double").alias("whole"),
    ).withColumn("level", (F.col("whole") - F.col("stopped")) / F.col("open"))
    # The level is that of the first source which it does not stop.
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("nth", "level"))).over(every)
    return running.withColumn("at", level.getField("level")).select(
        "source", "rows", "source_size", F.least("most", F.coalesce(F.col("at"), F.lit(0.0)) * F.col("weight")).alias("target")
    )


def allotments(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, taken): the words that the mix takes of each document."""
    sized = durable(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string").alias("source"),
            word_count(text_of()).alias("size"),
            _key(seed).alias("key"),
            F.md5(text_of()).alias("tie"),
        )
    )
    targets = durable(source_targets(sized, weights, cap))
    same = F.col("source").eqNullSafe(F.col("of"))
    facts = targets.withColumnRenamed("source", "of")
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    placed = sized.join(facts, same).drop("of").withColumn("bucket", F.floor(F.col("key") / float(1 << 52) * buckets).cast("long"))
    placed = placed.withColumn("part", _part(seed)).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    place = ["source", "block", "bucket", "part"]
    sums = durable(placed.groupBy(*place).agg(F.sum("size").alias("words")))
    running = lambda over, of: F.coalesce(F.sum(of).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words")).withColumn(
        "before_block", running(Window.partitionBy("source").orderBy("block"), "words")
    )
    within = sums.withColumn("before_part", running(Window.partitionBy("source", "block").orderBy("bucket", "part"), "words"))
    at_block = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    starts = within.join(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "before_block"), at_block).select(
        F.col("source").alias("of"), F.col("bucket").alias("in"), F.col("part").alias("nth"), (F.col("before_block") + F.col("before_part")).alias("before_bucket")
    )
    inside = Window.partitionBy("source", "bucket", "part").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = laid.join(starts, same & (F.col("bucket") == F.col("in")) & (F.col("part") == F.col("nth")))
    budget = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size)
    rest = budget - epochs * size
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_bucket") - F.col("before")))
    return joined.select(
        "doc_id", "source", "tie", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed documents, columns as given: each document as often as its whole text is taken, then its first words.

    ``n_chars``, where present, is set to the length of the text that is left of a document cut by the budget.
    """
    columns = docs.columns
    taken = allotments(docs, seed, weights, cap).groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(
        F.max("size").alias("__size"), F.sum("taken").alias("__taken")
    )
    # Rows that repeat an id and a text stand for one document here; their shares add up. Of rows that differ in other columns
    # that of the smallest hash of them stays.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.groupBy(F.col("doc_id").alias("__doc"), F.md5(text_of()).alias("__tie0")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.xxhash64(*hashed)).alias("__row"))
    left = rows.select("__tie0", "__row.*")
    pairs = left.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__tie0") == F.col("__tie")))
    size, words = F.col("__size"), F.col("__taken")
    whole = F.when(size > 0, F.floor(words / size)).otherwise(0)
    over = F.when(size > 0, words - whole * size).otherwise(0)
    copies = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<bigint>")),
        F.when(over > 0, F.array(over.cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    laid = pairs.withColumn("__cut", F.explode(copies))
    text = F.when(F.col("__cut") < 0, F.col("text")).otherwise(F.array_join(F.slice(word_array(text_of()), 1, F.col("__cut").cast("int")), " "))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return laid.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns))
