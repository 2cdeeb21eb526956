"""Hand-written data and its evaluation: seeds, answer checks, rival sections, records of play."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.plan import durable


def seed_problems(nodes: DataFrame, edges: DataFrame, types: DataFrame, relations: DataFrame) -> DataFrame:
    """(subject, problem): doubled ids, names claimed twice in a type, unknown types and relations, ends that are not there, self-loops.

    Types (entity_type) and relations (rel_type) are tables, so a vocabulary of any size is joined.
    """
    ids = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("subject"), F.lit("doubled id").alias("problem"))
    names = nodes.groupBy("entity_type", F.lower("name").alias("subject")).agg(F.countDistinct("id").alias("n")).where("n > 1").select("subject", F.lit("name claimed twice").alias("problem"))
    kinds = nodes.join(types.select("entity_type").distinct(), "entity_type", "left_anti").select(F.col("id").alias("subject"), F.lit("unknown type").alias("problem"))
    name = F.concat_ws(" ", "src", "rel_type", "dst").alias("subject")
    rels = edges.join(relations.select("rel_type").distinct(), "rel_type", "left_anti").select(name, F.lit("unknown relation").alias("problem"))
    loops = edges.where("src = dst").select(name, F.lit("self-loop").alias("problem"))
    lost = [edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select(name, F.lit("missing end").alias("problem")) for end in ("src", "dst")]
    return reduce(DataFrame.unionByName, [ids, names, kinds, rels, loops, *lost]).distinct()


def checked_answers(answers: DataFrame) -> DataFrame:
    """Adds ``passed`` to (question_id, run, text, must, must_not): all of must, none of must_not, in any case."""
    text = F.lower("text")
    said = F.forall("must", lambda m: F.contains(text, F.lower(m)))
    unsaid = ~F.exists("must_not", lambda m: F.contains(text, F.lower(m)))
    return answers.withColumn("passed", F.coalesce(said & unsaid, F.lit(False)))


def pass_rates(checked: DataFrame) -> DataFrame:
    """(question_id, runs, passes, every, any): how often each question passes over its runs."""
    return checked.groupBy("question_id").agg(
        F.count("*").alias("runs"), F.count(F.when(F.col("passed"), 1)).alias("passes"), F.bool_and("passed").alias("every"), F.bool_or("passed").alias("any")
    )


def rivals(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, section_id): sections whose heading holds a capitalised word of the note that the question lacks, but gold ones.

    Words of headings and notes meet in an equality join.
    """
    capital = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\p{Lu}\p{Ll}{2,})"), F.lit(1)))
    asked = F.array_distinct(F.split(F.lower("question"), r"[^\p{L}\p{N}]+"))
    words = questions.select("question_id", "gold", F.explode(F.filter(capital("note"), lambda w: ~F.array_contains(asked, F.lower(w)))).alias("word"))
    heads = sections.select("section_id", F.explode(capital("heading")).alias("word"))
    found = words.join(heads, "word").where(~F.array_contains("gold", F.col("section_id")))
    return found.select("question_id", "section_id").distinct()


def record_ids(kind: str, name: Column, parent: Column | None = None, number: Column | None = None) -> Column:
    """Ids of play records: ``<kind>_<slug>``, or ``<parent>_<kind>_<number>``."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", F.lit(kind), plain) if parent is None else F.concat_ws("_", parent, F.lit(kind), number.cast("string"))


def with_default_hp(characters: DataFrame) -> DataFrame:
    """Hit points default to eight a level, level to one; current ones to the most."""
    level = F.coalesce("level", F.lit(1))
    most = F.coalesce("max_hp", level * 8)
    return characters.withColumns({"level": level, "max_hp": most, "hp": F.coalesce("hp", most)})


def seeded_choice(items: DataFrame, keys: list[str], k: int, seed: str) -> DataFrame:
    """k items of each key without return, likelier by ``weight``: the largest of log(u) / weight, u from a hash of the id and the seed."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.log(u) / F.col("weight")), "id"))
    return items.where("weight > 0").withColumn("nth", rank).where(F.col("nth") <= k).drop("nth")


def retreats(hp: Column, most: Column, threshold: Column, style: Column, standing: Column) -> Column:
    """Whether a combatant leaves once its share of hit points is at the threshold: a berserker never, a coward always, others alone.

    ``standing`` counts the living of its side, itself included.
    """
    low = F.when(most > 0, hp / most).otherwise(0.0) <= threshold
    return low & (style != "berserker") & ((style == "cowardly") | (standing <= 1))


def stepped(x: Column, y: Column, to_x: Column, to_y: Column, speed: Column, reach: Column) -> Column:
    """(x, y) after moving towards a target by speed/5 cells at most, stopping ``reach`` cells before it; diagonals count as one."""
    away = F.greatest(F.abs(to_x - x), F.abs(to_y - y))
    steps = F.greatest(F.lit(0), F.least(F.floor(speed / 5), away - reach))
    move = lambda a, b: a + F.signum(b - a).cast("int") * F.least(F.abs(b - a), steps)
    return F.struct(move(x, to_x).cast("int").alias("x"), move(y, to_y).cast("int").alias("y"))


def shop_values(items: DataFrame) -> DataFrame:
    """(shop_id, items, value): lines and worth of each shop's stock."""
    return items.groupBy("shop_id").agg(F.count("*").alias("items"), F.round(F.sum(F.col("price") * F.col("quantity")), 2).alias("value"))


#: Pairs of a shop and an item that one task weighs, items that lie in one block of a list, and rounds that have a bound.
PAIRS, BLOCK, ROUNDS = 20_000_000, 1_000, 6


def generated_stock(shops: DataFrame, items: DataFrame, k: int, seed: str) -> DataFrame:
    """(shop_id, item_id, name, price, quantity): k items for each shop from its specialty's list, drawn by a hash of shop, item and seed.

    Items (item_id, name, specialty, weight, price) are a catalogue; a shop meets only its specialty's part of it. Weightier items
    are likelier, and a quantity of one to four follows from the same hash.

    Every pair is weighed, as each has a hash of its own, but only pairs above a bound are kept and ranked: of all weights ``much``
    times the share that one draw takes. Where a shop has k above it, these hold its k best; the others are drawn again with a
    lower bound, and at last with none. Lists are cut into blocks, so a specialty is spread over tasks.
    """
    shops, items = durable(shops.select("shop_id", "specialty")), items.where("weight > 0").select("item_id", "name", "specialty", "weight", "price")
    lists = durable(items.groupBy("specialty").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).join(shops.groupBy("specialty").agg(F.count("*").alias("shops")), "specialty"))
    size = lists.agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("shops")).alias("pairs")).first()
    blocks = max(1, math.ceil((size["n"] or 0) / BLOCK))
    stock = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    h = F.xxhash64("shop_id", "item_id", F.lit(seed))
    u = (F.pmod(h, F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    rank = F.row_number().over(Window.partitionBy("shop_id").orderBy(F.desc(F.log(u) / F.col("weight")), "item_id"))
    quantity = (F.pmod(F.shiftrightunsigned(h, 41), F.lit(4)) + 1).cast("int")
    by_shop, drawn, left, pairs = Window.partitionBy("shop_id"), [], shops, size["pairs"] or 0
    for much in (*((4.0 * k + 24) * 32**i for i in range(ROUNDS)), None):
        parts = max(shops.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS))
        own = left.join(lists.select("specialty", "n", "w"), "specialty").withColumn("least", F.least(F.lit(k).cast("long"), F.sum("n").over(by_shop)))
        asked = own.withColumn("bound", F.lit(much) / F.sum("w").over(by_shop)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("n", "w")
        both = asked.repartition(parts, "specialty", "block").join(stock.repartition(parts, "specialty", "block"), ["specialty", "block"])
        if much:  # log(u) is at most u - 1, so the first part loses no pair and spares most logarithms
            both = both.where((u >= 1 - F.col("bound") * F.col("weight") - 1e-9) & (F.log(u) / F.col("weight") >= -F.col("bound")))
        best = both.withColumn("nth", rank).where(F.col("nth") <= k).withColumn("got", F.count("*").over(by_shop)).where("got >= least")
        drawn.append(durable(best.select("shop_id", "item_id", "name", "price", quantity.alias("quantity"))))
        done = drawn[-1].select(F.col("shop_id").alias("done")).distinct()
        left = durable(left.join(lists.select("specialty"), "specialty", "left_semi").join(done, F.col("shop_id").eqNullSafe(F.col("done")), "left_anti").select("shop_id", "specialty"))
        pairs = left.count() * (size["n"] or 0)
        if not pairs:
            break
    return reduce(DataFrame.union, drawn)
