"""Stock drawn above a bound against all pairs, grades and best spellings of repeated names, sales of one number."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import authoring, combat, resolution
from graphloom.plans import document_queries


def all_pairs(shops, items, k, seed):
    both = shops.join(items.where("weight > 0"), "specialty")
    h = F.xxhash64("shop_id", "item_id", F.lit(seed))
    u = (F.pmod(h, F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    rank = F.row_number().over(Window.partitionBy("shop_id").orderBy(F.desc(F.log(u) / F.col("weight")), "item_id"))
    quantity = (F.pmod(F.shiftrightunsigned(h, 41), F.lit(4)) + 1).cast("int")
    return both.withColumn("nth", rank).where(F.col("nth") <= k).select("shop_id", "item_id", "name", "price", quantity.alias("quantity"))


@pytest.mark.parametrize("block", [7, 1_000])
def test_stock_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(authoring, "BLOCK", block)
    items = spark.range(400).select(
        F.col("id").alias("item_id"), F.concat(F.lit("n"), "id").alias("name"), F.element_at(F.array(*map(F.lit, "aaabc")), (F.col("id") % 5 + 1).cast("int")).alias("specialty"),
        F.when(F.col("id") == 4, 1e15).when(F.col("id") % 7 == 0, 0.0).otherwise((F.col("id") % 13).cast("double")).alias("weight"), F.lit(1.0).alias("price"),
    )
    few = spark.createDataFrame([(9000, "n", "d", 1.0, 1.0), (9001, "n", "d", 2.0, 1.0)], items.schema)
    shops = spark.createDataFrame([(i, s) for i in range(30) for s in "abcdx"[i % 5]] + [(3, "b"), (None, "a")], "shop_id long, specialty string")
    rows = lambda df: sorted(map(str, df.collect()))
    stock = items.union(few)
    assert rows(authoring.generated_stock(shops, stock, 8, "s")) == rows(all_pairs(shops, stock, 8, "s"))
    assert rows(authoring.generated_stock(shops.limit(0), stock, 8, "s")) == []


def test_different_names_are_graded_once(spark):
    gold = spark.createDataFrame([(i, "T", "red hot ring") for i in range(3000)] + [(5000, "T", "ring"), (5000, "U", "ring"), (5001, "T", "none")], "id long, entity_type string, name string")
    given = spark.createDataFrame([("T", "ring")] * 3000 + [("T", "hot ring"), ("T", "hot rod"), ("U", "ring"), ("U", "big ring")], "entity_type string, name string")
    found = resolution.graded(gold, given)
    assert found.groupBy("hits").count().orderBy("hits").collect() == [(0, 1), (2, 3000), (3, 1)]
    assert found.where("id = 5000").first().hits == 3  # of two types: ring, hot ring, big ring
    made = [int(line.split(":")[1].replace(",", "")) for line in _metrics(spark, found)]
    assert max(made) < 100_000  # all pairs of rows were nine million


def _metrics(spark, df):
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.finalPhysicalPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            out.append(f"rows:{found.get().value()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_best_spelling_of_repeated_names(spark, tmp_path):
    parts = spark.range(3000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "large ring").otherwise("Large Rings").alias("p_name"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    found = document_queries.fuzzy_names(spark, str(tmp_path))
    assert sorted((r.query_id, r.id, r.score) for r in found.collect()) == [(i, 0, 90.0) for i in range(0, 3000, 50)]
    assert max(int(x.split(":")[1]) for x in _metrics(spark, found)) <= 3000


@pytest.mark.parametrize("rows", [[(1, 7, 3), (1, 7, 9), (1, 2, 95)], [(1, 7, 9), (1, 2, 95), (1, 7, 3)]])
def test_sales_of_one_number(spark, rows):
    """The one that wants least comes first, in whatever order the rows lie."""
    orders, stock = spark.createDataFrame(rows, "item long, seq long, wanted long").coalesce(1), spark.createDataFrame([(1, 100)], "item long, stock long")
    assert sorted(combat.sales(orders, stock).collect()) == [(1, 2, 95, 5), (1, 7, 2, 0), (1, 7, 3, 2)]
