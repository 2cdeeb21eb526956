from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import review


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_review(spark):
    edges = spark.createDataFrame([("c", "Ann", "OWNS", "Cup", None), ("c", "Bob", "KNOWS", "Ann", "accepted"), ("d", "Ann", "OWNS", "Cup", None), ("c", "Al", "KNOWS", "Bo", "proposed")], "chapter string, source string, rel_type string, target string, status string")
    assert [r.source for r in review.review_queue(edges, "c").collect()] == ["Al", "Ann"]
    made = [(1, "c", "ann", "OWNS", "CUP", "rejected", "me", "2024-01-01"), (2, "c", "ann", "OWNS", "cup", "accepted", "me", "2024-02-01"), (3, "c", "no", "OWNS", "one", "accepted", "me", "2024-02-01")]
    decisions = spark.createDataFrame(made, "decision_id int, chapter string, source string, rel_type string, target string, new_status string, reviewer string, date string")
    decided, counts = review.decide(edges, decisions)
    assert rows(counts) == [(1, 1), (2, 1), (3, 0)]
    assert rows(decided.na.fill(""), "chapter", "source", "status", "reviewed_on") == [("c", "Al", "proposed", ""), ("c", "Ann", "accepted", "2024-02-01"), ("c", "Bob", "accepted", ""), ("d", "Ann", "", "")]


def test_lists(spark):
    seen = spark.createDataFrame([(1, n, t) for n, t in (("a", 1), ("b", 3), ("c", 3), ("d", 2))], "conv_id int, name string, turn int")
    assert [r.name for r in review.recent_subjects(seen, 3).orderBy("nth").collect()] == ["b", "c", "d"]
    items = spark.createDataFrame([(1, "rare"), (2, "common"), (3, "odd")], "id int, rarity string")
    assert [r.id for r in review.by_rank(items, "rarity", ("common", "rare")).collect()] == [3, 2, 1]
    assert tuple(spark.range(1).select(review.truncated(F.lit("ab cd"), 3).alias("t")).first().t) == ("ab", True)
    mentions = spark.createDataFrame([("m1", "s", 2, None), ("m2", "s", 1, "Hall")], "mention_id string, section_id string, occurrences int, display_name string")
    assert rows(review.captions(mentions, spark.createDataFrame([("s", "Hall")], "section_id string, heading string"))) == [("m1", "Hall x2")]


def test_stock_and_blocks(spark):
    shops = spark.createDataFrame([("s",)], "id string")
    contains = spark.createDataFrame([("s", "CONTAINS", "i"), ("s", "CONTAINS", "n"), ("t", "CONTAINS", "i"), ("s", "OWNS", "i")], "src string, rel_type string, dst string")
    items = spark.createDataFrame([("i", "Cup", "ITEM", 2.0, 1), ("n", "Ann", "NPC", None, None)], "id string, name string, entity_type string, price double, quantity int")
    assert rows(review.inventory(shops, contains, items), "shop_id", "name") == [("s", "Cup")]
    text = "Ghoul\nArmor Class 12\n" + "x" * 100 + "\nHit Points 22 (5d8)\n\nnext"
    pages = spark.createDataFrame([(1, text), (2, "Armor Class 1 Hit Points 2"), (3, None)], "page int, text string")
    assert rows(review.stat_blocks(pages), "page", "nth") == [(1, 0)]
    assert pages.where("page = 1").select(review.without_stat_blocks(F.col("text")).alias("t")).first().t == "Ghoul\n\n\nnext"
    assert review.with_provenance(pages, "b", "c").first().plane == "canon"
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "id string, source_kind string")
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y")], "src string, dst string, source_kind string")
    kept, links = review.golden_subset(nodes, edges, ("x",))
    assert rows(kept, "id") == [("a",), ("b",)] and rows(links, "src", "dst") == [("a", "b")]
    texts = spark.createDataFrame([(1, "Area K5 and k12")], "doc_id int, text string")
    assert rows(review.gazetteer_patterns(texts, spark.createDataFrame([("k", r"\bk[0-9]+")], "id string, pattern string"))) == [(1, "k", "K5"), (1, "k", "k12")]
