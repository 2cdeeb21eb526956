"""Registered queries of forests: sizes, containment, enclosing places and structure, over a deep tree of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import forest, sections
from graphloom.plans.fixtures import table
from graphloom.plans.registry import query

_TREE_SQL = """tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > p_partkey % 7 + 1 THEN p_partkey - p_partkey % 7 - 1 END AS parent FROM part),
up AS (SELECT id, parent AS above, 1 AS depth FROM tree WHERE parent IS NOT NULL UNION ALL SELECT up.id, t.parent, depth + 1 FROM up JOIN tree t ON up.above = t.id WHERE t.parent IS NOT NULL)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent): a part lies in one of the seven before it; chains are as long as a share of the table."""
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > k % 7 + 1, k - k % 7 - 1).alias("parent"))


@query(f"""WITH RECURSIVE {_TREE_SQL} SELECT t.id, coalesce(r.root, t.id) AS root, coalesce(n.n, 0) AS inside FROM tree t
LEFT JOIN (SELECT id, arg_max(above, depth) AS root FROM up GROUP BY id) r ON t.id = r.id LEFT JOIN (SELECT above AS id, count(*) AS n FROM up GROUP BY above) n ON t.id = n.id""")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie within each: half of the steps between its own."""
    return forest.labels(_tree(spark, sf_dir)).select("id", "root", ((F.col("high") - F.col("low") - 1) / 2).cast("long").alias("inside"))


@query(f"""WITH RECURSIVE {_TREE_SQL}, l AS (SELECT l_orderkey, l_partkey, min(l_partkey) OVER (PARTITION BY l_orderkey) AS least FROM lineitem)
SELECT l_orderkey, count(up.id) AS within, count(*) AS lines FROM l LEFT JOIN up ON l_partkey = up.id AND least = up.above GROUP BY l_orderkey""")
def orders_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose part lies within the order's first part, by a comparison of labels."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("inner"))
    least = lines.groupBy("l_orderkey").agg(F.min("inner").alias("outer"))
    marked = forest.labelled(lines.join(least, "l_orderkey"), forest.labels(_tree(spark, sf_dir)), "outer", "inner")
    return marked.groupBy("l_orderkey").agg(F.count(F.when(forest.inside("outer", "inner"), 1)).alias("within"), F.count("*").alias("lines"))


@query(f"""WITH RECURSIVE {_TREE_SQL} SELECT t.id AS section, min(near.place) AS place FROM tree t LEFT JOIN (SELECT up.id, arg_min(p_type, depth) AS place FROM up JOIN part ON up.above = p_partkey AND p_size % 5 = 0 GROUP BY up.id) near ON t.id = near.id GROUP BY t.id""")
def enclosing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest enclosing part that names a place; a title is its place but for the chapter's number."""
    title = F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(": "), F.col("p_type"))
    held = table(spark, sf_dir, "part").select(F.lit("c").alias("chapter"), F.col("p_partkey").cast("long").alias("section"), F.when(F.col("p_size") % 5 == 0, sections.place_of_title(title)).alias("place"))
    links = _tree(spark, sf_dir).select(F.lit("c").alias("chapter"), F.col("id").alias("section"), F.coalesce("parent", F.lit(-1)).alias("parent"))
    return sections.ancestor_places(held, links).select("section", "place")


@query("""WITH s AS (SELECT p_partkey // 50 AS chapter, p_partkey AS section, p_size % 4 AS depth, CASE WHEN p_partkey % 3 = 0 THEN 'e' || (p_partkey // 6) || CASE WHEN p_partkey % 6 = 3 THEN 'b' ELSE '' END END AS key,
CASE WHEN p_partkey % 6 = 3 THEN 'e' || (p_partkey // 6) END AS stem FROM part),
d AS (SELECT a.chapter, a.section, max(b.section) AS by_depth FROM s a JOIN s b ON a.chapter = b.chapter AND b.section < a.section AND b.depth BETWEEN 1 AND a.depth - 1 WHERE a.depth > 1 GROUP BY 1, 2),
k AS (SELECT a.chapter, a.section, min(b.section) AS by_key FROM s a JOIN s b ON a.chapter = b.chapter AND a.stem = b.key GROUP BY 1, 2)
SELECT s.chapter, s.section, key, coalesce(by_depth, by_key, -1) AS container, CASE WHEN by_depth IS NOT NULL THEN 'depth' WHEN by_key IS NOT NULL THEN 'key' ELSE 'chapter' END AS how
FROM s LEFT JOIN d ON s.chapter = d.chapter AND s.section = d.section LEFT JOIN k ON s.chapter = k.chapter AND s.section = k.section WHERE key IS NOT NULL AND coalesce(by_depth, by_key, -1) <> s.section""")
def structure_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds each keyed section: its parent by depth, the area of its key, else the chapter."""
    k = F.col("p_partkey").cast("long")
    key = F.when(k % 3 == 0, F.concat(F.lit("e"), F.floor(k / 6).cast("string"), F.when(k % 6 == 3, "b").otherwise("")))
    held = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("chapter"), k.alias("section"), (F.col("p_size") % 4).cast("int").alias("depth"), key.alias("key"))
    return sections.containment(held, sections.parents(held))
