"""Registered queries of records of play, answer checks, seeds and chapter plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ontology
from graphloom.operators import authoring
from graphloom.plans import chapter
from graphloom.plans.fixtures import GRAPH_SQL, edges, entities, table
from graphloom.plans.registry import query

#: The types and relations of the vocabulary.
_TYPES = sorted({t for ends in ontology.ALLOWED.values() for types in ends for t in types})
_RELATIONS = sorted(r for rs in ontology.LAYERS.values() for r in rs)
_listed = lambda names: ", ".join(f"'{n}'" for n in names)


@query("""WITH a AS (SELECT user_id % 40 AS question_id, event_id AS run, event_type AS text FROM events), c AS (SELECT *, contains(text, 'e') AND NOT contains(text, 'u') AS passed FROM a)
SELECT question_id, count(*) AS runs, count(CASE WHEN passed THEN 1 END) AS passes, bool_and(passed) AS every, bool_or(passed) AS "any" FROM c GROUP BY question_id""")
def answer_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("question_id"), F.col("event_id").alias("run"), F.col("event_type").alias("text"), F.array(F.lit("E")).alias("must"), F.array(F.lit("u")).alias("must_not"))
    return authoring.pass_rates(authoring.checked_answers(made))


@query("SELECT l_suppkey AS shop_id, count(*) AS items, round(sum(p_retailprice * CAST(l_quantity AS INTEGER)), 2) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
def shop_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return authoring.shop_values(stock.select(F.col("l_suppkey").alias("shop_id"), F.col("p_retailprice").alias("price"), F.col("l_quantity").cast("int").alias("quantity")))


@query("""SELECT leaves, count(*) AS n FROM (SELECT c_acctbal / 10000 <= 0.25 AND c_mktsegment <> 'BUILDING' AND (c_mktsegment = 'MACHINERY' OR c_nationkey <= 1) AS leaves FROM customer) GROUP BY leaves""")
def retreats(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("c_mktsegment") == "BUILDING", "berserker").when(F.col("c_mktsegment") == "MACHINERY", "cowardly").otherwise("tactical")
    leaves = authoring.retreats(F.col("c_acctbal"), F.lit(10000.0), F.lit(0.25), style, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").groupBy(leaves.alias("leaves")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT s_suppkey AS id, s_suppkey % 17 AS x, s_suppkey % 13 AS y, s_suppkey % 11 AS tx, s_suppkey % 7 AS ty FROM supplier), d AS (SELECT *, greatest(abs(tx - x), abs(ty - y)) AS away FROM p),
s AS (SELECT *, greatest(0, least(6, away - 1)) AS steps FROM d) SELECT id, CAST(x + sign(tx - x) * least(abs(tx - x), steps) AS INTEGER) AS x, CAST(y + sign(ty - y) * least(abs(ty - y), steps) AS INTEGER) AS y FROM s""")
def grid_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    moved = authoring.stepped(key % 17, key % 13, key % 11, key % 7, F.lit(30), F.lit(1))
    return table(spark, sf_dir, "supplier").select(key.alias("id"), moved.alias("p")).select("id", "p.x", "p.y")


@query()
def seeded_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_size").cast("double").alias("weight"))
    return authoring.seeded_choice(items, ["kind"], 10, "stock")


@query("""WITH n AS (SELECT p_type AS entity_type, lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1, 2) SELECT name AS subject, 'name claimed twice' AS problem FROM n WHERE n > 1 GROUP BY name""")
def seed_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    links = edges(spark, sf_dir, ("LOCATED_IN",)).where(F.lit(False))
    return authoring.seed_problems(nodes, links, nodes.select("entity_type"), ontology.relation_types(spark))


@query(f"""{GRAPH_SQL}, e AS (SELECT src, rel_type, dst, src || ' ' || rel_type || ' ' || dst AS subject FROM edges)
SELECT id AS subject, 'doubled id' AS problem FROM entities GROUP BY id HAVING count(*) > 1
UNION SELECT lower(name), 'name claimed twice' FROM entities GROUP BY entity_type, lower(name) HAVING count(DISTINCT id) > 1
UNION SELECT id, 'unknown type' FROM entities WHERE entity_type IS NULL OR entity_type NOT IN ({_listed(_TYPES)})
UNION SELECT subject, 'unknown relation' FROM e WHERE rel_type NOT IN ({_listed(_RELATIONS)})
UNION SELECT subject, 'self-loop' FROM e WHERE src = dst
UNION SELECT subject, 'missing end' FROM e WHERE src NOT IN (SELECT id FROM entities) OR dst NOT IN (SELECT id FROM entities)""")
def graph_seed_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a seed over the whole graph, against the types and relations of the vocabulary."""
    types = spark.createDataFrame([(t,) for t in _TYPES], "entity_type string")
    return authoring.seed_problems(entities(spark, sf_dir), edges(spark, sf_dir), types, ontology.relation_types(spark))


@query("""WITH n AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) SELECT 'node' AS part, 'written' AS outcome, count(DISTINCT lower(name)) AS n FROM n
UNION ALL SELECT 'edge', 'written', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)""")
def chapter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities(spark, sf_dir, ("region", "nation", "supplier"))
    names = found.select("id", "name")
    nodes = found.select("name", "entity_type", F.lit(None).cast("string").alias("key"), F.lit(1).alias("votes"), F.col("key").alias("seq"))
    links = edges(spark, sf_dir, ("LOCATED_IN",)).where(~F.startswith("src", F.lit("customer:")))
    named = links.join(names.toDF("src", "source"), "src").join(names.toDF("dst", "target"), "dst").select("source", "rel_type", "target", F.lit("accepted").alias("status"))
    return chapter.write_plan(nodes, named, ontology.relation_types(spark), found.select("name"), "fixture").account.select("part", "outcome", "n")
