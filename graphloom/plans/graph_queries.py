"""Registered reads over the fixture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ontology
from graphloom.operators import graph
from graphloom.plans.fixtures import EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, edges, entities, table
from graphloom.plans.registry import query

LAYERS_SQL = ontology.LAYERS_SQL
START = "nation:7"


@query(f"""{GRAPH_SQL} SELECT id, name, entity_type, CASE WHEN starts_with(lower(name), 'part#1') THEN 0 ELSE 1 END AS prefix_rank
FROM entities WHERE contains(lower(name), '1') AND entity_type IN ('NPC', 'FACTION') ORDER BY prefix_rank, id LIMIT 50""".replace("part#1", "1"))
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.search(entities(spark, sf_dir), "1", ("NPC", "FACTION"), limit=50)
    return found.select("id", "name", "entity_type", "prefix_rank")


@query(f"{GRAPH_SQL} SELECT id, name FROM entities WHERE entity_type = 'LOCATION' ORDER BY name NULLS LAST, id LIMIT 20")
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("region", "nation")).where(F.col("entity_type") == "LOCATION")
    return nodes.orderBy(F.asc_nulls_last("name"), "id").limit(20).select("id", "name")


@query(f"""{GRAPH_SQL} SELECT 'node' AS part, entity_type AS label, count(*) AS n FROM entities GROUP BY entity_type
UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir).groupBy(F.col("entity_type").alias("label")).agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    rels = edges(spark, sf_dir).groupBy(F.col("rel_type").alias("label")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edge"))
    return nodes.unionByName(rels).select("part", "label", "n")


_SYM = """sym AS (SELECT src AS a, rel_type, dst AS b, src || '|' || rel_type || '|' || dst AS e FROM rel
UNION ALL SELECT dst, rel_type, src, src || '|' || rel_type || '|' || dst FROM rel WHERE src <> dst)"""
_HOPS = f"WITH {EDGES_SQL}, rel AS (SELECT * FROM edges WHERE rel_type IN ('LOCATED_IN', 'OWNS')), {_SYM}"
_ONE = f"SELECT DISTINCT '{START}' AS start, b AS id, rel_type AS path, 1 AS length FROM sym WHERE a = '{START}'"
_TWO = f"""SELECT DISTINCT '{START}', y.b, x.rel_type || '>' || y.rel_type, 2 FROM sym x JOIN sym y ON x.b = y.a AND x.e <> y.e WHERE x.a = '{START}'"""


@query(f"{_HOPS} {_ONE}")
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir, ("LOCATED_IN", "OWNS")), spark.createDataFrame([(START,)], "id string"), 1)


@query(f"{_HOPS} {_ONE} UNION ALL {_TWO}")
def neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir, ("LOCATED_IN", "OWNS")), spark.createDataFrame([(START,)], "id string"), 2)


@query(f"""{_HOPS} SELECT path, length, count(*) AS n FROM ({_ONE} UNION ALL {_TWO} UNION ALL
SELECT DISTINCT '{START}', z.b, x.rel_type || '>' || y.rel_type || '>' || z.rel_type, 3 FROM sym x JOIN sym y ON x.b = y.a AND x.e <> y.e
JOIN sym z ON y.b = z.a AND z.e <> x.e AND z.e <> y.e WHERE x.a = '{START}') GROUP BY path, length""")
def neighbors_3hop_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.neighbors(edges(spark, sf_dir, ("LOCATED_IN", "OWNS")), spark.createDataFrame([(START,)], "id string"), 3)
    return found.groupBy("path", "length").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL} SELECT DISTINCT x.src AS start, x.dst AS id, x.rel_type AS path, 1 AS length FROM edges x WHERE x.src IN ('customer:1', 'customer:2')
UNION ALL SELECT DISTINCT x.src, y.dst, x.rel_type || '>' || y.rel_type, 2 FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src IN ('customer:1', 'customer:2')""")
def neighbors_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([("customer:1",), ("customer:2",)], "id string")
    return graph.neighbors(edges(spark, sf_dir), starts, 2, directed=True)


@query(f"""{GRAPH_SQL}, rel AS (SELECT * FROM edges), {_SYM}, hit AS (SELECT id FROM entities WHERE kind = 'nation' AND contains(lower(name), 'a') ORDER BY CASE WHEN starts_with(lower(name), 'a') THEN 0 ELSE 1 END, id LIMIT 1)
SELECT DISTINCT start, path, length, count(DISTINCT id) AS n FROM (SELECT h.id AS start, x.b AS id, x.rel_type AS path, 1 AS length FROM hit h JOIN sym x ON x.a = h.id
UNION SELECT h.id, y.b, x.rel_type || '>' || y.rel_type, 2 FROM hit h JOIN sym x ON x.a = h.id JOIN sym y ON y.a = x.b AND x.e <> y.e) GROUP BY start, path, length""")
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = graph.search(entities(spark, sf_dir, ("nation",)), "a", limit=1).select("id")
    found = graph.neighbors(edges(spark, sf_dir), hit, 2)
    return found.groupBy("start", "path", F.col("length").cast("long").alias("length")).agg(F.countDistinct("id").alias("n"))


@query(f"""{GRAPH_SQL}, kept AS (SELECT id FROM entities WHERE kind IN ('nation', 'region', 'supplier') ORDER BY id LIMIT 60)
SELECT src, rel_type, dst FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced(entities(spark, sf_dir, ("nation", "region", "supplier")), edges(spark, sf_dir), 60)[1]


_TYPED = """typed AS (SELECT id, name, CASE WHEN key % 7 = 0 THEN NULL ELSE entity_type END AS entity_type, key FROM entities WHERE kind IN ('customer', 'supplier'))"""


@query(f"""WITH {ENTITIES_SQL}, {_TYPED} SELECT id, entity_type FROM typed t WHERE EXISTS (SELECT 1 FROM typed b WHERE b.id = t.id AND b.key % 3 = 1)
OR entity_type IS NULL OR NOT entity_type IN ('NPC')""")
def tenancy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = entities(spark, sf_dir, ("customer", "supplier")).withColumn("entity_type", F.when(F.col("key") % 7 != 0, F.col("entity_type")))
    belongs = typed.select("id", F.concat(F.lit("t"), (F.col("key") % 3).cast("string")).alias("tenant"))
    return graph.shared_or_owned(typed, belongs, "t1", ("NPC",)).select("id", "entity_type")


@query("""SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'seen ' || c_name ELSE c_name END AS name,
CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS segment, c_custkey % 2 = 0 AS patched FROM customer""")
def overlay_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), key.cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), key)
    patches = base.where(key % 2 == 0).select(F.col("id").alias("canon_id"), F.concat(F.lit("seen "), "name").alias("name"), F.when(key % 4 == 0, F.lit("X")).alias("segment"))
    return graph.overlay(base.drop("c_custkey"), patches, ("name", "segment")).select("id", "name", "segment", "patched")


@query("""SELECT 'customer:' || c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def campaign_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(key)


@query(f"""WITH {EDGES_SQL}, camp AS (SELECT src, dst, rel_type FROM edges WHERE rel_type = 'LOCATED_IN' AND src LIKE 'supplier:%' AND length(src) % 2 = 0)
SELECT src, rel_type, dst, 'canon' AS plane FROM edges e WHERE rel_type IN ('LOCATED_IN', 'OWNS') AND NOT EXISTS (SELECT 1 FROM camp c WHERE c.src = e.src AND c.rel_type = e.rel_type)
UNION ALL SELECT src, rel_type, 'moved', 'campaign' FROM camp""")
def shadow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    canon = edges(spark, sf_dir, ("LOCATED_IN", "OWNS"))
    campaign = canon.where((F.col("rel_type") == "LOCATED_IN") & F.startswith("src", F.lit("supplier:")) & (F.length("src") % 2 == 0)).select(
        F.concat(F.lit("own:"), "src").alias("src"), F.col("src").alias("source_canon_id"), "rel_type", F.lit("moved").alias("dst")
    )
    laid = graph.shadowed(canon, campaign, ("LOCATED_IN",))
    return laid.withColumn("src", F.regexp_replace("src", "^own:", ""))


_REVEAL = """n AS (SELECT id, CASE WHEN key % 5 = 0 THEN NULL ELSE key % 4 END AS revealed FROM entities WHERE kind IN ('nation', 'customer')),
r AS (SELECT src, dst, length(src) % 4 AS revealed FROM edges WHERE rel_type = 'LOCATED_IN' AND src LIKE 'customer:%')"""


@query(f"""{GRAPH_SQL}, {_REVEAL} SELECT r.src, r.dst FROM r JOIN n a ON a.id = r.src AND a.revealed <= 2 JOIN n b ON b.id = r.dst AND b.revealed <= 2 WHERE r.revealed <= 2""")
def reveal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("nation", "customer")).withColumn("revealed", F.when(F.col("key") % 5 != 0, F.col("key") % 4))
    told = edges(spark, sf_dir, ("LOCATED_IN",)).where(F.startswith("src", F.lit("customer:"))).withColumn("revealed", F.length("src") % 4)
    return graph.revealed(told, nodes, 2).select("src", "dst")


@query(f"""WITH {EDGES_SQL}, {LAYERS_SQL}, ends AS (SELECT src AS id, layer FROM edges JOIN layers USING (rel_type) UNION SELECT dst, layer FROM edges JOIN layers USING (rel_type))
SELECT id, string_agg(layer, ',' ORDER BY layer) AS layers, count(*) AS n_layers FROM ends GROUP BY id HAVING count(*) >= 2""")
def layer_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.layer_intersections(edges(spark, sf_dir), ontology.relation_types(spark), 2)
    return found.select("id", F.array_join("layers", ",").alias("layers"), F.col("n_layers").cast("long").alias("n_layers"))


@query(f"""WITH {EDGES_SQL} SELECT src AS id, dst AS other, rel_type, 'out' AS direction FROM edges WHERE src LIKE 'nation:%'
UNION SELECT dst, src, rel_type, 'in' FROM edges WHERE dst LIKE 'nation:%'""")
def edges_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = entities(spark, sf_dir, ("nation",)).select("id")
    return graph.both_directions(edges(spark, sf_dir, ("LOCATED_IN",)), ids)


@query(f"""WITH {EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS relations, count(*) AS n_edges
FROM edges WHERE rel_type IN ('LOCATED_IN', 'OWNS') GROUP BY 1, 2""")
def pair_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_folds(edges(spark, sf_dir, ("LOCATED_IN", "OWNS")))


@query(f"WITH {EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


@query(f"""WITH {EDGES_SQL} SELECT src AS start, dst AS id, 1 AS depth FROM edges WHERE rel_type = 'LOCATED_IN'
UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src AND b.rel_type = 'LOCATED_IN' WHERE a.rel_type = 'LOCATED_IN'""")
def place_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = edges(spark, sf_dir, ("LOCATED_IN",)).select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    return graph.ancestors(parents, parents.select("id"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS players FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def player_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("o_orderkey").alias("players"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(counts, "id", "left").select("id", F.coalesce("players", F.lit(0).cast("long")).alias("players"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders)
SELECT c_custkey AS id, count(o_orderkey) AS n, coalesce(min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END), min(o_orderkey)) AS active
FROM customer LEFT JOIN k ON o_custkey = c_custkey GROUP BY c_custkey""")
def optional_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player with an optional list of characters: the first active one, else the first."""
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("held"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("open"), F.min("o_orderkey").alias("first")
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return people.join(held, "id", "left").select("id", F.coalesce("held", F.lit(0).cast("long")).alias("n"), F.coalesce("open", "first").alias("active"))


@query("""SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY n_name""")
def attendees(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    came = table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi")
    counts = came.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return counts.join(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_name").alias("name"), "n")
