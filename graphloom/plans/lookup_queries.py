"""Registered lookups: names, passages, contexts, bounded and staged lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import lookup, mentions
from graphloom.plans.document_queries import NAMES, _scan
from graphloom.plans.fixtures import EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, edges, entities, table
from graphloom.plans.registry import query

_M = "names(n) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + r"""), m AS (SELECT lower(n) AS e, doc_id, count(*) AS k FROM
(SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS w FROM documents) JOIN names ON w = n GROUP BY 1, 2)"""
_IDS = ("license", "apache", "die")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(_scan(spark, sf_dir))


def _ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i,) for i in _IDS], "id string")


@query(f"""WITH {ENTITIES_SQL}, a AS (SELECT id, name FROM entities WHERE kind IN ('nation', 'region', 'supplier')) SELECT upper(b.name) AS surface, a.id, a.name FROM a JOIN (SELECT DISTINCT name FROM a WHERE id LIKE 'nation:%') b ON lower(a.name) = lower(b.name)""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("nation", "region", "supplier"))
    aliases = nodes.select("name", F.col("id").alias("entity_id"))
    asked = nodes.where(F.col("kind") == "nation").select(F.upper("name").alias("surface"))
    return lookup.resolve(asked, aliases, nodes)


@query("""WITH a AS (SELECT p_type AS e, p_name AS name FROM part UNION ALL SELECT p_type, lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey % 700 = 0)
SELECT e AS entity_id, count(*) AS n FROM a WHERE e NOT IN (SELECT e FROM a WHERE NOT contains(name, ' ') AND name = lower(name)) GROUP BY e""")
def anchorable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    short = parts.where("p_partkey % 700 = 0").select(F.col("p_type").alias("entity_id"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    aliases = parts.select(F.col("p_type").alias("entity_id"), F.col("p_name").alias("name")).unionByName(short)
    return lookup.anchorable(aliases).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT e AS id, d.doc_id AS section_id, d.source AS chapter, d.doc_id AS index, k AS occurrences FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE e IN {_IDS}")
def entity_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.col("source").alias("chapter"), F.col("doc_id").alias("index"))
    return lookup.passages(_ids(spark), _mentions(spark, sf_dir), sections)


@query(f"""WITH {_M} SELECT x.e AS id, x.doc_id AS section_id, coalesce(string_agg(y.e, ',' ORDER BY y.e), '') AS others FROM m x LEFT JOIN m y ON y.doc_id = x.doc_id AND y.e <> x.e WHERE x.e IN {_IDS} GROUP BY 1, 2""")
def describing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.described_with(_ids(spark), _mentions(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, n AS (SELECT dst AS id, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) AS nth, count(*) OVER (PARTITION BY dst) AS c FROM edges WHERE rel_type = 'LOCATED_IN')
SELECT id, other, nth, greatest(c - 5, 0) AS cut FROM n WHERE nth <= 5""")
def bounded_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = edges(spark, sf_dir, ("LOCATED_IN",)).select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return lookup.bounded(near, ["id"], 5, F.col("other")).select("id", "other", "nth", "cut")


@query("""WITH q(query_id, w) AS (VALUES (1, '1'), (2, '22'), (3, 'zz')), s AS (SELECT query_id, s_suppkey AS id, 0 AS stage, s_suppkey AS pos FROM q JOIN supplier ON ends_with(s_name, w)
UNION ALL SELECT query_id, s_suppkey, 1, s_suppkey FROM q JOIN supplier ON contains(s_name, w)), b AS (SELECT query_id, id, min(stage) AS stage FROM s GROUP BY query_id, id)
SELECT query_id, id, stage, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, id) AS nth FROM b) WHERE nth <= 8""")
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("at"))
    words = F.explode(F.array(*(F.struct(F.lit(i).alias("query_id"), F.lit(w).alias("w")) for i, w in ((1, "1"), (2, "22"), (3, "zz")))))
    asked = shops.select("id", "name", "at", words.alias("q")).select("id", "name", "at", "q.*")
    ends, holds = asked.where(F.endswith("name", F.col("w"))), asked.where(F.contains("name", F.col("w")))
    return lookup.staged_fill([ends, holds], 8)


@query("""WITH a AS (SELECT n_name AS surface, CASE WHEN n_nationkey % 3 = 0 THEN 'LIKES' WHEN n_nationkey % 3 = 1 THEN 'OWNS' END AS rel_type, CASE WHEN n_nationkey % 4 = 0 THEN 'zz' ELSE 'src' || (n_nationkey % 5) END AS chapter FROM nation UNION ALL SELECT 'Nobody', 'OWNS', 'src1')
SELECT surface, rel_type, chapter, CASE WHEN rel_type = 'LIKES' THEN 'no_such_relationship' WHEN chapter NOT IN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) THEN 'chapter_not_extracted' WHEN surface = 'Nobody' THEN 'name_not_in_graph' END AS reason FROM a""")
def lookup_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    asked = nations.select(
        F.col("n_name").alias("surface"), F.when(key % 3 == 0, "LIKES").when(key % 3 == 1, "OWNS").alias("rel_type"), F.when(key % 4 == 0, "zz").otherwise(F.concat(F.lit("src"), (key % 5).cast("string"))).alias("chapter")
    ).union(spark.createDataFrame([("Nobody", "OWNS", "src1")], "surface string, rel_type string, chapter string"))
    rels = edges(spark, sf_dir, ("LOCATED_IN", "OWNS")).select("rel_type").distinct()
    return lookup.diagnosed(asked, rels, table(spark, sf_dir, "documents").select(F.col("source").alias("chapter")), nations.select(F.col("n_name").alias("name")))


@query("""SELECT conv_id AS query_id, string_agg('[' || n || '] ' || role, chr(10) ORDER BY n) AS context FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lookup.bounded(table(spark, sf_dir, "conversations"), ["conv_id"], 1 << 30, F.col("turn"))
    return lookup.rendered(ranked.select(F.col("conv_id").alias("query_id"), F.col("nth").alias("rank"), F.col("role").alias("text")))


@query(f"""{GRAPH_SQL}, h AS (SELECT id FROM entities WHERE kind IN ('nation', 'region') AND key % 2 = 0)
SELECT CASE WHEN a.id IS NOT NULL THEN src WHEN b.id IS NOT NULL THEN dst END AS owner, CASE WHEN a.id IS NOT NULL THEN 'out' WHEN b.id IS NOT NULL THEN 'in' ELSE 'orphan' END AS direction, rel_type, 'proposed' AS status, count(*) AS n
FROM edges LEFT JOIN h a ON a.id = src LEFT JOIN h b ON b.id = dst WHERE rel_type = 'LOCATED_IN' GROUP BY 1, 2, 3""")
def owned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = entities(spark, sf_dir, ("nation", "region")).where("key % 2 = 0").select("id")
    return lookup.owned(edges(spark, sf_dir, ("LOCATED_IN",)).withColumn("status", F.lit(None).cast("string")), held)


@query(f"""{GRAPH_SQL}, k AS (SELECT DISTINCT lower(name) AS k FROM entities WHERE kind IN ('nation', 'region')) SELECT a.name AS source, b.name AS target FROM edges e JOIN entities a ON a.id = e.src JOIN entities b ON b.id = e.dst
WHERE rel_type = 'LOCATED_IN' AND lower(a.name) IN (SELECT k FROM k) AND lower(b.name) IN (SELECT k FROM k)""")
def preview_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("region", "nation", "customer", "supplier"))
    names = nodes.select("id", "name")
    links = edges(spark, sf_dir, ("LOCATED_IN",)).join(names.toDF("src", "source"), "src").join(names.toDF("dst", "target"), "dst").select("source", "target")
    seen = nodes.where(F.col("kind").isin("region", "nation")).select("name", F.col("key").alias("seq"))
    return lookup.preview(seen, links)[1]


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'ar') ORDER BY coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size / 50.0 END, 0.5) DESC, p_partkey LIMIT 40""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50.0).alias("importance"))
    by_name = lookup.keyword_search(nodes.withColumn("kind", F.when(F.contains(F.lower("kind"), F.lit("ar")), "a")), "a", ("name", "kind"), 40)
    return by_name.select("id", "name")


@query("SELECT source AS chapter, count(*) AS sections, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS longest FROM documents GROUP BY source")
def section_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.section_census(table(spark, sf_dir, "documents").withColumnRenamed("source", "chapter"))
    return found.withColumn("longest", F.col("longest").cast("long"))


@query("""SELECT rung, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'REGION' WHEN n_nationkey % 2 = 0 THEN 'AREA' WHEN n_nationkey = 7 THEN 'SETTLEMENT' END AS rung FROM nation) GROUP BY rung""")
def location_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    place = F.when(key == 7, F.upper("n_name")).otherwise("zz")
    found = lookup.rung(F.when(key % 5 == 0, "REGION"), F.when(key % 2 == 0, "K1"), place, F.col("n_name"), F.lit("LOCATION"))
    return table(spark, sf_dir, "nation").groupBy(found.alias("rung")).agg(F.count("*").alias("n"))
