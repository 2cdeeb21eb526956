"""Registered queries of the candidate-to-graph pipeline and of writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ontology, text
from graphloom.operators import candidates, graph, upserts
from graphloom.operators.plan import shared_folder
from graphloom.plans.fixtures import EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, edges, entities, table
from graphloom.plans.registry import query
from graphloom.sources import paged

_SAMPLES_SQL = "s AS (SELECT event_type || ':' || CAST(user_id % 10 AS VARCHAR) AS name, user_id % 7 AS sample_id, event_id AS seq, value FROM events)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string")).alias("name"), (F.col("user_id") % 7).alias("sample_id"), F.col("event_id").alias("seq"), "value"
    )


@query(f"WITH {_SAMPLES_SQL} SELECT name, count(DISTINCT sample_id) AS votes, arg_min(value, seq) AS value FROM s GROUP BY name HAVING count(DISTINCT sample_id) >= 7")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.consensus(_samples(spark, sf_dir), ["name"], ["value"], 7)


@query(f"WITH {_SAMPLES_SQL} SELECT votes, count(*) AS n FROM (SELECT name, count(DISTINCT sample_id) AS votes FROM s GROUP BY name) GROUP BY votes")
def vote_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.vote_histogram(_samples(spark, sf_dir), ["name"])


def _rule(rel: str, side: int, column: str) -> str:
    words = ", ".join(f"'{w}'" for w in ontology.ALLOWED[rel][side])
    return f"WHEN '{rel}' THEN coalesce({column}, '') IN ({words}) OR {column} IS NULL"


def _fits_sql(side: int, column: str) -> str:
    return "CASE rel_type " + " ".join(_rule(r, side, column) for r in ontology.ALLOWED) + " ELSE true END"


@query(f"""{GRAPH_SQL}, t AS (SELECT e.rel_type, {_fits_sql(0, 'a.entity_type')} AS s, {_fits_sql(1, 'b.entity_type')} AS d, {_fits_sql(0, 'b.entity_type')} AND {_fits_sql(1, 'a.entity_type')} AS turned
FROM edges e LEFT JOIN entities a ON a.id = e.src LEFT JOIN entities b ON b.id = e.dst)
SELECT rel_type, CASE WHEN NOT s AND NOT d THEN 'both' WHEN NOT s THEN 'domain' ELSE 'range' END AS reason, turned AS reversal_would_pass, count(*) AS n FROM t WHERE NOT s OR NOT d GROUP BY 1, 2, 3""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = entities(spark, sf_dir).select("id", "entity_type")
    found = candidates.constraint_report(edges(spark, sf_dir), types, ontology.relation_types(spark))
    return found.groupBy("rel_type", "reason", "reversal_would_pass").agg(F.count("*").alias("n"))


_RIVALS_SQL = """r AS (SELECT src, rel_type, dst, CASE WHEN length(src) % 2 = 0 THEN 'accepted' END AS status FROM edges WHERE rel_type = 'LOCATED_IN'
UNION ALL SELECT src, 'CONTAINS', dst, CASE WHEN length(dst) % 2 = 0 THEN 'accepted' ELSE 'proposed' END FROM edges WHERE rel_type = 'LOCATED_IN' AND src LIKE 'customer:%')"""


def _rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = edges(spark, sf_dir, ("LOCATED_IN",))
    first = base.withColumn("status", F.when(F.length("src") % 2 == 0, "accepted"))
    second = base.where(F.startswith("src", F.lit("customer:"))).withColumn("rel_type", F.lit("CONTAINS")).withColumn("status", F.when(F.length("dst") % 2 == 0, "accepted").otherwise("proposed"))
    return first.unionByName(second)


@query(f"WITH {EDGES_SQL}, {_RIVALS_SQL} SELECT a.src, a.dst, 'CONTAINS' AS first, 'LOCATED_IN' AS second FROM r a JOIN r b ON a.src = b.src AND a.dst = b.dst WHERE a.rel_type = 'CONTAINS' AND b.rel_type = 'LOCATED_IN'")
def exclusive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.exclusive_conflicts(_rivals(spark, sf_dir), ontology.EXCLUSIVE)


@query(f"""WITH {EDGES_SQL}, {_RIVALS_SQL}, g AS (SELECT src, dst, count(DISTINCT rel_type) AS n, sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) AS a FROM r GROUP BY src, dst)
SELECT rel_type, CASE WHEN n > 1 AND (coalesce(status, 'proposed') <> 'accepted' OR a > 1) THEN 'conflicted' ELSE coalesce(status, 'proposed') END AS status, count(*) AS n FROM r JOIN g USING (src, dst) GROUP BY 1, 2""")
def conflict_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = candidates.marked_conflicts(_rivals(spark, sf_dir), ontology.EXCLUSIVE)
    return marked.groupBy("rel_type", "status").agg(F.count("*").alias("n"))


_PLAN_SQL = """p AS (SELECT 'part:' || p_partkey AS id, p_name AS name, regexp_replace(trim(lower(p_type || p_brand)), '^the ', '') AS folded FROM part),
best AS (SELECT folded, arg_min(id, (-length(name), id)) AS survivor FROM p GROUP BY folded HAVING count(*) > 1),
plan AS (SELECT id AS loser, survivor FROM p JOIN best USING (folded) WHERE id <> survivor)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat("p_type", "p_brand").alias("kind"))
    return candidates.merge_plan(parts, text.duplicate_key(F.col("kind")))


@query(f"WITH {_PLAN_SQL} SELECT loser, survivor FROM plan")
def duplicate_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"""WITH {EDGES_SQL}, {_PLAN_SQL} SELECT DISTINCT src, rel_type, coalesce(survivor, dst) AS dst FROM edges LEFT JOIN plan ON dst = loser WHERE rel_type = 'SERVES'""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.repoint(edges(spark, sf_dir, ("SERVES",)), _plan(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, c AS (SELECT src, rel_type, dst, CASE WHEN src = dst THEN 'self_loop' WHEN rel_type = 'SERVES' THEN 'constraint' WHEN length(dst) % 3 = 0 THEN 'gazetteer' WHEN length(src) % 5 = 0 THEN 'endpoint' END AS r FROM edges)
SELECT coalesce(r, 'written') AS outcome, count(*) AS n FROM c GROUP BY 1""")
def drop_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [
        ("self_loop", F.col("src") == F.col("dst")), ("constraint", F.col("rel_type") == "SERVES"),
        ("gazetteer", F.length("dst") % 3 == 0), ("endpoint", F.length("src") % 5 == 0),
    ]
    return candidates.accounting(candidates.staged_drops(edges(spark, sf_dir), stages))


@query(f"""WITH {ENTITIES_SQL}, {EDGES_SQL}, {_RIVALS_SQL}, t AS (SELECT src AS id FROM r WHERE status = 'accepted' UNION SELECT dst FROM r WHERE status = 'accepted')
SELECT e.id, CASE WHEN e.key % 10 = 0 OR t.id IS NOT NULL THEN 'accepted' ELSE 'proposed' END AS status FROM entities e LEFT JOIN t ON t.id = e.id WHERE kind IN ('nation', 'customer', 'supplier', 'region')""")
def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("nation", "customer", "supplier", "region")).select("id", F.when(F.col("key") % 10 == 0, F.lit("K1")).alias("key"))
    return candidates.node_status(nodes, _rivals(spark, sf_dir)).select("id", "status")


@query(f"""WITH {ENTITIES_SQL}, pairs AS (SELECT a.id AS a, b.id AS b, a.entity_type AS a_type, b.entity_type AS b_type FROM entities a JOIN entities b ON a.kind = 'customer' AND b.kind = 'supplier' AND a.key = b.key),
rules(rel_type, dom, ran) AS (VALUES {", ".join("('%s', '%s', '%s')" % (r, *map(" ".join, v)) for r, v in ontology.ALLOWED.items())}),
o AS (SELECT a, b, rel_type, 'out' AS direction FROM pairs, rules WHERE list_contains(string_split(dom, ' '), a_type) AND list_contains(string_split(ran, ' '), b_type)
UNION ALL SELECT a, b, rel_type, 'in' FROM pairs, rules WHERE list_contains(string_split(dom, ' '), b_type) AND list_contains(string_split(ran, ' '), a_type)) SELECT * FROM o""")
def legal_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = entities(spark, sf_dir, ("customer",)).select(F.col("id").alias("a"), F.col("entity_type").alias("a_type"), "key")
    right = entities(spark, sf_dir, ("supplier",)).select(F.col("id").alias("b"), F.col("entity_type").alias("b_type"), "key")
    return candidates.legal_options(left.join(right, "key"), ontology.relation_types(spark))


@query("""WITH c AS (SELECT c_custkey + 500 AS id, 'new ' || c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(b.c_custkey, c.id) AS id, coalesce(c.name, b.c_name) AS name, coalesce(c.balance, b.c_acctbal) AS balance FROM customer b FULL OUTER JOIN c ON b.c_custkey = c.id""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changes = base.where(F.col("id") % 2 == 0).select((F.col("id") + 500).alias("id"), F.concat(F.lit("new "), "name").alias("name"), F.when(F.col("id") % 3 != 0, F.col("balance")).alias("balance"))
    return upserts.upsert(base, changes, "id")


@query(f"""{GRAPH_SQL}, gone AS (SELECT id FROM entities WHERE kind = 'customer' AND key % 10 = 0) SELECT src, rel_type, dst FROM edges WHERE rel_type IN ('LOCATED_IN', 'OWNS') AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir, ("customer", "nation"))
    gone = nodes.where((F.col("kind") == "customer") & (F.col("key") % 10 == 0))
    return upserts.detach_delete(nodes, edges(spark, sf_dir, ("LOCATED_IN", "OWNS")), gone)[1]


@query("""SELECT s_suppkey AS entity_id, s_name AS name FROM supplier EXCEPT SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 2 = 0""")
def alias_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), "s_nationkey")
    return upserts.missing_aliases(wanted.where("s_nationkey % 2 = 0").drop("s_nationkey"), wanted)


@query(f"""WITH {EDGES_SQL}, owners AS (SELECT DISTINCT dst AS id, src AS chapter FROM edges WHERE rel_type = 'OWNS') SELECT id FROM (SELECT id, count(DISTINCT chapter) AS n, max(chapter) AS c FROM owners GROUP BY id) WHERE n = 1 AND c = 'customer:7'""")
def chapter_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = edges(spark, sf_dir, ("OWNS",)).select(F.col("dst").alias("id"), F.col("src").alias("chapter"))
    return upserts.sole_owned(owners, "customer:7")


@query("""WITH a AS (SELECT p_brand AS name, p_type AS layer FROM part) SELECT lower(name) AS name, count(DISTINCT layer) AS n_layers FROM a GROUP BY 1 HAVING count(DISTINCT layer) >= 2""")
def quest_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.anchored(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("layer")))
    return found.select("name", F.size("layers").cast("long").alias("n_layers"))


@query(f"""WITH {EDGES_SQL} SELECT src, rel_type, dst, CASE rel_type WHEN 'SERVES' THEN 'social' WHEN 'OWNS' THEN 'social' ELSE 'spatial' END AS layer FROM edges WHERE rel_type IN ('LOCATED_IN', 'OWNS') AND (src NOT LIKE 'order:%')""")
def add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, nodes = edges(spark, sf_dir, ("LOCATED_IN",)), entities(spark, sf_dir)
    new = edges(spark, sf_dir, ("OWNS",)).unionByName(spark.createDataFrame([("customer:-1", "OWNS", "order:1")], "src string, rel_type string, dst string"))
    return upserts.add_edges(base, new, nodes, ontology.relation_types(spark))


@query("""SELECT 'part:' || arg_min(p_partkey, (-p_retailprice, p_partkey)) AS id, p_brand AS name FROM part GROUP BY p_brand""")
def best_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node a name: the record of the highest rank, the earliest among equals."""
    first = graph.first_by(table(spark, sf_dir, "part"), ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey"))
    return first.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("name"))


@query("SELECT doc_id AS chapter, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, greatest(1, CAST(ceil(length(coalesce(text, '')) / 2000.0) AS INTEGER)) AS slices, sha256(coalesce(text, '')) AS digest FROM documents")
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as a paged reader's responses of 2000 characters, in two deliveries, and read back whole by the data source."""
    folder, docs = f"{shared_folder(spark)}/paged-{uuid.uuid4().hex}", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), "text")
    late = F.pmod(F.xxhash64("chapter"), F.lit(4)) == 0
    for delivery, part in ((1, docs.where(~late)), (2, docs.where(late))):
        paged.write(paged.sliced(part, 2000), folder, delivery)
    spark.dataSource.register(paged.PagedResponses)
    read = spark.read.format("paged_responses").load(folder)
    return read.select(F.col("chapter").cast("long").alias("chapter"), F.char_length("text").cast("long").alias("n_chars"), "slices", F.sha2("text", 256).alias("digest"))
