"""Registered filters, projections and small aggregations over the fixture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ontology
from graphloom.operators import publish, views
from graphloom.plans.document_queries import NAMES, _scan
from graphloom.plans.fixtures import EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, edges, entities, table
from graphloom.plans.registry import query

_IDS = ("nation:3", "region:1", "part:7", "none:0")
_NAMED = "names(n) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + r"), m AS (SELECT lower(n) AS e, doc_id, count(*) AS k FROM (SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS w FROM documents) JOIN names ON w = n GROUP BY 1, 2)"


@query(f"{GRAPH_SQL} SELECT id, name FROM entities WHERE id IN {_IDS}")
def nodes_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.by_id(entities(spark, sf_dir), spark.createDataFrame([(i,) for i in _IDS], "id string")).select("id", "name")


def _npcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), F.when(key % 5 != 0, F.lower("c_mktsegment")).alias("description"), F.when(key % 10 == 9, "PC").otherwise("NPC").alias("entity_type"),
        F.when(F.col("c_nationkey") % 3 == 0, "hostile").when(F.col("c_nationkey") % 3 == 1, "friendly").alias("disposition"), F.when(key % 2 == 0, "{}").alias("stat_block"), (key % 7 != 0).alias("active"),
        F.array(F.concat(F.lit("g"), (key % 4).cast("string")), F.concat(F.lit("g"), ((key + 2) % 4).cast("string"))).alias("guilds"),
    )


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 9 AND (contains(lower(c_name), 'build') OR (c_custkey % 5 <> 0 AND contains(lower(c_mktsegment), 'build')))
AND c_nationkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 4 IN (0, 2)""")
def npc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.found_npcs(_npcs(spark, sf_dir), "BUILD", hostile=True, with_stats=True, active=True, guild="g2").select("id")


@query("SELECT c_custkey AS id, c_name AS name, c_custkey % 7 <> 0 AS active FROM customer")
def tenant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.as_tenant_rows(_npcs(spark, sf_dir).select("id", "name", "active", F.col("id").alias("canon_id")))


@query("SELECT event_type, count(*) AS n FROM events WHERE value / 100 >= 0.5 GROUP BY event_type")
def confident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.confident(table(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 100)).groupBy("event_type").agg(F.count("*").alias("n"))


_STATUS_SQL = "s AS (SELECT src, rel_type, dst, CASE WHEN length(dst) % 3 = 0 THEN 'accepted' WHEN length(src) % 2 = 0 THEN 'proposed' END AS status FROM edges WHERE rel_type IN ('LOCATED_IN', 'OWNS'))"


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.length("dst") % 3 == 0, "accepted").when(F.length("src") % 2 == 0, "proposed")
    return edges(spark, sf_dir, ("LOCATED_IN", "OWNS")).withColumn("status", status)


@query(f"WITH {EDGES_SQL}, {_STATUS_SQL} SELECT coalesce(status, '') = 'accepted' AS accepted, count(*) AS n FROM s GROUP BY 1")
def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rest = views.split_by_status(_with_status(spark, sf_dir))
    return accepted.withColumn("accepted", F.lit(True)).union(rest.withColumn("accepted", F.lit(False))).groupBy("accepted").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL}, {_STATUS_SQL} SELECT rel_type, count(*) AS n FROM s WHERE status = 'accepted' GROUP BY rel_type")
def accepted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_proposed(_with_status(spark, sf_dir), False).groupBy("rel_type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL}, {_STATUS_SQL} SELECT rel_type, count(*) AS n, bool_or(coalesce(status, '') = 'accepted') AS accepted FROM s GROUP BY rel_type")
def relation_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relations_in_use(_with_status(spark, sf_dir))


@query(f"{GRAPH_SQL} SELECT DISTINCT entity_type AS label FROM entities UNION SELECT DISTINCT upper(kind) FROM entities")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.labels_in_use(entities(spark, sf_dir).withColumn("labels", F.array("entity_type", F.upper("kind"))))


@query("SELECT layer, string_agg(rel_type, ',' ORDER BY rel_type) AS relations FROM layers GROUP BY layer".join((f"WITH {ontology.LAYERS_SQL} ", "")))
def layer_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.layer_vocabulary(ontology.relation_types(spark))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.messages_with(table(spark, sf_dir, "conversations"), "THE").select("conv_id", "turn")


@query(f"""WITH {EDGES_SQL}, {_STATUS_SQL}, b AS (SELECT src AS id, dst AS other, rel_type, 'out' AS direction, status FROM s UNION ALL SELECT dst, src, rel_type, 'in', status FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(status, '') = 'accepted' DESC, other, rel_type, direction) AS nth, count(*) OVER (PARTITION BY id) AS c FROM b)
SELECT id, other, nth, greatest(c - 6, 0) AS cut FROM n WHERE nth <= 6""")
def expanded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_status(spark, sf_dir)
    both = s.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type", F.lit("out").alias("direction"), "status").union(s.select("dst", "src", "rel_type", F.lit("in"), "status"))
    return views.expanded(both, 6).select("id", "other", "nth", "cut")


@query(f"""WITH {ENTITIES_SQL}, {EDGES_SQL}, n AS (SELECT id, kind = 'nation' AND key % 2 = 0 AS canon, CASE WHEN kind IN ('nation', 'supplier') THEN key % 3 END AS tenant FROM entities)
SELECT src, rel_type, dst FROM edges JOIN n a ON a.id = src AND a.tenant = 1 JOIN n b ON b.id = dst AND (b.tenant = 1 OR b.canon) WHERE rel_type = 'LOCATED_IN'""")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir).withColumn("plane", F.when((F.col("kind") == "nation") & (F.col("key") % 2 == 0), "canon").otherwise("campaign"))
    belongs = nodes.where(F.col("kind").isin("nation", "supplier")).select("id", (F.col("key") % 3).cast("string").alias("tenant"))
    return views.without_leaks(edges(spark, sf_dir, ("LOCATED_IN",)), nodes, belongs, "1")


@query(f"WITH {_NAMED} SELECT DISTINCT e AS entity_id FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE d.lang = 'fr'")
def section_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    french = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("section_id"))
    return views.entities_in_sections(_scan(spark, sf_dir), french)


@query(f"WITH {_NAMED} SELECT id, section_id, nth, cut FROM (SELECT e AS id, doc_id AS section_id, row_number() OVER (PARTITION BY e ORDER BY k DESC, doc_id) AS nth, greatest(count(*) OVER (PARTITION BY e) - 4, 0) AS cut FROM m) WHERE nth <= 4")
def loudest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _scan(spark, sf_dir).groupBy(F.col("entity_id").alias("id"), "section_id").agg(F.count("*").alias("occurrences"))
    return views.loudest(counted, 4).select("id", "section_id", "nth", "cut")


@query("""WITH e AS (SELECT n_nationkey AS a, n_regionkey AS b, CASE WHEN n_nationkey % 3 = 0 THEN 'ALLIED_WITH' WHEN n_nationkey % 3 = 1 THEN 'HOSTILE_TO' ELSE 'KNOWS' END AS r FROM nation), x AS (SELECT a AS id, b AS o, r FROM e UNION SELECT b, a, r FROM e),
y AS (SELECT DISTINCT x.id, r, n_name AS name FROM x JOIN nation ON n_nationkey = o WHERE r <> 'KNOWS')
SELECT id, coalesce(string_agg(DISTINCT CASE WHEN r = 'ALLIED_WITH' THEN name END, ',' ORDER BY CASE WHEN r = 'ALLIED_WITH' THEN name END), '') AS allies, coalesce(string_agg(DISTINCT CASE WHEN r = 'HOSTILE_TO' THEN name END, ',' ORDER BY CASE WHEN r = 'HOSTILE_TO' THEN name END), '') AS foes FROM y GROUP BY id""")
def allies_and_foes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    rel = F.when(key % 3 == 0, "ALLIED_WITH").when(key % 3 == 1, "HOSTILE_TO").otherwise("KNOWS")
    return views.allies_and_foes(nations.select(key.alias("src"), F.col("n_regionkey").alias("dst"), rel.alias("rel_type")), nations.select(key.alias("id"), F.col("n_name").alias("name")))


@query("SELECT p_type AS entity_type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.type_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("entity_type")))


@query("SELECT user_id AS session, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, round(sum(floor(value) / 1024), 6) AS cost, bool_or(event_type = 'error') AS unverified FROM events GROUP BY user_id")
def running_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor("value").cast("long")
    return views.running_cost(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), tokens.alias("tokens"), (tokens / 1024).alias("cost"), (F.col("event_type") == "error").alias("unverified")))


@query("""WITH e AS (SELECT user_id % 20 AS query_id, user_id AS id, round(value, 3) AS score FROM events UNION ALL SELECT o_custkey % 20, o_custkey, round(o_totalprice / 1000, 3) FROM orders),
b AS (SELECT query_id, id, max(score) AS score FROM e GROUP BY query_id, id) SELECT query_id, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM b) WHERE nth <= 10""")
def merged_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("query_id"), F.col("user_id").alias("id"), F.round("value", 3).alias("score"))
    two = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_custkey").alias("id"), F.round(F.col("o_totalprice") / 1000, 3).alias("score"))
    return views.merged_ranks([one, two], 10).select("query_id", "id", "nth")


@query(f"WITH {EDGES_SQL} SELECT src, rel_type, dst FROM edges WHERE rel_type = 'LOCATED_IN' AND NOT (src LIKE 'supplier:%' AND length(src) % 2 = 0)")
def edges_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = edges(spark, sf_dir, ("LOCATED_IN",))
    return publish.without_edges(held, held.where(F.startswith("src", F.lit("supplier:")) & (F.length("src") % 2 == 0)))


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM edges WHERE NOT (rel_type = 'LOCATED_IN' AND length(src) % 3 = 0) GROUP BY rel_type")
def placements_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.length("src") % 3 == 0, "structural").when(F.length("src") % 3 == 1, "said so")
    return publish.without_derived_placements(edges(spark, sf_dir).withColumn("evidence", evidence)).groupBy("rel_type").agg(F.count("*").alias("n"))


@query(f"""WITH names(n) AS (VALUES {", ".join(f"('{n}')" for n in NAMES)}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT DISTINCT doc_id, line, lower(n) AS e FROM (SELECT doc_id, line, unnest(string_split_regex(line, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM l) JOIN names ON w = n)
SELECT x.e AS entity_id, count(DISTINCT y.e) AS partners, count(DISTINCT x.doc_id) AS sections FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.line = y.line AND x.e <> y.e GROUP BY 1""")
def line_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.explode(F.split("text", "\n")).alias("line"))
    words = F.array_intersect(F.array_distinct(F.split("line", r"[^\p{L}\p{N}]+")), F.array(*map(F.lit, NAMES)))
    held = lines.select("section_id", F.transform(words, lambda w: F.lower(w)).alias("names")).where(F.size("names") > 1)
    pairs = held.select("section_id", F.explode("names").alias("a"), "names").select("section_id", "a", F.explode("names").alias("b")).where("a <> b")
    return views.partners(pairs)


@query(f"WITH {EDGES_SQL}, e AS (SELECT * FROM edges WHERE rel_type = 'LOCATED_IN' AND (src IN {_IDS} OR dst IN {_IDS})) SELECT 'edge' AS part, count(*) AS n FROM e UNION ALL SELECT 'node', count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e UNION SELECT unnest({list(_IDS)}))")
def highlighted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, near = views.highlighted(edges(spark, sf_dir, ("LOCATED_IN",)), spark.createDataFrame([(i,) for i in _IDS], "id string"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(near, "edge").union(count(nodes, "node"))


@query("SELECT 'c' || c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'invented' FROM supplier")
def tenant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("invented").alias("note"))
    return views.with_invented(shared, made)


@query(f"WITH {_NAMED} SELECT e AS entity_id, doc_id AS section_id, k AS occurrences, upper(e[1]) || e[2:] AS names FROM m")
def mention_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([(n.lower(), n) for n in NAMES], "entity_id string, name string")
    return views.mention_uses(_scan(spark, sf_dir), aliases).select("entity_id", "section_id", "occurrences", "names")


@query("""WITH r AS (SELECT o_orderkey AS q, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 1.0 / (o_orderkey % 4) END AS rr, o_orderpriority AS needs FROM orders)
SELECT needs, count(*) AS questions, count(CASE WHEN rr > 0 THEN 1 END) AS hits, round(avg(CAST(rr AS DOUBLE)), 6) AS mrr FROM r GROUP BY needs""")
def recall_by_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rr = F.when(k % 4 == 0, 0.0).otherwise(1.0 / F.greatest(k % 4, F.lit(1)))
    orders = table(spark, sf_dir, "orders")
    return views.recall_by(orders.select(k.alias("query_id"), rr.alias("rr")), orders.select(k.alias("query_id"), F.col("o_orderpriority").alias("needs")), "needs")


@query("SELECT 'kb:' || source || '#' || doc_id AS section_id, 'e' || lang || '@kb:' || source || '#' || doc_id AS mention_id FROM documents")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.functions import text

    section = text.section_id(F.col("source"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(section.alias("section_id"), text.mention_id(F.concat(F.lit("e"), "lang"), section).alias("mention_id"))


@query("SELECT event_id AS id, printf('[%02d:%02d:%02d] ', event_id // 3600, (event_id // 60) % 60, event_id % 60) || event_type || ': ' || props AS line FROM events")
def diarised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.functions import text

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.diarised_line(F.col("event_id"), F.col("event_type"), F.col("props")).alias("line"))
