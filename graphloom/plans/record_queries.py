"""Registered queries of records, reviews, hand-written data, wiki pages, transcripts and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import authoring, publish, records, resolution, retrieval, review, transcripts, upserts, wiki
from graphloom.plans.fixtures import EDGES_SQL, edges, table
from graphloom.plans.registry import query
from graphloom.sources import corpora, seeds

# --- answers of a model, as JSON -------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer an order: two entities and a relation, with unknown types, empty names and broken JSON among them."""
    k = F.col("o_orderkey")
    first = F.struct(F.when(k % 4 == 0, "ghost").otherwise("npc").alias("type"), F.when(k % 5 != 0, F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"))).otherwise("").alias("text"), F.lit(None).cast("string").alias("canonical_name"))
    second = F.struct(F.lit("Location").alias("type"), F.col("o_orderpriority").alias("text"), F.lower("o_orderpriority").alias("canonical_name"))
    link = F.struct(F.when(k % 3 == 0, "located_in").otherwise("likes").alias("type"), F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("target"), F.repeat(F.lit("said "), 60).alias("evidence"))
    whole = F.to_json(F.struct(F.array(first, second).alias("entities"), F.array(link).alias("relationships")))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 11 == 0, "{broken").otherwise(whole).alias("json"))


@query("""SELECT o_orderkey AS doc_id, 'Clerk ' || o_custkey AS name, 'Clerk ' || o_custkey AS canonical, 'NPC' AS entity_type FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_orderpriority, lower(o_orderpriority), 'LOCATION' FROM orders WHERE o_orderkey % 11 <> 0""")
def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extracted_entities(_answers(spark, sf_dir), ("NPC", "LOCATION")).select("doc_id", "name", "canonical", "entity_type")


@query("SELECT o_orderkey AS doc_id, 'LOCATED_IN' AS rel_type, o_orderpriority AS target, 200 AS chars FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0")
def extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.extracted_relations(_answers(spark, sf_dir), ("LOCATED_IN",))
    return found.select("doc_id", "rel_type", "target", F.char_length("evidence").cast("long").alias("chars"))


@query("SELECT o_orderkey AS doc_id, 'Clerk ' || o_custkey AS source_id, o_orderpriority AS target_id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0")
def relation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    known = records.extracted_entities(answers, ("NPC", "LOCATION")).withColumn("id", F.col("name"))
    return records.endpoints(records.extracted_relations(answers, ("LOCATED_IN",)), known).select("doc_id", "source_id", "target_id")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no invented' END AS problem FROM orders""")
def checked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, "{oops").when(k % 5 == 1, "[1, 2]").when(k % 5 == 2, '{"from_canon": []}').when(k % 5 == 3, '```json\n{"from_canon": [], "invented": []}\n```').otherwise(' {"from_canon": 1, "invented": {"a": 2}} ')
    return records.validated(table(spark, sf_dir, "orders").select(k.alias("id"), body.alias("text"))).select("id", "problem")


@query("""WITH a AS (SELECT user_id % 9 AS batch, event_id % 40 AS n, arg_min(event_type, event_id) AS answer FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2), p AS (SELECT DISTINCT user_id % 9 AS batch, event_id % 50 AS n FROM events)
SELECT p.batch, p.n, CASE WHEN answer IS NULL THEN 'unanswered' WHEN answer = 'error' THEN 'none' WHEN answer IN ('click', 'view') THEN 'decided' ELSE 'off_vocabulary' END AS outcome FROM p LEFT JOIN a ON a.batch = p.batch AND a.n = p.n""")
def option_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "error", " None ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  ")))
    answers = e.where("event_id % 5 <> 0").select((F.col("user_id") % 9).alias("batch"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("n"), said.alias("answer"))
    pairs = e.select((F.col("user_id") % 9).alias("batch"), (F.col("event_id") % 50).alias("n")).distinct()
    options = pairs.select("batch", "n", F.explode(F.array(F.lit("click"), F.lit("View"))).alias("option"), F.lit("KNOWS").alias("rel_type"), F.lit("a").alias("source"), F.lit("b").alias("target"))
    return records.decided(answers, options).select("batch", "n", "outcome")


@query("""WITH e AS (SELECT s_suppkey AS k, s_name AS source, CASE WHEN s_suppkey % 6 = 0 THEN upper(s_name) ELSE 'x' END AS target, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NONE' WHEN 2 THEN 'OWNS' ELSE 'KNOWS' END AS new_rel, s_suppkey % 8 = 1 AS asked, s_suppkey % 3 = 0 AS flip FROM supplier)
SELECT k AS id, CASE WHEN new_rel IS NULL THEN 'failed' WHEN new_rel = 'NONE' AND lower(source) = lower(target) THEN 'self_loop' WHEN new_rel = 'NONE' AND asked THEN 'declined' WHEN new_rel = 'NONE' THEN 'no_relation_legal' WHEN new_rel <> 'KNOWS' THEN 'changed' WHEN NOT flip OR source = target THEN 'kept' ELSE 'flipped' END AS outcome FROM e""")
def reclassified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    new = F.when(k % 4 == 1, "NONE").when(k % 4 == 2, "OWNS").when(k % 4 == 3, "KNOWS")
    held = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("source"), F.when(k % 6 == 0, F.upper("s_name")).otherwise("x").alias("target"), F.lit("KNOWS").alias("rel_type"), new.alias("new_rel"), (k % 8 == 1).alias("asked"), (k % 3 == 0).alias("flip"))
    turned = held.withColumn("new_source", F.when(F.col("flip"), F.col("target")).otherwise(F.col("source"))).withColumn("new_target", F.when(F.col("flip"), F.col("source")).otherwise(F.col("target")))
    return records.reclassified(turned).select("id", "outcome")


# --- messages and profiles -------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderkey % 5 AS g, o_orderkey % 7 AS who, o_orderkey % 4 AS form, o_orderkey % 3 = 0 AS dm FROM orders), n AS (SELECT n_nationkey AS npc, n_regionkey AS g, 'Guard' || n_nationkey AS name FROM nation)
SELECT id AS message_id, npc AS npc_id, CASE WHEN dm AND form = 0 AND who = npc THEN 'dm_command' WHEN form = 1 AND who = npc THEN 'direct_mention' ELSE 'name_reference' END AS "trigger" FROM m JOIN n ON m.g = n.g WHERE who = npc AND form <> 3""")
def message_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("guard"), (k % 7).cast("string"))
    said = F.when(k % 4 == 0, F.concat(F.lit("/npc "), name, F.lit(" attacks"))).when(k % 4 == 1, "who are you").when(k % 4 == 2, F.concat(F.lit("I ask "), F.initcap(name), F.lit("'s friend"))).otherwise(F.concat(F.lit("x"), name, F.lit("y")))
    mentioned = F.when(k % 4 == 1, F.array((k % 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    messages = table(spark, sf_dir, "orders").select(k.alias("message_id"), (k % 5).cast("int").alias("guild"), said.alias("content"), (k % 3 == 0).alias("is_dm"), mentioned.alias("mentioned"))
    n = F.col("n_nationkey")
    npcs = table(spark, sf_dir, "nation").select(n.alias("npc_id"), F.col("n_regionkey").alias("guild"), F.concat(F.lit("Guard"), n.cast("string")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), n.cast("string").alias("app_id"))
    return records.triggers(messages, npcs)


@query("SELECT count(*) AS n, p_partkey % 3 AS form FROM part WHERE p_partkey % 3 <> 2 GROUP BY 2")
def items_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("Give me the "), F.upper("p_name"))).when(k % 3 == 1, F.concat(F.lit("one Potion of "), "p_name", F.lit(" please"))).otherwise("nothing")
    name = F.when(k % 3 == 1, F.concat(F.lit("Potion of "), "p_name")).otherwise(F.col("p_name"))
    held = table(spark, sf_dir, "part").where(records.item_mentioned(name, said))
    return held.groupBy((k % 3).alias("form")).agg(F.count("*").alias("n"))


def _profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    stats = F.when(k % 5 == 0, "{bad").otherwise(F.format_string('{"max_hit_points": %d, "armor_class": %d}', k % 90, F.lit(12)))
    person = F.when(k % 7 == 0, "no json").otherwise(F.format_string('{"combat_style": "%s", "retreat_threshold": 0.5}', F.when(k % 2 == 0, "Tactical").otherwise("odd")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), stats.alias("stat_block"), person.alias("personality"))


@query("""SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE c_custkey % 90 END AS INTEGER) AS max_hp, CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 12 END AS armor_class, 30 AS speed,
CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 'tactical' ELSE 'cowardly' END AS combat_style, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS retreat_threshold FROM customer""")
def npc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profiles(_profile_rows(spark, sf_dir), ("tactical", "berserker"), "cowardly")


@query("""SELECT c_custkey AS id, '{"max_hit_points":' || CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE c_custkey % 90 END || ',"armor_class":' || CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 12 END || ',"speed":30}' AS stat_block FROM customer""")
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.as_profile_json(records.profiles(_profile_rows(spark, sf_dir), ("tactical",), "cowardly")).select("id", "stat_block")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'price' END AS kept FROM supplier")
def allowed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    props = F.create_map(F.lit("owner"), F.col("s_name"), F.lit("price"), F.when(k % 2 == 0, "5"))
    kept = F.map_keys(records.allowed_fields(props, ("price", "quantity")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.get(kept, F.lit(0)).alias("kept"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'roll' WHEN 1 THEN 'roll_hidden' WHEN 2 THEN 'search' END AS tool FROM orders")
def first_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, " /Roll 2d6").when(k % 4 == 1, "/rollhidden 1d4").when(k % 4 == 2, "/find the inn").otherwise("roll /roll")
    return table(spark, sf_dir, "orders").select(k.alias("id"), records.first_command(said, (("/rollhidden", "roll_hidden"), ("/roll", "roll"), ("/find", "search"))).alias("tool"))


# --- review ----------------------------------------------------------------------------------------------------------


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("ch"), (k % 3).cast("string")).alias("chapter"), F.col("s_name").alias("source"), F.lit("OWNS").alias("rel_type"), F.concat(F.lit("place "), (k % 4).cast("string")).alias("target"), F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "proposed").alias("status"))


@query("SELECT s_name AS source, 'place ' || s_suppkey % 4 AS target FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 5 <> 0")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(_reviewed(spark, sf_dir), "ch1").select("source", "target")


@query("SELECT coalesce(CASE WHEN s_suppkey % 7 = 0 THEN 'rejected' END, CASE s_suppkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'proposed' END) AS status, count(*) AS n FROM supplier GROUP BY 1")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _reviewed(spark, sf_dir)
    key = F.split_part("source", F.lit("#"), F.lit(2)).cast("int")
    chosen = held.where(key % 7 == 0)
    decisions = chosen.select(F.upper("source").alias("source"), F.upper("target").alias("target"), "chapter", "rel_type", F.col("source").alias("decision_id"), F.lit("rejected").alias("new_status"), F.lit("me").alias("reviewer"), F.lit("2026-01-01").alias("date"))
    return review.decide(held, decisions)[0].groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS mention_id, CASE WHEN o_orderkey % 3 > 1 THEN o_orderpriority || ' x' || (o_orderkey % 3) ELSE o_orderpriority END AS display_name FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 > 1")
def mention_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    held = orders.select(k.alias("mention_id"), F.col("o_orderpriority").alias("section_id"), (k % 3).alias("occurrences"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("display_name"))
    return review.captions(held, orders.select(F.col("o_orderpriority").alias("section_id"), F.col("o_orderpriority").alias("heading")).distinct())


@query("SELECT conv_id, name, nth FROM (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, name) AS nth FROM (SELECT user_id AS conv_id, event_type AS name, max(event_id) AS turn FROM events GROUP BY 1, 2)) WHERE nth <= 4")
def recent_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id"), F.col("event_type").alias("name")).agg(F.max("event_id").alias("turn"))
    return review.recent_subjects(touched).select("conv_id", "name", "nth")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY coalesce(list_position(['BUILDING', 'MACHINERY'], c_mktsegment), 0), c_custkey) AS place FROM customer QUALIFY place <= 60")
def ranked_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    head = review.by_rank(rows, "kind", ("BUILDING", "MACHINERY")).limit(60)
    return retrieval.top(head.withColumn("all", F.lit(0)), ["all"], 60, F.coalesce(F.nullif(F.array_position(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("kind")), F.lit(0)), F.lit(0)), F.col("id")).select("id", F.col("rank").cast("long").alias("place"))


@query("SELECT doc_id, length(text) > 120 AS cut, md5(rtrim(substr(text, 1, 120), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", review.truncated(F.col("text"), 120).alias("t"))
    return held.select("doc_id", "t.cut", F.md5("t.text").alias("digest"))


@query("SELECT 'order:' || l_orderkey AS shop_id, 'part:' || l_partkey AS item_id, p_name AS name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey")
def shop_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = edges(spark, sf_dir, ("CONTAINS",))
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lit("ITEM").alias("entity_type"), F.col("p_retailprice").alias("price"), F.lit(1).alias("quantity"))
    return review.inventory(held.select(F.col("src").alias("id")).distinct(), held, items).select("shop_id", "item_id", "name")


@query("SELECT p_partkey AS page, count(*) AS blocks FROM part WHERE p_partkey % 3 <> 2 GROUP BY p_partkey")
def stat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    block = F.concat(F.lit("Armor Class 15\nHit Points "), k.cast("string"), F.lit(" and "), F.repeat(F.lit("claws "), 20))
    page = F.when(k % 3 == 0, F.concat(F.lit("The beast.\n"), block, F.lit("\n\nMore."))).when(k % 3 == 1, block).otherwise("Armor Class 1\nHit Points 2")
    return review.stat_blocks(table(spark, sf_dir, "part").select(k.alias("page"), page.alias("text"))).groupBy("page").agg(F.count("*").alias("blocks"))


@query("SELECT doc_id, 'book' AS book, 'one' AS chapter, 'canon' AS plane, CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'text' END AS chunk_type FROM documents")
def chunk_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "table").alias("chunk_type"))
    return review.with_provenance(chunks, "book", "one").select("doc_id", "book", "chapter", "plane", "chunk_type")


@query(f"WITH {EDGES_SQL}, k AS (SELECT src, dst FROM edges WHERE rel_type = 'LOCATED_IN' AND src LIKE 'nation:%') SELECT id FROM (SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region) WHERE id IN (SELECT src FROM k UNION SELECT dst FROM k) OR id LIKE 'nation:%'")
def golden_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = edges(spark, sf_dir, ("LOCATED_IN",)).withColumn("source_kind", F.split_part("src", F.lit(":"), F.lit(1)))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("source_kind"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("region").alias("source_kind"))
    return review.golden_subset(nation.union(region), held, ("nation",))[0].select("id")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)licen[sc]ed? [a-z]+')) + len(regexp_extract_all(text, '(?i)version [0-9.]+')) AS n FROM documents WHERE regexp_matches(text, '(?i)licen[sc]ed? [a-z]+') OR regexp_matches(text, '(?i)version [0-9.]+')")
def gazetteer_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([("a", "licen[sc]ed? [a-z]+"), ("b", "version [0-9.]+")], "id string, pattern string")
    return review.gazetteer_patterns(table(spark, sf_dir, "documents"), patterns, most=1).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- hand-written data -----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS question_id, (n_nationkey + 1) % 5 AS section_id FROM nation")
def rival_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note names its own section, which is gold, and the next one, which is a rival."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    word = F.element_at(F.array(*map(F.lit, ("Amber", "Birch", "Cedar", "Dogwood", "Elm"))), (F.col("k") + 1).cast("int"))
    heads = regions.select(F.col("r_regionkey").alias("section_id"), F.col("r_regionkey").alias("k")).select("section_id", F.concat(F.lit("of "), word).alias("heading"))
    named = heads.withColumnRenamed("section_id", "gold")
    k = F.col("n_nationkey")
    notes = nations.join(named.toDF("g", "own"), k % 5 == F.col("g")).join(named.toDF("h", "next"), (k + 1) % 5 == F.col("h"))
    asked = notes.select(k.alias("question_id"), F.lit("where is it").alias("question"), F.concat_ws(" and ", "own", "next").alias("note"), F.array(F.col("g")).alias("gold"))
    return authoring.rivals(asked, heads)


@query("SELECT s_suppkey AS id, 'npc_supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name_id, 'c' || s_nationkey || '_session_' || s_suppkey AS session_id FROM supplier")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    named = authoring.record_ids("npc", F.concat(F.lit("Supplier #"), F.lpad(k.cast("string"), 9, "0")))
    session = authoring.record_ids("session", F.lit(None), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), k)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), named.alias("name_id"), session.alias("session_id"))


@query("SELECT c_custkey AS id, coalesce(l, 1) AS level, coalesce(m, coalesce(l, 1) * 8) AS max_hp, coalesce(h, coalesce(m, coalesce(l, 1) * 8)) AS hp FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 20 AS INTEGER) END AS l, CASE WHEN c_custkey % 3 = 0 THEN 50 END AS m, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS h FROM customer)")
def default_hit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, (k % 20).cast("int")).alias("level"), F.when(k % 3 == 0, 50).alias("max_hp"), F.when(k % 5 == 0, 7).alias("hp"))
    return authoring.with_default_hp(rows)


@query("SELECT part, count(*) AS n FROM (SELECT 'node' AS part FROM nation UNION ALL SELECT 'edge' FROM nation) GROUP BY part")
def seed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed in YAML, written from the nations and read back; seeds are hand-written and small."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    body = "nodes:\n" + "".join(f"- {{name: 'Nation {r.n_nationkey}', type: LOCATION, aliases: ['n{r.n_nationkey}']}}\n" for r in rows)
    body += "edges:\n" + "".join(f"- {{source: 'Nation {r.n_nationkey}', type: CONNECTED_TO, target: 'Nation {(r.n_nationkey + 1) % len(rows)}'}}\n" for r in rows)
    nodes, links = seeds.seed(spark, {"world.yaml": body})
    return nodes.select(F.lit("node").alias("part")).union(links.select(F.lit("edge"))).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT k AS specialty, count(*) AS items FROM (SELECT 'general' AS k FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') UNION ALL SELECT 'arms' FROM part WHERE p_brand = 'Brand#12') GROUP BY k")
def shop_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    lists = {b: parts.where(F.col("p_brand") == b).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")) for b in ("Brand#11", "Brand#12")}
    return seeds.catalogue(lists, {"general": ("Brand#11", "Brand#12"), "arms": ("Brand#12",)}).groupBy("specialty").agg(F.count("*").alias("items"))


@query()
def generated_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by a hash: no SQL; a test holds that a shop has its number of different items of its own specialty."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("specialty"), F.col("p_size").cast("double").alias("weight"), F.col("p_retailprice").alias("price"))
    shops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shop_id"), F.concat(F.lit("Brand#1"), (1 + F.col("s_suppkey") % 5).cast("string")).alias("specialty"))
    return authoring.generated_stock(shops, parts, 8, "shop")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 9.5 ELSE s_acctbal END AS DOUBLE) AS gold, s_nationkey AS secret FROM supplier")
def shops_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    shops = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("gold"), F.col("s_nationkey").alias("secret"))
    fields = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("id") % 3 == 0, "new"), F.lit("gold"), F.when(F.col("id") % 2 == 0, "9.5"), F.lit("secret"), F.lit("99")), lambda k, v: v.isNotNull())
    return publish.changed(shops, shops.select("id", fields.alias("fields")), publish.SHOP_FIELDS)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), k AS (SELECT * FROM c WHERE o % 3 <> 0) SELECT 'shops' AS part, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'contains', count(*) FROM k UNION ALL SELECT 'items', count(*) FROM part WHERE p_partkey NOT IN (SELECT p FROM c) OR p_partkey IN (SELECT p FROM k)""")
def shops_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("k"))
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    left = publish.without_shops(shops, edges(spark, sf_dir, ("CONTAINS",)), items, shops.where("k % 3 = 0").select("id"))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in zip(("shops", "contains", "items"), left)]
    return rows[0].union(rows[1]).union(rows[2])


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT conv_id, lower(role) FROM conversations)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' INTERSECT SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')) AS edges""")
def transcript_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where(F.col("role").isNotNull())
    found = said.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")).alias("name"), F.lit("NPC").alias("entity_type"))
    links = said.select(F.col("conv_id").alias("doc_id"), F.lit("User").alias("source"), F.lit("KNOWS").alias("rel_type"), F.lit("Assistant").alias("target"), F.lit("said").alias("evidence"))
    nodes, made = publish.written_transcript(found, links)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(made.agg(F.count("*").alias("edges")))


# --- wiki, transcripts, text -----------------------------------------------------------------------------------------


def _infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation "), n).alias("title"), F.concat(F.lit("{{Infobox place\n| allies = [[Nation "), n, F.lit("0|N]], '''Bold'''\n| empty = \n| foes = {{x|y}}*Orc "), n, F.lit("\n}} text")).alias("content"))


@query("SELECT 'Nation ' || n_nationkey AS title, 'place' AS kind, f AS field, i AS item FROM nation, (VALUES ('ally', 'N'), ('ally', 'Bold'), ('foe', NULL)) v(f, i0), LATERAL (SELECT coalesce(i0, 'Orc ' || n_nationkey) AS i)")
def infobox_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.entries(_infoboxes(spark, sf_dir), {"allies": "ally", "foes": "foe", "empty": "none"})


@query("SELECT 'Nation ' || n_nationkey AS source, 'HOSTILE_TO' AS rel_type, 'Orc ' || n_nationkey AS target FROM nation")
def infobox_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.relations(wiki.entries(_infoboxes(spark, sf_dir), {"allies": "ally", "foes": "foe"}), {"foe": "HOSTILE_TO"})


@query("""WITH w AS (SELECT user_id AS a, event_id AS s, event_type AS sp FROM events), c AS (SELECT *, CASE WHEN sp = lag(sp) OVER (PARTITION BY a ORDER BY s) THEN 0 ELSE 1 END AS cut FROM w), r AS (SELECT *, sum(cut) OVER (PARTITION BY a ORDER BY s) AS run FROM c)
SELECT a AS audio_id, CAST(run AS BIGINT) AS run, min(sp) AS speaker, min(s) AS start, max(s) + 1 AS "end", string_agg('w' || s % 10, ' ' ORDER BY s) AS text FROM r GROUP BY a, run""")
def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("audio_id"), k.alias("seq"), F.col("event_type").alias("speaker"), k.alias("start"), (k + 1).alias("end"), F.concat(F.lit("w"), (k % 10).cast("string")).alias("word"), F.lit(0.5).alias("confidence"))
    return transcripts.segments_of_words(words).select("audio_id", "run", "speaker", "start", "end", "text")


@query("SELECT user_id AS audio_id, event_type AS speaker, count(*) AS segments, count(*) * 2.0 AS seconds FROM events GROUP BY 1, 2")
def speaker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("audio_id"), F.col("event_type").alias("speaker"), k.alias("start"), (k + 2).alias("end"), F.col("event_type").alias("text"))
    return transcripts.speaker_samples(rows).select("audio_id", "speaker", "segments", F.col("seconds").cast("double").alias("seconds"))


@query("SELECT conv_id AS transcript_id, count(*) AS segments, count(DISTINCT role) AS speakers FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id")
def json_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    held = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    texts = held.select("transcript_id", F.when(F.col("transcript_id") % 2 == 0, F.to_json("turns")).otherwise(F.to_json(F.struct("turns"))).alias("content"))
    return transcripts.parse_json(texts).groupBy("transcript_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"))


@query(r"SELECT item_id, replace(replace(trim(regexp_replace(text, '[^a-zA-Z0-9 ()+-]', '', 'g')), '+', '\+'), '-', '\-') AS q FROM (SELECT item_id, 'a+b-' || item_id AS text FROM benchmark)")
def lucene_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.lucene_query(F.array(F.concat(F.lit("a+b-"), F.col("item_id").cast("string")))).alias("q"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '(?m)^ ?[0-9]+ ?$', '', 'g'), '\n{3,}', E'\n\n', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(text.cleaned(F.col("text"))).alias("digest"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.title_case(F.lower("p_name")).alias("title"))


@query("SELECT o_orderkey AS id, printf('%02d:%02d:%02d', o_orderkey // 3600, (o_orderkey // 60) % 60, o_orderkey % 60) AS clock FROM orders")
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.clock(k + 0.5).alias("clock"))


@query(r"SELECT doc_id, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}''’_]+')), ['the', 'license', 'eau'])) AS n FROM documents WHERE text IS NOT NULL")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "license", "eau", "the")))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.terms_present(F.col("text"), terms).cast("long").alias("n"))


# --- resolution, ranks, writes ---------------------------------------------------------------------------------------


@query("SELECT 'n' || (n_nationkey % 30) AS surface, CASE WHEN n_nationkey % 3 = 0 THEN 0 WHEN n_nationkey % 3 = 1 THEN 1 ELSE 2 END AS tier FROM nation")
def lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.lit("n"), k.cast("string"))
    entries = table(spark, sf_dir, "nation").select(F.when(k % 3 == 0, name).when(k % 3 == 1, F.upper(name)).otherwise(F.concat(F.lit("other "), name)).alias("canonical"), F.array(F.when(k % 3 == 2, F.upper(name)).otherwise("none")).alias("aliases"))
    return resolution.lookup_tiers(table(spark, sf_dir, "nation").select(name.alias("surface")), entries).select("surface", "tier")


@query("SELECT count(CASE WHEN n > 0 THEN 1 END) / count(*) AS loose, count(CASE WHEN n = 1 THEN 1 END) / count(*) AS unambiguous FROM (SELECT s_suppkey % 4 AS n FROM supplier)")
def graded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.recall(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("hits")))


@query("""WITH m AS (SELECT conv_id % 10 AS q, conv_id AS section, sum(turn + 1) AS occ, count(DISTINCT role) AS ents, max(turn % 3) AS terms FROM conversations GROUP BY 1, 2)
SELECT q AS query_id, section, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY occ + 3 * terms DESC, ents DESC, section) AS rank FROM m) WHERE rank <= 5""")
def ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("query_id"), F.lit("c").alias("chapter"), F.col("conv_id").alias("section"), F.col("role").alias("entity_id"), (F.col("turn") + 1).alias("occurrences"), (F.col("turn") % 3).alias("terms"))
    return retrieval.passages(hits, 5).select("query_id", "section", "rank")


@query()
def spans_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over spans in order: no SQL; a test holds it against its definition."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (k * 3).alias("start"), (k * 3 + k % 400).alias("end"), (k % 7 / 7).alias("confidence"))
    return resolution.without_overlaps(rows)


@query()
def extraction_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer and tagger rows of conversations, resolved, joined with a model's answers, linked and cut by confidence."""
    named = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{3,})"), F.lit(1))
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 100_000).alias("at"), F.posexplode(named).alias("nth", "name"))
    span = words.select("doc_id", "name", F.lit("NPC").alias("entity_type"), F.when(F.col("nth") % 3 == 0, 0.9).otherwise(0.4).alias("confidence"), F.when(F.col("nth") % 3 == 0, "gazetteer").otherwise("spacy").alias("source"), (F.col("at") + F.col("nth") * 10).alias("start"), (F.col("at") + F.col("nth") * 10 + 5).alias("end"))
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), F.lit("Strange Newcomer").alias("name"), F.lit("NPC").alias("entity_type"), F.lit(0.8).alias("confidence")).distinct()
    known = spark.createDataFrame([("kb:1", "Strange Newcomer", "NPC", ["Stranger"])], "id string, name string, entity_type string, aliases array<string>")
    return resolution.extracted(span.where("source = 'gazetteer'"), span.where("source = 'spacy'"), said, known)


@query("SELECT count(*) AS n FROM nation")
def sound_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return upserts.require_endpoints(nations.select(F.col("n_regionkey").alias("region_id")), "region_id", regions.select(F.col("r_regionkey").alias("id"))).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'A,B' ELSE 'A' END AS labels, CASE WHEN s_suppkey % 4 = 0 THEN 'SITE' WHEN s_suppkey % 3 = 0 THEN 'AREA' END AS rung, s_suppkey % 5 = 0 OR s_suppkey % 8 = 0 AS is_artifact FROM supplier""")
def label_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    held = table(spark, sf_dir, "supplier").select(k.alias("id"), F.array(F.lit("A")).alias("labels"), F.when(k % 3 == 0, "AREA").alias("rung"), F.when(k % 5 == 0, True).alias("is_artifact"))
    new = held.where("id % 2 = 0").select("id", F.array(F.lit("B"), F.lit("A")).alias("labels"), F.when(F.col("id") % 4 == 0, "SITE").alias("rung"), (F.col("id") % 8 == 0).alias("is_artifact"))
    return upserts.label_union(held, new).select("id", F.array_join("labels", ",").alias("labels"), "rung", "is_artifact")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE 0 END AS n FROM customer")
def upserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("n"))
    return upserts.upsert(base, base.where("id % 3 = 0").select("id", (F.col("id") + 1).alias("n")), "id")


# --- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT digest, min(page) AS page, count(*) - 1 AS duplicates FROM (SELECT sha256(html) AS digest, page_id AS page FROM pages) GROUP BY digest")
def distinct_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.distinct_images(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").cast("binary").alias("content")))


@query("""SELECT n_regionkey AS digest, max(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END) AS best FROM nation GROUP BY 1""")
def best_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest transcription of each image; every fourth failed and does not count."""
    k = F.col("n_nationkey")
    cache = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("digest"), F.when(k % 4 != 0, F.concat(F.lit("# Page\n"), F.repeat(F.lit("x"), k))).alias("text"))
    found = corpora.best_transcripts(cache, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("digest")))
    return found.select("digest", (F.char_length("text") - 7).cast("int").alias("best"))


@query("SELECT source, count(*) AS chunks FROM documents WHERE source IS DISTINCT FROM 'src1' GROUP BY source")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.source_counts(corpora.without_source(table(spark, sf_dir, "documents"), "src1"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS content FROM documents")
def chunks_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("content"), F.lit(1).alias("page"), F.col("doc_id"))
    new = chunks.where("doc_id % 3 = 0").select("chunk_id", F.lit("new").alias("content"), F.lit(2).alias("page"), "doc_id")
    older = new.withColumn("page", F.lit(1)).withColumn("content", F.lit("old"))
    return corpora.upsert_chunks(chunks, new.union(older)).select("chunk_id", "content")


@query("SELECT n_regionkey AS region, 'Title ' || n_nationkey AS title, 'title-' || n_nationkey AS slug FROM nation")
def contents_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 1000 + F.col("n_nationkey") + 1).alias("position"), F.concat(F.lit("* [Title "), F.col("n_nationkey").cast("string"), F.lit("](x)")).alias("line"))
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 1000).alias("position"), F.concat(F.lit("### "), F.col("r_regionkey").cast("string")).alias("line"))
    return corpora.contents_table(n.union(r)).select(F.col("group").cast("int").alias("region"), "title", "slug")


@query("SELECT 'N' || n_nationkey AS title, n_nationkey % 3 <> 0 AS \"exists\", CASE WHEN n_nationkey % 3 <> 0 THEN 'text ' || n_nationkey END AS content FROM nation")
def wiki_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    page = F.concat(F.lit('{"title": "n'), k, F.lit('"'), F.when(F.col("n_nationkey") % 3 == 0, ', "missing": true}').otherwise(F.concat(F.lit(', "revisions": [{"slots": {"main": {"content": "text '), k, F.lit('"}}}]}'))))
    value = F.concat(F.lit('{"query": {"normalized": [{"from": "N'), k, F.lit('", "to": "n'), k, F.lit('"}], "pages": ['), page, F.lit("]}}"))
    return corpora.wiki_pages(table(spark, sf_dir, "nation").select(value.alias("value")))


@query("SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM supplier) AS edges, (SELECT count(*) FROM region) AS log")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk files and a query log, written to the shared folder and read back."""
    import uuid

    from graphloom.operators.plan import shared_folder

    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("LOCATION").alias("entity_type"))
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"), F.lit("LOCATED_IN").alias("rel_type"))
    corpora.export_graph(nodes, links, folder)
    corpora.append_log(table(spark, sf_dir, "region"), f"{folder}/log")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    read = lambda part: spark.read.option("header", True).csv(f"{folder}/{part}")
    return count(read("nodes"), "nodes").crossJoin(count(read("edges"), "edges")).crossJoin(count(spark.read.json(f"{folder}/log"), "log"))


@query("""SELECT 'entity' AS part, 'GHOST' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0 UNION ALL SELECT 'relation', 'LIKES', count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejected(_answers(spark, sf_dir), ("NPC", "LOCATION"), ("LOCATED_IN",))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN '{"name":"' || o_orderpriority || '","votes":' || o_orderkey % 9 || '}' END AS json FROM orders""")
def declared_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = F.to_json(F.struct(F.col("o_orderpriority").alias("name"), (k % 9).alias("votes"), F.lit("x").alias("unknown")))
    found = records.declared_only(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 11 == 0, F.lit(None)).otherwise(given).alias("json")), "name string, votes int")
    return found


@query("""SELECT 'r' || n_regionkey AS book, n_nationkey AS chapter_index, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'part' ELSE 'part-' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) END AS slug FROM nation""")
def unique_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators import sections

    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("book"), F.col("n_nationkey").alias("chapter_index"), F.lit("part").alias("slug"))
    return sections.disambiguated(rows)
