"""Registered queries of question planning, transcripts, sections and entity matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import planner, resolution, sections, transcripts
from graphloom.plans.fixtures import table
from graphloom.plans.registry import query
from graphloom.sources import corpora


def _count(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words) or "0"


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_SCORES = ", ".join(f"CAST(({_count(p)}) * {w} AS DOUBLE) AS {k}" for k, (w, p) in planner.PHRASES.items() if k not in ("npc_generation", "entity_info"))
_NPC = planner.PHRASES["npc_generation"][1]


_ASKED = ("how does the rule of", "where is now", "what happened last time with", "create an encounter with", "tell me about", "make a merchant npc for", "describe the current location of")


@query(rf"""WITH q AS (SELECT conv_id, turn, lower(['{"', '".join(_ASKED)}'][CAST(1 + (conv_id + turn) % {len(_ASKED)} AS INTEGER)] || ' ' || text) AS t FROM conversations WHERE text IS NOT NULL), s AS (SELECT conv_id, turn, {_SCORES},
CAST(({_count(_NPC)}) * 1.5 + CASE WHEN {_any(planner.MAKING)} AND {_any(_NPC)} AND NOT {_any(planner.FIGHTING)} THEN 2.5 ELSE 0 END AS DOUBLE) AS npc_generation,
CASE WHEN regexp_matches(t, '(tell me about|what is|who is|describe)\s+\w+') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS entity_info FROM q),
b AS (SELECT *, greatest({", ".join(planner.PHRASES)}) AS best FROM s)
SELECT CASE WHEN best < 0.5 THEN 'unknown' {" ".join(f"WHEN {k} = best THEN '{k}'" for k in planner.PHRASES)} END AS query_type,
round(CASE WHEN best < 0.5 THEN CAST(0.3 AS DOUBLE) ELSE least(CAST(1.0 AS DOUBLE), best / CAST(3.0 AS DOUBLE)) END, 6) AS confidence, count(*) AS n FROM b GROUP BY 1, 2""")
def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under seven ways of asking, so that every class is met."""
    lead = F.element_at(F.array(*map(F.lit, _ASKED)), (1 + (F.col("conv_id") + F.col("turn")) % len(_ASKED)).cast("int"))
    asked = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).withColumn("text", F.concat(lead, F.lit(" "), "text"))
    found = planner.classified(asked)
    return found.groupBy("query_type", F.round("confidence", 6).alias("confidence")).agg(F.count("*").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in planner.STOP_WORDS)


@query(rf"""SELECT item_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM
(SELECT item_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM (SELECT item_id, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+') AS ws FROM benchmark))
WHERE regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ({_STOP})) WHERE n <= 10 GROUP BY item_id""")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", planner.keywords(F.col("text")).alias("k")).where(F.size("k") > 0)
    return found.select("item_id", F.array_join("k", " ").alias("keywords"))


@query("""SELECT conv_id AS transcript_id, count(*) AS segments, count(DISTINCT lower(role)) AS speakers FROM (SELECT conv_id, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations) WHERE x <> '' GROUP BY conv_id""".replace("\\\\", "\\"))
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as ``Speaker: text`` lines and parsed again."""
    line = F.concat("role", F.lit(": "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    written = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    texts = written.select("transcript_id", F.array_join(F.transform("t", lambda x: x.line), "\n").alias("content"))
    found = transcripts.parse_lines(texts)
    return found.groupBy("transcript_id").agg(F.count("*").alias("segments"), F.countDistinct(F.lower("speaker")).alias("speakers"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown: every third line, whole, is a heading whose depth follows its number."""
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i % 9 / 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x)
    marked = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("chapter"), marked.alias("text"))


@query()
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _chapters(spark, sf_dir)
    spanned = sections.spans(sections.headings(chapters), chapters)
    cut = sections.split(chapters, sections.area_depth(sections.depth_table(spanned)), spanned)
    return cut.join(sections.parents(cut), ["chapter", "section"]).select("chapter", "section", "depth", "parent", F.length("body").alias("chars"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, CAST(floor(((i - 1) % 9) / 3) + 1 AS BIGINT) AS depth, x AS t FROM (SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS i FROM l) WHERE (i - 1) % 3 = 0)
SELECT depth, count(*) AS headings FROM h WHERE t <> '' AND NOT starts_with(t, '#') GROUP BY depth""")
def heading_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.headings(_chapters(spark, sf_dir))
    return found.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("headings"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return sections.chunks(pages, 200, 30).select("chunk_id", "page", "chunk_index", F.length("content").alias("chars"))


@query(r"""WITH p AS (SELECT page_id, string_split_regex(html, '(?i)<h1[^>]*>') AS ps FROM pages), e AS (SELECT page_id, unnest(ps) AS part, unnest(generate_series(0, len(ps) - 1)) AS section FROM p),
b AS (SELECT page_id, section, trim(regexp_extract(part, '(?is)^(.*?)</h1>', 1), ' ') AS title, trim(regexp_replace(regexp_replace(regexp_replace(part, '(?is)^.*?</h1>', ''), '(?i)</p>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), ' ') AS t FROM e)
SELECT page_id AS page, section, title, length(t) AS chars FROM b WHERE t <> ''""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.page_chunks(table(spark, sf_dir, "pages"), "pages").select("page", "section", "title", F.length("text").alias("chars"))


@query()
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names with a letter less against all customers."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"), F.array(F.concat(F.lit("alias "), "c_name")).alias("aliases"))
    asked = people.where("id % 50 = 0").select(F.expr("substring(name, 1, length(name) - 1)").alias("name"), "entity_type")
    return resolution.linked(asked, people)


@query()
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{3,})"), F.lit(1))
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "role", (F.col("turn") * 1_000_000).alias("at"), F.posexplode(named).alias("nth", "name")).withColumn("start", F.col("at") + F.col("nth"))
    seen = words.select("doc_id", F.lit("NPC").alias("entity_type"), "name", (F.lit(0.6) + F.when(F.col("role") == "user", 0.3).otherwise(0.0)).alias("confidence"), F.when(F.col("role") == "user", "gazetteer").otherwise("spacy").alias("source"), "start")
    return resolution.resolved(seen)


@query("""WITH n AS (SELECT p_partkey AS id, p_brand AS t, string_split(p_name, ' ') AS w FROM part), g AS (SELECT * FROM n), c AS (SELECT * FROM n)
SELECT g.id, count(DISTINCT c.w) AS hits FROM g LEFT JOIN c ON g.t = c.t AND list_has_any(g.w, c.w) AND (list_has_all(c.w, g.w) OR list_has_all(g.w, c.w)) GROUP BY g.id""")
def golden_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("name"))
    return resolution.graded(names, names)
