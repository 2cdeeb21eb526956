"""Registered queries over documents, vectors and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import maintained, mentions, retrieval, vector, vector_index
from graphloom.operators.fuzzy_join import alike
from graphloom.operators.plan import durable, shared_folder, small
from graphloom.plans.fixtures import table
from graphloom.plans.registry import query

#: A gazetteer for the fixture documents.
NAMES = ("The", "Licensed", "Apache", "License", "Version", "Is", "Than", "Eau", "Die", "Los", "Thing", "Onan")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), "text")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n.lower(), n) for n in NAMES], "entity_id string, name string")
    return mentions.scan(_sections(spark, sf_dir), names)


_NAMES_SQL = "names(n) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"
_TOKENS_SQL = r"tokens AS (SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS w FROM documents)"


@query(f"""WITH {_NAMES_SQL}, {_TOKENS_SQL} SELECT lower(n) AS entity_id, count(DISTINCT doc_id) AS sections, count(*) AS occurrences
FROM tokens JOIN names ON w = n GROUP BY n""")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mention_counts(_scan(spark, sf_dir))


@query(f"WITH {_NAMES_SQL}, {_TOKENS_SQL} SELECT lower(n) AS entity_id, doc_id AS section_id, count(*) AS occurrences FROM tokens JOIN names ON w = n GROUP BY n, doc_id")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(_scan(spark, sf_dir)).select("entity_id", "section_id", "occurrences")


@query()
def sentence_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.together(mentions.same_sentence(_scan(spark, sf_dir)))


@query()
def widest_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.widest_sentence(_scan(spark, sf_dir))


_WORDS_SQL = r"""gazetteer AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '\p{L}{4,}')) AS w FROM benchmark) UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer)"""


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, name): every word of four letters or more of the passages, and the names of suppliers and customers."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), 0)).alias("name"))
    named = words.union(table(spark, sf_dir, "supplier").select("s_name")).union(table(spark, sf_dir, "customer").select("c_name"))
    return named.distinct().select(F.col("name").alias("entity_id"), "name")


@query(f"WITH {_WORDS_SQL}, {_TOKENS_SQL} SELECT name AS entity_id, count(DISTINCT doc_id) AS sections, count(*) AS occurrences FROM tokens JOIN gazetteer ON w = name GROUP BY name")
def gazetteer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a gazetteer that the tables give: thousands of names."""
    return mentions.mention_counts(mentions.scan(_sections(spark, sf_dir), _gazetteer(spark, sf_dir)))


@query(f"WITH {_WORDS_SQL}, {_TOKENS_SQL} SELECT name AS entity_id, count(DISTINCT doc_id) AS sections, count(*) AS occurrences FROM tokens JOIN gazetteer ON w = name GROUP BY name")
def gazetteer_counts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an automaton of all names: each text meets the names whose rarest word it holds."""
    return mentions.mention_counts(mentions.scan(_sections(spark, sf_dir), _gazetteer(spark, sf_dir), most=0))


@query()
def gazetteer_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.together(mentions.same_sentence(mentions.scan(_sections(spark, sf_dir), _gazetteer(spark, sf_dir))))


@query(f"WITH {_WORDS_SQL}, {_TOKENS_SQL} SELECT name AS entity_id, count(DISTINCT doc_id) AS sections, count(*) AS occurrences FROM tokens JOIN gazetteer ON w = name GROUP BY name")
def gazetteer_counts_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts kept from changes: odd documents come with their text twice and are corrected, thirds go and come back, and the
    first batch comes once more, late."""
    folder, names, docs = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}", _gazetteer(spark, sf_dir), _sections(spark, sf_dir)
    odd, third = F.col("section_id") % 2 == 1, F.col("section_id") % 3 == 0
    first = docs.select("section_id", F.lit(1).alias("seq"), F.when(odd, F.concat_ws("\n", "text", "text")).otherwise(F.col("text")).alias("text"))
    second = docs.where(odd | third).select("section_id", F.lit(2).alias("seq"), F.when(~third, F.col("text")).alias("text"))
    back = docs.where(third).select("section_id", F.lit(3).alias("seq"), "text")
    for changes in (first, second, back.union(first)):
        maintained.apply(spark, folder, changes, names)
    return maintained.entity_counts(spark, folder)


@query()
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.sentence_table(_sections(spark, sf_dir))


_LINES_SQL = r"""lines AS (SELECT doc_id, i, t.line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) t)"""


@query(rf"""WITH {_NAMES_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT DISTINCT doc_id, line, lower(n) AS e
FROM (SELECT doc_id, line, unnest(string_split_regex(line, '[^\p{{L}}\p{{N}}]+')) AS w FROM l) JOIN names ON w = n)
SELECT x.e AS a, y.e AS b, count(DISTINCT x.doc_id) AS sections FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.line = y.line AND x.e < y.e GROUP BY 1, 2""")
def line_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named on one line: each line's distinct names, unfolded into ordered pairs within the line's own small array."""
    lines = _sections(spark, sf_dir).select("section_id", F.explode(F.split("text", "\n")).alias("line"))
    words = F.array_intersect(F.array_distinct(F.split("line", r"[^\p{L}\p{N}]+")), F.array(*map(F.lit, NAMES)))
    held = lines.select("section_id", F.array_sort(F.transform(words, lambda w: F.lower(w))).alias("names")).where(F.size("names") > 1)
    pairs = held.select("section_id", F.explode("names").alias("a"), "names").select("section_id", "a", F.explode("names").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.countDistinct("section_id").alias("sections"))


_STOP_SQL = ", ".join(f"'{w}'" for w in [*text.QUESTION_WORDS, *text.TABLE_WORDS])


@query(rf"""WITH w AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''’]+')) AS word FROM benchmark)
WHERE (length(word) >= 3 OR regexp_matches(word, '[0-9]')) AND word NOT IN ({_STOP_SQL})) SELECT item_id, count(*) AS n_terms, min(word) AS first_term, max(word) AS last_term FROM w GROUP BY item_id""")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select("item_id", text.content_terms(F.col("text")).alias("terms"))
    return terms.where(F.size("terms") > 0).select("item_id", F.size("terms").cast("long").alias("n_terms"), F.array_min("terms").alias("first_term"), F.array_max("terms").alias("last_term"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "").alias("words"))


def _query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of three letters or more of the whole passage that is no question word."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), lambda w: F.length(w) >= 3)
    said = F.array_except(words, F.array(*map(F.lit, [*text.QUESTION_WORDS, *text.TABLE_WORDS])))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(said).alias("term"))


_BM25 = f"""toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM toks),
terms AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP_SQL})))) AS term FROM benchmark),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, size, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score
FROM tf JOIN dfs USING (term) JOIN terms USING (term) CROSS JOIN corpus GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_tokens(spark, sf_dir), _query_terms(spark, sf_dir), 5).select("query_id", "doc_id", "rank")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage: a hash of its words two to four as the key of an equality join, then the passage itself.

    Its inner words stand between white space in a document too, whatever its ends touch there. A passage of fewer inner words
    has no such key and meets every document.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hashed = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    cut = F.split("passage", r"\s+")
    keyed = items.withColumn("key", F.when(F.size(cut) >= 5, hashed(cut, F.lit(1))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.split("text", r"\s+").alias("w")).where(F.size("w") >= 3)
    keys = words.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: hashed(F.col("w"), i))).alias("key"))
    near = keys.join(small(keyed.where(F.col("key").isNotNull()).select("query_id", "key")), "key").select("query_id", "doc_id").distinct()
    short = docs.crossJoin(small(keyed.where(F.col("key").isNull()).select("query_id"))).select("query_id", "doc_id")
    held = durable(near.union(short))
    return docs.join(small(held), "doc_id").join(items, "query_id").where(F.contains("text", F.col("passage"))).select("query_id", "doc_id")


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_GOLD} SELECT query_id, doc_id FROM gold")
def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


@query(f"""WITH {_BM25}, {_GOLD}, rr AS (SELECT g.query_id, coalesce(max(1.0 / r.rank), 0) AS rr FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.rank <= 20 GROUP BY g.query_id)
SELECT count(*) AS questions, count(CASE WHEN rr > 0 THEN 1 END) AS hits, round(avg(rr), 6) AS mrr FROM rr""")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.bm25(_tokens(spark, sf_dir), _query_terms(spark, sf_dir), 20)
    return retrieval.recall_summary(retrieval.reciprocal_ranks(ranked, _gold(spark, sf_dir)))


@query(f"""WITH {_BM25}, t AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 6), g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM scored),
gg AS (SELECT * FROM g WHERE rank <= 6), e AS (SELECT query_id, doc_id, CASE WHEN rank <= 3 THEN 0 ELSE 2 END AS tier, rank AS pos, 'graph' AS source FROM gg UNION ALL SELECT query_id, doc_id, 1, rank, 'text' FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY tier, pos) AS nth FROM e),
f AS (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY tier, pos, doc_id) AS rank FROM o WHERE nth = 1) SELECT query_id, doc_id, rank, source FROM f WHERE rank <= 5""")
def combined_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists under one budget: here BM25's against the newest of the same hits."""
    every = retrieval.bm25(_tokens(spark, sf_dir), _query_terms(spark, sf_dir), 1 << 30)
    best = every.where("rank <= 6").select("query_id", "doc_id", "rank")
    newest = retrieval.top(every.select("query_id", "doc_id"), ["query_id"], 6, F.desc("doc_id"))
    return retrieval.combine(newest, best, 5, 2)


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS score FROM q CROSS JOIN embeddings WHERE label % 2 = 0)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = rows.where(F.col("id") % 50 == 0)
    return vector.nearest(asked, rows.where(F.col("label") % 2 == 0), 5).select("query_id", "id", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_EXACT_SQL = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS score FROM q CROSS JOIN embeddings),
x AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10)"""


@query(f"WITH {_EXACT_SQL} SELECT query_id, id, rank FROM x")
def indexed_neighbors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the index, with the round that searches every list that could still hold a better one."""
    rows = _vectors(spark, sf_dir)
    return vector_index.search(rows.where(F.col("id") % 50 == 0), vector_index.build(rows), 10, exact=True).select("query_id", "id", "rank")


@query()
def indexed_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from each query's nearest lists only; ``indexed_recall`` holds them against the exact ones."""
    rows = _vectors(spark, sf_dir)
    return vector_index.search(rows.where(F.col("id") % 50 == 0), vector_index.build(rows), 10).select("query_id", "id", "score", "rank")


@query()
def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wanted, found, recall): how many of the exact ten neighbours of every fiftieth row its nearest lists hold."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("id") % 50 == 0)
    found = vector_index.search(asked, vector_index.build(rows), 10).select("query_id", "id", F.lit(1).alias("hit"))
    wanted = vector.nearest(asked, rows, 10).select("query_id", "id").join(found, ["query_id", "id"], "left")
    return wanted.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


@query("""SELECT doc_id, digest FROM (SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1""")
def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, lang, source FROM documents), s AS (SELECT doc_id, (CASE WHEN contains(t, 'the') THEN 0.2 ELSE 0 END + CASE WHEN contains(t, 'idiot') THEN 0.2 ELSE 0 END)
+ least(0.15, 0.03 * len(list_distinct(list_filter(string_split_regex(t, '\\s+'), lambda x: x IN ('where', 'is', 'the', 'thing')))))
+ (CASE doc_id % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 ELSE 1.0 END - 1.0) * 0.1 + CASE WHEN doc_id % 101 > 80 THEN (doc_id % 101 - 80) / 200.0 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END AS more FROM d)
SELECT doc_id, round(CAST(least(1.0, (doc_id % 10) / 10.0 * 0.7 + more * 0.3) AS DOUBLE), 6) AS score FROM s""".replace("\\\\", "\\"))
def rerank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "NPC").otherwise("ITEM")
    book = F.element_at(F.array(*map(F.lit, ("the PHB", "dmg 2", "mm", "Session 4", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    score = retrieval.rerank_score(F.col("text"), F.lit("Where is the thing"), F.array(F.lit("The"), F.lit("idiot")), (F.col("doc_id") % 10) / 10, book, kind, (F.col("doc_id") % 101).cast("double"))
    return docs.select("doc_id", F.round(score, 6).alias("score"))


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their last letter changed, every fiftieth, against all part names: the best of each."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    asked = parts.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat(F.expr("substring(name, 1, length(name) - 1)"), F.lit("x")).alias("spelling"))
    near = alike(asked.select(F.col("spelling").alias("name")), parts, 85.0).withColumnRenamed("name", "spelling")
    # Of the parts of one name the least id wins, and equal spellings have one answer, so neither is multiplied by its rows.
    first = parts.groupBy(F.col("name").alias("known")).agg(F.min("id").alias("id"))
    scored = near.join(first, "known").withColumn("score", F.round("score", 4))
    best = retrieval.top(scored, ["spelling"], 1, F.desc("score"), F.col("id"))
    return asked.join(best.select("spelling", "id", "score"), "spelling").select("query_id", "id", "score")


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS cut, text FROM conversations),
g AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM g GROUP BY conv_id, run""")
def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one speaker as one segment."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    cut = F.when(F.col("role") == F.lag("role").over(order), 0).otherwise(1)
    marked = table(spark, sf_dir, "conversations").withColumn("cut", cut).withColumn("run", F.sum("cut").over(order))
    return marked.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations)
SELECT conv_id, turn FROM n WHERE a <= 2 OR z <= 3""")
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two and the last three turns."""
    by = Window.partitionBy("conv_id")
    numbered = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.row_number().over(by.orderBy("turn")).alias("a"), F.row_number().over(by.orderBy(F.desc("turn"))).alias("z")
    )
    return numbered.where("a <= 2 OR z <= 3").select("conv_id", "turn")


@query("""SELECT conv_id, count(*) AS messages, CAST(floor(sum(length(text)) * 0.25) AS BIGINT) AS tokens,
round((sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) * 0.25 * 2.5 + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) * 0.25 * 10) / 1e6, 9) AS cost FROM conversations GROUP BY conv_id""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.sum(size).alias("chars"),
        F.sum(F.when(F.col("role") != "assistant", size).otherwise(0)).alias("asked"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("told"),
    )
    cost = (F.col("asked") * 0.25 * 2.5 + F.col("told") * 0.25 * 10) / 1e6
    return said.select("conv_id", "messages", F.floor(F.col("chars") * 0.25).alias("tokens"), F.round(cost, 9).alias("cost"))


@query("""WITH s AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id, role)
SELECT conv_id, role, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS k FROM s) WHERE k = 1""")
def main_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    best = counted.groupBy("conv_id").agg(F.max_by(F.struct("role", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("conv_id", "b.role", "b.n")


@query(r"""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")
    )


@query(r"""WITH h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS head FROM pages)
SELECT page_id, coalesce((SELECT x.head FROM h x WHERE x.head IS NOT NULL AND x.page_id <= h.page_id ORDER BY x.page_id DESC LIMIT 1), 'Front Matter') AS chapter FROM h""")
def chapter_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the last heading before them. Pages are a book's, so the order is kept a host-independent thousand at a time."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, host).alias("head"), F.floor(F.col("page_id") / 1000).alias("block"))
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("block").orderBy("page_id"))
    last = pages.groupBy("block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("page_id"))).alias("tail"))
    before = last.select("block", F.last("tail", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return pages.withColumn("own", own).join(before, "block").select("page_id", F.coalesce("own", "carried", F.lit("Front Matter")).alias("chapter"))
