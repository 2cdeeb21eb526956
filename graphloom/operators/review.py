"""Review of proposed edges, captions, recent subjects, stock lists, stat blocks and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import alias_key


def review_queue(edges: DataFrame, chapter: str) -> DataFrame:
    """Edges (chapter, source, rel_type, target, status) of a chapter that are not accepted; a missing status is proposed."""
    open_ = F.coalesce("status", F.lit("proposed")) != "accepted"
    return edges.where((F.col("chapter") == chapter) & open_).orderBy("rel_type", "source", "target")


def decide(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with decided status, reviewer and date; and (decision_id, matched): how many edges each decision met, 0 included.

    Decisions (decision_id, chapter, source, rel_type, target, new_status, reviewer, date) match names in any case.
    """
    keys = ["chapter", "rel_type", "__s", "__t"]
    keyed = lambda df: df.withColumn("__s", alias_key(F.col("source"))).withColumn("__t", alias_key(F.col("target")))
    left, right = keyed(edges), keyed(decisions).drop("source", "target")
    met = right.join(left.select(*keys), keys, "left_semi").select("decision_id").distinct()
    counts = right.join(left.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").select("decision_id", F.coalesce("n", F.lit(0).cast("long")).alias("matched"))
    latest = right.join(met, "decision_id").groupBy(*keys).agg(F.max_by(F.struct("new_status", "reviewer", "date"), F.struct("date", "decision_id")).alias("d"))
    joined = left.join(latest, keys, "left").drop("__s", "__t")
    out = joined.withColumn("status", F.coalesce("d.new_status", "status")).withColumn("reviewer", F.col("d.reviewer")).withColumn("reviewed_on", F.col("d.date")).drop("d")
    return out.select(*edges.columns, "reviewer", "reviewed_on"), counts


def captions(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """(mention_id, display_name): a section's heading, and how often if more than once; only those that differ from what is there."""
    named = mentions.join(sections.select("section_id", "heading"), "section_id")
    caption = F.when(F.col("occurrences") > 1, F.concat("heading", F.lit(" x"), F.col("occurrences").cast("string"))).otherwise(F.col("heading"))
    return named.withColumn("caption", caption).where(~F.col("caption").eqNullSafe(F.col("display_name"))).select("mention_id", F.col("caption").alias("display_name"))


def recent_subjects(touched: DataFrame, k: int = 4) -> DataFrame:
    """The last touched names (conv_id, name, turn) of each conversation, then by name."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "name"))
    return touched.withColumn("nth", nth).where(F.col("nth") <= k)


def by_rank(items: DataFrame, column: str, order: tuple[str, ...], descending: bool = False) -> DataFrame:
    """Items sorted by the place of a value in a list; values that are not in it come first, as place -1 does."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)) - 1, F.lit(-1))
    return items.orderBy(F.desc(place) if descending else place, "id")


def truncated(text: Column, budget: int) -> Column:
    """A struct of the text within a budget of characters, and whether something was cut."""
    return F.struct(F.rtrim(F.substring(text, 1, budget)).alias("text"), (F.char_length(text) > budget).alias("cut"))


def inventory(shops: DataFrame, contains: DataFrame, items: DataFrame) -> DataFrame:
    """(shop_id, item_id, name, price, quantity) over CONTAINS edges that end in items."""
    held = contains.where(F.col("rel_type") == "CONTAINS").join(shops.select(F.col("id").alias("src")), "src", "left_semi")
    return held.join(items.where(F.col("entity_type") == "ITEM"), held.dst == items.id).select(F.col("src").alias("shop_id"), F.col("dst").alias("item_id"), "name", "price", "quantity")


#: Fixed value: what a stat block looks like; shorter ones than a hundred letters are none.
STAT_BLOCK = r"(?is)armor class\s+\d+.*?hit points\s+\d+.*?(?=\n\s*\n|$)"


def stat_blocks(pages: DataFrame) -> DataFrame:
    """(page, block) of pages (page, text)."""
    each = pages.select("page", F.posexplode(F.regexp_extract_all("text", F.lit(STAT_BLOCK), F.lit(0))).alias("nth", "block"))
    return each.where(F.length("block") > 100)


def without_stat_blocks(text: Column) -> Column:
    return F.regexp_replace(text, STAT_BLOCK, "")


def with_provenance(chunks: DataFrame, book: str, chapter: str) -> DataFrame:
    return chunks.withColumns({"book": F.lit(book), "chapter": F.lit(chapter), "plane": F.lit("canon"), "chunk_type": F.coalesce("chunk_type", F.lit("text")) if "chunk_type" in chunks.columns else F.lit("text")})


def golden_subset(nodes: DataFrame, edges: DataFrame, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Edges of the sources, and the nodes that are of a source or an end of such an edge."""
    kept = edges.where(F.col("source_kind").isin(*sources))
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("is_end", F.lit(True))
    chosen = nodes.join(ends, "id", "left").where(F.col("source_kind").isin(*sources) | F.col("is_end")).drop("is_end")
    return chosen, kept


def gazetteer_patterns(texts: DataFrame, patterns: DataFrame, most: int = 2_000) -> DataFrame:
    """(doc_id, id, match): matches of each entry's patterns (id, pattern).

    Patterns are hand-written and become one expression; more than ``most`` are dealt into several, each a scan of its own.
    """
    parts = max(1, -(-patterns.count() // most))
    if parts > 1:
        dealt = [patterns.where(F.pmod(F.xxhash64("id", "pattern"), F.lit(parts)) == i) for i in range(parts)]
        return reduce(DataFrame.unionByName, (gazetteer_patterns(texts, part, 1 << 62) for part in dealt))
    held = patterns.select("id", "pattern").collect()

    def matches(entry: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(0)), lambda m: F.struct(F.lit(entry).alias("id"), m.alias("match")))

    found = [matches(r.id, r.pattern) for r in held]
    return texts.select("doc_id", F.explode(F.flatten(F.array(*found))).alias("m")).select("doc_id", "m.id", "m.match") if found else texts.select("doc_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("match")).where("false")
