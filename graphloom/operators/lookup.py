"""Lookups over names, mentions and edges: many questions at once, one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import alias_key


def resolve(surfaces: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, id, name): every entity that an alias of the same key names; all matches, never a guess."""
    asked = surfaces.select("surface", alias_key(F.col("surface")).alias("key")).distinct()
    keyed = aliases.select(alias_key(F.col("name")).alias("key"), F.col("entity_id").alias("id")).distinct()
    return asked.join(keyed, "key").join(entities.select("id", "name"), "id").select("surface", "id", "name")


def anchorable(aliases: DataFrame) -> DataFrame:
    """Aliases of entities none of whose one-word names is all lower case: a common noun in a text is no name."""
    common = F.bool_or(~F.contains("name", F.lit(" ")) & (F.col("name") == F.lower("name")))
    ruled_out = aliases.groupBy("entity_id").agg(common.alias("common")).where("common").select("entity_id")
    return aliases.join(ruled_out, "entity_id", "left_anti")


def passages(ids: DataFrame, mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, section_id, chapter, index, occurrences) where each id is mentioned."""
    found = mentions.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return found.join(sections.select("section_id", "chapter", "index"), "section_id").select(F.col("entity_id").alias("id"), "section_id", "chapter", "index", "occurrences")


def described_with(ids: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, section_id, others): the sections of each id and the other entities there; none is an empty text."""
    own = mentions.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("id"), "section_id").distinct()
    there = mentions.groupBy("section_id").agg(F.array_sort(F.collect_set("entity_id")).alias("there"))
    return own.join(there, "section_id").select("id", "section_id", F.array_join(F.array_remove("there", F.col("id")), ",").alias("others"))


def bounded(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first rows of each key, with ``cut``: how many were left out."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("nth", F.row_number().over(by.orderBy(*order))).withColumn("cut", F.greatest(F.count("*").over(by) - limit, F.lit(0)))
    return ranked.where(F.col("nth") <= limit)


def staged_fill(stages: list[DataFrame], limit: int) -> DataFrame:
    """(query_id, id, stage, nth): hits (query_id, id, at) of earlier stages first, each id once, up to the limit."""
    every = reduce(DataFrame.unionByName, (s.select("query_id", "id", "at", F.lit(i).alias("stage")) for i, s in enumerate(stages)))
    best = every.groupBy("query_id", "id").agg(F.min(F.struct("stage", "at")).alias("b")).select("query_id", "id", "b.stage", "b.at")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "at", "id"))
    return best.withColumn("nth", nth).where(F.col("nth") <= limit).select("query_id", "id", "stage", "nth")


def diagnosed(asked: DataFrame, relations: DataFrame, chapters: DataFrame, names: DataFrame) -> DataFrame:
    """Why a lookup (surface, rel_type, chapter) found nothing: relation, then chapter, then name; null if all are there."""
    rel = relations.select("rel_type", F.lit(True).alias("has_rel")).distinct()
    chapter = chapters.select("chapter", F.lit(True).alias("has_chapter")).distinct()
    name = names.select(alias_key(F.col("name")).alias("key"), F.lit(True).alias("has_name")).distinct()
    held = asked.withColumn("key", alias_key(F.col("surface"))).join(rel, "rel_type", "left").join(chapter, "chapter", "left").join(name, "key", "left")
    missing = F.when(F.col("rel_type").isNotNull() & F.col("has_rel").isNull(), "no_such_relationship")
    missing = missing.when(F.col("chapter").isNotNull() & F.col("has_chapter").isNull(), "chapter_not_extracted")
    return held.select("surface", "rel_type", "chapter", missing.when(F.col("has_name").isNull(), "name_not_in_graph").alias("reason"))


def rendered(ranked: DataFrame) -> DataFrame:
    """(query_id, context): passages (query_id, rank, text) as numbered lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    held = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return held.select("query_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("context"))


def owned(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(owner, direction, rel_type, status, n): edges grouped under the held end, the source if both are; ``orphan`` without one."""
    mark = lambda end: held.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
    both = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    direction = F.when(F.col("has_src"), "out").when(F.col("has_dst"), "in").otherwise("orphan")
    owner = F.when(F.col("has_src"), F.col("src")).when(F.col("has_dst"), F.col("dst"))
    return both.groupBy(owner.alias("owner"), direction.alias("direction"), "rel_type", F.coalesce("status", F.lit("proposed")).alias("status")).agg(F.count("*").alias("n"))


def preview(entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first entity (name, seq) of each name in any case, and the links (source, target) with both ends among them."""
    first = entities.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "seq").alias("name"))
    keys = first.select("key")
    kept = links.join(keys, F.lower("source") == F.col("key"), "left_semi").join(keys, F.lower("target") == F.col("key"), "left_semi")
    return first, kept


def keyword_search(nodes: DataFrame, word: str, fields: tuple[str, ...], limit: int) -> DataFrame:
    """Nodes any of whose fields holds the word, by importance (a half where unknown), then id."""
    hit = reduce(Column.__or__, (F.coalesce(F.contains(F.lower(F.col(f)), F.lower(F.lit(word))), F.lit(False)) for f in fields))
    return nodes.where(hit).orderBy(F.desc(F.coalesce("importance", F.lit(0.5))), "id").limit(limit)


def section_census(sections: DataFrame) -> DataFrame:
    """(chapter, sections, mean_chars, longest): counts of a chapter's sections."""
    size = F.length("text")
    return sections.groupBy("chapter").agg(F.count("*").alias("sections"), F.round(F.avg(size), 4).alias("mean_chars"), F.max(size).alias("longest"))


def rung(authored: Column, key: Column, chapter_place: Column, name: Column, entity_type: Column) -> Column:
    """A location's rung: what was authored, an area if it has a key, a settlement if it is the chapter's place; else none."""
    found = F.coalesce(authored, F.when(key.isNotNull(), "AREA"), F.when(alias_key(name) == alias_key(chapter_place), "SETTLEMENT"))
    return F.when(entity_type == "LOCATION", found)
