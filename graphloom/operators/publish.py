"""A chapter's tables written and deleted as one: spine, ownership, account, and a swap that readers see whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import alias_key
from graphloom.operators import versions
from graphloom.operators.upserts import missing_aliases, require_endpoints, sole_owned

Tables = dict[str, DataFrame]
#: The tables of a published graph, and their columns.
SCHEMAS = {
    "nodes": "id string, name string, entity_type string",
    "owners": "id string, chapter string",
    "aliases": "entity_id string, name string",
    "sections": "section_id string, chapter string, index int, heading string",
    "describes": "section_id string, entity_id string",
    "edges": "src string, rel_type string, dst string, chapter string, status string, evidence string",
    "mentions": "entity_id string, section_id string, chapter string, occurrences int",
}


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those named by (src, rel_type, dst)."""
    return edges.join(gone.select("src", "rel_type", "dst").distinct(), ["src", "rel_type", "dst"], "left_anti").select(*edges.columns)


def without_derived_placements(edges: DataFrame, marks: tuple[str, ...] = ("structural",)) -> DataFrame:
    """Edges without placements that only a document's structure is evidence for; a placement without evidence stays."""
    derived = (F.col("rel_type") == "LOCATED_IN") & F.coalesce(F.col("evidence").isin(*marks), F.lit(False))
    return edges.where(~derived)


def spine(chapters: DataFrame, sections: DataFrame, describes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the document's skeleton: book, chapters, sections, and the places that sections describe.

    Chapters (book, chapter, title, chapter_index), sections (section_id, chapter, index, heading), describes (section_id,
    entity_id); a description of a node that is not there is an error.
    """
    require_endpoints(describes.select("entity_id"), "entity_id", nodes)
    books = chapters.select(F.col("book").alias("id"), F.col("book").alias("name"), F.lit("BOOK").alias("label"), F.lit(None).cast("int").alias("index")).distinct()
    heads = chapters.select(F.col("chapter").alias("id"), F.col("title").alias("name"), F.lit("CHAPTER").alias("label"), F.col("chapter_index").alias("index"))
    parts = sections.select(F.col("section_id").alias("id"), F.col("heading").alias("name"), F.lit("SECTION").alias("label"), "index")
    edge = lambda df, src, rel, dst, index: df.select(F.col(src).alias("src"), F.lit(rel).alias("rel_type"), F.col(dst).alias("dst"), index.cast("int").alias("index"))
    links = edge(chapters, "book", "HAS_CHAPTER", "chapter", F.col("chapter_index"))
    links = links.union(edge(sections, "chapter", "HAS_SECTION", "section_id", F.col("index"))).union(edge(describes, "section_id", "DESCRIBES", "entity_id", F.lit(None)))
    return books.union(heads).union(parts), links


def foreign_edges(tables: Tables, chapter: str) -> DataFrame:
    """Edges of other chapters at the nodes that only this chapter owns: deleting the chapter would cut them."""
    own = sole_owned(tables["owners"], chapter)
    others = tables["edges"].where(~F.col("chapter").eqNullSafe(F.lit(chapter)))
    at = lambda end: others.join(own.withColumnRenamed("id", end), end, "left_semi").select(*others.columns)
    return at("src").union(at("dst")).distinct()


def without_chapter(tables: Tables, chapter: str) -> tuple[Tables, DataFrame]:
    """The tables without a chapter, and an account (table, deleted).

    Nodes go that only this chapter owns, with their aliases; its edges, sections, mentions and descriptions go. If an edge of
    another chapter touches such a node, nothing is deleted and an error says so.
    """
    held = foreign_edges(tables, chapter).take(3)
    if held:
        raise ValueError(f"edges of other chapters hold nodes of {chapter}: {[(r.src, r.rel_type, r.dst) for r in held]}")
    own = sole_owned(tables["owners"], chapter)
    other = ~F.col("chapter").eqNullSafe(F.lit(chapter))
    sections = tables["sections"].where(other)
    out = {
        "nodes": tables["nodes"].join(own, "id", "left_anti"),
        "owners": tables["owners"].where(other),
        "aliases": tables["aliases"].join(own.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti"),
        "sections": sections,
        "describes": tables["describes"].join(sections.select("section_id"), "section_id", "left_semi"),
        "edges": tables["edges"].where(other),
        "mentions": tables["mentions"].where(other),
    }
    count = lambda name, df, sign: df.agg((F.count("*") * sign).alias("n")).select(F.lit(name).alias("table"), "n")
    rows = None
    for name in SCHEMAS:
        both = count(name, tables[name], 1).union(count(name, out[name], -1))
        rows = both if rows is None else rows.union(both)
    return {k: out[k].select(*tables[k].columns) for k in SCHEMAS}, rows.groupBy("table").agg(F.sum("n").alias("deleted"))


def with_chapter(tables: Tables, new: Tables, chapter: str, replace: bool = False) -> Tables:
    """The tables with a chapter's rows: nodes, then aliases, sections, edges and mentions, all of whose ends have to be there.

    A chapter that is there is refused, or deleted first with ``replace``. Nodes that other chapters hold keep their row; each
    node's own name is one of its aliases.
    """
    if not tables["sections"].where(F.col("chapter") == chapter).isEmpty():
        if not replace:
            raise ValueError(f"{chapter} is there already")
        tables = without_chapter(tables, chapter)[0]
    nodes = tables["nodes"].unionByName(new["nodes"].join(tables["nodes"].select("id"), "id", "left_anti"))
    for name, column in (("edges", "src"), ("edges", "dst"), ("mentions", "entity_id"), ("describes", "entity_id"), ("aliases", "entity_id")):
        require_endpoints(new[name].select(column), column, nodes)
    own_names = new["nodes"].select(F.col("id").alias("entity_id"), "name").union(new["aliases"].select("entity_id", "name"))
    owners = tables["owners"].union(new["nodes"].select("id", F.lit(chapter).alias("chapter"))).distinct()
    merged = {"nodes": nodes, "owners": owners, "aliases": tables["aliases"].unionByName(missing_aliases(tables["aliases"], own_names))}
    return merged | {k: tables[k].unionByName(new[k]).dropDuplicates(keys) for k, keys in (("sections", ["section_id"]), ("describes", ["section_id", "entity_id"]), ("edges", ["src", "rel_type", "dst", "chapter"]), ("mentions", ["entity_id", "section_id"]))}


def publish(tables: Tables, folder: str, base: int | None = None) -> str:
    """Write a whole version of the tables beside the old ones, then name it in the log of versions; its folder.

    ``base`` is the number of the version that the tables were made from (``versions.last`` before they were read; the last one now
    if not given). Where another writer has published on that base meanwhile, ``FileExistsError``: nothing is lost silently. A
    write that fails halfway has no number and is never seen.
    """
    spark = next(iter(tables.values())).sparkSession
    number = (versions.last(spark, folder) if base is None else base) + 1
    version = f"{folder}/version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    versions.take(spark, folder, number, version)
    return version


def current(spark: SparkSession, folder: str) -> Tables:
    """The tables of the last published version; empty ones where there is none."""
    found = versions.entries(spark, folder)
    if not found:
        return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    return {name: spark.read.parquet(f"{found[-1][1]}/{name}") for name in SCHEMAS}


#: What may be changed of a shop and of an item.
SHOP_FIELDS = ("name", "description", "shop_type", "owner_name", "gold")
ITEM_FIELDS = ("name", "description", "price", "quantity", "category", "rarity")


def changed(rows: DataFrame, changes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with changes (id, and a map of new values as texts): fields outside the allow-list are not touched."""
    kept = changes.select(F.col("id").alias("__id"), F.map_filter("fields", lambda k, v: k.isin(*allowed) & v.isNotNull()).alias("__f"))
    joined = rows.join(kept, F.col("id") == F.col("__id"), "left")
    new = lambda c: F.coalesce(F.try_element_at("__f", F.lit(c)).try_cast(rows.schema[c].dataType), F.col(c)).alias(c)
    return joined.select(*(new(c) if c in allowed else F.col(c) for c in rows.columns))


def without_shops(shops: DataFrame, contains: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shops without those in (id), their CONTAINS edges, and the items that only they held."""
    ids = gone.select(F.col("id").alias("src")).distinct()
    kept = contains.join(ids, "src", "left_anti").select(*contains.columns)
    lost = contains.join(ids, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(kept.select(F.col("dst").alias("id")), "id", "left_anti")
    return shops.join(ids.withColumnRenamed("src", "id"), "id", "left_anti"), kept, items.join(lost, "id", "left_anti")


def written_transcript(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what a transcript named: nodes one a folded name and type, the first spelling; edges between names that are nodes.

    Entities (doc_id, seq, name, entity_type), relations (doc_id, source, rel_type, target, evidence). A name of several types is
    the first type's by name.
    """
    nodes = entities.groupBy("doc_id", alias_key(F.col("name")).alias("key"), "entity_type").agg(F.min_by("name", "seq").alias("name"))
    nodes = nodes.select("doc_id", F.concat_ws(":", F.lower("entity_type"), "key").alias("id"), "name", "entity_type", "key")
    by_name = nodes.groupBy("doc_id", "key").agg(F.min_by("id", "entity_type").alias("id"))
    end = lambda c: by_name.select("doc_id", F.col("key").alias(f"{c}_key"), F.col("id").alias("src" if c == "source" else "dst"))
    keyed = relations.withColumn("source_key", alias_key(F.col("source"))).withColumn("target_key", alias_key(F.col("target")))
    edges = keyed.join(end("source"), ["doc_id", "source_key"]).join(end("target"), ["doc_id", "target_key"])
    return nodes.drop("key"), edges.groupBy("doc_id", "src", "rel_type", "dst").agg(F.min("evidence").alias("evidence"))
