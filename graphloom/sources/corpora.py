"""Readers and writers: markdown corpora, gazetteers, wiki responses, caches, chunk tables, logs, bulk exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import slug
from graphloom.operators.graph import first_by


def whole_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, text): each file as one row."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def markdown_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter_index, chapter, title, text) in the order of manifest.json (a list of files); files it does not name, or that are missing, are left out."""
    listed = spark.read.schema("files array<string>").option("multiLine", True).json(f"{folder}/manifest.json")
    order = listed.select(F.posexplode("files").alias("chapter_index", "file"))
    title = F.trim(F.regexp_extract("text", r"(?m)^# +(.+?) *#*$", 1))
    held = order.join(whole_files(spark, folder, "*.md"), "file")
    named = F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace("file", r"\.md$", ""))
    return held.select("chapter_index", slug(F.regexp_replace("file", r"\.md$", "")).alias("chapter"), named.alias("title"), "text")


def find_chapter(chapters: DataFrame, prefix: str) -> DataFrame:
    """The one chapter whose name or title starts so, in any case; an error if there is none or more."""
    found = chapters.where(F.startswith(F.lower("chapter"), F.lower(F.lit(prefix))) | F.startswith(F.lower("title"), F.lower(F.lit(prefix))))
    names = [r[0] for r in found.select("chapter").take(2)]
    if len(names) != 1:
        raise ValueError(f"{prefix!r} names {'no chapter' if not names else 'more than one chapter'}")
    return found


def contents_table(lines: DataFrame) -> DataFrame:
    """(group, title, slug, position) from (position, line): bullets under the last ``###`` heading before them."""
    from pyspark.sql import Window

    group = F.nullif(F.regexp_extract("line", r"^### +(.+)$", 1), F.lit(""))
    filled = lines.withColumn("group", F.last(group, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("position")))
    title = F.trim(F.regexp_extract("line", r"^\s*[-*] +(?:\[)?([^\]\n]+)", 1))
    return filled.withColumn("title", title).where(title != "").select("group", "title", slug(F.col("title")).alias("slug"), "position")


def gazetteer_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, entity_type, aliases) from a document with an ``entries`` list; the first entry of a name counts."""
    schema = "entries array<struct<name:string,type:string,aliases:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("entries").alias("at", "e"))
    none = F.array().cast("array<string>")
    held = rows.select("at", F.trim("e.name").alias("name"), F.col("e.type").alias("entity_type"), F.coalesce("e.aliases", none).alias("aliases"))
    return first_by(held.where(F.col("name") != ""), ["name"], "at").drop("at")


def gazetteer_yaml(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """(id, name, entity_type, aliases, patterns) from hand-written YAML, by file name: small dimensions, read on the driver.

    The type is the entry's, else its label, else the file's name; the id is ``<type>_<name>`` unless given; a short name is an alias.
    """
    import yaml

    rows = []
    for file, text in sorted(documents.items()):
        for entry in yaml.safe_load(text) or []:
            name = str(entry["name"])
            kind = str(entry.get("type") or entry.get("label") or file.rsplit(".", 1)[0].rstrip("s")).upper()
            aliases = [*(entry.get("aliases") or []), *([entry["short_name"]] if entry.get("short_name") else [])]
            rows.append((str(entry.get("id") or f"{kind.lower()}_{name.lower().replace(' ', '_')}"), name, kind, list(map(str, aliases)), list(entry.get("patterns") or [])))
    return spark.createDataFrame(rows, "id string, name string, entity_type string, aliases array<string>, patterns array<string>")


_WIKI = T.StructType([T.StructField("query", T.StructType([
    T.StructField("normalized", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]))),
    T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()), T.StructField("missing", T.BooleanType()), T.StructField("invalid", T.BooleanType()),
        T.StructField("revisions", T.ArrayType(T.StructType([T.StructField("slots", T.StructType([T.StructField("main", T.StructType([T.StructField("content", T.StringType())]))]))]))),
    ]))),
]))])


def wiki_pages(responses: DataFrame, column: str = "value") -> DataFrame:
    """(title, exists, content) of batched wiki responses, by the title that was asked for."""
    parsed = responses.select(F.from_json(column, _WIKI).alias("r"))
    names = parsed.select(F.explode("r.query.normalized").alias("n")).select(F.col("n.to").alias("page"), F.col("n.from").alias("asked"))
    pages = parsed.select(F.explode("r.query.pages").alias("p"))
    gone = F.coalesce("p.missing", F.lit(False)) | F.coalesce("p.invalid", F.lit(False))
    content = F.get(F.col("p.revisions"), F.lit(0)).getField("slots").getField("main").getField("content")
    rows = pages.select(F.col("p.title").alias("page"), (~gone & content.isNotNull()).alias("exists"), content.alias("content"))
    return rows.join(names, "page", "left").select(F.coalesce("asked", "page").alias("title"), "exists", "content").dropDuplicates(["title"])


def distinct_images(pages: DataFrame) -> DataFrame:
    """(digest, page, duplicates): each different image (page, content) once, by its first page."""
    hashed = pages.select("page", F.sha2("content", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("page").alias("page"), (F.count("*") - 1).alias("duplicates"))


def best_transcripts(cache: DataFrame, images: DataFrame) -> DataFrame:
    """For each image, the cached transcription with most headings, then the longest; failures (null text) do not count."""
    rank = F.struct(F.regexp_count("text", F.lit(r"(?m)^#{1,6} ")), F.length("text"))
    best = cache.where(F.col("text").isNotNull()).groupBy("digest").agg(F.max_by("text", rank).alias("text"))
    return images.join(best, "digest", "left")


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with new ones in place of those of equal id; of new ones with one id, the last page's stays."""
    latest = first_by(new, ["chunk_id"], F.desc("page"))
    return chunks.join(latest.select("chunk_id"), "chunk_id", "left_anti").unionByName(latest, allowMissingColumns=True)


def without_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(~F.col("source").eqNullSafe(F.lit(source)))


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))


def append_log(records: DataFrame, folder: str) -> None:
    """Query-log records as JSON lines beside those that are there."""
    records.write.mode("append").json(folder)


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Bulk-load files: nodes and edges with loader headers, as CSV."""
    nodes.select(F.col("id").alias("id:ID"), "name", F.col("entity_type").alias(":LABEL")).write.mode("overwrite").option("header", True).csv(f"{folder}/nodes")
    edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("rel_type").alias(":TYPE")).write.mode("overwrite").option("header", True).csv(f"{folder}/edges")


def page_chunks(pages: DataFrame, source: str) -> DataFrame:
    """Pages of HTML (page_id, html) as sections: text under each ``<h1>``, paragraphs as lines."""
    parts = F.split("html", "(?i)<h1[^>]*>")
    each = pages.select("page_id", F.posexplode(parts).alias("section", "part"))
    title = F.trim(F.regexp_extract("part", "(?is)^(.*?)</h1>", 1))
    body = F.regexp_replace(F.regexp_replace("part", "(?is)^.*?</h1>", ""), "(?i)</p>", "\n")
    plain = F.trim(F.regexp_replace(body, "(?s)<[^>]*>", " "))
    return each.select(F.lit(source).alias("source"), F.col("page_id").alias("page"), "section", title.alias("title"), plain.alias("text")).where(F.col("text") != "")
