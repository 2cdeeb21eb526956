"""Headings and sections of markdown chapters, containment, chapter assembly and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.forest import nearest

FIT, BUDGET, PREAMBLE = 0.75, 1_000, "(preamble)"
#: A heading's line, the key and name at its head, and how a chapter refers to its keys. A key has four signs at most,
#: of which a run of digits is one, so that a chapter's areas from a hundred on are keys as the first ones are (``E100b``).
HEADING = r"^(#{1,6})[ \t]+(?!#)(.+?)[ \t]*$"
KEYED = r"^((?:\p{Nd}++|[^\s.\p{Nd}]){1,4})\.\s+(\S.*)$"
REFERENCE = r"\b(?:area|areas|room|rooms)\s+([A-Za-z][0-9]*[a-z]?|[0-9]+[A-Za-z]?)\b"
CHAPTER_PREFIX = r"(?i)^(chapter\s+\d+|appendix\s+[a-z])\s*[:.]\s*"


def tokens(text: Column) -> Column:
    """A quarter of the characters: an estimate, since the tokenizer is a parameter of who calls."""
    return F.ceil(F.length(text) / 4)


def key_shape(token: Column) -> Column:
    """Runs of digits, capitals and anything else as one sign each: ``K85`` is ``A#``, ``E5g`` ``A#a``, ``St`` ``Aa``."""
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"[^\p{Nd}\p{Lu}]+", "\u0001"), r"\p{Nd}+", "#"), r"\p{Lu}+", "A")
    return F.replace(signs, F.lit("\u0001"), F.lit("a"))


def headings(chapters: DataFrame) -> DataFrame:
    """(chapter, line_no, depth, heading, start, length) of (chapter, text): where each heading's line starts."""
    lines = chapters.select("chapter", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("chapter").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = lines.withColumn("start", before).where(F.rlike("line", F.lit(HEADING)))
    return laid.select("chapter", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("depth"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("heading"), "start")


def spans(found: DataFrame, chapters: DataFrame) -> DataFrame:
    """Headings with ``stop``: where the next heading of the same depth or a shallower one starts, or the text ends.

    For each of the six depths, the next heading at most so deep is one window's first value from below; a heading then reads
    that of its own depth. A chapter's headings are sorted once.
    """
    after = Window.partitionBy("chapter").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    following = F.array(*(F.first(F.when(F.col("depth") <= d, F.col("start")), ignorenulls=True).over(after) for d in range(1, 7)))
    order = Window.partitionBy("chapter").orderBy("start")
    laid = found.select("chapter", (F.row_number().over(order) - 1).alias("nth"), "start", "depth", "heading", following.alias("following"))
    sized = laid.join(chapters.select("chapter", F.length("text").alias("size")), "chapter")
    return sized.select("chapter", "nth", "start", "depth", "heading", F.coalesce(F.get("following", F.col("depth") - 1), "size").alias("stop"))


def depth_table(spanned: DataFrame, budget: int = BUDGET) -> DataFrame:
    size = F.ceil((F.col("stop") - F.col("start")) / 4)
    return spanned.groupBy("chapter", "depth").agg(F.count("*").alias("headings"), F.count(F.when(size <= budget, 1)).alias("fits"))


def area_depth(table: DataFrame) -> DataFrame:
    """(chapter, area_depth, qualified): the shallowest depth at which three quarters fit, else the deepest."""
    fits = F.min(F.when(F.col("fits") >= F.col("headings") * FIT, F.col("depth")))
    return table.groupBy("chapter").agg(F.coalesce(fits, F.max("depth")).alias("area_depth"), fits.isNotNull().alias("qualified"))


def key_shapes(chapters: DataFrame) -> DataFrame:
    """(chapter, shapes): the shapes of keys that the chapter refers to."""
    keys = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))
    return chapters.select("chapter", F.array_sort(F.array_distinct(F.transform(keys, key_shape))).alias("shapes"))


def keyed(found: DataFrame, shapes: DataFrame) -> DataFrame:
    """Headings with key, stem, suffix and name where their prefix has a shape that the chapter refers to; else null.

    A letter after digits is a sub-area's suffix; a chapter that refers to nothing has no keys.
    """
    plain = F.trim("heading")
    token = F.regexp_extract(plain, KEYED, 1)
    known = F.coalesce((token != "") & F.array_contains("shapes", key_shape(token)), F.lit(False))
    of = lambda c: F.when(known, c)
    suffix = F.regexp_extract(token, "^.*[0-9]([A-Za-z])$", 1)
    stem = F.when(suffix != "", F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token"))
    held = found.join(shapes, "chapter", "left").withColumn("token", token)
    return held.select(*found.columns, of(F.lower("token")).alias("key"), of(stem).alias("stem"), of(suffix).alias("suffix"), of(F.trim(F.regexp_extract(plain, KEYED, 2))).alias("name"))


def key_split(chapters: DataFrame, shapes: DataFrame) -> DataFrame:
    """(chapter, section, depth, heading, body): cut at every keyed heading of any level and at unkeyed ones of level two.

    Levels are noise where this mode is used, so each section's depth is 0; the text before the first cut is the preamble.
    """
    found = keyed(headings(chapters), shapes)
    cuts = found.where((F.col("depth") == 2) | F.col("key").isNotNull()).select("chapter", "start", "heading")
    return _pieces(chapters, cuts.select("chapter", "start", F.lit(0).alias("depth"), "heading"))


def _pieces(chapters: DataFrame, cuts: DataFrame) -> DataFrame:
    """The texts between cuts (chapter, start, depth, heading), and before the first one unless that is blank."""
    first = chapters.select("chapter", F.lit(0).alias("start"), F.lit(0).alias("depth"), F.lit(PREAMBLE).alias("heading"), F.lit(True).alias("before"))
    all_cuts = cuts.withColumn("before", F.lit(False)).unionByName(first.join(cuts.where("start = 0").select("chapter"), "chapter", "left_anti"))
    stop = F.lead("start").over(Window.partitionBy("chapter").orderBy("start"))
    ranged = all_cuts.withColumn("stop", stop).join(chapters.select("chapter", "text"), "chapter")
    body = F.regexp_replace(F.substr("text", F.col("start") + 1, F.coalesce(F.col("stop"), F.length("text")) - F.col("start")), r"^\s+|\s+$", "")
    pieces = ranged.select("chapter", "start", "depth", F.trim("heading").alias("heading"), "before", body.alias("body")).where(~F.col("before") | (F.col("body") != ""))
    return pieces.withColumn("section", F.row_number().over(Window.partitionBy("chapter").orderBy("start")) - 1).drop("start", "before")


def place_of_title(title: Column) -> Column:
    """The place that a chapter's title names: without its number, the article kept; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(title, CHAPTER_PREFIX, "")), F.lit(""))


def ancestor_places(sections: DataFrame, links: DataFrame) -> DataFrame:
    """(chapter, section, place): the nearest enclosing section's place, walking outwards; none where no ancestor has one.

    Sections (chapter, section, place) and links (chapter, section, parent; -1 at the top). The walk is ``forest.nearest``.
    """
    mark = lambda c: F.concat_ws("#", "chapter", F.col(c).cast("string"))
    up = links.where("parent >= 0").select(mark("section").alias("id"), mark("parent").alias("parent"))
    named = sections.where(F.col("place").isNotNull()).select(mark("section").alias("near"), "place")
    near = nearest(up, named.select(F.col("near").alias("id"))).where("near IS NOT NULL").join(named, "near").select("id", "place")
    return sections.select("chapter", "section").withColumn("id", mark("section")).join(near, "id", "left").select("chapter", "section", "place")


def split(chapters: DataFrame, depths: DataFrame, spanned: DataFrame) -> DataFrame:
    """(chapter, section, depth, heading, body): cut at headings of the area depth or shallower; text before is a preamble."""
    tops = spanned.join(depths, "chapter").where(F.col("depth") <= F.col("area_depth"))
    return _pieces(chapters, tops.select("chapter", "start", "depth", "heading"))


def parents(sections: DataFrame) -> DataFrame:
    """(chapter, section, parent): the nearest section before of a strictly smaller depth; depth 0 has and is no parent (-1).

    For each depth, the last section so shallow is a window's last value; a section reads that of the depth above its own.
    """
    before = Window.partitionBy("chapter").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*(F.last(F.when(F.col("depth").between(1, d), F.col("section")), ignorenulls=True).over(before) for d in range(1, 6)))
    found = sections.select("chapter", "section", "depth", last.alias("last"))
    return found.select("chapter", "section", F.when(F.col("depth") <= 1, -1).otherwise(F.coalesce(F.get("last", F.col("depth") - 2), F.lit(-1))).alias("parent"))


def containment(sections: DataFrame, links: DataFrame) -> DataFrame:
    """(chapter, section, key, container, how): the section's parent by depth, else the area its key is part of, else the chapter."""
    stem = F.regexp_extract("key", "^(.*[0-9])[a-z]$", 1)
    own = sections.select("chapter", "section", "key", stem.alias("stem")).where(F.col("key").isNotNull())
    stems = sections.where(F.col("key").isNotNull()).groupBy("chapter", F.col("key").alias("stem")).agg(F.min("section").alias("by_key"))
    both = own.join(links, ["chapter", "section"], "left").join(stems, ["chapter", "stem"], "left")
    by_depth = F.when(F.col("parent") >= 0, F.col("parent"))
    how = F.when(by_depth.isNotNull(), "depth").when(F.col("by_key").isNotNull(), "key").otherwise("chapter")
    return both.select("chapter", "section", "key", F.coalesce(by_depth, "by_key", F.lit(-1)).alias("container"), how.alias("how")).where("container <> section")


def unique_slugs(names: list[str]) -> list[str]:
    """Slugs in order; one that was given out before gets the first free number from 2 on."""
    given: set[str] = set()
    out = []
    for name in names:
        slug, n = name, 2
        while slug in given:
            slug, n = f"{name}-{n}", n + 1
        given.add(slug)
        out.append(slug)
    return out


def packed(paragraphs: list[str], size: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Chunks of whole paragraphs within a budget; trailing ones within the overlap begin the next chunk; longer ones go by sentences."""
    import re

    out: list[str] = []
    held: list[str] = []

    def flush(glue: str = "\n\n") -> None:
        if held:
            out.append(glue.join(held))
        held.clear()

    total = 0
    for p in paragraphs:
        n = count(p)
        if n > size:
            flush()
            total = 0
            for s in re.split(r"(?<=[.!?])\s+", p):
                k = count(s)
                if total + k > size:
                    flush(" ")
                    total = 0
                held.append(s)
                total += k
            flush(" ")
            total = 0
            continue
        if total + n > size and held:
            tail: list[str] = []
            for q in reversed(held):
                if sum(map(count, tail)) + count(q) > overlap:
                    break
                tail.insert(0, q)
            flush()
            held.extend(["\n\n".join(tail)] if tail else [])
            total = sum(map(count, held))
        held.append(p)
        total += n
    flush()
    return out


def chunks(pages: DataFrame, size: int = 500, overlap: int = 50, count: Callable[[str], int] = lambda s: -(-len(s) // 4)) -> DataFrame:
    """(chunk_id, source, page, chunk_index, content) from (source, page, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            rows = []
            for source, page, text in zip(batch.source, batch.page, batch.text):
                paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]
                for i, content in enumerate(packed(paragraphs, size, overlap, count)):
                    rows.append((f"{source}_p{page}_c{i}", source, page, i, content))
            yield pd.DataFrame(rows, columns=["chunk_id", "source", "page", "chunk_index", "content"])

    return pages.select("source", F.col("page").cast("long"), "text").mapInPandas(run, "chunk_id string, source string, page long, chunk_index int, content string")


def disambiguated(chapters: DataFrame) -> DataFrame:
    """(book, chapter_index, slug): slugs of a book's chapters (book, chapter_index, slug) in order, each given out once.

    A number that was given to one may be another's own slug, so a book's chapters are folded in order; they are few.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chapter_index")
        return group.assign(slug=unique_slugs(group.slug.tolist()))

    return chapters.select("book", F.col("chapter_index").cast("long").alias("chapter_index"), "slug").groupBy("book").applyInPandas(fold, "book string, chapter_index long, slug string")
