"""What a book's headings say: keys and their places, names that the book heads, reports of structure, paged texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import alias_key, slug
from graphloom.operators import sections
from graphloom.operators.graph import first_by

#: Fixed value: how a chapter's or an appendix's title begins.
TITLE = r"(?i)^(chapter \d+|appendix [a-f])\b"


def first_keyed(found: DataFrame, places: DataFrame) -> DataFrame:
    """(chapter, key, name): the first heading of each key (chapter, line_no, key, name), but for names that are a chapter's own place.

    Places (place) are those of every chapter of the book: a keyed area of that name only refers to it.
    """
    real = found.where(F.col("key").isNotNull()).join(places.select(F.col("place").alias("name")).distinct(), "name", "left_anti")
    return first_by(real, ["chapter", "key"], "line_no").select("chapter", "key", "name")


def book_names(found: DataFrame, structural: DataFrame) -> DataFrame:
    """(name): every folded heading of the book that is not keyed, no chapter's title and not in the structural list (name).

    A book that heads nothing is an error: a filter that removes everything would pass for an empty list.
    """
    plain = found.where(F.col("key").isNull() & ~F.rlike("heading", F.lit(TITLE))).select(alias_key(F.col("heading")).alias("name"))
    names = plain.where(F.col("name") != "").join(structural.select(alias_key(F.col("name")).alias("name")).distinct(), "name", "left_anti").distinct()
    if names.isEmpty():
        raise ValueError("the book heads no name")
    return names


def structure_report(spanned: DataFrame, cut: DataFrame, keyed: DataFrame, depths: DataFrame) -> DataFrame:
    """(chapter, area_depth, qualified, headings, sections, keyed): what the splitter derives of each chapter."""
    count = lambda df, name: df.groupBy("chapter").agg(F.count("*").alias(name))
    rows = depths.join(count(spanned, "headings"), "chapter", "left").join(count(cut, "sections"), "chapter", "left")
    held = rows.join(count(keyed.where(F.col("key").isNotNull()), "keyed"), "chapter", "left")
    return held.select("chapter", "area_depth", "qualified", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("headings", "sections", "keyed")))


def containment_report(found: DataFrame) -> DataFrame:
    """(part, outcome, n): whether sub-areas lie deeper than their areas, and unkeyed headings deeper than the keyed one before.

    Found (chapter, line_no, depth, key). A sub-area's key ends in a small letter, its area's key is that without the letter;
    an area that has no heading makes an orphan. A shallower unkeyed heading ends its keyed one.
    """
    first = first_by(found.where(F.col("key").isNotNull()), ["chapter", "key"], "line_no").select("chapter", "key", "depth")
    subs = first.where(F.rlike("key", F.lit("[a-z]$"))).withColumn("stem", F.expr("substring(key, 1, length(key) - 1)"))
    areas = first.select("chapter", F.col("key").alias("stem"), F.col("depth").alias("above"))
    how = lambda d, a: F.when(a.isNull(), "orphan").when(d > a, "deeper").when(d == a, "same").otherwise("shallower")
    inside = subs.join(areas, ["chapter", "stem"], "left").select(F.lit("sub-area").alias("part"), how(F.col("depth"), F.col("above")).alias("outcome"))
    order = Window.partitionBy("chapter").orderBy("line_no")
    run = found.withColumn("run", F.sum(F.col("key").isNotNull().cast("int")).over(order)).where("run > 0")
    in_run = Window.partitionBy("chapter", "run").orderBy("line_no")
    led = run.withColumn("lead", F.first("depth").over(in_run)).withColumn("ended", F.max((F.col("key").isNull() & (F.col("depth") < F.first("depth").over(in_run))).cast("int")).over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
    after = led.where(F.col("key").isNull() & (F.coalesce("ended", F.lit(0)) == 0)).select(F.lit("follower").alias("part"), how(F.col("depth"), F.col("lead")).alias("outcome"))
    return inside.union(after).groupBy("part", "outcome").agg(F.count("*").alias("n"))


def keys_for(candidates: DataFrame, keyed: DataFrame) -> DataFrame:
    """(id, key, undecidable) of candidates (id, chapter, section, name) among a chapter's keyed sections (chapter, section, key, name).

    A section's own heading decides first; else a name that the chapter keys once is that place wherever it stands; a name of
    several keys, mentioned from none of their sections, is undecidable. Names are compared as slugs.
    """
    places = keyed.where(F.col("key").isNotNull()).select("chapter", "section", "key", slug(F.col("name")).alias("place"))
    own = places.groupBy("chapter", "section", "place").agg(F.min("key").alias("own"))
    held = places.groupBy("chapter", "place").agg(F.countDistinct("key").alias("n"), F.min("key").alias("only"))
    asked = candidates.withColumn("place", slug(F.col("name"))).join(own, ["chapter", "section", "place"], "left").join(held, ["chapter", "place"], "left")
    key = F.coalesce("own", F.when(F.col("n") == 1, F.col("only")))
    return asked.select("id", key.alias("key"), (key.isNull() & F.coalesce(F.col("n") > 1, F.lit(False))).alias("undecidable"))


def reassembled(blocks: DataFrame) -> DataFrame:
    """(chapter, text) from a reader's slices (chapter, offset, content, total), checked against the total that it states.

    Slices are exact, so they are joined as they are, in order. A text of another length than stated is an error.
    """
    slices = F.array_sort(F.collect_list(F.struct("offset", "content")))
    whole = blocks.groupBy("chapter").agg(F.array_join(F.transform(slices, lambda b: b.content), "").alias("text"), F.max("total").alias("total"))
    bad = whole.where(F.col("total").isNotNull() & (F.char_length("text") != F.col("total"))).select("chapter").take(3)
    if bad:
        raise ValueError(f"slices do not add up: {[r.chapter for r in bad]}")
    return whole.select("chapter", "text")


def without_frame(response: Column, header_lines: int, notice: str) -> Column:
    """A response's slice: without its header lines and from its truncation notice (a pattern) on; blanks of the slice stay."""
    body = F.regexp_replace(response, rf"^(?:[^\n]*\n){{{header_lines}}}\n?", "")
    return F.regexp_replace(body, rf"(?s){notice}.*$", "")


def gazetteer_document(entries: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, counts): index entries (name, entity_type, aliases) with what their pages (title, exists, redirect) say, as JSON lines.

    Counts (entries, fetched, page_exists, redlinks, redirects) are one row.
    """
    page = pages.select(F.col("title").alias("name"), F.lit(True).alias("got"), "exists", "redirect")
    held = entries.join(page, "name", "left").withColumn("fetched", F.coalesce("got", F.lit(False)))
    there = F.coalesce(F.col("exists"), F.lit(False))
    row = F.to_json(F.struct("name", "aliases", "entity_type", "fetched", there.alias("page_exists"), F.col("redirect").alias("redirect_to")))
    count = lambda c: F.count(F.when(c, 1))
    counts = held.agg(F.count("*").alias("entries"), count(F.col("fetched")).alias("fetched"), count(there).alias("page_exists"), count(F.col("fetched") & ~there).alias("redlinks"), count(F.col("redirect").isNotNull()).alias("redirects"))
    return held.select("name", row.alias("entry")), counts


def keyed_headings(chapters: DataFrame) -> DataFrame:
    """The headings of chapters (chapter, text), with keys by each chapter's own scheme."""
    return sections.keyed(sections.headings(chapters), sections.key_shapes(chapters))
