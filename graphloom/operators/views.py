"""Filters, projections and small aggregations over nodes, edges, mentions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lookup import bounded


def by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the ids (id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def found_npcs(nodes: DataFrame, text: str | None = None, hostile: bool = False, with_stats: bool = False, active: bool = False, guild: str | None = None, limit: int | None = None) -> DataFrame:
    """NPCs by what is asked for only: a word of the name or description, hostility, a stat block, being active, a guild; by id."""
    found = nodes.where(F.col("entity_type") == "NPC")
    if text is not None:
        holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
        found = found.where(holds("name") | holds("description"))
    if hostile:
        found = found.where(F.col("disposition") == "hostile")
    if with_stats:
        found = found.where(F.col("stat_block").isNotNull())
    if active:
        found = found.where("active")
    if guild is not None:
        found = found.where(F.array_contains("guilds", F.lit(guild)))
    return found.orderBy("id").limit(limit) if limit else found


def as_tenant_rows(nodes: DataFrame) -> DataFrame:
    """Overlay rows as a tenant sees them: the id of the shared entity is not shown."""
    return nodes.drop("canon_id")


def confident(rows: DataFrame, least: float = 0.5) -> DataFrame:
    return rows.where(F.col("confidence") >= least)


def is_accepted() -> Column:
    """A missing status is proposed, never accepted."""
    return F.coalesce("status", F.lit("")) == "accepted"


def split_by_status(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edges.where(is_accepted()), edges.where(~is_accepted())


def with_proposed(edges: DataFrame, include: bool) -> DataFrame:
    """All edges, or only accepted ones where proposals are switched off."""
    return edges if include else edges.where(is_accepted())


def labels_in_use(nodes: DataFrame) -> DataFrame:
    """(label): every label that a node (labels) wears."""
    return nodes.select(F.explode("labels").alias("label")).distinct()


def relations_in_use(edges: DataFrame) -> DataFrame:
    """(rel_type, n, accepted): how many edges of each relation there are, and whether one of them is accepted."""
    return edges.groupBy("rel_type").agg(F.count("*").alias("n"), F.bool_or(is_accepted()).alias("accepted"))


def layer_vocabulary(relations: DataFrame) -> DataFrame:
    """(layer, relations): the sorted relations of each layer; those without one are left out."""
    held = relations.where(F.col("layer").isNotNull()).groupBy("layer").agg(F.array_sort(F.collect_set("rel_type")).alias("r"))
    return held.select("layer", F.array_join("r", ",").alias("relations"))


def messages_with(messages: DataFrame, text: str) -> DataFrame:
    return messages.where(F.contains(F.lower("text"), F.lower(F.lit(text))))


def expanded(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (id, other, rel_type, direction, status) of each id within a limit: accepted ones first, then by name; ``cut`` counts the rest."""
    return bounded(edges, ["id"], limit, ~is_accepted(), F.col("other"), F.col("rel_type"), F.col("direction"))


def loudest(found: DataFrame, limit: int) -> DataFrame:
    """The sections that name each id most often, then in reading order."""
    return bounded(found, ["id"], limit, F.desc("occurrences"), F.col("section_id"))


def without_leaks(edges: DataFrame, nodes: DataFrame, belongs: DataFrame, tenant: str) -> DataFrame:
    """A tenant's own edges whose target is shared, or the tenant's own too: never another tenant's node."""
    own = belongs.where(F.col("tenant") == tenant).select("id").distinct()
    shared = nodes.where("plane = 'canon'").select("id")
    sources = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi")
    return sources.join(own.union(shared).distinct().withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel_type", "dst")


def entities_in_sections(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """(entity_id): who is mentioned in any of the sections (section_id)."""
    return mentions.join(sections.select("section_id").distinct(), "section_id", "left_semi").select("entity_id").distinct()


def allies_and_foes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id, allies, foes): sorted names of those an edge of either direction makes an ally or a foe."""
    ends = edges.where(F.col("rel_type").isin("ALLIED_WITH", "HOSTILE_TO", "ENEMY_OF"))
    both = ends.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type").union(ends.select("dst", "src", "rel_type"))
    named = both.join(names.select(F.col("id").alias("other"), "name"), "other").distinct()
    ally = F.when(F.col("rel_type") == "ALLIED_WITH", F.col("name"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return named.groupBy("id").agg(listed(ally).alias("allies"), listed(F.when(ally.isNull(), F.col("name"))).alias("foes"))


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"))


def running_cost(calls: DataFrame) -> DataFrame:
    """(session, calls, tokens, cost, unverified): totals of a session's calls; one unverified price makes the total unverified."""
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.bool_or("unverified").alias("unverified"))


def merged_ranks(lists: list[DataFrame], limit: int) -> DataFrame:
    """Scored rows (query_id, id, score) of several lists as one: the best score of an id, the first ``limit`` of a query."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    best = every.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return bounded(best, ["query_id"], limit, F.desc("score"), F.col("id"))


def partners(pairs: DataFrame) -> DataFrame:
    """(entity_id, partners, sections): with how many others an entity shares a sentence, and in how many sections, from ordered pairs (section_id, a, b)."""
    return pairs.groupBy(F.col("a").alias("entity_id")).agg(F.countDistinct("b").alias("partners"), F.countDistinct("section_id").alias("sections"))


def highlighted(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) one hop around the ids: edges with either end among them, and all their ends."""
    at = lambda end: edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi").select("src", "rel_type", "dst")
    near = at("src").union(at("dst")).distinct()
    return near.select(F.explode(F.array("src", "dst")).alias("id")).union(ids.select("id")).distinct(), near


def with_invented(overlaid: DataFrame, invented: DataFrame) -> DataFrame:
    """A tenant's view: shared entities with patches, and what the tenant made up; columns that one lacks are null."""
    return overlaid.unionByName(invented, allowMissingColumns=True)


def mention_uses(scanned: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, section_id, occurrences, first, names): a row a mention, with the sorted recorded spellings that the section uses."""
    known = aliases.select("entity_id", "name").distinct().withColumn("known", F.lit(True))
    held = scanned.join(known, ["entity_id", "name"], "left")
    used = F.array_join(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("name")))), ",")
    return held.groupBy("entity_id", "section_id").agg(F.count("*").alias("occurrences"), F.min("start").alias("first"), used.alias("names"))


def recall_by(rr: DataFrame, questions: DataFrame, column: str) -> DataFrame:
    """(column, questions, hits, mrr): reciprocal ranks (query_id, rr) broken down by what a question (query_id, column) needs."""
    held = rr.join(questions.select("query_id", column), "query_id")
    return held.groupBy(column).agg(F.count("*").alias("questions"), F.count(F.when(F.col("rr") > 0, 1)).alias("hits"), F.round(F.avg("rr"), 6).alias("mrr"))
