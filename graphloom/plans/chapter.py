"""A chapter's write plan: candidates in, nodes and edges and an account of every row out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ontology, text
from graphloom.operators import candidates
from graphloom.operators.plan import small


class WritePlan(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    account: DataFrame


def write_plan(nodes: DataFrame, edges: DataFrame, relations: DataFrame, gazetteer: DataFrame, chapter: str) -> WritePlan:
    """Stages over nodes (name, entity_type, key, votes, seq) and edges (source, rel_type, target, status).

    Nodes: names outside the gazetteer (name) go unless they have a key; ids are minted; the spelling of most votes, then the
    earliest, stands for an id. Edges: self-loops, forbidden types, and ends that name no node, or more than one, go; equal
    triples are one, accepted before proposed; conflicts are marked; nodes get their status. The account has a row for each
    outcome of nodes and edges, and its numbers add up to the candidates.
    """
    key = lambda c: text.alias_key(F.col(c))
    known = gazetteer.select(key("name").alias("folded")).distinct().withColumn("known", F.lit(True))
    minted = nodes.withColumn("folded", key("name")).withColumn("id", text.entity_id(F.col("name"), F.lit(chapter), F.col("key")))
    listed = minted.join(known, "folded", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("key").isNull() & F.col("known").isNull(), F.desc("votes"), "seq"))
    staged = candidates.staged_drops(listed.withColumn("nth", rank), [("gazetteer", F.col("known").isNull() & F.col("key").isNull()), ("merged", F.col("nth") > 1)])
    kept = staged.where(F.col("drop_reason").isNull()).select("id", "name", "entity_type", "key", "folded")

    # A spelling that was merged away still names its node.
    names = staged.where(F.coalesce("drop_reason", F.lit("")) != "gazetteer").groupBy("folded").agg(F.collect_set("id").alias("ids"), F.first("entity_type").alias("type"))
    end = lambda c: names.select(F.col("folded").alias(f"{c}_key"), F.col("ids").alias(f"{c}_ids"), F.col("type").alias(f"{c}_type"))
    rules = small(relations.select("rel_type", "domain", "range"))
    joined = edges.withColumn("source_key", key("source")).withColumn("target_key", key("target")).join(end("source"), "source_key", "left").join(end("target"), "target_key", "left").join(rules, "rel_type", "left")
    fits = candidates._fits(F.col("source_type"), F.col("domain")) & candidates._fits(F.col("target_type"), F.col("range"))
    count = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    first = F.row_number().over(Window.partitionBy("source_key", "rel_type", "target_key").orderBy(F.coalesce("status", F.lit("proposed")) != "accepted", "source", "target"))
    marked = candidates.staged_drops(
        joined.withColumn("nth", first),
        [
            ("self_loop", F.col("source_key") == F.col("target_key")),
            ("constraint", ~fits),
            ("unknown_end", (count("source_ids") == 0) | (count("target_ids") == 0)),
            ("ambiguous_end", (count("source_ids") > 1) | (count("target_ids") > 1)),
            ("duplicate", F.col("nth") > 1),
        ],
    )
    sound = marked.where(F.col("drop_reason").isNull()).select(F.col("source_ids")[0].alias("src"), "rel_type", F.col("target_ids")[0].alias("dst"), "status")
    judged = candidates.marked_conflicts(sound, ontology.EXCLUSIVE)
    account = candidates.accounting(staged).withColumn("part", F.lit("node")).unionByName(candidates.accounting(marked).withColumn("part", F.lit("edge")))
    return WritePlan(candidates.node_status(kept, judged).drop("folded"), judged, account)
