"""From candidate nodes and edges to a graph: votes, constraints, conflicts, duplicates, status, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.plan import small


def consensus(samples: DataFrame, keys: list[str], record: list[str], least: int) -> DataFrame:
    """Keys seen in at least so many different samples, with their votes and the first record seen (by ``seq``)."""
    voted = samples.groupBy(*keys).agg(F.countDistinct("sample_id").alias("votes"), F.min_by(F.struct(*record), F.col("seq")).alias("r"))
    return voted.where(F.col("votes") >= least).select(*keys, "votes", *(F.col(f"r.{c}").alias(c) for c in record))


def vote_histogram(samples: DataFrame, keys: list[str]) -> DataFrame:
    voted = samples.groupBy(*keys).agg(F.countDistinct("sample_id").alias("votes"))
    return voted.groupBy("votes").agg(F.count("*").alias("n"))


def _fits(types: Column, allowed: Column) -> Column:
    """An endpoint without a type, or a relation without a rule, is let pass."""
    return types.isNull() | allowed.isNull() | F.array_contains(F.coalesce(allowed, F.array().cast("array<string>")), F.coalesce(types, F.lit("")))


def constraint_report(edges: DataFrame, types: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges that a relation's domain or range forbids: reason, and whether the reverse edge would pass."""
    rules = small(relations.select("rel_type", "domain", "range"))
    typed = edges.join(types.toDF("src", "src_type"), "src", "left").join(types.toDF("dst", "dst_type"), "dst", "left").join(rules, "rel_type", "left")
    source, target = _fits(F.col("src_type"), F.col("domain")), _fits(F.col("dst_type"), F.col("range"))
    reason = F.when(~source & ~target, "both").when(~source, "domain").when(~target, "range")
    turned = _fits(F.col("dst_type"), F.col("domain")) & _fits(F.col("src_type"), F.col("range"))
    return typed.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("src", "rel_type", "dst", "reason", turned.alias("reversal_would_pass"))


def exclusive_conflicts(edges: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(src, dst, first, second): ordered endpoints that carry two relations which exclude each other."""
    held = edges.groupBy("src", "dst").agg(F.collect_set("rel_type").alias("held"))
    found = F.array(*(F.struct(F.lit(min(p)).alias("first"), F.lit(max(p)).alias("second")) for p in pairs))
    both = held.select("src", "dst", F.explode(F.filter(found, lambda p: F.array_contains("held", p.first) & F.array_contains("held", p.second))).alias("p"))
    return both.select("src", "dst", "p.first", "p.second")


def marked_conflicts(edges: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Status after conflicts: an accepted edge stands against a proposed rival, two equals are both conflicted."""
    groups = {r: i for i, p in enumerate(pairs) for r in p}
    group = F.lit(None).cast("int")
    for rel, i in groups.items():
        group = F.when(F.col("rel_type") == rel, i).otherwise(group)
    status = F.coalesce("status", F.lit("proposed"))
    by = Window.partitionBy("src", "dst", "group")
    rivals = F.size(F.collect_set("rel_type").over(by)) > 1
    accepted = F.sum(F.when(status == "accepted", 1).otherwise(0)).over(by)
    lost = F.col("group").isNotNull() & rivals & ((status != "accepted") | (accepted > 1))
    return edges.withColumn("group", group).withColumn("status", F.when(lost, "conflicted").otherwise(status)).drop("group")


def merge_plan(nodes: DataFrame, key: Column) -> DataFrame:
    """(loser, survivor): nodes of one folded name; the longest name survives, then the smallest id."""
    folded = nodes.withColumn("folded", key)
    best = folded.groupBy("folded").agg(F.count("*").alias("n"), F.min_by("id", F.struct(-F.length("name"), "id")).alias("survivor")).where("n > 1")
    return folded.join(best, "folded").where(F.col("id") != F.col("survivor")).select(F.col("id").alias("loser"), "survivor")


def repoint(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges with losers replaced by survivors: self-loops that arise go, and triples are single again."""
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(plan.select(F.col("loser").alias(end), F.col("survivor").alias(f"new_{end}")), end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    return moved.where(F.col("src") != F.col("dst")).select("src", "rel_type", "dst").distinct()


def fold_mentions(found: DataFrame, plan: DataFrame) -> DataFrame:
    """Mentions (entity_id, section_id, offsets) after a merge: one a section, the offsets united and in order."""
    ids = plan.select(F.col("loser").alias("entity_id"), "survivor")
    moved = found.join(ids, "entity_id", "left").withColumn("entity_id", F.coalesce("survivor", "entity_id"))
    return moved.groupBy("entity_id", "section_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def node_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node is accepted if it has a key or an accepted edge touches it; else proposed."""
    touched = edges.where(F.coalesce("status", F.lit("")) == "accepted").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    marked = nodes.join(touched.withColumn("touched", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("key").isNotNull() | F.col("touched"), "accepted").otherwise("proposed")).drop("touched")


def staged_drops(candidates: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Each candidate with the first stage that drops it, or null; so drops and writes add up to the candidates."""
    reason = reduce(lambda c, s: c.when(s[1], s[0]), stages[1:], F.when(stages[0][1], stages[0][0]))
    return candidates.withColumn("drop_reason", reason)


def accounting(staged: DataFrame) -> DataFrame:
    return staged.groupBy(F.coalesce("drop_reason", F.lit("written")).alias("outcome")).agg(F.count("*").alias("n"))


def legal_options(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, rel_type, direction): what a pair's types (a_type, b_type) allow; nothing between a node and itself."""
    rules = small(relations.where(F.col("domain").isNotNull()))
    fits = lambda s, t: F.array_contains("domain", F.col(s)) & F.array_contains("range", F.col(t))
    either = pairs.where("a <> b").join(rules, fits("a_type", "b_type") | fits("b_type", "a_type"))
    options = F.array_compact(F.array(F.when(fits("a_type", "b_type"), F.lit("out")), F.when(fits("b_type", "a_type"), F.lit("in"))))
    return either.select("a", "b", "rel_type", F.explode(options).alias("direction"))


def anchored(nodes: DataFrame) -> DataFrame:
    """Names that a layer other than a quest's own witnesses: (name, layers) for names seen in two layers at least."""
    seen = nodes.groupBy(F.lower("name").alias("name")).agg(F.collect_set("layer").alias("layers"))
    return seen.where(F.size("layers") >= 2)
