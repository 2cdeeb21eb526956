"""Reads over a property graph of ``entities`` (id, name, entity_type) and ``edges`` (src, rel_type, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.plan import durable, small


def search(entities: DataFrame, text: str, types: tuple[str, ...] = (), limit: int | None = None, fields: tuple[str, ...] = ("name",)) -> DataFrame:
    """Case-insensitive substring search; prefix matches of the name come first, then ids decide."""
    wanted = F.lower(F.lit(text))
    hit = reduce(Column.__or__, (F.contains(F.lower(F.col(f)), wanted) for f in fields))
    found = entities.where(hit)
    if types:
        found = found.where(F.col("entity_type").isin(*types))
    ranked = found.withColumn("prefix_rank", F.when(F.startswith(F.lower("name"), wanted), 0).otherwise(1))
    return ranked.orderBy("prefix_rank", "id").limit(limit) if limit else ranked


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, to, src, rel_type, dst): every edge from both of its ends, in one scan; a self-loop from one."""
    ends = F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.when(F.col("src") != F.col("dst"), F.struct(F.col("dst").alias("at"), F.col("src").alias("to"))))
    return edges.select("src", "rel_type", "dst", F.inline(F.array_compact(ends)))


def neighbors(edges: DataFrame, starts: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(start, id, path, length): distinct (neighbour, relations passed, length) over trails of up to ``hops`` edges.

    A trail uses an edge once at most; nodes may repeat, so a start can be its own neighbour. Each hop is one scan of the edges
    against the frontier, which is counted: a small one is sent to every task, a large one is shuffled. Edges are named only
    where the frontier meets them, and the frontier is written after each hop.
    """
    steps = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "rel_type", "dst") if directed else both_ways(edges)
    none = F.array().cast("array<string>")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), none.alias("path"), none.alias("used"))
    found = []
    for hop in range(hops):
        edge = F.concat_ws("|", "src", "rel_type", "dst")
        met = steps.join(small(front), F.col("end") == F.col("at")).where(~F.array_contains("used", edge))
        front = met.select("start", F.col("to").alias("end"), F.concat("path", F.array("rel_type")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
        if hop + 1 < hops:
            front = durable(front)
        found.append(front.select("start", F.col("end").alias("id"), F.array_join("path", ">").alias("path"), F.size("path").alias("length")))
    return reduce(DataFrame.unionByName, found).distinct()


def induced(entities: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes by id, and the edges with both ends among them."""
    nodes = entities.orderBy("id").limit(limit)
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inside.select("src", "rel_type", "dst")


def shared_or_owned(entities: DataFrame, belongs: DataFrame, tenant: str, scoped: tuple[str, ...]) -> DataFrame:
    """Entities of a tenant, or not of a scoped type; a null type is shared, so the null test is explicit."""
    own = belongs.where(F.col("tenant") == tenant).select("id").distinct().withColumn("own", F.lit(True))
    kept = F.col("own") | F.col("entity_type").isNull() | ~F.col("entity_type").isin(*scoped)
    return entities.join(own, "id", "left").where(kept).drop("own")


def overlay(shared: DataFrame, patches: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Shared entities with a tenant's sparse patches (canon_id, and columns that may be null) laid over them."""
    patch = patches.select(F.col("canon_id").alias("id"), F.lit(True).alias("patched"), *(F.col(c).alias(f"new_{c}") for c in columns))
    laid = shared.join(patch, "id", "left")
    rest = [c for c in shared.columns if c not in columns]
    return laid.select(*rest, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns), F.coalesce("patched", F.lit(False)).alias("patched"))


def shadowed(canon: DataFrame, campaign: DataFrame, resolvable: tuple[str, ...]) -> DataFrame:
    """Canon edges, but for those of resolvable relations that the campaign settles for the same source, and campaign edges."""
    settled = campaign.where(F.col("rel_type").isin(*resolvable)).select(F.coalesce("source_canon_id", "src").alias("src"), "rel_type").distinct()
    kept = canon.join(settled, ["src", "rel_type"], "left_anti").select("src", "rel_type", "dst", F.lit("canon").alias("plane"))
    return kept.unionByName(campaign.select("src", "rel_type", "dst", F.lit("campaign").alias("plane")))


def revealed(edges: DataFrame, nodes: DataFrame, session: int) -> DataFrame:
    """Edges that are revealed by a session, and both of whose ends are."""
    known = nodes.where(F.col("revealed").isNotNull() & (F.col("revealed") <= session)).select("id")
    told = edges.where(F.col("revealed").isNotNull() & (F.col("revealed") <= session))
    return told.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def layer_intersections(edges: DataFrame, layers: DataFrame, least: int) -> DataFrame:
    """(id, layers, n_layers): nodes that edges of at least so many layers touch, at either end."""
    typed = edges.join(small(layers.select("rel_type", "layer")), "rel_type")
    ends = typed.select(F.explode(F.array("src", "dst")).alias("id"), "layer")
    found = ends.groupBy("id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    return found.where(F.size("layers") >= least).withColumn("n_layers", F.size("layers"))


def both_directions(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, rel_type, direction): the edges at each id, from either end."""
    out = edges.join(ids, edges.src == ids.id, "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type", F.lit("out").alias("direction"))
    back = edges.join(ids, edges.dst == ids.id, "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel_type", F.lit("in").alias("direction"))
    return out.union(back).distinct()


def pair_folds(edges: DataFrame) -> DataFrame:
    """(a, b, relations, n_edges): edges folded onto unordered pairs."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type")
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("relations"), F.count("*").alias("n_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, depth): the whole chain of parents of each start, one join a level until no row is left.

    A parent that a chain has passed before ends it, so cycles end too. Each level is written, and counted, once.
    """
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("seen"))
    up = parents.where(F.col("parent").isNotNull()).select(F.col("id").alias("at"), "parent")
    found = []
    while True:
        front = durable(front.join(up, "at").where(~F.array_contains("seen", F.col("parent"))).select("start", F.col("parent").alias("at"), F.concat("seen", F.array("parent")).alias("seen")))
        if front.isEmpty():
            break
        found.append(front.select("start", F.col("at").alias("id"), F.lit(len(found) + 1).alias("depth")))
    empty = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).where("false")
    return reduce(DataFrame.unionByName, found, empty)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:  # noqa: ANN002
    """The first row of each key in an order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
