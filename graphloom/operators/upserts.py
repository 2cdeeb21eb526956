"""Writes as functional rewrites: each gives the new table, to be written to a new place and swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.plan import small


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert or update by key: a null in ``changes`` leaves the old value."""
    rest = [c for c in base.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"new_{c}") for c in rest if c in changes.columns))
    joined = base.join(new, key, "full_outer")
    return joined.select(key, *(F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in rest))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone`` (id), and edges that touch none of them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """Merge edges by triple: both ends have to exist; the layer comes from the vocabulary."""
    ids = nodes.select("id")
    sound = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    triples = edges.select("src", "rel_type", "dst").unionByName(sound.select("src", "rel_type", "dst")).distinct()
    return triples.join(small(layers.select("rel_type", "layer")), "rel_type", "left").select("src", "rel_type", "dst", "layer")


def require_endpoints(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows, or an error if any of them names a node that is not there."""
    missing = rows.join(nodes.select(F.col("id").alias(column)), column, "left_anti")
    first = missing.select(column).take(3)
    if first:
        raise ValueError(f"no node for {column}: {[r[0] for r in first]}")
    return rows


def label_union(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Labels accumulate, a rung is replaced only by a new one, the artifact flag is only ever set."""
    side = new.select("id", F.col("labels").alias("l"), F.col("rung").alias("r"), F.col("is_artifact").alias("a"))
    joined = nodes.join(side, "id", "full_outer")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("labels", none), F.coalesce("l", none)))
    flag = F.coalesce("is_artifact", F.lit(False)) | F.coalesce("a", F.lit(False))
    return joined.select("id", labels.alias("labels"), F.coalesce("r", "rung").alias("rung"), flag.alias("is_artifact"))


def sole_owned(owners: DataFrame, chapter: str) -> DataFrame:
    """(id): entities that only this chapter owns, so that deleting the chapter may delete them."""
    held = owners.groupBy("id").agg(F.count_distinct("chapter").alias("n"), F.max("chapter").alias("chapter"))
    return held.where((F.col("n") == 1) & (F.col("chapter") == chapter)).select("id")


def missing_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (entity_id, name) pairs to add."""
    return wanted.select("entity_id", "name").distinct().join(aliases, ["entity_id", "name"], "left_anti")
