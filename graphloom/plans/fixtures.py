"""A property graph over the star-schema tables, and the same graph as SQL common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Node kind: (table, key column, name column, entity type).
NODES = {
    "region": ("region", "r_regionkey", "r_name", "LOCATION"),
    "nation": ("nation", "n_nationkey", "n_name", "LOCATION"),
    "customer": ("customer", "c_custkey", "c_name", "NPC"),
    "supplier": ("supplier", "s_suppkey", "s_name", "FACTION"),
    "part": ("part", "p_partkey", "p_name", "ITEM"),
    "order": ("orders", "o_orderkey", "o_orderpriority", "QUEST"),
}
#: Edge: (table, source kind, source key, relation, target kind, target key).
EDGES = (
    ("nation", "nation", "n_nationkey", "LOCATED_IN", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "LOCATED_IN", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "LOCATED_IN", "nation", "s_nationkey"),
    ("orders", "customer", "o_custkey", "OWNS", "order", "o_orderkey"),
    ("lineitem", "order", "l_orderkey", "CONTAINS", "part", "l_partkey"),
    ("lineitem", "supplier", "l_suppkey", "SERVES", "part", "l_partkey"),
)


def entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(NODES)) -> DataFrame:
    """(id, name, entity_type, kind, key)."""
    parts = [
        table(spark, sf_dir, t).select(
            F.concat(F.lit(f"{k}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"),
            F.lit(k).alias("kind"), F.col(key).cast("long").alias("key"),
        )
        for k, (t, key, name, kind) in NODES.items()
        if k in kinds
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(src, rel_type, dst), each triple once. Only the line items repeat triples, so only they are made distinct."""
    parts = []
    for t, source, skey, rel, target, tkey in EDGES:
        if relations and rel not in relations:
            continue
        keys = table(spark, sf_dir, t).select(F.col(skey).alias("s"), F.col(tkey).alias("d"))
        keys = keys.distinct() if t == "lineitem" else keys  # numbers are made distinct, not the names that are made of them
        parts.append(keys.select(F.concat(F.lit(f"{source}:"), F.col("s").cast("string")).alias("src"), F.lit(rel).alias("rel_type"), F.concat(F.lit(f"{target}:"), F.col("d").cast("string")).alias("dst")))
    return reduce(DataFrame.unionByName, parts)


ENTITIES_SQL = "entities AS (" + " UNION ALL ".join(
    f"SELECT '{k}:' || CAST({key} AS VARCHAR) AS id, {name} AS name, '{kind}' AS entity_type, '{k}' AS kind, CAST({key} AS BIGINT) AS key FROM {t}"
    for k, (t, key, name, kind) in NODES.items()
) + ")"
EDGES_SQL = "edges AS (" + " UNION ALL ".join(
    f"SELECT {'DISTINCT ' if t == 'lineitem' else ''}'{s}:' || CAST({sk} AS VARCHAR) AS src, '{rel}' AS rel_type, '{d}:' || CAST({dk} AS VARCHAR) AS dst FROM {t}"
    for t, s, sk, rel, d, dk in EDGES
) + ")"
GRAPH_SQL = f"WITH {ENTITIES_SQL}, {EDGES_SQL}"
GRAPH_RECURSIVE_SQL = f"WITH RECURSIVE {ENTITIES_SQL}, {EDGES_SQL}"
