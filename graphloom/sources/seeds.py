"""Hand-written dimensions: seeds in YAML and catalogues of constant lists. They are small, and read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed(spark: SparkSession, documents: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of seeds by file name, each with ``nodes`` (name, type, aliases, key) and ``edges`` (source, type, target).

    A node without a name or type, an edge without an end, an end that names no node, or a name that two nodes of one type
    claim is an error that names its file.
    """
    import yaml

    nodes, edges = [], []
    for file, text in sorted(documents.items()):
        body = yaml.safe_load(text) or {}
        for n in body.get("nodes") or []:
            if not n.get("name") or not n.get("type"):
                raise ValueError(f"{file}: a node needs a name and a type: {n}")
            nodes.append((str(n["name"]), str(n["type"]).upper(), [str(a) for a in n.get("aliases") or []], str(n["key"]) if n.get("key") else None, file))
        for e in body.get("edges") or []:
            if not all(e.get(k) for k in ("source", "type", "target")):
                raise ValueError(f"{file}: an edge needs a source, a type and a target: {e}")
            edges.append((str(e["source"]), str(e["type"]).upper(), str(e["target"]), file))
    names = [n[0].lower() for n in nodes]
    claimed = {(n[0].lower(), n[1]) for n in nodes}
    if len(claimed) < len(nodes):
        raise ValueError(f"names claimed twice: {sorted({n for n in names if names.count(n) > 1})[:5]}")
    lost = [e for e in edges if e[0].lower() not in set(names) or e[2].lower() not in set(names)]
    if lost:
        raise ValueError(f"{lost[0][3]}: no node for {lost[0][0]!r} or {lost[0][2]!r}")
    return (
        spark.createDataFrame(nodes, "name string, entity_type string, aliases array<string>, key string, file string"),
        spark.createDataFrame(edges, "source string, rel_type string, target string, file string"),
    )


def listed_names(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """(name, value, file) of flat YAML: a list of names, or a mapping of names to one value or several."""
    import yaml

    rows = []
    for file, text in sorted(documents.items()):
        body = yaml.safe_load(text) or []
        pairs = body.items() if isinstance(body, dict) else ((n, None) for n in body)
        for name, value in pairs:
            rows += [(str(name), None if v is None else str(v), file) for v in (value if isinstance(value, list) else [value])]
    return spark.createDataFrame(rows, "name string, value string, file string")


def catalogue(lists: dict[str, DataFrame], specialties: dict[str, tuple[str, ...]]) -> DataFrame:
    """(specialty, ...): the rows of the lists that each specialty draws from; a list may serve several."""
    out = None
    for specialty, names in specialties.items():
        for name in names:
            part = lists[name].withColumn("specialty", F.lit(specialty))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no specialty")
    return out
