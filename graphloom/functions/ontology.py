"""The closed vocabulary: relation layers, type constraints and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The layer of each relation; relations not listed here have none.
LAYERS = {
    "spatial": ("LOCATED_IN", "CONTAINS", "CONNECTED_TO", "TRAVELED_TO"),
    "social": ("KNOWS", "ALLIED_WITH", "HOSTILE_TO", "ENEMY_OF", "MEMBER_OF", "SERVES", "RELATED_TO", "OWNS", "GUARDS", "WIELDS"),
    "narrative": ("SEEKS", "OPPOSES", "RESOLVES_TO", "PREREQUISITE_OF", "IDENTITY_OF", "THREATENS", "GAVE_QUEST", "COMPLETED", "OBJECTIVE_AT"),
}
#: Groups of types that the constraints name.
_ANIMATE = ("NPC", "MONSTER")
_AGENT = ("NPC", "MONSTER", "FACTION")
_PHYSICAL = ("NPC", "MONSTER", "ITEM", "LOCATION")
_CONTAINER = ("LOCATION", "ITEM")
#: Source types and target types that a relation allows.
ALLOWED = {
    "CONNECTED_TO": (("LOCATION",), ("LOCATION",)),
    "CONTAINS": (_CONTAINER, _PHYSICAL),
    "LOCATED_IN": ((*_PHYSICAL, "FACTION"), _CONTAINER),
    "TRAVELED_TO": (_AGENT, ("LOCATION",)),
    "ALLIED_WITH": (_AGENT, _AGENT),
    "ENEMY_OF": (_AGENT, _AGENT),
    "GUARDS": (_AGENT, _PHYSICAL),
    "HOSTILE_TO": (_AGENT, _AGENT),
    "KNOWS": (_ANIMATE, _ANIMATE),
    "MEMBER_OF": (_ANIMATE, ("FACTION",)),
    "OWNS": (_AGENT, ("ITEM", "LOCATION")),
    "RELATED_TO": (("NPC",), ("NPC",)),
    "SERVES": (_ANIMATE, _AGENT),
    "WIELDS": (_ANIMATE, ("ITEM",)),
    "COMPLETED": (_AGENT, ("QUEST",)),
    "GAVE_QUEST": (_AGENT, ("QUEST",)),
    "IDENTITY_OF": (_ANIMATE, _ANIMATE),
    "OBJECTIVE_AT": (("QUEST",), ("LOCATION",)),
    "OPPOSES": (_AGENT, _AGENT),
    "PREREQUISITE_OF": (("QUEST", "EVENT"), ("QUEST", "EVENT")),
    "RESOLVES_TO": (("ITEM", "QUEST", "EVENT"), ("LOCATION", "NPC", "ITEM")),
    "SEEKS": (_AGENT, (*_PHYSICAL, "QUEST", "LORE")),
    "THREATENS": (_AGENT, (*_PHYSICAL, "FACTION")),
}
#: Relations that exclude each other between the same ordered endpoints.
EXCLUSIVE = (("IDENTITY_OF", "RELATED_TO"), ("CONTAINS", "LOCATED_IN"))
#: Fixed value: relations whose campaign edges replace the shared ones.
RESOLVABLE = ("RESOLVES_TO",)


def relation_types(spark: SparkSession) -> DataFrame:
    """(rel_type, layer, domain, range): one row a relation of the vocabulary; small by construction, so safe to broadcast."""
    layer = {r: k for k, rs in LAYERS.items() for r in rs}
    rows = [(r, k, *((list(a) for a in ALLOWED[r]) if r in ALLOWED else (None, None))) for r, k in layer.items()]
    words = T.ArrayType(T.StringType())
    kinds = [("rel_type", T.StringType()), ("layer", T.StringType()), ("domain", words), ("range", words)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in kinds]))


LAYERS_SQL = "layers(rel_type, layer) AS (VALUES " + ", ".join(f"('{r}', '{k}')" for k, rs in LAYERS.items() for r in rs) + ")"
