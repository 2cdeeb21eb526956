"""Query classification, keywords and the strategy that a class asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases that count for each class, and what one counts.
PHRASES: dict[str, tuple[float, tuple[str, ...]]] = {
    "rules_lookup": (1.0, (
        "how does", "how do", "what is", "what are", "explain", "rule", "rules", "mechanic", "mechanics", "work",
        "can i", "can you", "is it possible", "allowed", "damage", "attack", "saving throw", "ability check",
        "spell", "spells", "casting", "concentration", "action", "bonus action", "reaction", "movement",
        "condition", "conditions", "advantage", "disadvantage",
    )),
    "campaign_state": (1.5, (
        "where is", "where are", "current", "now", "right now", "status", "location", "what does", "who is",
        "inventory", "have", "possess", "carrying",
    )),
    "campaign_history": (1.5, (
        "what happened", "when did", "last time", "previously", "remember", "before", "history", "past", "session",
        "did we", "did they", "did i",
    )),
    "encounter_generation": (2.0, ("create", "generate", "design", "build", "make", "encounter", "combat", "fight", "battle", "ambush")),
    "npc_generation": (1.5, ("npc", "character", "person", "merchant", "innkeeper", "villain", "ally", "contact", "quest giver")),
    "entity_info": (0.0, ()),
}
MAKING, FIGHTING = PHRASES["encounter_generation"][1][:5], PHRASES["encounter_generation"][1][5:]
#: Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "just", "and", "but", "if", "or", "because", "until", "while", "about", "against", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "i", "me", "my", "myself", "we", "our", "ours", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they",
    "them", "their",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def scores(question: Column) -> dict[str, Column]:
    text = F.lower(question)
    found = {}
    for name, (weight, phrases) in PHRASES.items():
        hits = F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))) if phrases else F.lit(0)
        found[name] = hits * F.lit(weight)
    makes = _any(text, MAKING) & _any(text, PHRASES["npc_generation"][1]) & ~_any(text, FIGHTING)
    found["npc_generation"] = found["npc_generation"] + F.when(makes, 2.5).otherwise(0.0)
    found["entity_info"] = F.when(F.rlike(text, F.lit(r"(tell me about|what is|who is|describe)\s+\w+")), 1.0).otherwise(0.0)
    return found


def classified(questions: DataFrame, column: str = "text") -> DataFrame:
    """Adds query_type and confidence: the first class with the highest score; ``unknown`` under a half."""
    held = questions.withColumn("__s", F.struct(*(v.alias(k) for k, v in scores(F.col(column)).items())))
    best = F.greatest(*(F.col(f"__s.{k}") for k in PHRASES))
    name = F.coalesce(*(F.when(F.col(f"__s.{k}") == best, F.lit(k)) for k in PHRASES))
    low = best < 0.5
    return held.withColumn("query_type", F.when(low, "unknown").otherwise(name)).withColumn("confidence", F.when(low, 0.3).otherwise(F.least(F.lit(1.0), best / 3.0))).drop("__s")


def keywords(question: Column, most: int = 10) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)), 1, most)


def strategies(spark: SparkSession) -> DataFrame:
    """(query_type, use_vector, use_graph, depth, vector_k, graph_k): one row a class."""
    # Fixed values.
    rows = [
        ("rules_lookup", True, False, 2, 7, 0), ("campaign_state", False, True, 2, 0, 10), ("campaign_history", True, True, 2, 5, 5),
        ("entity_info", True, True, 3, 3, 8), ("encounter_generation", True, False, 2, 10, 0), ("npc_generation", False, True, 1, 0, 5), ("unknown", True, True, 2, 5, 5),
    ]
    return spark.createDataFrame(rows, "query_type string, use_vector boolean, use_graph boolean, depth int, vector_k int, graph_k int")
