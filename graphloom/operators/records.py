"""JSON answers, profiles and messages as checked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import alias_key

_EXTRACTION = (
    "struct<entities:array<struct<type:string,text:string,canonical_name:string>>,"
    "relationships:array<struct<type:string,source:string,target:string,evidence:string>>>"
)


def extracted_entities(answers: DataFrame, types: tuple[str, ...], confidence: float = 0.8) -> DataFrame:
    """(doc_id, name, canonical, entity_type, confidence) from answers (doc_id, json): unknown types and empty texts are left out."""
    each = answers.select("doc_id", F.explode(F.from_json("json", _EXTRACTION).entities).alias("e"))
    kind = F.upper("e.type")
    return each.where(kind.isin(*types) & (F.coalesce("e.text", F.lit("")) != "")).select(
        "doc_id", F.col("e.text").alias("name"), F.coalesce("e.canonical_name", "e.text").alias("canonical"), kind.alias("entity_type"), F.lit(confidence).alias("confidence")
    )


def extracted_relations(answers: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(doc_id, source, rel_type, target, evidence): unknown relations and missing ends are left out; evidence is cut at 200."""
    each = answers.select("doc_id", F.explode(F.from_json("json", _EXTRACTION).relationships).alias("r"))
    kind = F.upper("r.type")
    ends = (F.coalesce("r.source", F.lit("")) != "") & (F.coalesce("r.target", F.lit("")) != "")
    return each.where(kind.isin(*relations) & ends).select("doc_id", F.col("r.source").alias("source"), kind.alias("rel_type"), F.col("r.target").alias("target"), F.substring("r.evidence", 1, 200).alias("evidence"))


def endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose ends, in any case, are known entities (name, id) of the same document."""
    known = lambda end: entities.select("doc_id", F.lower("name").alias(f"{end}_key"), F.col("id").alias(f"{end}_id")).dropDuplicates(["doc_id", f"{end}_key"])
    keyed = relations.withColumn("source_key", F.lower("source")).withColumn("target_key", F.lower("target"))
    return keyed.join(known("source"), ["doc_id", "source_key"]).join(known("target"), ["doc_id", "target_key"]).drop("source_key", "target_key")


def validated(answers: DataFrame, required: tuple[str, ...] = ("from_canon", "invented")) -> DataFrame:
    """Adds ``problem`` to (id, text): a fenced block is opened; what is not JSON, not an object, or lacks a part is named."""
    opened = F.regexp_replace(F.trim("text"), r"(?s)^```[^\n]*\n(.*?)\s*(?:```)?\s*$", "$1")
    body = F.trim(opened)
    problem = F.when(F.try_parse_json(body).isNull(), "not JSON").when(~F.startswith(body, F.lit("{")), "not an object")
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    for name in required:
        problem = problem.when(~F.array_contains(keys, name), f"no {name}")
    return answers.withColumn("problem", problem)


def decided(answers: DataFrame, options: DataFrame) -> DataFrame:
    """(batch, n, rel_type, source, target, outcome) for every pair of ``options`` (batch, n, option, rel_type, source, target).

    Answers (batch, seq, n, answer) are matched by their number, the first of a number counts, and only an offered option,
    whatever its case and spaces, is taken; ``NONE`` is a decision, anything else is none.
    """
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    first = answers.groupBy("batch", "n").agg(F.min_by("answer", "seq").alias("answer")).withColumn("chosen", fold("answer"))
    pairs = options.select("batch", "n").distinct()
    offered = options.withColumn("chosen", fold("option")).dropDuplicates(["batch", "n", "chosen"])
    found = pairs.join(first, ["batch", "n"], "left").join(offered, ["batch", "n", "chosen"], "left")
    outcome = F.when(F.coalesce("chosen", F.lit("")) == "", "unanswered").when(F.col("chosen") == "none", "none").when(F.col("option").isNull(), "off_vocabulary").otherwise("decided")
    return found.select("batch", "n", "rel_type", "source", "target", outcome.alias("outcome"))


def reclassified(edges: DataFrame) -> DataFrame:
    """Adds ``outcome`` to edges (source, rel_type, target, new_rel, new_source, new_target, asked): who decided what."""
    same = F.col("source").eqNullSafe(F.col("new_source")) & F.col("target").eqNullSafe(F.col("new_target"))
    loop = alias_key(F.col("source")) == alias_key(F.col("target"))
    outcome = (
        F.when(F.col("new_rel").isNull(), "failed")
        .when((F.col("new_rel") == "NONE") & loop, "self_loop")
        .when((F.col("new_rel") == "NONE") & F.col("asked"), "declined")
        .when(F.col("new_rel") == "NONE", "no_relation_legal")
        .when(F.col("new_rel") != F.col("rel_type"), "changed")
        .when(same, "kept")
        .otherwise("flipped")
    )
    return edges.withColumn("outcome", outcome)


def triggers(messages: DataFrame, npcs: DataFrame) -> DataFrame:
    """(message_id, npc_id, trigger): commands of a game master before mentions before names, for the npcs of a message's guild.

    Messages (message_id, guild, content, is_dm, mentioned) meet npcs (npc_id, guild, name, aliases, app_id).
    """
    both = messages.join(npcs, "guild")
    text = F.lower("content")
    quoted = F.concat(F.lit(r"\Q"), F.lower("name"), F.lit(r"\E"))
    command = F.rlike(text, F.concat(F.lit(r"^(?:[!/]npc\s+"), quoted, F.lit(r"|\["), quoted, F.lit(r"\])\s+")))
    word = lambda n: F.rlike(text, F.concat(F.lit(r"(?U)\b\Q"), F.lower(n), F.lit(r"\E\b")))
    named = word(F.col("name")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), word)
    kind = F.when(F.col("is_dm") & command, "dm_command").when(F.array_contains("mentioned", F.col("app_id")), "direct_mention").when(named, "name_reference")
    return both.select("message_id", "npc_id", kind.alias("trigger")).where(F.col("trigger").isNotNull())


#: What may be left off an item's name.
ITEM_PREFIXES = ("potion of ", "oil of ", "philter of ", "elixir of ", "scroll of ")


def item_mentioned(item: Column, message: Column) -> Column:
    text, name = F.lower(message), F.lower(item)
    short = reduce(lambda c, p: F.when(F.startswith(name, F.lit(p)), F.substr(name, F.lit(len(p) + 1))).otherwise(c), ITEM_PREFIXES, F.lit(None).cast("string"))
    return F.contains(text, name) | F.coalesce(F.contains(text, short), F.lit(False))


def profiles(nodes: DataFrame, styles: tuple[str, ...], default: str) -> DataFrame:
    """Nodes (id, stat_block, personality) with JSON read as columns: bad JSON gives defaults, an unknown style the default one."""
    stats = F.from_json("stat_block", "struct<max_hit_points:int,armor_class:int,speed:int>")
    person = F.from_json("personality", "struct<combat_style:string,retreat_threshold:double>")
    style = F.lower(person.combat_style)
    return nodes.select(
        "id", F.coalesce(stats.max_hit_points, F.lit(10)).alias("max_hp"), F.coalesce(stats.armor_class, F.lit(10)).alias("armor_class"), F.coalesce(stats.speed, F.lit(30)).alias("speed"),
        F.when(style.isin(*styles), style).otherwise(default).alias("combat_style"), F.coalesce(person.retreat_threshold, F.lit(0.25)).alias("retreat_threshold"),
    )


def as_profile_json(rows: DataFrame) -> DataFrame:
    """The reverse: columns as the JSON texts that a node keeps."""
    stats = F.to_json(F.struct(F.col("max_hp").alias("max_hit_points"), "armor_class", "speed"))
    return rows.select("id", stats.alias("stat_block"), F.to_json(F.struct("combat_style", "retreat_threshold")).alias("personality"))


def allowed_fields(props: Column, allowed: tuple[str, ...]) -> Column:
    return F.map_filter(props, lambda k, v: k.isin(*allowed) & v.isNotNull())


def first_command(message: Column, commands: tuple[tuple[str, str], ...]) -> Column:
    """The tool of the first prefix, in order, that the message begins with; null if none."""
    text = F.lower(F.trim(message))
    return F.coalesce(*(F.when(F.startswith(text, F.lit(p)), F.lit(tool)) for p, tool in commands))


def rejected(answers: DataFrame, types: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """(part, kind, n): how many rows of the answers were left out for a type or relation that the vocabulary lacks."""
    parsed = answers.select(F.from_json("json", _EXTRACTION).alias("p"))
    each = lambda field, part: parsed.select(F.lit(part).alias("part"), F.explode(f"p.{field}").alias("x")).select("part", F.upper("x.type").alias("kind"))
    known = F.when(F.col("part") == "entity", F.col("kind").isin(*types)).otherwise(F.col("kind").isin(*relations))
    return each("entities", "entity").union(each("relationships", "relation")).where(~F.coalesce(known, F.lit(False))).groupBy("part", "kind").agg(F.count("*").alias("n"))


def declared_only(artifacts: DataFrame, schema: str) -> DataFrame:
    """Artifacts (id, json) read by a declared schema and written again: undeclared keys are gone, bad JSON is null."""
    return artifacts.select("id", F.to_json(F.from_json("json", schema)).alias("json"))
