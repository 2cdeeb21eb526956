"""Transcripts: format, turns, speakers, segments of diarised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line of each format looks like.
DISCORD = r"^(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s*[AP]M\s*)?([^:]+):\s*(.+)$"
TIMED = r"^\s*[\[\(]?(\d{1,2}:\d{2}(?::\d{2})?)\s*[\]\)]?\s*([^:]+?):\s*(.+)$"
SIMPLE = r"^([^:\n]+?)(?:\s*\(([^)]+)\))?\s*:\s*(.+)$"
#: Names of the one who leads the game.
DM_NAMES = ("dm", "dungeon master", "gm", "game master", "narrator")


def format_of(content: Column) -> Column:
    text = F.trim(content)
    return (
        F.when(F.rlike(text, F.lit(r"^[\[{]")) & F.try_parse_json(text).isNotNull(), "json")
        .when(F.rlike(content, F.lit(r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}")), "discord")
        .when(F.rlike(content, F.lit(r"(?m)^\s*[\[\(]?\d{1,2}:\d{2}")), "timestamped")
        .when(F.rlike(content, F.lit(r"(?m)^[^:\n]+:\s+.+$")), "simple")
        .otherwise("plain")
    )


def role_of(speaker: Column, explicit: Column | None = None) -> Column:
    name = F.lower(F.trim(speaker))
    found = F.when(name.isin(*DM_NAMES), "dm").when(F.startswith(name, F.lit("player")), "player").otherwise("unknown")
    if explicit is None:
        return found
    said = F.lower(explicit)
    return F.when(said.isin(*DM_NAMES[:4]), "dm").when(said == "player", "player").otherwise(found)


def _one_role(segments: DataFrame) -> DataFrame:
    """The first role that a speaker of a transcript has sticks."""
    by = Window.partitionBy("transcript_id", F.lower("speaker")).orderBy("index")
    return segments.withColumn("role", F.first("role").over(by))


def parse_lines(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, index, speaker, role, character, timestamp, text) of line formats; other texts are one segment."""
    held = transcripts.select("transcript_id", "content", format_of(F.col("content")).alias("format"))
    lines = held.where(F.col("format").isin("discord", "timestamped", "simple")).select("transcript_id", "format", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    of = lambda i: F.when(F.col("format") == "discord", F.regexp_extract("line", DISCORD, i)).when(F.col("format") == "timestamped", F.regexp_extract("line", TIMED, i))
    # A speaker's part of a timed line is read as the head of a simple line is.
    head = F.when(F.col("format") == "simple", F.col("line")).when(F.col("format") == "timestamped", F.concat(of(2), F.lit(": .")))
    who = F.trim(F.when(F.col("format") == "discord", of(2)).otherwise(F.regexp_extract(head, SIMPLE, 1)))
    text = F.trim(F.coalesce(of(3), F.regexp_extract("line", SIMPLE, 3)))
    character = F.nullif(F.trim(F.when(F.col("format") != "discord", F.regexp_extract(head, SIMPLE, 2))), F.lit(""))
    cut = lines.select("transcript_id", "line_no", F.trim(of(1)).alias("timestamp"), who.alias("who"), character.alias("character"), text.alias("text")).where((F.col("text") != "") & (F.length("who") <= 50))
    said = cut.select(
        "transcript_id", (F.row_number().over(Window.partitionBy("transcript_id").orderBy("line_no")) - 1).alias("index"),
        F.col("who").alias("speaker"), "character", F.nullif("timestamp", F.lit("")).alias("timestamp"), "text",
    )
    rest = held.where("format = 'plain'").select("transcript_id", F.lit(0).alias("index"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("character"), F.lit(None).cast("string").alias("timestamp"), F.trim("content").alias("text"))
    both = said.unionByName(rest).withColumn("role", F.coalesce(role_of(F.col("speaker")), F.lit("unknown")))
    return _one_role(both)


_TURN = "array<struct<speaker:string,name:string,user:string,text:string,content:string,message:string,timestamp:string,time:string,character:string,role:string>>"


def parse_json(transcripts: DataFrame) -> DataFrame:
    """The same columns from JSON transcripts: a list of turns, or an object that holds one as turns, segments or messages."""
    content = F.trim("content")
    held = transcripts.where(format_of(F.col("content")) == "json")
    boxed = F.from_json(content, f"struct<turns:{_TURN},segments:{_TURN},messages:{_TURN}>")
    turns = F.when(F.startswith(content, F.lit("[")), F.from_json(content, _TURN)).otherwise(F.coalesce(boxed.turns, boxed.segments, boxed.messages))
    each = held.select("transcript_id", F.posexplode(turns).alias("index", "t"))
    text = F.coalesce("t.text", "t.content", "t.message")
    speaker = F.coalesce("t.speaker", "t.name", "t.user", F.lit("Unknown"))
    said = each.where(text != "").select(
        "transcript_id", "index", speaker.alias("speaker"), F.col("t.character").alias("character"), F.coalesce("t.timestamp", "t.time").alias("timestamp"), text.alias("text"), role_of(speaker, F.col("t.role")).alias("role")
    )
    return _one_role(said)


def segments_of_words(words: DataFrame) -> DataFrame:
    """(audio_id, run, speaker, start, end, text, confidence): consecutive words of one speaker (audio_id, seq, speaker, start, end, word, confidence)."""
    order = Window.partitionBy("audio_id").orderBy("seq")
    cut = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = words.withColumn("cut", cut).withColumn("run", F.sum("cut").over(order))
    return marked.groupBy("audio_id", "run").agg(
        F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x.word), " ").alias("text"), F.avg("confidence").alias("confidence"),
    )


def speaker_samples(segments: DataFrame, k: int = 5) -> DataFrame:
    """(audio_id, speaker, segments, seconds, samples): totals of each speaker and the first k texts."""
    nth = F.row_number().over(Window.partitionBy("audio_id", "speaker").orderBy("start"))
    numbered = segments.withColumn("nth", nth)
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= k, F.struct("nth", "text"))))
    return numbered.groupBy("audio_id", "speaker").agg(
        F.count("*").alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 2).alias("seconds"), F.transform(first, lambda x: x.text).alias("samples")
    )
