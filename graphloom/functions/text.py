"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that only shape a question, and words of the game table.
QUESTION_WORDS = (
    "who", "what", "when", "where", "why", "which", "how", "whose", "whom", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does",
    "did", "doing", "done", "can", "could", "shall", "should", "will", "would", "may", "might", "must", "a", "an", "the", "this", "that", "these",
    "those", "there", "here", "i", "me", "my", "we", "us", "our", "you", "your", "it", "its", "they", "them", "their", "of", "in", "on", "at", "to",
    "for", "from", "by", "with", "about", "into", "onto", "over", "under", "and", "or", "but", "if", "then", "than", "as", "so",
)
TABLE_WORDS = (
    "character", "characters", "pc", "pcs", "party", "player", "players", "adventurer", "adventurers", "dm", "gm", "campaign", "session", "game",
    "adventure",
)


def alias_key(name: Column) -> Column:
    """Aliases: lower case, trimmed, straight apostrophes, no soft hyphens."""
    return F.trim(F.lower(F.translate(F.replace(name, F.lit("­")), "’", "'")))


def vote_key(name: Column) -> Column:
    """Votes: lower case, trimmed."""
    return F.trim(F.lower(name))


def grade_key(name: Column) -> Column:
    """Grading: no punctuation, single spaces, no leading article."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.regexp_replace(plain, "^(the|a|an) ", "")


def duplicate_key(name: Column) -> Column:
    """Duplicates: no leading "the", lower case."""
    return F.regexp_replace(F.trim(F.lower(name)), "^the ", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def entity_id(name: Column, chapter: Column | None = None, key: Column | None = None) -> Column:
    """A keyed place belongs to its chapter; any other name is one entity everywhere."""
    free = F.concat(F.lit("kb:"), slug(name))
    if chapter is None or key is None:
        return free
    return F.when(key.isNotNull(), F.concat(F.lit("kb:"), chapter, F.lit(":"), F.lower(key), F.lit("-"), slug(name))).otherwise(free)


def content_terms(question: Column) -> Column:
    """Words that say what a question is about: no question or table words, three letters at least unless there is a digit."""
    words = F.transform(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)[\w'’]+"), F.lit(0)), lambda w: F.regexp_replace(w, "^['’]+|['’]+$", ""))
    said = F.filter(words, lambda w: (F.length(w) >= 3) | ((w != "") & F.rlike(w, F.lit("[0-9]"))))
    return F.array_except(F.array_distinct(said), F.array(*map(F.lit, [*QUESTION_WORDS, *TABLE_WORDS])))


def terms_present(text: Column, terms: Column) -> Column:
    """How many terms stand in the text as whole words. Terms are words, so membership among the text's words decides."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}'’_]+")
    return F.size(F.array_intersect(F.array_distinct(words), F.array_distinct(terms)))


def cleaned(text: Column) -> Column:
    """Runs of blanks as one, no lines of digits only, two line breaks at most in a row."""
    blanks = F.regexp_replace(text, r"[ \t]+", " ")
    pages = F.regexp_replace(blanks, r"(?m)^ ?[0-9]+ ?$", "")
    return F.trim(F.regexp_replace(pages, r"\n{3,}", "\n\n"))


def lucene_query(terms: Column) -> Column:
    """Terms, with the query syntax's letters escaped, joined by OR."""
    escaped = F.transform(terms, lambda t: F.regexp_replace(t, r'([+\-!(){}\[\]^"~*?:\\/|&])', r"\\$1"))
    return F.array_join(escaped, " OR ")


def title_case(name: Column) -> Column:
    """Upper-case words of four letters at most stay, small words stay, others are capitalised."""
    small = ("of", "the", "and", "in", "on", "at", "to", "for", "a", "an")
    return F.array_join(
        F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.when((w == F.upper(w)) & (F.length(w) <= 4), w).when(F.lower(w).isin(*small) & (w == F.lower(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))),
        " ",
    )


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def section_id(chapter: Column, index: Column) -> Column:
    return F.concat(F.lit("kb:"), chapter, F.lit("#"), index.cast("string"))


def mention_id(entity: Column, section: Column) -> Column:
    return F.concat(entity, F.lit("@"), section)


def diarised_line(seconds: Column, label: Column, text: Column) -> Column:
    """``[HH:MM:SS] label: text`` of one segment."""
    return F.concat(F.lit("["), clock(seconds), F.lit("] "), label, F.lit(": "), text)
