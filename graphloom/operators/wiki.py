"""Wiki markup to plain fields: infoboxes, index rows, citations, gazetteer entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAIRS = {"{{": "}}", "[[": "]]"}


def pieces(text: str, mark: str = "|") -> list[str]:
    """The text cut at a mark that stands in no braces or brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in _PAIRS:
            depth, i = depth + 1, i + 2
        elif two in _PAIRS.values() and depth:
            depth, i = depth - 1, i + 2
        else:
            if text[i] == mark and not depth:
                out.append(text[start:i])
                start = i + 1
            i += 1
    return [*out, text[start:]]


def templates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost double braces; an unclosed one is none."""
    found, open_ = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m.group() == "{{":
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            if not open_:
                found.append((start, m.end()))
    return found


def plain(text: str) -> str:
    """Text without references, comments and templates; links as what they show."""
    text = re.sub(r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", text)
    for start, end in reversed(templates(text)):
        text = text[:start] + text[end:]
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ([^\]]*)\]", r"\1", text)
    return re.sub(r"[ \t]+", " ", re.sub(r"'{2,}|<[^>]+>", "", text)).strip()


def infobox(text: str) -> tuple[str | None, dict[str, str]]:
    """(kind, fields) of the first template whose name begins with Infobox; values are plain, empty ones are left out."""
    for start, end in templates(text):
        name, *rest = pieces(text[start + 2 : end - 2])
        if name.strip().lower().startswith("infobox"):
            fields = dict((k.strip().lower(), plain(v)) for k, _, v in (p.partition("=") for p in rest) if v)
            return name.strip()[7:].strip().lower() or None, {k: v for k, v in fields.items() if v}
    return None, {}


def listed(value: str) -> list[str]:
    """The items of a field: lines, bullets or commas."""
    parts = re.split(r"\n\s*\*?|<br\s*/?>|, ", value)
    return list(dict.fromkeys(p.strip(" *") for p in parts if p.strip(" *")))


def entries(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(title, kind, field, item): the items of each page's infobox (title, content) whose field is asked for, by its own name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for title, content in zip(batch.title, batch.content):
                kind, found = infobox(content or "")
                rows += [(title, kind, name, item) for key, name in fields.items() for item in listed(found.get(key, ""))]
            yield pd.DataFrame(rows, columns=["title", "kind", "field", "item"])

    return pages.select("title", "content").mapInPandas(run, "title string, kind string, field string, item string")


def relations(found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(source, rel_type, target) from infobox entries: fields that are relations, each triple once."""
    kinds = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    return found.where(F.col("field").isin(*fields)).select(F.col("title").alias("source"), F.element_at(kinds, F.col("field")).alias("rel_type"), F.col("item").alias("target")).distinct()
