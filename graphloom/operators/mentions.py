"""Names in texts and questions: whole-word scan, sentence co-occurrence and counts.

A name matches where no letter or digit stands on either side of it. Curly apostrophes are straight, soft hyphens within the
text are passed over, and a full stop of a name need not stand in the text ("St Osric's" is "St. Osric's"), though one that
stands in the text has to be the name's. The case of a one-word name counts, that of longer ones does not; a question may
fold the case of all.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sentences import MOST, Sentences
from graphloom.operators.plan import durable

MOST_NAMES = 2_000_000
_FOLD = str.maketrans({"’": "'", "‘": "'"})
_SOFT = "\u00ad"
_BARE = {ord("."): None, ord(_SOFT): None}

Hit = tuple[int, int, str, str]


def _lower(text: str) -> str:
    """Lower case of equal length, letter by letter where a letter's lower case is longer."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def plain_name(name: str) -> str:
    return name.translate(_FOLD).replace(_SOFT, "").strip()


def automaton(names: list[tuple[str, str]], fold_case: bool = False):  # noqa: ANN201
    """One automaton over folded names without full stops; each holds its (entity, spelling, plain spelling, whether case matters)."""
    found: dict[str, list[tuple[str, str, str, bool]]] = {}
    for entity, name in names:
        plain = plain_name(name)
        key = _lower(plain.translate(_BARE))
        if key.strip():
            found.setdefault(key, []).append((entity, name, plain, not fold_case and len(plain.split()) == 1))
    machine = ahocorasick.Automaton()
    for key, held in found.items():
        machine.add_word(key, (len(key), held))
    if found:
        machine.make_automaton()
    return machine if found else None


def _end(text: str, at: int, name: str, exact: bool) -> int:
    """Where the name ends that begins at a place of the folded text, or -1: soft hyphens are passed, its full stops optional.

    A last full stop is the name's unless a letter follows it; what follows the end may not be one.
    """
    for i, c in enumerate(name):
        here = at
        while i and here < len(text) and text[here] == _SOFT:
            here += 1
        if c == ".":
            after = here + 1
            if here < len(text) and text[here] == "." and not (i == len(name) - 1 and after < len(text) and text[after].isalnum()):
                at = after
            elif not (here < len(text) and text[here].isalnum() and i == len(name) - 1):
                at = here
        elif here < len(text) and (text[here] == c or (not exact and _lower(text[here]) == _lower(c))):
            at = here + 1
        else:
            return -1
    return at


def hits(text: str, machine) -> list[Hit]:  # noqa: ANN001
    """(start, end, entity, spelling) of every whole-word match, overlapping ones too, in the text's own offsets."""
    if machine is None:
        return []
    folded = text.replace("’", "'").replace("‘", "'")
    bare, places = folded, None
    if "." in folded or _SOFT in folded:
        codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
        places = np.flatnonzero((codes != ord(".")) & (codes != ord(_SOFT)))
        bare = folded.replace(".", "").replace(_SOFT, "")
    out = []
    size_of = len(folded)
    for last, (size, held) in machine.iter(_lower(bare)):
        start = last - size + 1
        if places is not None:
            start, last = int(places[start]), int(places[last])
        # Most places lie within longer words; a letter or digit on either side rules all spellings out.
        if (start and folded[start - 1].isalnum()) or (last + 1 < size_of and folded[last + 1].isalnum()):
            continue
        for entity, name, plain, exact in held:
            low = start - 1 if plain.startswith(".") and start and folded[start - 1] == "." else start
            end = _end(folded, low, plain, exact)
            if end >= 0 and not (low and folded[low - 1].isalnum()) and not (end < len(folded) and folded[end].isalnum()):
                out.append((low, end, entity, name))
    return out


def without_overlaps(found: list[Hit]) -> list[Hit]:
    """Overlaps go to the longest, then the first; equal spans all stay. Taken spans are disjoint and in order."""
    kept, taken = [], []
    for start, end, entity, name in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2], x[3])):
        at = bisect.bisect_left(taken, (start, end))
        if at < len(taken) and taken[at] == (start, end):
            kept.append((start, end, entity, name))
        elif (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            kept.append((start, end, entity, name))
    return sorted(kept)


_SCANNED = "section_id long, entity_id string, name string, start int, low int, high int, whole boolean"


_KINDS = {"section_id": pa.int64(), "entity_id": pa.string(), "name": pa.string(), "start": pa.int32(), "low": pa.int32(), "high": pa.int32(), "whole": pa.bool_()}


def _found(section: int | None, text: str, machine) -> list[tuple]:  # noqa: ANN001
    hit = without_overlaps(hits(text, machine))
    cut = Sentences(text) if hit else None
    return [(section, entity, name, start, *cut.around(start)) for start, _, entity, name in hit]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))


def _words(text: Column, joined: bool) -> Column:
    """Lower-case runs of letters and digits. Full stops part words, or, ``joined``, are left out, as names may have them or not."""
    plain = F.regexp_replace(text, "[\u00ad.]" if joined else "\u00ad", "")
    return F.array_remove(F.array_distinct(F.split(F.lower(plain), r"[^\p{L}\p{N}]+")), "")


def sure_words(name: Column) -> Column:
    """The words of a name that stand as such in every text that holds it: those with no full stop between their letters."""
    runs = F.split(F.regexp_replace(name, "\u00ad", ""), r"[^\p{L}\p{N}.]+")
    bare = F.transform(runs, lambda r: F.lower(F.regexp_replace(r, r"^\.+|\.+$", "")))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & ~F.contains(w, F.lit("."))))


def scan(sections: DataFrame, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(section_id, entity_id, name, start, low, high, whole): each mention, the bounds of its sentence, and whether they are all of it.

    A text's sentences are found in one scan, so its cost grows with its length and its mentions, not with their product.
    ``names`` (entity_id, name) are counted. Up to ``most`` make one automaton that every task gets. More of them are not gathered:
    a name lies under the one of its sure words that the fewest texts hold, texts meet the names of their words by an equality join,
    and each text, moved once, is searched for the names that it met. Names without a sure word ("A.B.") meet every text as one
    automaton of their own, if they are up to ``MOST_NAMES``.
    """
    held = names.select("entity_id", "name").where(F.col("name").isNotNull()).distinct()
    texts = sections.select(F.col("section_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if held.count() <= most:
        return _scan_sent(texts, held)
    held = durable(held.withColumn("words", sure_words(F.col("name"))))
    loose = held.where(F.size("words") == 0)
    if loose.count() > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names hold no word without full stops")
    return _scan_met(texts, held.where(F.size("words") > 0), loose.select("entity_id", "name"))


def _scan_sent(texts: DataFrame, held: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in held.collect()))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in source:
            rows = [r for section, text in zip(*(c.to_pylist() for c in batch.columns)) for r in _found(section, text, machine)]
            if rows:
                yield _batch(rows)

    return texts.mapInArrow(batches, _SCANNED)


def _scan_met(texts: DataFrame, held: DataFrame, loose: DataFrame) -> DataFrame:
    """A text's words ask for names; the row number of a written text keeps texts of one id apart."""
    laid = durable(texts.select(F.monotonically_increasing_id().alias("row"), "section_id", "text"))
    words = laid.select("row", F.explode(F.array_union(_words(F.col("text"), False), _words(F.col("text"), True))).alias("word"))
    inverted = held.select("entity_id", "name", F.explode("words").alias("word"))
    common = words.join(inverted.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("n"))
    # A name of which a word stands in no text is in none; the rarest word is where it lies.
    rated = inverted.join(common, "word", "left").groupBy("entity_id", "name").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = words.join(rated, "word").groupBy("row").agg(F.collect_list(F.struct("entity_id", "name")).alias("named"))
    shared = texts.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in loose.collect()))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = shared.value
        for batch in source:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for section, text, named in zip(*(c.to_pylist() for c in part.columns)):
                    rows += _found(section, text, automaton([*((x["entity_id"], x["name"]) for x in named or ()), *always]))
                if rows:
                    yield _batch(rows)

    asked = laid.join(met, "row", "left").select("section_id", "text", "named")
    return (asked if loose.count() else asked.where(F.col("named").isNotNull())).mapInArrow(batches, _SCANNED)


def once_each(found: list[Hit]) -> list[Hit]:
    """The spellings that a question holds: the longest first, each once, and none over another's span."""
    by_name: dict[str, list[Hit]] = {}
    for h in found:
        by_name.setdefault(h[3], []).append(h)
    out: list[Hit] = []
    taken: list[tuple[int, int]] = []
    for name in sorted(by_name, key=lambda n: (-len(n), n)):
        for start, end, entity, _ in sorted(by_name[name]):
            at = bisect.bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end))
                out.append((start, end, entity, name))
                break
    return out


_NAMED = "query_id long, surface string, start int, loose boolean"


def names_in_questions(questions: DataFrame, spellings: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(query_id, surface, start, loose) of questions (query_id, text): the recorded spellings (name) that each holds.

    The case of one-word names counts first; a question that names nothing then is matched with all case folded, and its
    names are ``loose``. More than ``most`` spellings are dealt into several automata, whose hits meet again by question.
    """
    held = spellings.select("name").where(F.col("name").isNotNull()).distinct()
    parts = max(1, -(-held.count() // most))
    asked = questions.select(F.col("query_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def batches(shared):  # noqa: ANN001, ANN202
        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact, folded = (automaton([("", n) for n in shared.value], fold) for fold in (False, True))
            for batch in source:
                rows = []
                for query, text in zip(*(c.to_pylist() for c in batch.columns)):
                    strict = hits(text, exact)
                    rows += [(query, name, start, end, False) for start, end, _, name in strict]
                    rows += [(query, name, start, end, True) for start, end, _, name in hits(text, folded)] if parts > 1 or not strict else []
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["query_id", "surface", "start", "end", "loose"])

        return run

    found = []
    for i in range(parts):
        part = held.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i) if parts > 1 else held
        shared = questions.sparkSession.sparkContext.broadcast(sorted(r[0] for r in part.collect()))
        found.append(asked.mapInArrow(batches(shared), f"{_NAMED.replace('start int', 'start int, end int')}"))
    every = found[0]
    for other in found[1:]:
        every = every.union(other)

    def settled(group: pd.DataFrame) -> pd.DataFrame:
        loose = bool(group.loose.all())
        rows = group if loose else group[~group.loose]
        kept = once_each([(a, b, "", n) for a, b, n in zip(rows.start, rows.end, rows.surface)])
        return pd.DataFrame({"query_id": [group.query_id.iloc[0]] * len(kept), "surface": [k[3] for k in kept], "start": [k[0] for k in kept], "loose": [loose] * len(kept)})

    return every.groupBy("query_id").applyInPandas(settled, _NAMED)


def mentions(scanned: DataFrame) -> DataFrame:
    """One row an entity and section, with its offsets in order."""
    return scanned.groupBy("entity_id", "section_id").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_list("start")).alias("offsets"))


def mention_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("entity_id").agg(F.countDistinct("section_id").alias("sections"), F.count("*").alias("occurrences"))


def sentence_table(sections: DataFrame) -> DataFrame:
    """(section_id, nth, low, high): every sentence of each text, in order, from one scan of it; null ids and texts have none."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, nth, low, high = [], [], [], []
            for section, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = Sentences(text).spans()
                ids += [section] * len(spans)
                nth += range(len(spans))
                low += [a for a, _ in spans]
                high += [b for _, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in (nth, low, high))], names=["section_id", "nth", "low", "high"])

    texts = sections.select(F.col("section_id").cast("long"), "text").where(F.col("section_id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInArrow(batches, "section_id long, nth int, low int, high int")


def _pairs_of_sentences(scanned: DataFrame) -> DataFrame:
    """(section_id, a, b) with a < b. The scan is written once and read by each way.

    Mentions of one sentence that is no longer than MOST have the same bounds, so they meet in its set of names, which is as short
    as a sentence. In longer ones each mention has its own window; there mentions meet in bins of MOST characters, of which a window
    touches two.
    """
    held = durable(scanned.select("section_id", "entity_id", "start", "low", "high", "whole"))
    named = held.where("whole").groupBy("section_id", "low", "high").agg(F.array_sort(F.collect_set("entity_id")).alias("names")).where(F.size("names") > 1)
    within = named.select("section_id", "names", F.explode("names").alias("a")).select("section_id", "a", F.explode("names").alias("b")).where("a < b")
    bin_ = lambda c: F.floor(c / MOST)
    low, high = F.col("low"), F.greatest(F.col("high") - 1, F.col("low"))
    long = held.where("NOT whole")
    left = long.select("section_id", F.col("entity_id").alias("x"), "low", "high", F.explode(F.sequence(bin_(low), bin_(high))).alias("bin")).distinct()
    right = long.select("section_id", F.col("entity_id").alias("y"), F.col("start").alias("at"), bin_(F.col("start")).alias("bin"))
    met = left.join(right, ["section_id", "bin"]).where((F.col("x") != F.col("y")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return within.union(met.select("section_id", F.least("x", "y"), F.greatest("x", "y"))).distinct()


def same_sentence(scanned: DataFrame) -> DataFrame:
    """(section_id, a, b): different entities of which one stands within the other's sentence; a row an ordered pair."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return _pairs_of_sentences(scanned).select("section_id", F.inline(both))


def together(pairs: DataFrame) -> DataFrame:
    """(a, b, sections): unordered pairs and the number of sections that hold both in a sentence, from distinct ordered ones."""
    return pairs.where("a < b").groupBy("a", "b").agg(F.count("*").alias("sections"))


def widest_sentence(scanned: DataFrame) -> DataFrame:
    """The sentence that names most different entities; the first in reading order wins ties, and one name is not enough."""
    counted = scanned.groupBy("section_id", "low", "high").agg(F.countDistinct("entity_id").alias("n"))
    return counted.where("n >= 2").orderBy(F.desc("n"), "section_id", "low").limit(1)
