"""Entity matching: gazetteer tiers, overlaps, clusters of one document, links to known entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import fuzzy
from graphloom.operators import greedy
from graphloom.operators.fuzzy_join import alike
from graphloom.operators.graph import first_by
from graphloom.operators.plan import durable, small


def lookup_tiers(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(surface, canonical, tier): exact names before case-insensitive ones before aliases, from entries (canonical, aliases)."""
    exact = entries.select(F.col("canonical").alias("form"), "canonical", F.lit(0).alias("tier"))
    folded = entries.select(F.lower("canonical").alias("form"), "canonical", F.lit(1).alias("tier"))
    alias = entries.select(F.explode("aliases").alias("a"), "canonical").select(F.lower("a").alias("form"), "canonical", F.lit(2).alias("tier"))
    hits = asked.join(exact, asked.surface == exact.form).unionByName(asked.join(folded.unionByName(alias), F.lower("surface") == F.col("form")))
    return first_by(hits.select("surface", "canonical", "tier"), ["surface"], "tier", "canonical")


def earliest_first(spans: list[tuple[int, int, float]]) -> list[int]:
    """Places of the spans that stay: by start, then confidence; one that starts before the last kept ends goes."""
    kept, end = [], -1
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][2])):
        if spans[i][0] >= end:
            kept.append(i)
            end = spans[i][1]
    return kept


def _order() -> list:
    return [F.col("__doc"), F.col("start"), F.desc("confidence"), F.col("end"), F.col("__row")]


def exits(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upto, exit): what a stretch of spans in order makes of the last end before it, by steps.

    An end up to ``upto`` (and beyond the step before) leaves as ``exit``; one beyond all steps leaves as it came. From each span the
    next that fits is found by bisection, and the last of its chain by pointer doubling.
    """
    n = len(starts)
    ahead = np.append(np.maximum(np.arange(1, n + 1), np.searchsorted(starts, ends, "left")), n)
    last = np.arange(n + 1)
    while (ahead < n).any():
        last, ahead = np.where(ahead < n, last[ahead], last), ahead[ahead]
    out = ends[last[:-1]]
    firsts = np.flatnonzero(np.append(True, np.diff(starts) > 0))
    upto, out = starts[firsts], out[firsts]
    steps = np.append(np.diff(out) != 0, True)
    return upto[steps], out[steps]


def _last_spans(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's (document, start, end) the last document's steps; a document that began in it enters without an end."""
    doc, held, alone = None, [], True
    for batch in source:
        docs = batch.column(0).to_pylist()
        if not docs:
            continue
        if doc is not None:
            alone = alone and docs[0] == doc
        at = len(docs) - 1
        while at and docs[at - 1] == docs[-1]:
            at -= 1
        alone = alone and at == 0
        if at or docs[0] != doc:
            held = []
        doc = docs[-1]
        held.append((batch.column(1).to_numpy()[at:], batch.column(2).to_numpy()[at:]))
    if held:
        upto, out = exits(*(np.concatenate(x) for x in zip(*held)))
        upto, out = (upto, out) if alone else (upto[:1], out[:1])
        n = len(upto)
        columns = [pa.array([doc] * n, pa.string()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([alone] * n, pa.bool_()), pa.array(upto, pa.int64()), pa.array(out, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "alone", "upto", "exit"])


def _strung(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps by document, partition and upto to the end that each partition leaves; one row is held at a time."""
    doc = part = end = found = None
    for batch in source:
        rows = []
        for d, p, alone, upto, out in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, p) != (doc, part):
                if part is not None:
                    end = end if found is None else found
                    rows.append((doc, part, end))
                if d != doc:
                    end = None
                doc, part, found = d, p, None
            if found is None and (end is None or not alone or end <= upto):
                found = out
        yield _ends(rows)
    if part is not None:
        yield _ends([(doc, part, end if found is None else found)])


def _ends(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["doc", "part", "exit"])


def without_overlaps(matches: DataFrame) -> DataFrame:
    """Matches (doc_id, start, end, confidence, ...) without overlaps, as ``earliest_first`` keeps them.

    The matches are ranged by document, start and confidence, so a document may span any number of partitions. Each partition gives
    what its last document's spans make of the end before them, by steps; the steps of a document are strung together in order, one
    row held at a time; and the partitions are walked once more from the ends so found, of which the driver sees one a partition.
    Matches without a start or an end are left out; those without a document are one document; ties go by end, then by a hash.
    """
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    rows = matches.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumns({"__doc": doc, "__row": F.xxhash64(*matches.columns)})
    laid = durable(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()))
    spans = ("__doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    steps = laid.select(*spans).mapInArrow(_last_spans, "doc string, part int, alone boolean, upto long, exit long")
    strung = steps.repartition("doc").sortWithinPartitions("doc", "part", "upto").mapInArrow(_strung, "doc string, part int, exit long")
    columns, left = matches.columns, {r["part"]: (r["doc"], r["exit"]) for r in strung.collect()}
    begins: dict[int, tuple[str, int] | None] = {}
    for part in range(max(left, default=-1) + 1):
        begins[part + 1] = left.get(part) or begins.get(part)

    def walked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, end = begins.get(TaskContext.get().partitionId()) or (None, 0)
        for batch in source:
            kept = []
            for d, a, b in zip(*(batch.column(c).to_pylist() for c in ("__doc", "start", "end"))):
                kept.append(d != doc or a >= end)
                if kept[-1]:
                    doc, end = d, b
            yield batch.filter(pa.array(kept, pa.bool_())).select(columns)

    return laid.mapInArrow(walked, matches.schema)


def clusters(names: list[str], least: float) -> list[int]:
    """The definition: for names in order, the place of the seed that takes each; a seed takes all that are like it, not in turn theirs."""
    seed = [-1] * len(names)
    for i, name in enumerate(names):
        if seed[i] < 0:
            seed[i] = i
            for j in range(i + 1, len(names)):
                if seed[j] < 0 and greedy.similarity(name, names[j]) >= least:
                    seed[j] = i
    return seed


def resolved(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, entity_type, name, confidence, source, merged): clusters of a document's entities of one type.

    Seeds take what is like them in order of confidence, then start, then name (``greedy.seeds``), as ``clusters`` gives them. A gazetteer member gives the
    name, and more sources raise the confidence by 0.1 each, 0.2 at most. No document is folded in one task.
    """
    keys = ["doc_id", "entity_type"]
    order = F.struct((-F.coalesce("confidence", F.lit(float("-inf")))).alias("c"), F.col("start").alias("s"))
    rows = durable(greedy.grouped(entities.select(*keys, "name", "confidence", "source", "start"), keys, "name").where(F.col("low").isNotNull()))
    taken = rows.join(greedy.seeds(rows.select(*keys, "name", "confidence", "start"), keys, "name", order, least), ["of", "low"])
    base = F.struct((F.col("source") != "gazetteer").alias("g"), order.alias("o"), F.col("name").alias("n"))
    found = taken.groupBy("of", "seed").agg(F.min_by(F.struct(*keys, "name", "confidence", "source"), base).alias("b"), F.countDistinct("source").alias("sources"), F.count("*").alias("merged"))
    more = F.least(F.lit(0.2), F.lit(0.1) * (F.col("sources") - 1))
    return found.select(
        F.col("b.doc_id").cast("long").alias("doc_id"), "b.entity_type", "b.name", F.least(F.lit(1.0), F.col("b.confidence") + more).alias("confidence"),
        F.when(F.col("sources") <= 1, F.col("b.source")).otherwise("hybrid").alias("source"), "merged",
    )


def _less_one(df: DataFrame) -> DataFrame:
    """Names (entity_type, name) with each spelling (short) that one letter less makes of them."""
    places = F.sequence(F.lit(1), F.length("name"))
    short = F.array_distinct(F.transform(places, lambda i: F.concat(F.substr("name", F.lit(1), i - 1), F.substr("name", i + 1, F.length("name")))))
    return df.where(F.length("name") > 0).select("entity_type", "name", F.explode(short).alias("short"))


def _one_letter_off(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_type, name, known) of different names (entity_type, name) that are equal, or once one of them has lost a letter.

    They meet by equality, whatever number of names is alike beyond that.
    """
    other = known.withColumnRenamed("name", "known")
    equal = asked.join(other.withColumn("name", F.col("known")), ["entity_type", "name"]).select("entity_type", "name", "known")
    longer = asked.join(_less_one(known).toDF("entity_type", "known", "name"), ["entity_type", "name"]).select("entity_type", "name", "known")
    shorter = _less_one(asked).join(other.withColumn("short", F.col("known")), ["entity_type", "short"]).select("entity_type", "name", "known")
    return equal.union(longer).union(shorter)


def linked(found: DataFrame, known: DataFrame, least: float = 85.0) -> DataFrame:
    """(name, entity_type, id, score): the known entity (id, name, entity_type, aliases) of one type most like each name.

    Different names are scored once, whatever number of rows hold them. Names that are equal or a letter off are found first: with
    three letters or more nothing else is as like, since two letters off leave at most 1 - 1/(n + 1) of a name of n and one leaves
    1 - 1/(2n - 1) at least. Only the other names are held against those that share their rarest grams. An alias that is equal scores 95.
    """
    asked = found.select("name", "entity_type").distinct()
    folded = lambda df: df.select(F.lower("name").alias("name"), "entity_type")
    wanted, held = durable(folded(asked.where((F.length("name") > 0) & F.col("entity_type").isNotNull())).distinct()), folded(known).where("name IS NOT NULL AND entity_type IS NOT NULL").distinct()
    close = durable(_one_letter_off(small(wanted.where(F.length("name") > 2)), held))
    rest = durable(wanted.join(close.select("entity_type", "name").distinct(), ["entity_type", "name"], "left_anti"))
    near = close.withColumn("score", fuzzy.ratio_of("name", "known")).where(F.col("score") >= least).select("entity_type", "name", "known", "score")
    if not rest.isEmpty():
        near = near.unionByName(alike(rest, held, least, "entity_type").select("entity_type", "name", "known", "score"))
    near = near.withColumnsRenamed({"name": "low", "known": "other"})
    scored = asked.withColumn("low", F.lower("name")).join(near, ["entity_type", "low"]).join(known.select("id", "entity_type", F.lower("name").alias("other")), ["entity_type", "other"]).select("name", "entity_type", "id", "score")
    alias = known.select("id", "entity_type", F.explode("aliases").alias("a")).join(asked, "entity_type").where(F.lower("a") == F.lower("name")).select("name", "entity_type", "id", F.lit(95.0).alias("score"))
    return first_by(scored.unionByName(alias).where(F.col("score") >= least), ["name", "entity_type"], F.desc("score"), "id")


def new_only(more: DataFrame, held: DataFrame, least: float = 85.0) -> DataFrame:
    """Entities of ``more`` (doc_id, name, entity_type, ...) that no entity of the same document and type is more than so like."""
    pairs = more.select("doc_id", "entity_type", "name").distinct().join(held.select("doc_id", "entity_type", F.col("name").alias("known")).distinct(), ["doc_id", "entity_type"])
    # A ratio over the bound needs lengths within that share of their sum.
    close = F.least(F.length("name"), F.length("known")) * 200 >= least * (F.length("name") + F.length("known"))
    alike = pairs.where(close).where(fuzzy.ratio_of(F.lower("name"), F.lower("known")) > least).select("doc_id", "entity_type", "name").distinct()
    return more.join(alike, ["doc_id", "entity_type", "name"], "left_anti")


def extracted(matches: DataFrame, tagged: DataFrame, answered: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, name, entity_type, confidence, source, id): gazetteer matches and a tagger's spans without overlaps, resolved a
    document, a model's entities where they are new, linked to what is known, and what is confident enough.

    Matches and tagged are (doc_id, name, entity_type, confidence, source, start, end), answered (doc_id, name, entity_type,
    confidence); the tagger and the model run elsewhere, their rows are inputs. Known is (id, name, entity_type, aliases).
    """
    columns = ("doc_id", "name", "entity_type", "confidence", "source", "start", "end")
    spans = without_overlaps(matches.select(*columns).unionByName(tagged.select(*columns)))
    held = resolved(spans).select("doc_id", "name", "entity_type", "confidence", "source")
    fresh = new_only(answered, held).select("doc_id", "name", "entity_type", "confidence", F.lit("llm").alias("source"))
    every = held.unionByName(fresh)
    ids = linked(every, known).select("name", "entity_type", "id")
    return every.join(ids, ["name", "entity_type"], "left").where(F.col("confidence") >= least).select("doc_id", "name", "entity_type", "confidence", "source", "id")


def graded(golden: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, hits): golden names of a type against candidate names whose words are the same, or a proper part either way.

    Any shared word makes a pair meet, so the match is an equality join on words with the whole sets compared after it. Different
    names meet once, whatever number of ids hold them; only an id of several names needs its candidates themselves.
    """
    named = durable(golden.select("id", "entity_type", "name").distinct())
    words = F.array_distinct(F.split("name", " "))
    left = named.select("entity_type", "name").distinct().withColumn("gold", words).withColumn("word", F.explode("gold"))
    right = candidates.select("entity_type", "name").distinct().withColumn("given", words).withColumn("word", F.explode("given")).withColumnRenamed("name", "candidate")
    part = lambda a, b: F.size(F.array_except(a, b)) == 0
    met = left.join(right, ["entity_type", "word"]).where(part(F.col("gold"), F.col("given")) | part(F.col("given"), F.col("gold")))
    pairs = durable(met.select("entity_type", "name", "candidate").distinct())
    one = named.groupBy("id").agg(F.count("*").alias("names"), F.first("entity_type").alias("entity_type"), F.first("name").alias("name"))
    single = one.where("names = 1").join(pairs.groupBy("entity_type", "name").agg(F.count("*").alias("hits")), ["entity_type", "name"]).select("id", "hits")
    several = named.join(one.where("names > 1").select("id"), "id", "left_semi").join(pairs, ["entity_type", "name"]).groupBy("id").agg(F.countDistinct("candidate").alias("hits"))
    return golden.select("id").distinct().join(single.union(several), "id", "left").select("id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def recall(grades: DataFrame) -> DataFrame:
    """(loose, unambiguous): shares of golden entries with a hit, and with exactly one; 1.0 where there are none."""
    n = F.count("*")
    share = lambda c: F.when(n == 0, 1.0).otherwise(F.round(F.count(F.when(c, 1)) / n, 6))
    return grades.agg(share(F.col("hits") > 0).alias("loose"), share(F.col("hits") == 1).alias("unambiguous"))
