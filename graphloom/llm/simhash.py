"""SimHash near-duplicates by deletion-variant signatures.

``fingerprints`` makes one 64-bit SimHash a document. Two fingerprints at most three bits apart are linked. The 64 bits
are cut into two segments of 32: of three differing bits, one segment holds at most one. So a pair agrees on a segment
exactly, or agrees on it once the one differing bit is a wildcard. ``links`` indexes, for each distinct fingerprint,
both exact segments and the 64 one-wildcard variants, joins on equality and verifies the whole distance. A wildcard entry
only meets entries with the other value at the wildcard, so that no pair is found once for each of 32 wildcards.

Exact copies collapse to one fingerprint before the index is built, so that a group of copies costs one entry; only the
membership table keeps a row a document. Components come from min-label propagation with pointer jumping over the links
between distinct fingerprints, each round cut off in the shared checkpoint folder.

Edge cases: a null or empty text and one without words have fingerprint zero, and are linked like any other. One or two
words are hashed as one shingle. Rows that repeat a document id share its component. A row with a null
id has its fingerprint, a null component and no part in the links of others. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, hash_sampled, sample_rate, text_of

MAX_DISTANCE = 3
ORDER_SAMPLE, SHARE = 4_000, 0.005
#: Bits of the wide SimHash. At a similarity of 0.8 two texts differ in 39 of its 256 bits, give or take 6, and in 10 of the first
#: 64, give or take 3: the bounds lose such a pair with a chance under one in a million.
WIDE, MOST_APART, MOST_APART_FIRST = 4, 68, 26
#: Ends of candidate pairs that are sent to every task at most, four longs each, and how often texts are read for more of them.
MOST_SENT, MOST_PASSES = 400_000, 12
#: Bits of the map by which tasks know the texts of candidates where these are more still: 16 MB, whatever their number.
MAP_BITS = 1 << 27
_SLICE = 1 << 16


def simhash64(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of the shingles of lower-cased (A-Z) words; 0 if there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        part = zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([simhash64(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same 64 bits."""
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")



def _segments(df: DataFrame) -> DataFrame:
    """(segment, value, fp): the high and the low 32 bits of each fingerprint."""
    return df.select(
        "fp",
        F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("segment", "value"),
    )


def _distance() -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): every pair of different fingerprints at most MAX_DISTANCE bits apart, from a table of distinct ``fp``."""
    segments = _segments(distinct)
    exact = segments.select("segment", "value", "fp")
    same = exact.join(_shuffled(exact.withColumnRenamed("fp", "other")), ["segment", "value"]).where(F.col("fp") < F.col("other"))
    # One row a segment and wildcard place: the value without that bit is the signature, the bit says which side it is on.
    variants = segments.select(
        "fp", "segment", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place")
    ).select(
        "fp",
        F.expr("bigint(segment * 32 + place) * 4294967296 + (value & ~shiftleft(1L, place))").alias("signature"),
        F.expr("(shiftrightunsigned(value, place) & 1) = 1").alias("bit"),
    )
    zero = variants.where(~F.col("bit")).select("signature", "fp")
    one = variants.where("bit").select("signature", F.col("fp").alias("other"))
    near = zero.join(_shuffled(one), "signature")
    return (
        same.select("fp", "other")
        .union(near.select("fp", "other"))
        .where(_distance() <= MAX_DISTANCE)
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
        .distinct()
    )


def _shuffled(df: DataFrame) -> DataFrame:
    """Joined by a shuffle: what grows with the input is not gathered in the driver to be broadcast, of which rounds would hold many."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for the nodes of ``edges`` (a, b), the smallest node that is reachable.

    Each round takes the smallest label of a node and its neighbours (summed up before the shuffle), then follows the
    label's own label, so that long chains shorten by about half a round.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        offered = both.join(_shuffled(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(_shuffled(offered), "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = durable(lower.join(_shuffled(jump), "mid").select("node", "old", F.least("mid", "far").alias("label")))
        labels = step.select("node", "label")
        if step.where("label < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links, the document's own included."""
    every = durable(fingerprints(docs))
    prints = every.where(F.col("doc_id").isNotNull())
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    marked = durable(links(distinct.select("fp")))
    first = distinct.select("fp", "first_id")
    by_id = marked.join(_shuffled(first.toDF("a", "a_id")), "a").join(_shuffled(first.toDF("b", "b_id")), "b")
    found = components(by_id.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    # Written, so that both sides of the last join are plain exchanges, which AQE splits where one fingerprint is hot.
    classes = durable(first.join(_shuffled(found), first.first_id == found.node, "left").select("fp", F.coalesce("label", "first_id").alias("component_id")))
    unnamed = every.where(F.col("doc_id").isNull()).select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return prints.join(_shuffled(classes), "fp").select("doc_id", "fp", "component_id").union(unnamed)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of lower-cased (A-Z) words, ascending; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(words) - shingle + 1)]
    stops = ends[min(shingle, len(words)) - 1 :]
    found = (xxhash.xxh64_intdigest(joined[a:b], 7) for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
    return np.unique(np.fromiter(found, np.uint64, len(starts)).view(np.int64))


def _common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shares) of shingles that several texts of a bounded sample hold, from (mark, text).

    They only set the order of the prefixes and spread what is frequent over tasks; pairs do not depend on them.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t, shingle))], names=["h"])

    sample = durable(hash_sampled(docs, sample_rate(docs.count(), ORDER_SAMPLE), "mark").select("mark", "text").dropDuplicates(["mark"]))
    found = sample.select("text").mapInArrow(batches, "h long").groupBy("h").count().where("count >= 3").orderBy("h").toPandas()
    return found.h.to_numpy(np.int64), found["count"].to_numpy(np.float64) / max(1, sample.count())


def prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shares) of the first shingles in one order of all, rare ones first: two sets as similar as that share one of theirs."""
    at = np.searchsorted(common[0], hashes)
    at[at == len(common[0])] = 0
    share = np.where(common[0][at] == hashes, common[1][at], 0.0) if len(common[0]) else np.zeros(len(hashes))
    order = np.lexsort((hashes, share))[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]
    return hashes[order], share[order]


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE 64-bit words over a set of hashes; a shingle's further words are mixed from its hash."""
    out = np.zeros(WIDE, np.uint64)
    for k in range(WIDE if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _SLICE):
            h = hashes[at : at + _SLICE].view(np.uint64) + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _sketched(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(mark, doc_id, n, fp, wide, heads), a row a different text: the first id, the size of its set, its SimHashes and its prefix.

    A shingle that is frequent in the sample has salts over 0, which spread it over tasks, a few thousandths of all texts each.
    Their number is a power of two, so that near copies, whose shingles are about as frequent, are spread alike by all of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                sizes, wides, heads, salts = [], [], [], []
                for mark, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    hashes = shingle_hashes(text, shingle)
                    found, share = prefix(hashes, similarity, shared.value) if len(hashes) else (hashes, np.zeros(0))
                    sizes.append(len(hashes))
                    wides.append(wide_simhash(hashes))
                    heads.append(found)
                    salts.append(np.where(share > SHARE, 1 + mark % np.exp2(np.ceil(np.log2(np.maximum(share, SHARE) / SHARE))).astype(np.int64), 0).astype(np.int32))
                wide = np.array(wides, np.uint64).reshape(-1, WIDE).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(sizes, pa.int32()), pa.array(np.ascontiguousarray(wide[:, 0])), pa.array(list(wide[:, 1:]), pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))],
                    names=["doc_id", "mark", "n", "fp", "wide", "heads", "salts"],
                )

    rows = docs.mapInArrow(batches, "doc_id long, mark long, n int, fp long, wide array<long>, heads array<long>, salts array<int>")
    return durable(rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fp", "wide", "heads", "salts"))))


def _alike(similarity: float, other: Column | None = None) -> Column:
    """Whether two texts (n, at) and (o_n, o_at), or ``other``, that share a shingle there can be so similar, by the sizes of their sets."""
    o_n, o_at = (F.col("o_n"), F.col("o_at")) if other is None else (other.n, other.at)
    # What follows the first shingle that two texts share has to hold the rest of what they need to share.
    most = F.least(F.col("n") - F.col("at"), o_n - o_at)
    least, greatest = F.least(F.col("n"), o_n), F.greatest(F.col("n"), o_n)
    return (least >= greatest * similarity - 1e-6) & (most >= (F.col("n") + o_n) * (similarity / (1 + similarity)) - 1e-6)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _central() -> list[Column]:
    """Orders a group: first the texts with the fewest shingles of their own before the shared one, which most others are alike to."""
    return [F.col("own"), F.col("at"), F.col("mark")]


def _others(by: list[str], similarity: float) -> Column:
    """What a text meets in its group: the text before it and the first, (mark, n, at) each, where they can be alike."""
    order = Window.partitionBy(*by).orderBy(*_central())
    # Plain columns, since a struct would be made before the shuffle and travel with it.
    met = F.array_distinct(F.array(*(F.struct(*(f(c).over(order).alias(c) for c in ("mark", "n", "at"))) for f in (F.lag, F.first))))
    return F.filter(met, lambda o: (o.mark != F.col("mark")) & _alike(similarity, o))


def _met(rows: DataFrame) -> DataFrame:
    return rows.select("mark", F.explode("others.mark").alias("o_mark")).select(*_pair("mark", "o_mark"))


def _with_first(groups: DataFrame, tops: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a text of a spread shingle with the first of all its salts."""
    first = tops.where("salt > 0").groupBy("h").agg(F.min_by(F.struct("mark", "n", "at"), F.struct(*_central())).alias("o"))
    first = first.select("h", *(F.col(f"o.{c}").alias(f"o_{c}") for c in ("mark", "n", "at")))
    few = first.limit(MOST_SENT + 1).count() <= MOST_SENT
    met = groups.where("salt > 0").join(F.broadcast(first) if few else first, "h")
    return met.where((F.col("mark") != F.col("o_mark")) & _alike(similarity)).select(*_pair("mark", "o_mark"))


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column of texts compressed; what stands before it stays."""
    for batch in source:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], names=part.schema.names)


def _asked(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, mark, text), packed, of the texts whose mark may be among the ends, by a map of bits of a fixed size."""
    place = F.col("mark").bitwiseAND(F.lit(MAP_BITS - 1))
    found = ends.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("part")).agg(F.expr("bitmap_construct_agg(place & 32767)").alias("bits"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in found.collect():
        bits[4096 * r["part"] : 4096 * (r["part"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = batch.column(1).to_numpy() & (MAP_BITS - 1)
            yield from _packed(iter([batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))]))

    return docs.select("doc_id", "mark", "text").mapInArrow(batches, "doc_id long, mark long, text binary")


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of marks whose sets are so similar: far ones go by their wide SimHashes, the rest is held on whole texts."""
    side = lambda c: sketches.select(F.col("mark").alias(c), F.col("doc_id").alias(f"{c}_id"), F.concat(F.array("fp"), "wide").alias(f"{c}_wide"), F.col("n").alias(f"{c}_n"))
    apart = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("a_n", "b_n") < 20) | (apart <= MOST_APART))
    near = durable(near.select("a", "b", "a_id", "b_id"))
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = (shingle_hashes(zlib.decompress(t).decode("utf-8", "surrogatepass"), shingle) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Only texts that are asked for move, compressed and once a pair, in passes over all of them with a counted number of ends; if
    # that would take too many passes they move once more, to their ends.
    passes = max(1, math.ceil(2 * near.count() / MOST_SENT))
    deal, found = passes if passes <= MOST_PASSES else 1, []
    for nth in range(deal):
        dealt = near.where(F.pmod(F.xxhash64("a", "b"), F.lit(deal)) == nth)
        ends = dealt.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("mark"), F.col("a_id").alias("doc_id")), F.struct(F.col("b").alias("mark"), F.col("b_id").alias("doc_id")))))
        if passes <= MOST_PASSES:
            met = docs.join(F.broadcast(ends), ["doc_id", "mark"]).select("a", "b", "text").mapInArrow(_packed, "a long, b long, text binary")
        else:
            met = _asked(docs, ends).join(ends, ["doc_id", "mark"])
        texts = met.groupBy("a", "b").agg(F.min("text").alias("x"), F.max("text").alias("y"))
        found.append(durable(texts.mapInArrow(batches, "a long, b long")))
    return reduce(DataFrame.union, found)


def similar(docs: DataFrame, sketches: DataFrame, linked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, label): the components of texts whose shingle sets have that Jaccard similarity or more, joined with links (a, b).

    Two such texts share a shingle of their prefixes. First a text meets the one before it and the first in each shingle's
    group, which has the fewest shingles of its own; that joins nearly all that can be joined of a large group of near copies. Then every pair of the same group in different components is tried,
    so none is left out; texts of a group's largest component do not meet one another.
    """
    own = F.size(F.filter("salts", lambda s: s == 0)).alias("own")
    heads = sketches.select("mark", "n", own, F.posexplode(F.arrays_zip("heads", "salts")).alias("at", "head"))
    heads = heads.select("mark", "n", F.when(F.col("head.salts") > 0, F.col("own")).otherwise(0).alias("own"), "at", F.col("head.heads").alias("h"), F.col("head.salts").alias("salt"))
    order = Window.partitionBy("h", "salt").orderBy(*_central())
    several = (F.col("salt") > 0) | F.lag("mark").over(order).isNotNull() | F.lead("mark").over(order).isNotNull()
    placed = heads.select("*", several.alias("several"), F.row_number().over(order).alias("nth"), _others(["h", "salt"], similarity).alias("others"))
    groups = durable(placed.where("several").drop("several"))
    tops = groups.where("nth = 1")  # a spread shingle has one first text a salt, any other shingle only one
    near = _met(groups).union(_met(tops.select("mark", _others(["h"], similarity).alias("others")))).union(_with_first(groups, tops, similarity)).distinct()
    sure = durable(linked.select("a", "b").union(_verified(docs, sketches, near, shingle, similarity)))
    labels = components(sure).withColumnRenamed("node", "mark")
    known = durable(sketches.select("mark", "fp").join(labels, "mark", "left").select("mark", "fp", F.coalesce("label", "mark").alias("label")))
    split = _split(groups, known)
    other = split.select("h", *(F.col(c).alias(f"o_{c}") for c in ("mark", "n", "at", "label", "fp", "main")))
    aside = split.where(F.col("label") != F.col("main")).join(other, "h").where(
        (F.col("label") != F.col("o_label")) & ((F.col("o_label") == F.col("o_main")) | (F.col("mark") < F.col("o_mark"))) & _near_enough() & _alike(similarity)
    )
    known = _merged(known, _verified(docs, sketches, aside.select(*_pair("mark", "o_mark")).distinct(), shingle, similarity))
    return known.select(F.col("mark").alias("node"), "label")


def _near_enough() -> Column:
    """Whether the first SimHashes of two texts let them be similar; sets of under twenty shingles are let through."""
    return (F.bit_count(F.col("fp").bitwiseXOR(F.col("o_fp"))) <= MOST_APART_FIRST) | (F.least("n", "o_n") < 20)


def _split(groups: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of groups with several components, each with its component and the group's largest one."""
    marked = durable(groups.select("h", "mark", "n", "at").join(known, "mark"))
    sizes = marked.groupBy("h", "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("h").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    return durable(marked.join(largest.select("h", "main"), "h"))


def _merged(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mark, fp, label) with the components that the pairs (a, b) join as one; only components meet, not texts."""
    side = lambda c: known.select(F.col("mark").alias(c), F.col("label").alias(f"{c}_label"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct()
    over = components(joined).select(F.col("node").alias("label"), F.col("label").alias("over"))
    return durable(known.join(over, "label", "left").select("mark", "fp", F.coalesce("over", "label").alias("label")))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that are the first of their group, by id, then by a hash of the text; a document without an id stays.

    Texts are linked if SimHashes of their ``shingle``-word sets are at most MAX_DISTANCE bits apart, or if the sets are at least
    as similar as ``similarity``; texts without words are one. Rows that share an id and differ in text are told apart; those that
    share both are one row.
    """
    mark = F.xxhash64(text_of())
    named = docs.where(F.col("doc_id").isNotNull())
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), text_of().alias("text"))
    sketches = _sketched(texts, shingle, similarity)
    first = durable(sketches.groupBy("fp").agg(F.min("mark").alias("first")))
    close = links(first.select("fp"))
    by_fp = close.join(first.toDF("a", "a_mark"), "a").join(first.toDF("b", "b_mark"), "b").select(F.col("a_mark").alias("a"), F.col("b_mark").alias("b"))
    same = sketches.select("mark", "fp").join(first, "fp").where("mark != first").select(F.col("mark").alias("a"), F.col("first").alias("b"))
    found = similar(texts, sketches, durable(by_fp.union(same)), shingle, similarity)
    grouped = sketches.select("mark", "doc_id").join(found.withColumnRenamed("node", "mark"), "mark", "left")
    kept = grouped.groupBy(F.coalesce("label", "mark").alias("label")).agg(F.min(F.struct("doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_mark"))
    marked = named.withColumn("_mark", mark)
    chosen = marked.join(kept, (marked.doc_id.cast("long") == kept["_id"]) & (marked["_mark"] == kept["_mark"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "_mark"]).drop("_mark").unionByName(docs.where(F.col("doc_id").isNull()))
