"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes sets piece boundaries: at block size b a piece ends where the mixed hash plus one divides by
b, so a boundary depends on its seven bytes alone and survives edits elsewhere. Each piece gives one letter of a signature.
A fingerprint is ``block:signature:signature at twice the block``. Two fingerprints compare where they share a block size,
by edit distance (insertions and deletions) of the signatures, as a likeness from 0 to 1.

``neighbour_fingerprints`` sends each text through one shuffle: ranges of document ids, cut at quantiles, are partitions,
sorted in descending order; the last row of a range needs the first of the next one, so that row travels to both.

Edge cases: a null or empty text has fingerprint ``3::``; two of them are alike (1.0), one against another text is 0.0.
Equal texts have equal fingerprints. Rows that repeat an id sort by text and count as neighbours of each other; a null id
sorts as the smallest. A table of one row is its own neighbour. An empty table gives an empty result. Other columns are not
read. The block size grows until a signature has at most ``MOST`` pieces, so a very long text costs no more to compare.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of

WINDOW, LEAST_BLOCK, LEAST, MOST = 7, 3, 32, 96
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: bytes) -> np.ndarray:
    """A mixed 32-bit hash of the seven bytes that end at each place (zeros stand before the text)."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    value = padded[: len(data)] + np.uint32(1)
    for k in range(1, WINDOW):
        value = value * np.uint32(0x01000193) + padded[k : k + len(data)]
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(13)
    return value


def _letters(data: bytes, stops: np.ndarray) -> str:
    edges = [0, *(stops + 1).tolist()]
    if edges[-1] < len(data):
        edges.append(len(data))
    return "".join([_LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(edges, edges[1:])])


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "replace")
    if not data:
        return f"{LEAST_BLOCK}::"
    value = _rolling(data)
    block = LEAST_BLOCK
    while block * 64 < len(data):
        block *= 2
    # Boundaries at twice a block are boundaries at the block, so each finer level contains the coarser ones.
    ends = lambda b: np.flatnonzero(value % np.uint32(b) == np.uint32(b - 1))
    stops = ends(block)
    while len(stops) < LEAST and block > LEAST_BLOCK:
        block //= 2
        stops = ends(block)
    while len(stops) > MOST:
        block *= 2
        stops = stops[value[stops] % np.uint32(block) == np.uint32(block - 1)]
    coarse = stops[value[stops] % np.uint32(2 * block) == np.uint32(2 * block - 1)]
    return f"{block}:{_letters(data, stops)}:{_letters(data, coarse)}"


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, all columns of a row at once in the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _signature_likeness(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """1 minus the edit distance over the signatures' joint length, at the best block size both have; 0 without one."""
    if one == two:
        return 1.0
    block1, fine1, coarse1 = one.split(":")
    block2, fine2, coarse2 = two.split(":")
    b1, b2 = int(block1), int(block2)
    if b1 == b2:
        return max(_signature_likeness(fine1, fine2), _signature_likeness(coarse1, coarse2))
    if b1 == 2 * b2:
        return _signature_likeness(fine1, coarse2)
    if b2 == 2 * b1:
        return _signature_likeness(coarse1, fine2)
    return 0.0


_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each whole text, without a shuffle."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], schema=_FINGERPRINT)

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, "doc_id long, fingerprint string")


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits lie below the key, in two steps over about the square root of their number."""
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    tops = F.lit([g[-1] for g in groups])
    coarse = F.size(F.filter(tops, lambda s: s < key))
    within = F.get(F.lit([g + [g[-1]] * (step - len(g)) for g in groups]), coarse)
    fine = F.coalesce(F.size(F.filter(within, lambda s: s < key)), F.lit(0))
    return F.least(coarse * step + F.when(coarse < len(groups), fine).otherwise(0), F.lit(len(splits))).cast("int")


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _edited(text: str, after: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) in order: each row waits for the next of its part; a guest only serves as next."""
    held: tuple | None = None
    for batch in source:
        out = []
        for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            print_ = fingerprint(text)
            if held and held[0] == part:
                _, own_id, own, own_print = held
                edited = _edited(own, text)
                edited_print = fingerprint(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                near, after = likeness(own_print, edited_print), likeness(own_print, print_)
                out.append((own_id, len(own), digest, own_print, edited_print, near, after))
            held = None if guest else (part, doc_id, text, print_)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)


def neighbour_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint against its edited text's and against the next document's, in descending id order.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document; after the
    last document comes the first. ``ranges`` (by default four for each shuffle partition) bounds what the driver holds: one
    id a range.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long"), text_of().alias("text"))
    high, splits = keyed.agg(
        F.max("key"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)
    ).first()
    splits = sorted({s for s in splits or [] if s < high}) if high is not None else []
    # A split is a row's own key, so the rows with the key of a split are the first of their range in descending order.
    part = _range_of(F.col("key"), splits) if splits else F.lit(0)
    placed = keyed.withColumn("part", part)
    return _with_guests(placed, splits, high).mapInArrow(_rows, _RESULT)


def _with_guests(placed: DataFrame, splits: list[int], high: int | None) -> DataFrame:
    """Add to each range, as its last row, the row that follows it: the first of the next range, or of all rows.

    Of rows with one key at a range's top, the one with the greatest text comes first, so that row is the guest.
    """
    tops = placed.where(F.col("key").isin([*splits, high])) if high is not None else placed.where("false")
    guests = tops.groupBy("part", "key").agg(F.max_by("doc_id", "text").alias("doc_id"), F.max("text").alias("text"))
    last = len(splits)
    guests = guests.select(
        F.when(F.col("key") == F.lit(high), 0).otherwise(F.col("part") + 1).cast("int").alias("part"), F.lit(True).alias("guest"), "key", "doc_id", "text"
    ).where(F.col("part") <= last)
    every = placed.select("part", F.lit(False).alias("guest"), "key", "doc_id", "text").unionByName(guests)
    # One sort column for the shuffle's key keeps a range whole; within it: own rows in descending order, then the guest.
    return every.repartition("part").sortWithinPartitions("part", "guest", F.desc("key"), F.desc("text")).select("part", "guest", "doc_id", "text")
