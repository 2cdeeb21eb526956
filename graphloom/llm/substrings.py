"""Removal of repeated word passages by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of the runs of MER words inside it. Consecutive
windows that share a minimiser are one super-k-mer: it travels as one packed string to the minimiser's bucket, and equal
windows meet there, since they have equal minimisers. Sorting a bucket's windows brings equal ones together; the smallest
document id of a window decides who keeps it.

Three exact savings keep the shuffle below a few times the input:

* Only minimisers that occur in two documents or more can hold a repeated window, so (minimiser, document) pairs are matched
  first and only super-k-mers of shared minimisers are packed.
* Minimisers that are frequent in a sample of documents are taken as shared without a match. Their windows are parted by a second
  minimiser, the next smallest hash inside them: consecutive windows that share both travel as one, to a bucket of both, so no
  bucket has to hold all that surrounds a frequent run of words. Those of the most frequent
  are also spread by document over as many salts as their count in the sample asks for: within a salt the smallest id decides;
  then the salts' smallest ids, one a salt and window, are compared. The sample only chooses the route; windows of all routes
  are compared.

* A super-k-mer holds at most MOST_WINDOWS windows, and equal ones of a document travel once with all their places, so a text that
  repeats one word without end costs what a short one does but for its places.
* Later copies of a whole text are known by its MD5: all their windows start in the first copy, so they are left out of the
  search and lose every word (of 13 or more). Only the first id of each text is sent back, however many copies there are.

So a bucket holds at most about FREQUENT of SAMPLE_ROWS documents (a five-hundredth of all), a window or a salt of it at most about
SPREAD (a hundredth), and what is gathered beyond that is summed up before it is shuffled.

Texts are shuffled once, by id (those without an id by a hash of the text), and that exchange serves the search, the packing
and the removal.

Edge cases: a null or empty text has no words and keeps an empty text. Documents of fewer than WINDOW words keep all. A null
id counts as larger than any. Rows that repeat an id do not count against each other, and each has the result of its own text. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, hash_sampled, sample_rate, text_of

WINDOW, MER = 13, 4
#: Windows of a packed super-k-mer at most; a run of one word is one minimiser over any length, and is cut into equal pieces.
MOST_WINDOWS = 64
SAMPLE_ROWS, FREQUENT, SPREAD = 20_000, 40, 200
_LAST = (1 << 63) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """A text's words on one line, their places in its bytes, and a 64-bit hash of each.

    The hash of a word is a polynomial in its bytes, modulo 2^64, taken from prefix sums over the whole line; the inverse of
    the odd base takes the word's place out of it. Equal words have equal hashes; that others may too costs time only, since
    windows are compared by their words.
    """

    _base = 0x9E3779B97F4A7C15
    _up, _down = _powers(_base, 1 << 12), _powers(pow(_base, -1, 1 << 64), 1 << 12)

    def __init__(self, text: str) -> None:
        parts = text.encode("utf-8", "replace").split()
        self.line, self.count = b" ".join(parts), len(parts)
        if self.count < WINDOW:
            return
        size = len(self.line)
        if len(Words._up) <= size:
            Words._up, Words._down = _powers(self._base, 2 * size), _powers(pow(self._base, -1, 1 << 64), 2 * size)
        letters = np.frombuffer(self.line, np.uint8)
        gaps = np.flatnonzero(letters == 32)
        self.starts, self.ends = np.append(0, gaps + 1), np.append(gaps, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((letters + np.uint64(1)) * Words._up[:size], out=sums[1:])
        self.hashes = (sums[self.ends] - sums[self.starts]) * Words._down[self.starts]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _mers(words: Words) -> np.ndarray:
    """A mixed hash of each run of MER words; none if the text has no window."""
    if words.count < WINDOW:
        return np.zeros(0, np.uint64)
    size = words.count - MER + 1
    mers = words.hashes[:size].copy()
    for k in range(1, MER):
        mers = mers * _MULTIPLIER + words.hashes[k : k + size]
    return _mix(mers)


def minimisers(mers: np.ndarray) -> np.ndarray:
    """The minimiser of each window, as a signed long."""
    if not len(mers):
        return np.zeros(0, np.int64)
    least, span, whole = mers, 1, WINDOW - MER + 1
    while span < whole:  # minima over twice the span, then over the whole
        step = min(span, whole - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least.view(np.int64)


def second_buckets(mers: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A bucket for each window from its minimiser and the next smallest hash inside it."""
    least = found.view(np.uint64)
    second = np.full(len(least), np.iinfo(np.uint64).max)
    for k in range(WINDOW - MER + 1):
        here = mers[k : k + len(least)]
        np.minimum(second, here, out=second, where=here != least)
    return _mix(least ^ (second * _MULTIPLIER)).view(np.int64)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays; null is empty."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(held):
        return np.zeros(len(values), bool)
    at = np.searchsorted(held, values)
    at[at == len(held)] = 0
    return held[at] == values


def _pairs(left_out: frozenset[int] | dict[int, int]):  # noqa: ANN202
    """Rows (key, text, tie) to each document's different minimisers, but for those left out."""
    held = np.array(sorted(left_out), np.int64)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [np.unique(minimisers(_mers(Words(t)))) for t in part.column(1).to_pylist()]
                minimiser = np.concatenate(found)
                wanted = ~_among(minimiser, held)
                key, tie = (np.repeat(part.column(i).to_numpy(), [len(x) for x in found])[wanted] for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(minimiser[wanted]), pa.array(key), pa.array(tie)], names=["minimiser", "key", "tie"])

    return batches


def _packed(frequent: dict[int, int]):  # noqa: ANN202
    """Rows (key, text, shared minimisers, tie) to super-k-mers (bucket, salt, key, starts, words, tie); salt 0 is not spread."""
    often = np.array(sorted(frequent), np.int64)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple[int, int, int, list[int], bytes, int]] = []
                for key, text, shared, tie in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _lists(part.column(2)), part.column(3).to_pylist()):
                    words = Words(text)
                    mers = _mers(words)
                    found = minimisers(mers)
                    if not len(found):
                        continue
                    hot = _among(found, often)
                    buckets = np.where(hot, second_buckets(mers, found), found) if hot.any() else found
                    edges = np.append(0, np.flatnonzero((np.diff(found) != 0) | (np.diff(buckets) != 0)) + 1)
                    wanted = hot[edges] | np.isin(found[edges], shared)
                    starts, stops = edges[wanted], np.append(edges[1:], len(found))[wanted]
                    # What a document repeats travels once, with all its places.
                    places: dict[tuple[int, int, bytes], list[int]] = {}
                    if len(starts) and (stops - starts).max() > MOST_WINDOWS:
                        pieces = -(-(stops - starts) // MOST_WINDOWS)
                        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                        starts, stops = np.repeat(starts, pieces) + nth * MOST_WINDOWS, np.repeat(stops, pieces)
                        stops = np.minimum(starts + MOST_WINDOWS, stops)
                    runs = zip(found[starts].tolist(), buckets[starts].tolist(), starts.tolist(), words.starts[starts].tolist(), words.ends[stops + WINDOW - 2].tolist())
                    for minimiser, bucket, a, low, high in runs:
                        salts = frequent.get(minimiser, 1)
                        salt = 1 + (key ^ tie) % salts if salts > 1 else 0
                        places.setdefault((bucket, salt, words.line[low:high]), []).append(a)
                    rows += [(bucket, salt, key, at_, packed, tie) for (bucket, salt, packed), at_ in places.items()]
                if rows:
                    columns = list(zip(*rows))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int32())
                    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                    arrays[4] = arrays[4].cast(pa.string())
                    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "salt", "key", "starts", "words", "tie"])

    return batches


def frequent_minimisers(docs: DataFrame) -> dict[int, int]:
    """Minimisers in at least FREQUENT documents of a bounded sample, and their salts; the sample's size bounds their number."""
    rate = sample_rate(docs.count(), SAMPLE_ROWS)
    sampled = hash_sampled(docs, rate, "key").select("key", "text", F.lit(0).alias("tie")).mapInArrow(_pairs(frozenset()), "minimiser long, key long, tie int")
    found = sampled.groupBy("minimiser").count().where(F.col("count") >= FREQUENT)
    return {r["minimiser"]: -(-r["count"] // SPREAD) for r in found.collect()}


def repeated_windows(texts: DataFrame, frequent: dict[int, int]) -> DataFrame:
    """(key, tie, start): the windows whose words also start in a document of a smaller key, from (key, tie, text)."""
    # One exchange serves the count and what it is joined to: both read all of its columns and rows that
    # are not null, as the join asks, so that it is the same for both. Key and tie are never null; that is said again after the
    # sum, else the join with the texts would ask it of one side of the exchange alone.
    pairs = texts.select("key", "text", "tie").mapInArrow(_pairs(frequent), "minimiser long, key long, tie int").where(F.col("minimiser").isNotNull()).repartition("minimiser")
    met = pairs.groupBy("minimiser").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("tie").alias("tie")).where("low < high and tie >= 0").select("minimiser")
    shared = pairs.join(met, "minimiser").groupBy("key", "tie").agg(F.collect_list("minimiser").alias("shared"))
    shared = shared.select(F.coalesce("key", F.lit(_LAST)).alias("key"), F.coalesce("tie", F.lit(0)).alias("tie"), "shared")
    rows = _of_text(texts, shared, "left").select("key", "text", "shared", "tie")
    packed = rows.mapInArrow(_packed(frequent), "bucket long, salt int, key long, starts array<int>, words string, tie int")
    windows = F.transform(F.sequence(F.lit(1), F.size("list") - (WINDOW - 1)), lambda i: F.array_join(F.slice("list", i, WINDOW), " "))
    spread = packed.repartition("bucket", "salt").withColumn("list", F.split("words", " ")).select(
        "bucket", "salt", "key", "tie", "starts", F.posexplode(windows).alias("place", "window")
    )
    # A bucket and salt holds a bounded share of the documents. Of a spread window only the smallest id of each salt is still
    # open; those meet by bucket and window, a row a salt, while what is decided goes by its own key.
    low = spread.withColumn("low", F.min("key").over(Window.partitionBy("bucket", "salt", "window")))
    open_ = F.col("low") == F.col("key")
    held = low.where((F.col("low") < F.col("key")) | (open_ & (F.col("salt") > 0))).select(
        "key", "tie", "place", "starts", F.when(open_, F.col("bucket")).otherwise(F.xxhash64("key", "place")).alias("group"), F.when(open_, F.col("window")).alias("window")
    )
    first = F.min("key").over(Window.partitionBy("group", "window"))
    later = held.withColumn("first", first).where(F.col("window").isNull() | (F.col("first") < F.col("key")))
    return later.select("key", "tie", "place", F.explode("starts").alias("start")).select("key", "tie", (F.col("start") + F.col("place")).alias("start"))


def _spot() -> Column:
    """Where a text lies: by its key, or, without an id, by its tie."""
    return F.when(F.col("key") == _LAST, F.col("tie").cast("long")).otherwise(F.col("key"))


def _of_text(texts: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with what was found for them. The join is by spot alone, as the texts lie; key and tie are compared beside it."""
    right = found.select(_spot().alias("of"), F.col("key").alias("of_key"), F.col("tie").alias("of_tie"), *(c for c in found.columns if c not in ("key", "tie")))
    beside = (F.col("key") - F.col("of_key") == 0) & (F.col("tie") - F.col("of_tie") == 0)
    return texts.join(right, (F.col("spot") == F.col("of")) & beside, how).drop("of", "of_key", "of_tie")


def _kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, is a later copy, starts) to (doc_id, n_words, n_removed, kept)."""
    for batch in source:
        totals, removed, texts = [], [], []
        for text, copy, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _lists(batch.column(3))):
            words = text.encode("utf-8", "replace").split()
            if copy and len(words) >= WINDOW:
                out, kept = len(words), b""
            elif len(starts):
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts)
                cover[at] += 1
                cover[at + WINDOW] -= 1
                left = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
                out, kept = len(words) - len(left), b" ".join([words[i] for i in left])
            else:
                out, kept = 0, b" ".join(words)
            totals.append(len(words))
            removed.append(out)
            texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(source):
        digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], digests], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame) -> DataFrame:
    text = text_of()
    tie = F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int")
    # Texts without an id are told apart by a hash, which also says where they lie.
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), text.alias("text"), F.when(F.col("doc_id").isNull(), tie).otherwise(0).alias("tie"))
    keyed = keyed.select("key", "text", _spot().alias("spot"))
    digests = durable(keyed.select("key", "spot", F.md5("text").alias("digest")))
    named = digests.where(F.col("key") != _LAST)
    # Ids with several texts tell them apart by a hash too; all others have tie 0, which costs nothing in the shuffles.
    several = named.groupBy(F.col("key").alias("spot")).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("spot", F.lit(True).alias("several"))
    first = digests.groupBy(F.col("digest").alias("of_digest")).agg(F.min(F.struct("key", "spot")).alias("f")).select("of_digest", F.col("f.key").alias("of_key"), F.col("f.spot").alias("spot"))
    apart = F.coalesce("several", F.lit(False)) | (F.col("key") == _LAST)
    tied = keyed.repartition("spot").join(several, "spot", "left").select("spot", "key", "text", F.when(apart, F.pmod(F.xxhash64("text"), F.lit(1 << 31))).otherwise(0).cast("int").alias("tie"), "several")
    # The first id of a text is not a copy; neither are texts of an id with several, which are searched as they are.
    firsts = first.select(F.col("spot").alias("of"), "of_key", "of_digest")
    texts = tied.join(firsts, (F.col("spot") == F.col("of")) & (F.col("key") - F.col("of_key") == 0) & (F.position("of_digest", F.md5("text")) == 1), "left").select(
        "spot", "key", "text", "tie", (F.col("of_key").isNull() & F.col("several").isNull() & (F.col("key") != _LAST)).alias("copy")
    )
    found = repeated_windows(texts.where(~F.col("copy")).select("spot", "key", "text", "tie"), frequent_minimisers(keyed))
    gone = found.groupBy("key", "tie").agg(F.collect_list("start").alias("starts"))
    marked = _of_text(texts, gone, "left")
    none = F.array().cast("array<int>")
    return marked.select(F.when(F.col("key") != _LAST, F.col("key")).alias("doc_id"), "text", "copy", F.coalesce("starts", none).alias("starts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space."""
    return _joined(docs).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return _joined(docs).mapInArrow(_hashed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
