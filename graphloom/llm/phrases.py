"""Collocations: phrases of two to four words that stand together more often than apart, by language.

Words of at least LEAST occurrences in their language get numbers, the most frequent the smallest; no phrase that counts can hold
another word, so pieces are broken there. At every place the numbers of up to four words are packed into a key of 16 bytes, four
big-endian bytes a word and zeros where the piece ends. A task sorts its keys by radix, 16 bits at a time, and counts runs; the
keys go to ranges, are sorted there, and a run of equal beginnings is the count of a phrase of two, three or four words at once.
Where ranges begin is read off the keys of a sample of the texts, so that all texts are packed once; it says only which task counts a key.
Only phrases at the edge of a batch can be counted in parts, so those and the frequent ones are all that is summed up afterwards.

The dictionary is counted: up to ``most_words`` it is sent to the tasks; a larger one is joined to the words of pieces, which are
cut to segments that overlap by three words, so that no text or piece is gathered whole. The best of each language are found
in rounds, each over fewer groups, so that no task orders a language's phrases alone.

Edge cases: a null text is empty, a null language is ``und``; a text or piece of one word has no phrase; repeated rows count as often
as they occur; ids and other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, text_of

LEAST, MOST_RANK, LONGEST, SHARE = 30, 2000, 4, 80
#: Words of a dictionary that is sent to Python tasks, rows of a table that is sent to joins, keys and different words that a task holds at
#: once. Few keys come again within a task (holding eight times as many makes 5.3 million rows of 5.7), so it holds few.
MOST_WORDS, MOST_SENT, HELD, HELD_WORDS = 1_000_000, 200_000, 250_000, 500_000
SEGMENT, CHARACTERS = 512, 250_000
#: Places that a range has at least, and for each range: places of the sample, and keys of it that are sent to the driver.
LEAST_RANGE, SAMPLED, BOUNDS = 20_000, 10_000, 100
_NONE = "und"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case, the characters between pieces to a line feed, tab to a space.
_FOLD = bytes.maketrans(_UPPER.encode() + b".,;:!?\x0b\x0c\x0d\t", _LOWER.encode() + b"\n" * 9 + b" ")


def words_of(texts: list[str]) -> list[bytes]:
    """The words of texts in order; a full stop, which no word holds, stands between pieces and between texts."""
    return "\n".join(texts).encode("utf-8", "replace").translate(_FOLD).replace(b"\n", b" . ").split()


def _pieces(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)).alias("lang"), text_of().alias("text"))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """A batch's texts by language, about CHARACTERS or one text at a time."""
    held: dict[str, list[str]] = {}
    sizes: Counter = Counter()
    for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text)
            if sizes[lang] > CHARACTERS:
                yield lang, held.pop(lang)
                del sizes[lang]
    yield from held.items()


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): counts of words, and under a null word how many there are."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(b".", None)
            total, left = sum(found.values()), iter(found.items())
            while some := list(islice(left, 50_000)):
                columns = [lang] * len(some), [w.decode() for w, _ in some], [n for _, n in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([None], pa.string()), pa.array([total], pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    for batch in source:
        for lang, texts in _by_language(batch):
            counts.setdefault(lang, Counter()).update(words_of(texts))
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from rows(counts)
            counts = {}
    if counts:
        yield from rows(counts)


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, n) of words that occur so often in their language, and of a null word: all occurrences."""
    counted = _pieces(docs).mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return durable(counted.where((F.col("n") >= least) | F.col("word").isNull()))


def dictionary(counts: DataFrame) -> DataFrame:
    """(id, lang, word, n): words numbered from 1 by falling count, from the sizes of sorted partitions."""
    ordered = durable(counts.where("word is not null").orderBy(F.desc("n"), "lang", "word"))
    at = ordered.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()  # a row a partition
    first, before = {}, 1
    for r in sorted(at):
        first[r["part"]], before = before, before + r["count"]
    if before > 1 << 31:
        raise ValueError("a dictionary holds at most 2^31 words")
    starts = pa.table({"part": pa.array(first.keys(), pa.int32()), "first": pa.array(first.values(), pa.int64())})  # rows would start Python workers
    starts = ordered.sparkSession.createDataFrame(starts)
    placed = ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within"), "lang", "word", "n")
    return durable(placed.join(F.broadcast(starts), "part").select((F.col("first") + F.col("within")).alias("id"), "lang", "word", "n"))


def radix_sorted(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of two 64-bit halves in order, by stable passes over 16 bits; halves' digits that are all equal are passed over."""
    for half in (1, 0):
        for shift in (0, 16, 32, 48):
            digits = ((low if half else high) >> np.uint64(shift)).astype(np.uint16)
            if len(digits) and digits.min() != digits.max():
                order = np.argsort(digits, kind="stable")
                high = high[order]  # one after another, so that each takes the place of the last
                low = low[order]
                n = n[order]
    return high, low, n


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def keys_of(ids: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The packed keys (high, low) of places where two known words or more begin; 0 is no known word."""
    ids = np.append(ids.astype(np.uint64), np.zeros(LONGEST - 1, np.uint64))
    size = len(ids) - LONGEST + 1
    a, b, c, d = (ids[k : k + size] for k in range(LONGEST))
    c = c * (b > 0)
    d = d * (c > 0)
    wanted = (a > 0) & (b > 0) if own is None else (a > 0) & (b > 0) & own
    shift = np.uint64(32)
    return (a[wanted] << shift) | b[wanted], (c[wanted] << shift) | d[wanted]


class _Keys:
    """Gathers keys and gives them as counted, sorted rows (key, n, part), the part being the range between ``bounds``."""

    def __init__(self, bounds: list[bytes] | None = None) -> None:
        self.bounds = np.array(bounds or [], "S16")
        self.clear()

    def clear(self) -> None:
        self.high: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = self.unsummed = 0

    def add(self, high: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.high.append(high)
        self.low.append(low)
        self.n.append(np.ones(len(high), np.int64))
        self.size, self.unsummed = self.size + len(high), self.unsummed + len(high)
        if self.unsummed > HELD // 2:
            self._sum()
            if self.size > HELD:
                yield from self.rows()

    def _sum(self) -> None:
        """Sorts and counts what is held; nothing is held twice meanwhile, as a task's memory is mostly this."""
        high, low, n = radix_sorted(_taken(self.high), _taken(self.low), _taken(self.n))
        starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(n) else np.zeros(0, np.int64)
        self.high, self.low, self.n = [high[starts]], [low[starts]], [np.add.reduceat(n, starts) if len(n) else n]
        self.size, self.unsummed = len(starts), 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._sum()
            high, low, counts = self.high[0], self.low[0], self.n[0]
            self.clear()
            for i in range(0, len(counts), 50_000):
                packed, n = np.stack([high[i : i + 50_000], low[i : i + 50_000]], axis=1).astype(">u8"), counts[i : i + 50_000]
                offsets = np.arange(0, 16 * len(n) + 1, 16, dtype=np.int32)
                keys = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
                edges = np.searchsorted(packed.view("S16").ravel(), self.bounds)
                part = np.repeat(np.arange(len(edges) + 1, dtype=np.int32), np.diff(edges, prepend=0, append=len(n)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(part)], names=["key", "n", "part"])


def _numbers(table: pa.Table) -> dict[str, dict[bytes, int]]:
    """By language the number of each word; a slice at a time, so that a large dictionary is not held as lists besides."""
    known: dict[str, dict[bytes, int]] = {}
    for part in table.to_batches(max_chunksize=10_000):
        for lang, word, number in zip(*(c.to_pylist() for c in part.columns)):
            known.setdefault(lang, {})[word.encode()] = number
    return known


def _packed_sent(docs: DataFrame, numbered: DataFrame, bounds: list[bytes]) -> DataFrame:
    """(key, n, part), the dictionary sent to every task."""
    table = numbered.select("lang", "word", "id").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys = _numbers(shared.value), _Keys(bounds)
        for batch in source:
            for lang, texts in _by_language(batch):
                words = words_of(texts)
                get = known.get(lang, {}).get
                yield from keys.add(*keys_of(np.fromiter(map(get, words, repeat(0)), np.int64, len(words))))
        yield from keys.rows()

    return _pieces(docs).mapInArrow(batches, "key binary, n long, part int")


def _segments(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words): pieces cut every SEGMENT words; all but a piece's last segment hold the next three words too."""
    for batch in source:
        langs, rows = [], []
        for lang, texts in _by_language(batch):
            for piece in b" ".join(words_of(texts)).decode().split("."):
                words = piece.split(" ")
                words = [w for w in words if w]
                for at in range(0, len(words) - 1, SEGMENT):
                    langs.append(lang)
                    rows.append(words[at : at + SEGMENT + LONGEST - 1])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.list_(pa.string()))], names=["lang", "words"])


def _packed_joined(docs: DataFrame, numbered: DataFrame, bounds: list[bytes]) -> DataFrame:
    """(key, n, part), the dictionary joined to the words of segments."""
    cut = _pieces(docs).mapInArrow(_segments, "lang string, words array<string>")
    cut = durable(cut.select(F.monotonically_increasing_id().alias("segment"), "lang", "words"))
    placed = cut.select("segment", "lang", F.posexplode("words").alias("at", "word"))
    met = placed.join(numbered.select("lang", "word", "id"), ["lang", "word"])
    lists = met.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("found")).select(F.col("found.at").alias("at"), F.col("found.id").alias("ids"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, span = _Keys(bounds), SEGMENT + 2 * LONGEST  # segments lie apart on one line, so that no key spans two
        for batch in source:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                offsets = part.column(0).offsets.to_numpy()
                at, ids = (part.column(i).flatten().to_numpy() for i in (0, 1))
                place = at + span * np.repeat(np.arange(part.num_rows), np.diff(offsets))
                line = np.zeros(span * part.num_rows, np.int64)
                line[place] = ids
                yield from keys.add(*keys_of(line, np.arange(len(line)) % span < SEGMENT))
        yield from keys.rows()

    return lists.mapInArrow(batches, "key binary, n long, part int")


def _runs(least: int):  # noqa: ANN202
    """Sorted rows (key, n) to counts (key, m, n) of beginnings of m words: frequent ones, and parts of those at a batch's edges."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            size = batch.num_rows
            if not size:
                continue
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(size, LONGEST)
            n = batch.column(1).to_numpy()
            fresh, found, lengths, sums = np.zeros(size, bool), [], [], []
            fresh[0] = True
            fresh[1:] = keys[1:, 0] != keys[:-1, 0]
            for m in range(2, LONGEST + 1):
                fresh[1:] |= keys[1:, m - 1] != keys[:-1, m - 1]
                starts = np.flatnonzero(fresh)
                total = np.add.reduceat(n, starts)
                kept = total >= least
                kept[[0, -1]] = True
                kept &= keys[starts, m - 1] > 0
                rows = keys[starts[kept]].copy()
                rows[:, m:] = 0
                found += [rows[i].tobytes() for i in range(len(rows))]
                lengths += [m] * len(rows)
                sums += total[kept].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], names=["key", "m", "n"])

    return batches


def _bounds(sampled: DataFrame, ranges: int) -> list[bytes]:
    """Keys that cut the sampled ones into ranges of about equal numbers of different keys; none if there are too few."""
    keys = durable(sampled.select("key").distinct())
    size = keys.count()
    thin = keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, size // (BOUNDS * ranges)))) == 0)
    found = sorted(thin.toArrow().column(0).to_pylist()) if size >= BOUNDS * ranges else []
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def phrase_counts(docs: DataFrame, numbered: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, m, a): how often each phrase of two to four dictionary words occurs, if so often."""
    words, places = numbered.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    packed = _packed_sent if words <= most_words else _packed_joined
    ranges = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + places // LEAST_RANGE)
    bounds = _bounds(packed(docs.sample(min(1.0, SAMPLED * ranges / max(1, places)), 1), numbered, []), ranges) if ranges > 1 else []
    keys = packed(docs, numbered, bounds)
    if ranges == 1 or bounds:
        ranged = keys.repartitionById(ranges, "part")
    else:  # a few long texts, of which none may be sampled
        ranged = keys.repartitionByRange("key")
    summed = ranged.select("key", "n").sortWithinPartitions("key").mapInArrow(_runs(least), "key binary, m int, n long").groupBy("key", "m").agg(F.sum("n").alias("a"))
    return durable(summed.where(F.col("a") >= least))


def _part(start: int, words: int) -> Column:
    """The key of so many words of a key, from the one at ``start`` on."""
    return F.concat(F.substring("key", 4 * start + 1, 4 * words), F.lit(bytes(4 * (LONGEST - words))))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scored(counts: DataFrame, numbered: DataFrame) -> DataFrame:
    """(key, m, a, l, r, score): each phrase with its lowest-scoring cut; the first of equals."""
    single = F.concat(F.unhex(F.lpad(F.hex("id"), 8, "0")), F.lit(bytes(4 * (LONGEST - 1))))
    known = counts.select(F.col("key").alias("part"), F.col("a").alias("f")).union(numbered.select(single.alias("part"), "n"))
    cuts = [F.when(F.col("m") == m, F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")) for k in range(1, m) for side, part in (("l", _part(0, k)), ("r", _part(k, m - k))))))
            for m in range(2, LONGEST + 1)]
    held = counts.select("key", "m", "a", F.inline(F.coalesce(*cuts))).join(known, "part")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = held.groupBy("key", "m", "a").agg(*(of(k, side) for k in range(1, LONGEST) for side in "lr"))
    score = lambda k: F.expr(f"CAST(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) AS DECIMAL(38,0)) div CAST(l{k} + r{k} AS DECIMAL(38,0))")
    each = F.array(*(F.when(F.col("m") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)))
    return wide.withColumn("cut", F.array_min(F.array_compact(each))).select("key", "m", "a", "cut.l", "cut.r", "cut.score")


def without_covered(found: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """Phrases of which no longer phrase that holds them has ``share`` per cent of their count or more."""
    inner = [F.when(F.col("m") == m, F.array(*(_part(i, j) for j in range(2, m) for i in range(m - j + 1)))) for m in range(3, LONGEST + 1)]
    longer = counts.where("m > 2").select(F.explode(F.coalesce(*inner)).alias("key"), F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("cover"))
    covered = F.coalesce(_wide(F.col("cover")) * 100 >= _wide(F.col("a")) * share, F.lit(False))
    return found.join(longer, "key", "left").where(~covered).drop("cover")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def spelt(found: DataFrame, numbered: DataFrame) -> DataFrame:
    """The phrases with their language and words."""
    names = _sent(numbered.select("id", "lang", "word"))
    for i in range(LONGEST):
        number = F.conv(F.hex(F.substring("key", 4 * i + 1, 4)), 16, 10).cast("long")
        found = found.withColumn("id", number).join(names.select("id", *(["lang"] if i == 0 else []), F.col("word").alias(f"w{i}")), "id", "left").drop("id")
    return found.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(LONGEST)))).drop(*(f"w{i}" for i in range(LONGEST)))


def best(found: DataFrame, most: int = MOST_RANK) -> DataFrame:
    """The first so many of each language, with their rank; rounds over ever fewer groups of a language keep groups small."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    spread = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(4096)).cast("int"))
    for groups in (4096, 256, 16, 1):
        by = Window.partitionBy("lang", F.col("salt") % groups).orderBy(*order)
        spread = spread.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return spread.drop("salt").withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_RANK, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language."""
    counts = word_counts(docs, least)
    numbered = dictionary(counts)
    phrases = phrase_counts(docs, numbered, least, most_words)
    kept = without_covered(scored(phrases, numbered), phrases)
    total = counts.where("word is null").select("lang", "n")
    return best(spelt(kept, numbered), most).join(_sent(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
