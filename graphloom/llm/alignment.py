"""Alignment of two tokenizers' tokens over the same bytes.

A whole Arrow batch is laid out as one line of bytes, each document at its offset. The ends of the tokens of both tokenizers
are counted into one array over that line (``bincount``): where both end a group ends, where either ends a link ends, since a
stretch between two neighbouring ends lies in exactly one token of each. Running sums over the line give, at the documents'
offsets, the groups and links of each document; nothing is looped over tokens.

Words between single spaces are tokenised once a worker and remembered, as neither tokenizer merges over a space that has no white
space beside it; texts for which that is not sure are tokenised whole. The vocabulary files are read by the driver and sent: their
size is fixed. A document's different links, with how often it has them, are written to the shared folder once, so that the
corpus-wide counts and what each document draws from them are two reads of one table. The counts are sent to every task if they
are few; else the join shuffles.

Edge cases: a text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens: zeros and an empty
string. Strings of special tokens are plain text. Repeated rows each give a row and each count; null ids stay null; other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.bpe import letters_of_bytes
from graphloom.llm.common import shared_folder

#: Characters of the texts that are laid out at once, words and characters that a worker remembers, and counts that are sent.
MOST_CHARS, REMEMBERED, MOST_REMEMBERED_CHARS, MOST_SENT = 1_000_000, 200_000, 4_000_000, 1_000_000
_AT_ONCE = 5_000
_SPACE = "▁"
#: Where a word may not stand alone: white space beside a space, at the start or, a space, at the end; the pieces' own space.
_WHOLE = re.compile(rf"^\s| \s| $|{_SPACE}").search


class _Numbers(dict):
    """Numbers words as they are first met and keeps them in ``fresh`` until they are tokenised."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class _Side:
    """One tokenizer's ids of the remembered words, end to end."""

    def __init__(self, names: list[bytes]) -> None:
        self.names = names
        self.bytes = np.array([len(x) for x in names], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32)])
        self.counts = np.concatenate([self.counts, np.array([len(x) for x in lists], np.int64)])
        self.starts = _offsets(self.counts)[:-1]

    def spelt(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words, offset of each word's first)."""
        counts = self.counts[words]
        at = _offsets(counts)
        return self.ids[np.repeat(self.starts[words] - at[:-1], counts) + np.arange(at[-1])], at


class Aligned:
    """What a batch of texts gives. Arrays end in one entry more than there are documents where they hold offsets."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        line = int(a_ends[-1]) if len(a_ends) else 0
        ends = (np.bincount(a_ends, minlength=line + 1) + 2 * np.bincount(b_ends, minlength=line + 1)).astype(np.uint8)
        at = _offsets(a_size[a])[a_at]  # each document's place on the line
        self.groups_at, self.links_at = np.cumsum(ends == 3)[at], np.cumsum(ends > 0)[at]
        self.a_cut, self.b_cut = ends[a_ends] == 3, ends[b_ends] == 3
        met = ends[ends > 0]
        in_a, in_b = met & 1, met >> 1
        self.link_a, self.link_b = a[np.cumsum(in_a, dtype=np.int64) - in_a], b[np.cumsum(in_b, dtype=np.int64) - in_b]

    def listed(self, digits: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups of all documents as ``a1,a2|b1;`` on one line, and where each document's begin."""
        a_group, b_group = (np.cumsum(cut) - cut for cut in (self.a_cut, self.b_cut))
        n = int(self.groups_at[-1])
        a_in, b_in = (np.bincount(g, minlength=n) for g in (a_group, b_group))
        size = len(self.a) + len(self.b)
        ids, marks = np.empty(size, np.int32), np.empty(size, np.uint8)
        a_to, b_to = np.arange(len(self.a)) + _offsets(b_in)[a_group], np.arange(len(self.b)) + _offsets(a_in)[b_group + 1]
        ids[a_to], ids[b_to] = self.a, self.b
        marks[a_to], marks[b_to] = np.where(self.a_cut, ord("|"), ord(",")), np.where(self.b_cut, ord(";"), ord(","))
        long = sizes[ids]
        shown = digits[ids]
        shown[np.arange(size), long] = marks
        line = shown[np.arange(shown.shape[1]) <= long[:, None]].tobytes()
        return line, _offsets(long + 1)[self.a_at + self.b_at]


class Aligner:
    def __init__(self, a_file: str, b_file: bytes) -> None:
        self.a_coder = Tokenizer.from_str(a_file)
        self.a_coder.encode_special_tokens = True
        self.a_coder.no_truncation()
        self.a_coder.no_padding()
        self.b_coder = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = letters_of_bytes()
        spelt = {i: t for t, i in self.a_coder.get_vocab().items()}
        of_letters = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a = _Side([of_letters(spelt.get(i, "")) for i in range(max(spelt) + 1)])
        pieces = [self.b_coder.id_to_piece(i) for i in range(self.b_coder.get_piece_size())]
        self.b = _Side([bytes([int(p[3:5], 16)]) if self.b_coder.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.apart = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        most = max(len(self.a.names), len(self.b.names))
        width = len(str(most - 1))
        self.sizes = np.array([len(str(i)) for i in range(most)])
        self.digits = np.frombuffer("".join(str(i).ljust(width + 1) for i in range(most)).encode(), np.uint8).reshape(most, width + 1)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars, self.good = _Numbers(), 0, np.zeros(0, bool)
        self.a.clear()
        self.b.clear()

    def _learn(self) -> None:
        fresh = self.numbers.fresh
        for low in range(0, len(fresh), _AT_ONCE):
            words = fresh[low : low + _AT_ONCE]
            a = [e.ids for e in self.a_coder.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
            b = self.b_coder.encode(words, num_threads=1)
            same = [self.a.spelt(x) == self.b.spelt(y) == b" " + w.encode() for w, x, y in zip(words, a, b)]
            self.a.add(a)
            self.b.add(b)
            self.good = np.append(self.good, np.array(same, bool))
            self.chars += sum(map(len, words))
        fresh.clear()

    def align(self, texts: list[str | None]) -> Aligned:
        if len(self.numbers) > REMEMBERED or self.chars > MOST_REMEMBERED_CHARS:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = text.split(" ") if self.apart and not _WHOLE(text) else [text]
                counts[i] = len(found)
                words += found
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        bad = np.diff(np.cumsum(np.append(0, ~self.good[numbers]))[_offsets(counts)]) > 0
        numbers = numbers[~np.repeat(bad, counts)]
        at = _offsets(np.where(bad, 0, counts))
        (a, a_at), (b, b_at) = self.a.of(numbers), self.b.of(numbers)
        return Aligned(a, b, a_at[at], b_at[at], self.a.bytes, self.b.bytes)


@lru_cache(maxsize=1)
def _aligner(a_file: str, b_file: bytes) -> Aligner:
    """A worker that is used again keeps its words."""
    return Aligner(a_file, b_file)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most MOST_CHARS bytes of text, or of one row."""
    ends = np.cumsum(np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MOST_CHARS, "right")))
        yield batch.slice(low, high - low)
        low = high


def _files(docs: DataFrame, a_path: str, b_path: str):  # noqa: ANN202
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, a_ends, b_ends): both tokenizers' ids, and after how many of each every group ends."""
    shared = _files(docs, a_path, b_path)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in parts(batch, 2):
                found = _aligner(*shared.value).align(part.column(2).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) for ids, at in ((found.a, found.a_at), (found.b, found.b_at))]
                for cut, at in ((found.a_cut, found.a_at), (found.b_cut, found.b_at)):
                    ends = np.flatnonzero(cut) + 1 - np.repeat(at[:-1], np.diff(found.groups_at))
                    lists.append(pa.ListArray.from_arrays(pa.array(found.groups_at, pa.int32()), pa.array(ends, pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(1), *lists], names=["doc_id", "a", "b", "a_ends", "b_ends"])

    return _rows(docs).mapInArrow(batches, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: counts, the hash of its groups, its different links (a's id * 2^32 + b's id) and how often it has each."""
    shared = _files(docs, a_path, b_path)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in parts(batch, 2):
                aligner = _aligner(*shared.value)
                found = aligner.align(part.column(2).to_pylist())
                line, at = found.listed(aligner.digits, aligner.sizes)
                hashes = [hashlib.sha256(line[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                n_links, width = np.diff(found.links_at), len(aligner.b.names)
                of = np.repeat(np.arange(part.num_rows), n_links) * (len(aligner.a.names) * width)
                keys, times = np.unique(of + found.link_a.astype(np.int64) * width + found.link_b, return_counts=True)
                row, pair = np.divmod(keys, len(aligner.a.names) * width)
                pair = (pair // width << 32) + pair % width
                edges = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                counted = [pa.array(np.diff(x), pa.int64()) for x in (found.a_at, found.b_at, found.groups_at)]
                lists = [pa.ListArray.from_arrays(edges, pa.array(pair)), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *counted, pa.array(n_links, pa.int64()), pa.array(hashes, pa.string()), *lists], names=[c.split()[0] for c in _LINKED.split(", ")])

    return _rows(docs).mapInArrow(batches, _LINKED)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which columns and compression keep smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/linked-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold a pair of ids, and whether no other pair of its B id has more."""
    counts = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def digests(docs: DataFrame, a_path: str, b_path: str, most: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a document."""
    table = written(linked(docs, a_path, b_path))
    rated = written(pair_counts(table))
    rated = F.broadcast(rated) if rated.count() <= most else rated
    held = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = held.join(rated, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return table.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
