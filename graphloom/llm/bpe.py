"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word of the pre-tokenizer starts as its bytes. ``encode_word`` holds the boundaries of its parts and, beside them, the
rank of each adjacent pair in one array. It scans for the smallest rank, deletes the boundary between the two parts, and
refreshes the ranks of the neighbours, until no pair has a rank. The scan is over a short array, so it beats a heap for
usual words; words of over ``LONG_WORD`` bytes take a heap with links, which gives the same merges without a quadratic scan.

The driver reads the vocabulary file, whose size is fixed, and broadcasts it. Documents are encoded where they lie: there
is no shuffle. Each worker remembers words it has seen, up to ``REMEMBERED``, and then starts anew.

Edge cases: a null or empty text has no ids and decodes to an empty text. The strings of added tokens are single ids wherever
they occur, as in the tokenizers library. Repeated rows each give a row; other columns are not read; an empty table gives
an empty result. Ids outside the vocabulary raise ``KeyError`` when decoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import text_of

LONG_WORD = 256
REMEMBERED = 300_000
_NONE = 1 << 60
#: Fixed value: how the byte-level pre-tokenizer of this vocabulary cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letters_of_bytes() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, document: str) -> None:
        data = json.loads(document)
        letters = letters_of_bytes()
        ids: dict[str, int] = data["model"]["vocab"]
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        of_byte = {b: ids[c] for c, b in letters.items() if c in ids}
        self.bytes = [of_byte.get(b, -1) for b in range(256)]
        #: For each id, the rank of its pair with each right neighbour; for each rank, the id of the merged part.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.tokens) + 1)]
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left]].setdefault(ids[right], rank)
            self.merged.append(ids[left + right])


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def encode_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    parts = [i for b in word if (i := vocabulary.bytes[b]) >= 0]
    if len(parts) > LONG_WORD:
        return _encode_long(parts, vocabulary)
    table, merged = vocabulary.ranks, vocabulary.merged
    ranks = [table[a].get(b, _NONE) for a, b in zip(parts, parts[1:])]
    while ranks and (least := min(ranks)) != _NONE:
        at = ranks.index(least)
        parts[at] = part = merged[least]
        del parts[at + 1], ranks[at]
        if at < len(ranks):
            ranks[at] = table[part].get(parts[at + 1], _NONE)
        if at:
            ranks[at - 1] = table[parts[at - 1]].get(part, _NONE)
    return parts


def _encode_long(parts: list[int], vocabulary: Vocabulary) -> list[int]:
    """The same merges in the same order: smallest rank first, leftmost first among equals."""
    table, merged, size = vocabulary.ranks, vocabulary.merged, len(parts)
    before, after, alive = list(range(-1, size - 1)), list(range(1, size + 1)), [True] * size
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int, right: int) -> None:
        rank = table[parts[left]].get(parts[right], _NONE)
        if rank != _NONE:
            heapq.heappush(heap, (rank, left, parts[left], parts[right]))

    for i in range(size - 1):
        offer(i, i + 1)
    while heap:
        rank, at, left, right = heapq.heappop(heap)
        gone = after[at]
        if not alive[at] or gone >= size or parts[at] != left or parts[gone] != right:
            continue
        parts[at], alive[gone], after[at] = merged[rank], False, after[gone]
        if after[at] < size:
            before[after[at]] = at
            offer(at, after[at])
        if before[at] >= 0:
            offer(before[at], at)
    return [p for p, kept in zip(parts, alive) if kept]


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.seen: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.loose = regex.compile(r" \s").search
        self.words = regex.compile(WORDS).findall
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.added.split(text) if self.added else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append(self.vocabulary.added[piece])
            elif piece:
                self._encode_piece(piece, ids)
        return ids

    def _encode_piece(self, piece: str, ids: list[int]) -> None:
        """A space before anything but white space always starts a word of the pattern, so such texts are cut there first."""
        if self.loose(piece):
            ids += self._encode_words(piece)
            return
        chunks = piece.split(" ")
        ids += self._encode_words(chunks[0])
        known = self.chunks
        for chunk in chunks[1:]:
            found = known.get(chunk)
            if found is None:
                found = tuple(self._encode_words(" " + chunk))
                if len(chunk) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = found
            ids += found

    def _encode_words(self, piece: str) -> list[int]:
        ids: list[int] = []
        seen = self.seen
        for word in self.words(piece):
            known = seen.get(word)
            if known is None:
                known = tuple(encode_word(word.encode("utf-8", "replace"), self.vocabulary))
                if len(word) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _mapper(broadcast, row: Callable, schema: T.StructType) -> Callable:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(broadcast.value)
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [row(codec, v) for v in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), arrow.types[1:], strict=True))] if rows else []
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return batches


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(_mapper(shared, lambda c, t: (c.encode(t),), schema), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the texts of rows of ids; null ids: an empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    return encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.array().cast("array<int>"))).mapInArrow(
        _mapper(shared, lambda c, ids: (c.decode(ids),), schema), schema
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` and ``decode`` give, as hashes, in one pass."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def row(codec: Codec, text: str) -> tuple[int, str, str]:
        ids = codec.encode(text)
        listed = ",".join(map(str, ids)).encode()
        decoded = codec.decode(ids).encode("utf-8", "replace")
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(_mapper(shared, row, schema), schema)
