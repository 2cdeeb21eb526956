"""Stored responses of a paged reader as a data source, in batches and as a stream.

    spark.dataSource.register(PagedResponses)
    spark.read.format("paged_responses").load(folder)
    spark.readStream.format("paged_responses").load(folder)

A folder holds numbered deliveries (``000001``, ``000002``, ...), a later one with a larger number, each of files of JSON lines:
{"chapter", "offset", "content", "next_offset", "total"}. All responses of a chapter lie in one file, in the order of chapter and
offset; ``write`` lays them so. A row is a chapter: its slices from offset 0 along ``next_offset`` until there is none.

A chapter that does not begin at 0, whose next slice is missing, that goes on behind its end or whose text is shorter or longer than
the total that it states is an error, not a short text. A null content is an empty one; a null total is not checked. A null chapter is
an error. Offsets are code points.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "delivery long, chapter string, text string, slices int"


@dataclass
class File(InputPartition):
    delivery: int
    path: str


def _open(folder: str):  # noqa: ANN202
    """The file system of a folder, local or remote, and its path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _deliveries(folder: str) -> list[int]:
    """Numbers of the deliveries that are whole: those that their writer has closed with ``_SUCCESS``."""
    from pyarrow import fs

    system, path = _open(folder)
    listed = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [i.base_name for i in listed if i.type == fs.FileType.Directory and i.base_name.isdigit() and i.base_name == f"{int(i.base_name):06d}"]
    return sorted(int(n) for n in names if system.get_file_info(f"{path}/{n}/_SUCCESS").type == fs.FileType.File)


def _files(folder: str, numbers: list[int]) -> list[File]:
    from pyarrow import fs

    system, path = _open(folder)
    out = []
    for number in numbers:
        listed = system.get_file_info(fs.FileSelector(f"{path}/{number:06d}"))
        out += [File(number, i.path) for i in sorted(listed, key=lambda i: i.path) if i.base_name.endswith(".json")]
    return out


def chapters(lines: Iterator[str]) -> Iterator[tuple[str, str, int]]:
    """(chapter, text, slices) of responses in order; one chapter is held at a time."""
    chapter, parts, at, total = None, [], 0, None

    def whole() -> tuple[str, str, int]:
        text = "".join(parts)
        if at is not None:
            raise ValueError(f"chapter {chapter!r}: no response at {at}")
        if total is not None and len(text) != total:
            raise ValueError(f"chapter {chapter!r}: {len(text)} of {total}")
        return chapter, text, len(parts)

    for line in lines:
        r = json.loads(line)
        name = r.get("chapter")
        if name is None:
            raise ValueError("a response without a chapter")
        if name != chapter:
            if chapter is not None:
                yield whole()
            chapter, parts, at = name, [], 0
        if at is None or r["offset"] != at:
            raise ValueError(f"chapter {chapter!r}: a response at {r['offset']} where {at} was next")
        parts.append(r.get("content") or "")
        at, total = r.get("next_offset"), r.get("total")
    if chapter is not None:
        yield whole()


class _Reads:
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def read(self, partition: File | None) -> Iterator[tuple]:
        import io

        if partition is None:  # what Spark asks for where there are no partitions
            return
        system, _ = _open(self.folder)
        with io.TextIOWrapper(system.open_input_stream(partition.path), encoding="utf-8") as lines:
            for chapter, text, slices in chapters(line for line in lines if line.strip()):
                yield partition.delivery, chapter, text, slices


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[File]:
        return _files(self.folder, _deliveries(self.folder))


class _Stream(_Reads, DataSourceStreamReader):
    """Progress is the number of the last delivery; a batch reads what came after it."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"delivery": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"delivery": max(_deliveries(self.folder), default=0)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return _files(self.folder, [n for n in _deliveries(self.folder) if start["delivery"] < n <= end["delivery"]])


class PagedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options["path"])


def write(responses: DataFrame, folder: str, delivery: int) -> None:
    """Store responses (chapter, offset, content, next_offset, total) as one delivery, refused if the number is there."""
    laid = responses.select(F.col("chapter").cast("string").alias("chapter"), "offset", "content", "next_offset", "total").repartition("chapter")
    laid.sortWithinPartitions("chapter", "offset").write.option("compression", "none").json(f"{folder}/{delivery:06d}")


def sliced(texts: DataFrame, size: int) -> DataFrame:
    """Responses of ``size`` code points each of texts (chapter, text), as a paged reader would answer; a null text is one empty slice."""
    total = F.coalesce(F.char_length("text"), F.lit(0))
    last = F.greatest(F.ceil(total / size).cast("int") - 1, F.lit(0))
    cut = texts.select("chapter", "text", total.alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("nth"))
    offset = F.col("nth") * size
    following = F.when(offset + size < F.col("total"), offset + size)
    content = F.coalesce(F.substring(F.col("text"), offset + 1, F.lit(size)), F.lit(""))
    return cut.select("chapter", offset.alias("offset"), content.alias("content"), following.alias("next_offset"), "total")
