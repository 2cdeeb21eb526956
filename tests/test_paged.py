"""Stored responses read as a data source: whole texts, short ones refused, deliveries as a stream's progress."""

from __future__ import annotations

import json

import pytest

from graphloom.sources import paged

TEXTS = "chapter string, text string"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(paged.PagedResponses)
    return "paged_responses"


def line(chapter, offset, content, following, total):
    return json.dumps({"chapter": chapter, "offset": offset, "content": content, "next_offset": following, "total": total})


def test_texts_come_back_whole(spark, source, tmp_path):
    texts = [("a", "ö" * 25), ("b", ""), ("c", None), ("d", "x" * 10), ("e", "line\nof\r\n two \U0001f600" * 9)]
    paged.write(paged.sliced(spark.createDataFrame(texts, TEXTS), 10), str(tmp_path), 1)
    found = {r.chapter: (r.text, r.slices) for r in spark.read.format(source).load(str(tmp_path)).collect()}
    assert found == {c: (t or "", max(1, -(-len(t or "") // 10))) for c, t in texts}


@pytest.mark.parametrize(("lines", "said"), [
    ([line("a", 0, "12345", 5, 8), line("a", 5, "67", None, 8)], "7 of 8"),
    ([line("a", 0, "12345", 5, 8)], "no response at 5"),
    ([line("a", 0, "12345", 5, 8), line("b", 0, "", None, 0)], "no response at 5"),
    ([line("a", 5, "678", None, 8)], "where 0 was next"),
    ([line("a", 0, "1", None, 1), line("a", 0, "1", None, 1)], "where None was next"),
    ([line(None, 0, "1", None, 1)], "without a chapter"),
])
def test_what_is_short_is_refused(lines, said):
    with pytest.raises(ValueError, match=said):
        list(paged.chapters(iter(lines)))


def test_a_short_text_fails_the_job(spark, source, tmp_path):
    spark.createDataFrame([("a", 0, "12345", None, 9)], "chapter string, offset int, content string, next_offset int, total int").write.json(str(tmp_path / "000001"))
    with pytest.raises(Exception, match="5 of 9"):
        spark.read.format(source).load(str(tmp_path)).collect()


def test_empty_folders_have_no_rows(spark, source, tmp_path):
    assert spark.read.format(source).load(str(tmp_path / "none")).collect() == []


def test_a_stream_goes_on_after_the_last_delivery(spark, source, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        rows = spark.readStream.format(source).load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        rows.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.delivery, r.chapter, r.text) for r in spark.read.parquet(out).collect())

    paged.write(paged.sliced(spark.createDataFrame([("a", "x" * 25)], TEXTS), 10), folder, 1)
    assert run() == [(1, "a", "x" * 25)]
    assert run() == [(1, "a", "x" * 25)]
    paged.write(paged.sliced(spark.createDataFrame([("b", "y")], TEXTS), 10), folder, 2)
    (tmp_path / "in" / "000003").mkdir()  # a delivery that is not closed yet
    assert run() == [(1, "a", "x" * 25), (2, "b", "y")]
