"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, bpe, chat, ctph, langid, mixing, phrases, pii, quality, simhash, substrings, toxicity, urls
from graphloom.llm.common import crc_of_id, table

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op2_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(*columns)
    said = "\\### Assistant: </turn> ok"
    values = ", ".join(f"(-7L, {turn}L, '{role}', r'{said}')" for turn, role in enumerate(("user", "assistant")))
    extra = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    read = chat.read_back(chat.format_conversations(chat.as_events(rows.union(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_of_id() % 3 != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_of_id() % 4 != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    m = F.col("m")
    return judged.select(
        "doc_id",
        quality.n_words(m).alias("n_words"),
        m.word_chars.alias("word_chars"),
        m.n_symbols.alias("n_symbols"),
        quality.n_dup_lines(m).alias("n_dup_lines"),
        quality.n_repeat_words(m).alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotments(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose path ends in the number of a labelled document; bad is of low quality or toxic."""
    named = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)")
    marks = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(
        F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    return pages.select("url", named.alias("doc")).join(marks, "doc").select("url", "bad")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = urls.mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return urls.judged(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_ctph, op3_chat, op4_toxicity, op5_bpe, op6_langid, op7_quality, op8_substrings, op9_mixing, op10_simhash, op11_urls, op12_phrases, op13_alignment)
}
