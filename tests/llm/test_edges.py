"""Every operator on odd rows and on an empty table: no failure, and the results that the docstrings state."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, chat, ctph, langid, mixing, pii, quality, simhash, substrings, toxicity

from .conftest import SCHEMA, prose, row

EMPTY = hashlib.sha256(b"").hexdigest()


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score double")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]


def test_pii(odd, none):
    assert ids(pii.find(odd, pii.fit(odd))) == ALL
    assert pii.find(none, pii.fit(none)).count() == 0
    first = pii.find(odd, {}).where("doc_id = 1").first()
    assert (first.n_email, first.spans, first.base_sha256) == (0, "", EMPTY)
    kept = pii.redact(odd, pii.fit(odd))
    assert kept.columns == odd.columns and kept.where("text is null").count() == 1


def test_ctph(odd, none, spark):
    found = {(r.doc_id, r.n_chars): r for r in ctph.neighbour_fingerprints(odd).collect()}
    assert ids(ctph.neighbour_fingerprints(odd)) == ALL
    assert found[1, 0].fingerprint == found[2, 0].fingerprint == "3::" and found[2, 0].near_next == 1.0
    assert found[7, len(found) and found[(7, odd.where("doc_id = 7").first().n_chars)].n_chars].near_next == 1.0
    assert ctph.neighbour_fingerprints(none).count() == 0 and ctph.fingerprints(none).count() == 0
    alone = ctph.neighbour_fingerprints(odd.where("doc_id = 6")).first()
    assert alone.near_next == 1.0


def test_chat(spark):
    log = spark.createDataFrame([], "conv_id long, turn long, message int, seq int, kind string, role string, text string, key string")
    assert chat.format_conversations(log).count() == 0


def test_toxicity(odd, none, spark):
    one = toxicity.score(odd, toxicity.fit(odd, labels(spark, [(6, 1, 1, 0.0)]))).collect()
    assert len(one) == len(ALL) and all(r.score == 1.0 for r in one)
    zero = toxicity.score(odd, toxicity.fit(odd, labels(spark))).collect()
    assert all(r.score == 0.0 and r.predicted == 0 for r in zero)
    two = toxicity.fit(odd, labels(spark, [(6, 1, 1, 0.0), (6, 1, 1, 0.0), (10, 1, 0, 0.0), (4, 1, None, 0.0), (None, 1, 1, 0.0)]))
    scored = toxicity.score(odd, two)
    assert ids(scored) == ALL and scored.where("score < 0 or score > 1 or isnan(score)").count() == 0
    assert toxicity.score(none, two).count() == 0


def test_bpe(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(odd, path)
    assert ids(encoded) == ALL and encoded.where("doc_id = 1").first().ids == []
    back = bpe.decode(encoded, path)
    given = sorted((r.doc_id, r.text or "") for r in odd.collect())
    assert sorted((r.doc_id, r.text) for r in back.collect()) == given
    assert bpe.digests(none, path).count() == 0
    with pytest.raises(Exception, match="60000"):
        bpe.decode(encoded.select("doc_id", F.array(F.lit(60000)).alias("ids")), path).collect()


def test_langid(odd, none):
    model = langid.fit(odd)
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0.0
    assert langid.predict(none, langid.fit(none)).count() == 0
    single = langid.predict(odd, langid.fit(odd.where("lang = 'en'"))).where("doc_id = 9").first()
    assert (single.lang_pred, single.score) == ("en", 1.0)
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_quality(odd, none, spark):
    found = quality.judged(odd, labels(spark, [(6, 1, 0, 0.0), (6, 1, 0, 0.0), (7, None, 0, 0.0)]))
    assert ids(found) == ALL
    bad = {r.doc_id for r in found.where("base_failed").collect()}
    assert bad == {1, 2, 3, 4, 9, 10}
    assert quality.keep_good(odd, labels(spark)).columns == odd.columns
    assert ids(quality.keep_good(odd, labels(spark))) == [5, 6, 7, 8, 8]
    assert quality.judged(none, labels(spark)).count() == 0 and quality.keep_good(none, labels(spark)).count() == 0


def test_substrings(odd, none):
    found = {r.doc_id: r for r in substrings.removal_digests(odd).collect()}
    assert ids(substrings.removal_digests(odd)) == ALL
    assert found[1].kept_sha256 == EMPTY and found[1].n_words == 0
    assert found[6].n_removed == 0 and found[7].n_removed == found[7].n_words == 40
    assert found[8].n_removed == 0
    assert substrings.removal_digests(none).count() == 0


def test_mixing(odd, none):
    found = mixing.allotments(odd)
    assert ids(found) == ALL and found.where("taken > 3 * size or taken < 0").count() == 0
    assert found.where("source is null").count() == 2
    mixed = mixing.mix(odd)
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert mixed.columns == odd.columns and words(mixed) == found.agg(F.sum("taken")).first()[0]
    assert mixing.allotments(none).count() == 0 and mixing.mix(none).count() == 0


def test_simhash(odd, none, spark):
    found = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert ids(simhash.near_duplicates(odd)) == ALL
    assert [found[i].fp for i in (1, 2, 3)] == [0, 0, 0] and found[3].component_id == 1
    assert found[7].component_id == 6
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 4, 5, 6, 8, 9, 10]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_of_each(none).count() == 0


def test_pipeline(odd, none, spark, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels(spark).write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert ({r.doc_id for r in rows} <= {5, 6, 8}) and (len(rows) > 0) == (name == "odd")


def test_substrings_of_ids_with_several_texts(spark):
    from .conftest import SCHEMA, prose, row

    docs = spark.createDataFrame([row(1, prose(1, 30)), row(2, prose(1, 30)), row(2, prose(2, 30)), row(3, prose(2, 30)), row(None, prose(3, 20)), row(None, prose(3, 20)), row(4, prose(3, 20))], SCHEMA)
    found = sorted(((r.doc_id is None, r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert found == sorted([(False, 1, 0), (False, 2, 30), (False, 2, 0), (False, 3, 30), (True, None, 20), (True, None, 20), (False, 4, 0)], key=str)


def test_copies_and_repeated_labels_prove_no_cutoff(spark):
    """Forty good texts and ten bad ones, each fifty times over, are forty and ten trials."""
    good = [row(i * 100 + k, f"{prose(i, 30)}", "x") for i in range(40) for k in range(50)]
    bad = [row(9_000 + i * 100 + k, "#### " * 30 + prose(900 + i, 20), "x") for i in range(10) for k in range(50)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 9_000)) for r in good + bad] * 2, "doc_id long, quality int")
    assert quality.thresholds(quality.measured(docs), labels).collect() == []
    apart = [row(i, prose(i, 30), "x") for i in range(2_000)] + [row(9_000 + i, prose(5_000 + i, 60).replace(" ", "## "), "x") for i in range(100)]
    known = spark.createDataFrame([(r[0], int(r[0] < 9_000)) for r in apart], "doc_id long, quality int")
    found = quality.thresholds(quality.measured(spark.createDataFrame(apart, SCHEMA)), known).collect()
    assert {r.n for r in found} == {2_000} and "symbols_per_word" in {r.rule for r in found}


def test_a_word_without_end_is_cut_into_equal_pieces(spark):
    texts = ["a " * 200_000, "b " + "a " * 150_000 + "c", prose(5, 20) + " " + "a " * 40]
    found = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [found[i].n_removed for i in range(3)] == [0, 150_000, 40] and found[1].kept == "b c"
