from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import fuzzy, sentences, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_names(spark):
    lit = F.lit
    assert value(spark, text.alias_key(lit("  Mal­lory’s ")) ) == "mallory's"
    assert value(spark, text.grade_key(lit("The  Blue-Water Inn!"))) == "blue water inn"
    assert value(spark, text.duplicate_key(lit("The Abbey"))) == "abbey"
    assert value(spark, text.slug(lit("  Krezk: Gate & Wall "))) == "krezk-gate-wall"
    assert value(spark, text.entity_id(lit("Blue Room"), lit("ch-3"), lit("E4"))) == "kb:ch-3:e4-blue-room"
    assert value(spark, text.entity_id(lit("Blue Room"), lit("ch-3"), lit(None).cast("string"))) == "kb:blue-room"
    assert value(spark, text.title_case(lit("the HOUSE of NPC durst"))) == "the House of NPC Durst"
    assert value(spark, text.clock(lit(3725.9))) == "01:02:05"


def test_terms(spark):
    found = value(spark, text.content_terms(F.lit("Who is the baker’s wife in area E5 — and the wife's 2 dogs?")))
    assert found == ["baker’s", "wife", "area", "e5", "wife's", "2", "dogs"]
    assert value(spark, text.terms_present(F.lit("A wife, two Dogs."), F.array(F.lit("wife"), F.lit("dogs"), F.lit("dog")))) == 2
    assert value(spark, text.lucene_query(F.array(F.lit("a+b"), F.lit("c")))) == r"a\+b OR c"
    assert value(spark, text.cleaned(F.lit("a  b\n12\n\n\n\nc"))) == "a b\n\nc"


def test_fuzzy(spark):
    assert fuzzy.ratio("abcd", "abxd") == 75.0 and fuzzy.ratio("", "") == 100.0 and fuzzy.ratio("a", "") == 0.0
    assert fuzzy.partial_ratio("kor", "koranthis") == 100.0 and fuzzy.partial_ratio("abc", "xxabyxx") > 60
    frame = spark.createDataFrame([("kitten", "sitting"), (None, "a")], "a string, b string")
    assert [round(r[0], 2) for r in frame.select(fuzzy.ratio_of("a", "b")).collect()] == [61.54, 0.0]


def test_sentences():
    t = "He met St. Osric in area E5. She left! Then 2. came\nNext line."
    at = lambda word: t[slice(*sentences.bounds(t, t.index(word)))]
    assert at("Osric") == "He met St. Osric in area E5. She left!"
    assert at("Then") == "Then 2. came"
    assert at("Next") == "Next line."
    long = "word " * 200
    low, high = sentences.bounds(long, 500)
    assert low <= 500 < high and high - low <= sentences.MOST
    assert sentences.bounds("", 3) == (0, 0)
