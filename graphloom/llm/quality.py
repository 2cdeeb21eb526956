"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

``measured`` computes measures of each whole text where it lies. The base rule fails documents of under ten words, or
with over a fifth of their words in five-word windows that occur twice or more in the text.

The method adds rules ``measure > cutoff``. For each stratum (language), rule and cutoff of a fixed grid, the labelled good
documents are a holdout: n of them, k of which the cutoff rejects. The exact binomial test asks how likely k or fewer
would be if the true false-rejection rate were ALPHA over the number of rules (so that the union of all rules stays within
ALPHA). A cutoff passes if that chance is at most DELTA over the number of strata times rules: Bonferroni over those, and a
fixed sequence from the most lenient cutoff to stricter ones within each. The strictest cutoff that passes is taken, if it
rejects more labelled bad than good documents. A stratum with too few labels for a guarantee gets no cutoff.

Edge cases: a null text has no words and fails the base rule. A null language is the stratum ``und``. Documents without a
label are judged but do not count in thresholds; a document has one label, good only if all of its labels are, and copies of a text are one trial; null labels are left out.
Rows that repeat an id are judged each on its own text. No labels: the base rule alone decides. Columns that are called like
a measure are no matter: measures live in one struct with a reserved name. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, text_of

ALPHA, DELTA, SPAN = 0.05, 0.05, 5
_SPACE = " \t\n\x0b\x0c\r"
#: Rule: (measure, cutoffs from lenient to strict). A document is rejected if the measure is over the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "exclamations_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeated_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "repeated_word_share": (0.19, 0.18, 0.16, 0.15, 0.14, 0.12, 0.1),
    "long_words": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0),
}


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """Bind a value once within an expression, so that higher-order functions do not evaluate it again for each item."""
    return F.transform(F.array(value), body).getItem(0)


def _count(text: Column, letters: str) -> Column:
    """How many characters of a few ASCII letters the text has: what their removal takes away."""
    return (F.char_length(text) - F.char_length(reduce(lambda c, x: F.replace(c, F.lit(x)), letters, text))).cast("long")


def _words(text: Column) -> Column:
    """The words, by plain replacement and a one-letter split, which need no regular expression."""
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), _SPACE[1:], text)
    return F.array_remove(F.split(plain, " "), "")


def _repeats(words: Column) -> Column:
    """How many words stand in windows of SPAN words that occur twice or more.

    Windows are 64-bit hashes. Where some are equal, they are sorted with their places, so that equal ones are neighbours.
    """

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            pairs = F.zip_with(o, F.slice(o, 2, F.size(o)), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)))
            return F.array_distinct(F.flatten(F.array_compact(pairs)))

        places = _let(ordered, starts)
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (SPAN - 1))))))

    def of_hashes(h: Column) -> Column:
        count = F.size(h) - (SPAN - 1)
        windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(SPAN))))
        found = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
        return F.when(count >= 2, found).otherwise(0)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column) -> Column:
    """A struct of counts of one text (not null)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("all"), _repeats(w).cast("long").alias("repeated"))
    return F.struct(
        _let(_words(text), of_words).alias("words"),
        (F.char_length(text).cast("long") - _count(text, _SPACE)).alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        _count(text, "!").alias("n_exclamations"),
        _let(lines, counted).alias("lines"),
    )


def n_words(m: Column) -> Column:
    return m.words.getField("all")


def n_repeat_words(m: Column) -> Column:
    return m.words.repeated


def _rates(m: Column) -> dict[str, Column]:
    """The rules' measures from the counts; 0 for a text without words."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per(m.n_symbols, n_words(m)),
        "exclamations_per_word": per(m.n_exclamations, n_words(m)),
        "repeated_line_share": per(n_dup_lines(m), m.lines.getField("all")),
        "repeated_word_share": per(n_repeat_words(m), n_words(m)),
        "long_words": per(m.word_chars, n_words(m)),
        "short_words": -per(m.word_chars, n_words(m)),
    }


def n_dup_lines(m: Column) -> Column:
    return (m.lines.getField("all") - m.lines.different).cast("long")


def base_failed(m: Column) -> Column:
    return (n_words(m) < 10) | (n_repeat_words(m) * 100 > n_words(m) * 20)


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, mark, m): the counts of each document, without its text, and a hash of it that tells copies."""
    return docs.select(F.col("doc_id").cast("long"), _stratum().alias("stratum"), text_of().alias("__text")).select(
        "doc_id", "stratum", F.md5("__text").alias("mark"), measures(F.col("__text")).alias("m")
    )


def _chance(n: Column, k: Column, rate: Column) -> Column:
    """P(at most k of n) at the rate, summed term by term in logarithms; 1 where k is over the mean and no test can pass."""
    first = F.struct((n * F.log1p(-rate)).alias("term"), F.lit(0.0).alias("sum"))
    more = F.log(rate) - F.log1p(-rate)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        first,
        lambda s, i: F.struct((s.term + F.log((n - i) / (i + 1)) + more).alias("term"), (s["sum"] + F.exp(s.term)).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when((n > 0) & (k <= n * rate), total).otherwise(F.lit(1.0))


def thresholds(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, chance): the cutoffs that the labelled holdout allows, from ``measured`` and labels.

    The bound is of independent trials, so a document has one label (good only if all of its labels are) and a text of a stratum is
    one trial, however many documents are copies of it (good only if all of them are).
    """
    rates = _rates(F.col("m"))
    labelled = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality") == 1).alias("good"))
    held = found.where(~base_failed(F.col("m"))).join(labelled, "doc_id").select("stratum", "mark", "good", *(v.alias(k) for k, v in rates.items()))
    rows = held.groupBy("stratum", "mark").agg(F.min("good").alias("good"), *(F.max(k).alias(k) for k in rates)).drop("mark")
    grid = [(rule, cut) for rule, cuts in RULES.items() for cut in cuts]
    # One row a stratum: the whole grid is counted in one pass, summed up before the shuffle.
    count = lambda which, rule, cut: F.count(F.when(which & (F.col(rule) > cut), 1))
    good, bad = F.col("good"), ~F.col("good")
    counted = rows.groupBy("stratum").agg(
        F.count(F.when(good, 1)).alias("n"), *(c.alias(f"{s}{i}") for i, x in enumerate(grid) for s, c in (("g", count(good, *x)), ("b", count(bad, *x))))
    )
    cells = F.array(
        *(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, (r, c) in enumerate(grid))
    )
    long = counted.select("stratum", "n", F.explode(cells).alias("x")).select("stratum", "n", "x.*")
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy()))
    tested = long.withColumn("chance", _chance(F.col("n"), F.col("k"), F.lit(alpha / len(RULES)))).withColumn("tests", strata * len(RULES))
    passed = tested.where((F.col("chance") <= delta / F.col("tests")) & (F.col("bad") > F.col("k")))
    strictest = F.row_number().over(Window.partitionBy("stratum", "rule").orderBy("cutoff"))
    return passed.withColumn("nth", strictest).where("nth = 1").select("stratum", "rule", "cutoff", "n", "k", "chance")


def _rejected(stratum: Column, m: Column, chosen: list) -> Column:
    """Whether a chosen cutoff rejects; the list has a row for each stratum and rule at most."""
    rates = _rates(m)
    out = F.lit(False)
    for s in sorted({r["stratum"] for r in chosen}):
        over = F.lit(False)
        for r in chosen:
            if r["stratum"] == s:
                over = over | (rates[r["rule"]] > F.lit(r["cutoff"]))
        out = F.when(stratum == F.lit(s), over).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, m, base_failed, kept) for each row."""
    found = durable(measured(docs))
    chosen = thresholds(found, labels).collect()
    failed = base_failed(F.col("m"))
    return found.select("doc_id", "m", failed.alias("base_failed"), (~failed & ~_rejected(F.col("stratum"), F.col("m"), chosen)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, columns as given.

    Every text is measured once: rows and measures are written to the shared checkpoint folder, thresholds are found from what
    was written, and so are the rows that pass. No text is shuffled.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    given = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _stratum().alias("stratum"), text_of().alias("text"))
    found = durable(given.select("row", "doc_id", "stratum", F.md5("text").alias("mark"), measures(F.col("text")).alias("m")))
    chosen = thresholds(found.select("doc_id", "stratum", "mark", "m"), labels).collect()
    return found.where(~base_failed(F.col("m")) & ~_rejected(F.col("stratum"), F.col("m"), chosen)).select("row.*")
