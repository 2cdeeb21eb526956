"""URL filters: host and path rules first, then rules of association that are mined from labelled URLs.

A URL is a set of tokens: each label of its host, and each word of what follows, digits read as one 0. FP-growth over the URLs that
are labelled bad proposes combinations of tokens; how many labelled URLs hold a combination, good and bad, is counted exactly by
matching it. Combinations with enough bad URLs and a high enough share of them are rules, less those that hold a smaller rule,
which match nothing that it doesn't.

Matching is an inverted index: a rule lies under its rarest token, a URL asks for each of its tokens, and what it meets is held
against its whole set. The rules are sent to every task if they are few; else the join shuffles. Each different URL is matched once,
however many pages have it.

A set of n tokens has 2^n combinations, so FP-growth takes the bad URLs of at most ``MOST_ITEMS`` tokens that may combine. Combinations
that a longer one holds are found level by level instead, counted over all URLs, and only those are extended that may become a rule: a
token that spares no good URL is in no smallest rule of several tokens (see ``_of_long``). Both together propose every smallest rule.

Edge cases: a URL that is null or has no ``://`` has an empty host and path and no tokens, and is allowed; URLs without a label
teach nothing; of labels that conflict, bad wins; a URL counts once however often it is labelled; with no bad URLs there are no
rules. Null and repeated page ids keep their rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable

#: A rule holds at least this share of labelled URLs, and so many, as bad ones, and is bad in so many per cent of those it matches.
LEAST_SHARE, LEAST_COUNT, CONFIDENCE = 0.002, 5, 60
#: Tokens of a URL that FP-growth takes (the SQL, which lists all sets, stops there), and rules that are sent to every task.
MOST_ITEMS, MOST_SENT = 12, 100_000
#: Host and path to verdict; a rule fits the host and its subdomains where the path begins like the rule's.
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands from the first ``://`` up to ``/``, ``?`` or ``#``, A-Z as a-z."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Different tokens in order: ``h:`` and a label of the host, ``t:`` and a word of the rest."""
    rest = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1), _UPPER, _LOWER)
    cut = lambda text, at, mark: F.transform(F.array_remove(F.split(text, at), ""), lambda w: F.concat(F.lit(mark), w))
    words = F.concat(cut(host_of(url), r"\.", "h:"), cut(F.regexp_replace(rest, "[0-9]+", "0"), "[/.?&=#]+", "t:"))
    return F.array_sort(F.array_distinct(words))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest of a short list of rules that fits, or null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), rule))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (with ``tokens``) beside each of the ``rules`` (lead, items) that it holds; a pair meets once, under the rule's lead."""
    asked = sets.withColumn("lead", F.explode("tokens"))
    return asked.join(_sent(rules), "lead").where(F.size(F.array_except("items", "tokens")) == 0)


def labelled(urls: DataFrame) -> DataFrame:
    """(tokens, bad), a row a different URL of (url, bad)."""
    known = urls.where(F.col("url").isNotNull() & F.col("bad").isNotNull())
    once = known.groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    return durable(once.select(tokens_of(F.col("url")).alias("tokens"), "bad").where(F.size("tokens") > 0))


def _confident(confidence: int) -> Column:
    return F.col("bad") * 100 >= (F.col("bad") + F.col("good")) * confidence


def _sets(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(items, bad): of each row the given tokens, in order; rows without one are left out."""
    held = rows.select(F.monotonically_increasing_id().alias("row"), "bad", "tokens").select("row", "bad", F.explode("tokens").alias("token")).join(_sent(tokens), "token")
    return held.groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"), F.max("bad").alias("bad")).drop("row")


def _of_long(rows: DataFrame, single: DataFrame, least: int, confidence: int) -> DataFrame:
    """(items): the smallest rules of two tokens or more that a bad URL of more than ``MOST_ITEMS`` of the tokens ``single`` holds.

    No part of a smallest rule is a rule, though as many bad URLs hold it, so more good ones do: each token of the rule spares some. Then
    each token of each part spares some too. So sets grow by a token at a time from those that hold no rule, are in enough bad URLs and
    in fewer good ones than each of their parts; what a set of all tokens has in common is dropped at once.
    """
    sets = _sets(rows, single.select("token")).groupBy("items").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    long = (F.col("bad") > 0) & (F.size("items") > MOST_ITEMS)
    sets = durable(sets.select(F.monotonically_increasing_id().alias("set"), "items", "bad", "good", long.alias("long")))
    asked = sets.where("long").select(F.explode("items").alias("last")).distinct()
    held = sets.select("set", "bad", "good", "long", F.array().cast("array<string>").alias("start"), F.explode("items").alias("last")).join(_sent(asked), "last", "left_semi")
    parts, found, size = single.select(F.array("token").alias("part"), F.col("good").alias("most")), [], 2
    while True:
        other = held.select("set", "start", F.col("last").alias("next"))
        met = held.join(other, ["set", "start"]).where("last < next")
        held = durable(met.select("set", "bad", "good", "long", F.concat("start", F.array("last")).alias("start"), F.col("next").alias("last")))
        counted = held.groupBy("start", "last").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("long").alias("long"))
        counted = durable(counted.where((F.col("bad") >= least) & F.col("long")).withColumn("items", F.concat("start", F.array("last"))))
        less = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("items", lambda _, i: i != k))
        known = counted.select("items", F.explode(less).alias("part")).join(parts, "part").groupBy("items").agg(F.count("*").alias("n"), F.min("most").alias("most"))
        known = durable(counted.join(known.where(F.col("n") == size), "items").where(F.col("good") < F.col("most")))
        found.append(known.where(_confident(confidence)).select("items"))
        open_ = known.where(~_confident(confidence))
        if open_.count() <= size:  # one larger set has so many parts
            return functools.reduce(DataFrame.union, found)
        parts, size = open_.select(F.col("items").alias("part"), F.col("good").alias("most")), size + 1
        held = held.join(open_.select("start", "last"), ["start", "last"], "left_semi")


def _proposed(rows: DataFrame, least: int, confidence: int) -> DataFrame:
    """(items): frequent tokens of bad URLs, and every smallest rule of several: what FP-growth finds among them in short URLs, and levels in longer ones."""
    counts = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    single = durable(counts.where(F.col("bad") >= least))
    alone = single.select(F.array("token").alias("items"))
    open_ = single.where(~_confident(confidence) & (F.col("good") < rows.where("bad = 0").count()))  # others are in no smallest rule of several
    sets = durable(_sets(rows.where("bad = 1"), open_.select("token")))
    short = sets.where(F.size("items") <= MOST_ITEMS)
    n = short.count()
    if n >= least:
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(short).freqItemsets
        alone = alone.union(found.where(F.size("items") > 1).select(F.array_sort("items").alias("items")))
    if sets.count() > n:
        alone = alone.union(_of_long(rows, open_, least, confidence))
    return alone


def mine(urls: DataFrame, share: float = LEAST_SHARE, count: int = LEAST_COUNT, confidence: int = CONFIDENCE) -> DataFrame:
    """(rule, lead, items, bad, total): the smallest combinations of tokens that are bad often enough, from (url, bad)."""
    rows = labelled(urls)
    least = max(count, -int(-rows.count() * share // 1))
    proposed = _proposed(rows, least, confidence)
    frequency = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    placed = proposed.select("items", F.explode("items").alias("token")).join(frequency, "token").groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("lead"))
    placed = durable(placed.select("lead", "items"))
    counted = matches(rows, placed).groupBy("lead", "items").agg(F.sum("bad").alias("bad"), F.count("*").alias("total"))
    good = durable(counted.where((F.col("bad") >= least) & (F.col("bad") * 100 >= F.col("total") * confidence)))
    inner = good.select("lead", "items", F.size("items").alias("inner"))
    larger = matches(good.select(F.col("items").alias("whole"), F.col("items").alias("tokens")), inner).where(F.size("whole") > F.col("inner")).select(F.col("whole").alias("items"))
    return durable(good.join(larger, "items", "left_anti").select(F.array_join("items", " ").alias("rule"), "lead", "items", "bad", "total"))


def judged(pages: DataFrame, mined: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, url, host, path, rule, matched, verdict): by the fixed rule that fits, else blocked where a mined one matches."""
    url = F.col("url")
    parted = pages.select("page_id", url.cast("string").alias("url")).select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    parted = parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    asked = parted.where(F.col("rule").isNull()).select("url").distinct().withColumn("tokens", tokens_of(url))
    met = matches(asked, mined.select("lead", "items", "rule", (F.col("bad") / F.col("total")).alias("share"), "bad"))
    first = met.groupBy(url.alias("of")).agg(F.max_by("rule", F.struct("share", "bad", "rule")).alias("matched"))
    said = dict(rules)
    fixed = F.coalesce(*(F.when(F.col("rule") == r, v) for r, v in said.items()), F.lit(None).cast("string"))
    whole = parted.join(first, (parted.url == first.of) & F.col("rule").isNull(), "left")
    return whole.select("page_id", "url", "host", "path", "rule", "matched", F.coalesce(fixed, F.when(F.col("matched").isNotNull(), "block").otherwise("allow")).alias("verdict"))
