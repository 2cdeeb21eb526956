"""URL rules: fixed ones by hand, mined ones against all combinations of tokens."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest

from graphloom.llm import urls

PAGES = "page_id long, url string, html string, host string, tokens string, lead int"


def paged(spark, found):
    return spark.createDataFrame([(i, u, "x", "h", "t", 1) for i, u in found], PAGES)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme/here", "", "", None, "allow"),
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://net/a://b/", "net", "/a://b/", "net/", "block"),
        ("HTTP://x.org/fr/#top", "x.org", "/fr/", "org/fr/", "allow"),
        ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        ("https://example.com?x=/de/", "example.com", "", None, "allow"),
        ("a\nb://H\n.org/fr/\n?z", "h\n.org", "/fr/\n", "org/fr/", "allow"),
    ],
)
def test_fixed_rules(spark, url, host, path, rule, verdict):
    none = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    r = urls.judged(paged(spark, [(1, url), (None, url)]), none).collect()
    assert [(x.host, x.path, x.rule, x.verdict) for x in r] == [(host, path, rule, verdict)] * 2


def tokens(url):
    rest = re.sub("^.*?://", "", url, count=1, flags=re.S) if "://" in url else None
    if rest is None:
        return set()
    host = re.match("[^/?#]*", rest)[0]
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    after = re.sub("[0-9]+", "0", fold(rest[len(host) :]))
    return {"h:" + w for w in fold(host).split(".") if w} | {"t:" + w for w in re.split("[/.?&=#]+", after) if w}


def by_all_sets(known, least, confidence):
    once = {}
    for u, bad in known:
        if u is not None and bad is not None:
            once[u] = once.get(u, False) or bad
    rows = [(tokens(u), bad) for u, bad in once.items() if tokens(u)]
    tried = {frozenset(c) for t, bad in rows if bad for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    good = set()
    for s in tried:
        held = [bad for t, bad in rows if s <= t]
        if sum(held) >= least and 100 * sum(held) >= confidence * len(held):
            good.add(s)
    return {s for s in good if not any(x < s for x in good)}


def test_mined_rules_against_all_sets(spark):
    r = random.Random(4)
    known = []
    for i in range(400):
        host = r.choice(["a", "b", "spam", "bets"]) + "." + r.choice(["x", "y"]) + ".com"
        path = "/" + r.choice(["en", "de"]) + "/" + r.choice(["win", "news", "buy"]) + f"/{i}" + r.choice(["", "?ref=x", ".html"])
        known.append((f"http://{host}{path}", r.random() < (0.9 if "bets" in host and "win" in path else 0.8 if "spam" in host and "de" in path else 0.1)))
    known += [(None, True), ("nothing", True), known[0], ("http://bets.x.com/en/win/1", None)]
    least = max(5, math.ceil(len({u for u, b in known if u and b is not None and tokens(u)}) * 0.002))
    expected = by_all_sets(known, least, 60)
    found = urls.mine(spark.createDataFrame(known, "url string, bad boolean"))
    assert {frozenset(x["items"]) for x in found.collect()} == expected and any(len(s) > 1 for s in expected)
    asked = [(i, u) for i, (u, _) in enumerate(known)] + [(7, "http://bets.z.com/fr/win"), (8, "http://spam.q.com/de/")]
    for x in urls.judged(paged(spark, asked), found, ()).collect():
        assert x.verdict == ("block" if any(s <= tokens(x.url or "") for s in expected) else "allow")


def test_long_urls_do_not_multiply(spark):
    """Two hundred tokens that all bad URLs share: 2^200 sets, of which the rarest few propose and all single ones count."""
    long = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    known = [(f"http://h{i}.com/{long}/{'x' * i}", True) for i in range(40)] + [(f"http://h{i}.org/a", False) for i in range(40)]
    found = urls.mine(spark.createDataFrame(known, "url string, bad boolean")).collect()
    assert {x.rule for x in found} >= {"h:com", "t:waa", "t:wza"} and all(x.bad == x.total for x in found)


def test_rules_of_long_urls_against_all_sets(spark):
    """Of fifteen tokens in a URL the most frequent make rules as well as the rarest."""
    r = random.Random(11)
    pool = [f"w{chr(97 + i)}" for i in range(13)]
    known = []
    for i in range(80):
        words = [w for k, w in enumerate(pool) if r.random() < (0.75 if k < 3 else 0.97 if i % 3 else 0.3)]
        likely = 0.9 if {"wa", "wb", "wc"} <= set(words) else 0.04
        known.append((f"http://h/{'/'.join(words)}?{i}", r.random() < likely))
    expected = by_all_sets(known, 5, 60)
    assert max(len([t for t in tokens(u) if {t} not in expected]) for u, bad in known if bad) > urls.MOST_ITEMS and max(map(len, expected)) > 4
    found = urls.mine(spark.createDataFrame(known, "url string, bad boolean"))
    assert {frozenset(x["items"]) for x in found.collect()} == expected


def test_tokens_that_all_long_urls_share_do_not_multiply(spark):
    """Two hundred tokens in good and bad URLs alike: only the two that lie apart make a rule, though each is in as many good URLs as bad."""
    long = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    ends = [("left/right", True), ("left", False), ("right", False), ("", False)]
    known = [(f"http://h/{long}/{end}?{'x' * i}", bad) for i, (end, bad) in enumerate(ends * 10)]
    found = urls.mine(spark.createDataFrame(known, "url string, bad boolean")).collect()
    assert [(x.rule, x.bad, x.total) for x in found] == [("t:left t:right", 10, 10)]


def test_empty_tables_and_repeats(spark):
    none = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    assert none.collect() == []
    assert urls.judged(paged(spark, []), none).collect() == []
    twice = urls.judged(paged(spark, [(1, "http://x.de/a"), (1, "http://x.de/a"), (2, None)]), none).collect()
    assert sorted((r.page_id, r.verdict) for r in twice) == [(1, "allow"), (1, "allow"), (2, "allow")]
