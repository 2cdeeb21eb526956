"""Personal data by candidate spans and gradient-boosted trees.

Generators of high recall propose spans that overlap, most of them wrong: every stretch about an at sign, written or spelt
out, tight and up to the blanks; every run of seven digits or more, tight and with its neighbours; dotted numbers; whole values that
follow a credential's name, which may end a longer one (``access_token``); and every long mixed token, named or not. Each
candidate is described by its format (length, digits, separators, groups, letters, classes, checks) and its context (what
stands on either side, words that announce such data or something else). Boosted trees, one set a family of candidates, give
a score; Platt scaling on a held-back fifth makes it a chance, and a family's threshold is the lowest chance at which the
held-back precision reaches ``PRECISION``. A chosen span that overlaps no other chosen one is kept, the likeliest first.

The base rules decide on their kinds by themselves: their spans always stay, and the trees add spans beside them.

There are no labelled spans, so the fitting set is built. Personal data of many forms (``POSITIVES``) and look-alikes
(``NEGATIVES``) are written between words of sampled documents; of the candidates that the generators propose there, those
that match the written span are positive and all others, also those with wrong bounds, negative. The documents' own
candidates join in: base spans as positives, other addresses and numbers as negatives; own values that may be credentials
are of unknown truth and left out. The labels come from the builder, never from what the trees see.

Fitting uses a bounded, hashed sample of documents (``SAMPLE_ROWS``), with ``OWN`` own candidates a document at most; one task
a family grows its trees over that sample. The trees have a fixed size and are broadcast. Finding is one pass over whole
texts where they lie.

Edge cases: a null or empty text has no spans. Rows that repeat an id each have a result; other columns are not read by
``find`` and are carried by ``redact``. An empty table gives an empty model, which adds nothing, and an empty result.
``boost`` refuses to learn from one class.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import hash_sampled, sample_rate, text_of

SAMPLE_ROWS, OWN, ROUNDS, MOST_ROUNDS = 4_000, 40, 4_000, 400
TREES, DEPTH, SHRINK, PRECISION, _BINS = 40, 4, 0.2, 0.99, 32
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain.

    A local part cannot cross an at sign, so it is the run of its letters before one: each stretch is looked at once, however
    long it is.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass the kind's check, by kind, then start."""
    out = [("email", a, b) for a, b in _base_emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


FAMILIES = ("address", "number", "secret")
_NAMED = re.compile(r"(?i)(?:\b|(?<=_))(?:api[_-]?key|token|secret|passw(?:or)?d|pwd|access[_-]?key)[\"']?(?:\s{0,3}[=:]|\s{1,3}is\b:?)\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{6,}+)")
#: Generators of numbers and of tokens that no name announces; bounded repeats and possessive runs keep them linear.
_NUMBERS = (
    re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,24}"),
    re.compile(r"[+(]?[0-9](?:[ ().:/,-]{0,2}[0-9]){6,}+"),
    re.compile(r"[0-9]{1,3}(?: ?[.:] ?[0-9]{1,3}){3}"),
    re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Fa-f])"),
)
_TOKENS = (
    re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"),
    re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{12,}+"),
)
_SPELT = re.compile(r"(?i)(?<=[\w%+-])(?: ?[(\[] ?at ?[)\]] ?| at )(?=\w)")
_DOTS = re.compile(r"(?i)[\w-]++(?: ?(?:\.|[(\[] ?dot ?[)\]]| dot ) ?[\w-]++)*+")
_FIRST = re.compile(r"[\w-]++(?:\.[\w-]++)?")
_NAME = re.compile(r"[\w.%+-]++")
_BLANK = re.compile(r"[ \n\t]")
#: A stretch between blanks is proposed up to this length; longer ones would be read again for each of their at signs.
STRETCH = 512


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """About each at sign or spelt "at": the name and the host with its dots, the host's first part only, and up to the blanks.

    Names and hosts are runs of any length: all runs are found once, and each sign takes the one that ends where it begins.
    """
    found = [(m.start(), m.end()) for m in _SPELT.finditer(text)]
    at = text.find("@")
    while at >= 0:
        found.append((at, at + 1))
        at = text.find("@", at + 1)
    names = {m.end(): m.start() for m in _NAME.finditer(text)}
    blanks = [m.start() for m in _BLANK.finditer(text)]
    for low, high in found:
        name = names.get(low)
        host = _DOTS.match(text, high)
        if name is not None and host:
            yield name, host.end()
            first = _FIRST.match(text, high)
            if first:
                yield name, first.end()
            before, after = bisect.bisect_left(blanks, low), bisect.bisect_left(blanks, host.end())
            left, right = blanks[before - 1] + 1 if before else 0, blanks[after] if after < len(blanks) else len(text)
            if right - left <= STRETCH:
                yield left, right


_DIGIT = re.compile("[0-9]")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(family, start, end) of every generator's matches, each span once. A generator only runs where its letters stand."""
    lowered = text.lower()
    found: set[tuple[str, int, int]] = set()
    if "@" in text or any(x in lowered for x in (" at ", "at)", "at]", "at )", "at ]")):
        found.update(("address", a, b) for a, b in _addresses(text))
    if any(x in lowered for x in ("key", "token", "secret", "passw", "pwd")):
        found.update(("secret", *m.span(1)) for m in _NAMED.finditer(text))
    if _DIGIT.search(text):
        for family, patterns in (("number", _NUMBERS), ("secret", _TOKENS)):
            for pattern in patterns:
                found.update((family, *m.span()) for m in pattern.finditer(text))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


_CUES = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|reach|dial|card|visa|account|iban|ip|host|server|mail|e-mail|contact|ssn|write)\b[^\n]{0,12}$")
_SECRET_CUES = re.compile(r"(?i)(?:api[_-]?key|token|secret|passw(?:or)?d|pwd|access[_-]?key|credentials?|bearer)[\"']?\W{0,6}$")
_OTHER_CUES = re.compile(r"(?i)\b(?:id|order|version|release|commit|sha\d*|md5|checksum|isbn|doi|invoice|page|file|path|uuid|no|item|ref|build|at|on|from|date)\b[^\n]{0,6}$")
_CHANGES = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")
_HEX = re.compile(r"[0-9a-fA-F]")


def features(text: str, start: int, end: int) -> list[float]:
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    size = len(s)
    digits = sum(map(str.isdigit, s))
    letters = sum(map(str.isalpha, s))
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    upper = sum(map(str.isupper, s))
    after = re.split(r"(?i)@|[(\[ ]at[)\] ]", s, maxsplit=1)[-1]
    return [
        size, digits, digits / size, letters / size, len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        s.count("."), s.count("-"), s.count(" "), s.count("("), s.count(":"), s.count("/"), s.count("_"), s.count("="), float(s[0] == "+"), float(s[0] == "0"), s.count("@"),
        float("." in after or " dot " in after.lower() or "dot)" in after.lower() or "dot]" in after.lower()), float("(" in s or "[" in s), float(13 <= digits <= 19 and _luhn(_NOT_DIGIT.sub("", s))) if digits < 30 else 0.0,
        upper / size, len(_CHANGES.findall(s)) / size, len(_HEX.findall(s)) / size, len(set(s)) / min(size, 64), float(s[-1].isalnum()), float(s[0].isalnum()),
        float(bool(_CUES.search(left))), float(bool(_SECRET_CUES.search(left))), float(bool(_OTHER_CUES.search(left))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:] in "\"'=:" and left != ""), float(right[:1] in "/@:=" and right != ""),
    ]


#: What is written into fitting texts. ``<w>`` is a word of letters, ``<d5>`` five digits, ``<x40>`` forty hexadecimal digits,
#: ``<b20>`` letters of both cases and digits, ``<u16>`` capitals and digits, ``<card>`` sixteen digits that pass Luhn; braces mark the span.
POSITIVES = {
    "address": (
        "{<w>.<w>@<w>.com}", "mail {<w><d2>@<w>.example.org}.", "<{<w>_<w>@<w>.net}>", "mailto:{<w>@<w>-<w>.de}", "({<w>@mail.<w>.co.uk})", "{<w>@<w>.io},",
        "{<w> (at) <w>.com}", "{<w>.<w> [at] <w>.org}", "{<w>(at)<w>(dot)com}", "{<w> [at] <w> [dot] net}", "contact {<w> at <w> dot com}", "write to {<w>.<w> at <w> dot org}.",
        "{<b60><b30> (at) <w>.com}", "{<w>@<w>.<w>.<w>.<w>.<w>.<w>.org}", "{<w><b70>@<w>.net}",
    ),
    "number": (
        "{+<d2> <d3> <d3> <d4>}", "tel {<d3>-<d3>-<d4>}", "call ({<d3>) <d3>-<d4>}", "{(<d3>) <d3>-<d4>}", "phone: {<d3>.<d3>.<d4>}", "{<d3>-<d3>-<d4>},", "fax 00{<d2> <d2> <d7>}", "mobile {0<d3> <d6>}",
        "{<card>}", "card {<card4>}", "visa {<card4>}.", "ssn {<d3>-<d2>-<d4>}", "{<d3>-<d2>-<d4>}", "ip {<i>.<i>.<i>.<i>}", "server {<i>.<i>.<i>.<i>}:8080", "{<i> . <i> . <i> . <i>}",
        "mac {<x2>:<x2>:<x2>:<x2>:<x2>:<x2>}", "{<x2>-<x2>-<x2>-<x2>-<x2>-<x2>},",
    ),
    "secret": (
        'token = "{<x40>}"', "password={<x18>}", "api_key: {<b32>}", "{AKIA<u16>}", "key {AKIA<u16>}.", "AWS_SECRET_ACCESS_KEY={<b40>}", "Authorization: Bearer {<b36>}", "{ghp_<b36>}", "{sk-<b48>}", "secret: '{<b24>}'",
        "access_token={eyJ<b20>.eyJ<b60>.<b43>}", "pwd: {<b12>}", 'auth_token = "{<x32>}"', "db_password = {<b16>}", "client_secret={<b240>}", "passwd={<w><d4>}", "token: {<x64>}", "{xoxb-<d12>-<b24>}",
        "token = {<b240>}", "auth_token: {<b160>}", "password is {<w><d3><b4>}", "pwd={<w><d4>}", "the secret is: {<b16>}", "the token is {<x24>}",
    ),
}
NEGATIVES = {
    "address": (
        "@<w>", "meet <w> at <w> again", "look at <w>. <w>", "ssh <w>@<w>", "@<w>(<w>)", "<w> at <d2> dot", "sold at <w>-<w> for", "<w> @ <w>", "5 @ 10.50", "arrive at <w>, <w>", "<w> at version <d1>.<d1>", "@<w>.<w> said",
        "stood at the <w> of", "at <w>.<w>", "<w>@", "price <d2>@<d3>",
    ),
    "number": (
        "on <y>-<m>-<m> <h>:<h>:<h>", "<y>/<m>/<m> <h>:<h>", "order <d9>", "order no. <d12>", "isbn 978-<d1>-<d2>-<d6>-<d1>", "version <d1>.<d2>.<d3>.<d4>", "<d1>,<d3>,<d3>.<d2>", "<y>-<y>, <d3> <d3>", "page <d3>, <d3>, <d3>",
        "1 2 3 4 5 6 7 8 9", "<d2>.<d5>, <d2>.<d5>", "id <d16>", "<d20>", "<d7>", "<d30>", "<d8>T<d6>", "build <d4>.<d5>.<d3>", "item <d4>-<d4>", "0.<d16>", "<m>.<m>.<y> <h>.<h>", "invoice <d4> <d4> <d4>", "<d3> <d3> <d3> units",
        "<h>:<h>:<h>.<d6>", "score <d2>:<d2> <d2>:<d2>",
    ),
    "secret": (
        "id <x8>-<x4>-<x4>-<x4>-<x12>", "commit <x40>", "sha256: <x64>", "md5 <x32>", "checksum <x32>", "file <w>_<w>_<d8>.txt", "/<w>/<w>/<w>-<d4>/<w>", "https://<w>.com/<w>/<w>-<w>-<d5>.html", "<w>-<w>-<d2>-<w>-<w>",
        "<w><w><w><w><d1>", "doi 10.<d4>/<w>.<y>.<d6>", "<y>-<m>-<m>T<h>:<h>:<h>", "<d20>", "<w>_<w>_<w>_v<d1>", "img-<d4>-<d2>-<d2>-<w>", "version-<d1>.<d2>.<d3>-<w>", "token = <w>_<w>_value", "password: <w><w>", "secret = <w>-<w>",
        "<W><W><W><d2>", "<w>+<w>+<d4>=<w>", "item-<d4>-<d4>-<d4>", "(<w>/<w>/<d4>)", "<u5>-<u4>-<d8>", "tokens <w>_<w>_<d6>", "<w>.<w>.<w>.<d4>.<w>", "<x8><w>-<w>-<w>",
        "the password is <w><w>", "the secret is <w><w>", "pwd=<w><w>", "the token is <w>-<w><w>", "a key is <w><w>",
    ),
}
_FIELD = re.compile(r"<([a-zA-Z]+)([0-9]*)>")
_CONTEXT = 6


def _written(r: random.Random, pattern: str) -> tuple[str, tuple[int, int] | None]:
    """A pattern filled in, and the marked span."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def fill(m: re.Match) -> str:
        kind, n = m[1], int(m[2] or 0)
        word = "".join(r.choices(letters, k=r.randint(2, 9)))
        if kind == "card":
            body = "4" + "".join(r.choices(digits, k=14))
            number = body + next(c for c in digits if _luhn(body + c))
            return r.choice(" -.").join(number[i : i + n] for i in range(0, 16, n)) if n else number
        simple = {"w": word, "W": word.title(), "i": str(r.randint(0, 255)), "y": str(r.randint(1900, 2030)), "m": f"{r.randint(1, 12):02}", "h": f"{r.randint(0, 59):02}"}
        pool = {"d": digits, "x": digits + "abcdef", "u": letters.upper() + digits, "b": letters + letters.upper() + digits}
        return simple.get(kind) or "".join(r.choices(pool[kind], k=n))

    text = _FIELD.sub(fill, pattern)
    a, b = text.find("{"), text.find("}") - 1
    return text.replace("{", "", 1).replace("}", "", 1), (a, b) if a >= 0 else None


def _same(a: int, b: int, x: int, y: int) -> bool:
    return a == x and b == y


def built(text: str, seed: str, rounds: int) -> Iterator[tuple[str, float, bool, list[float]]]:
    """(family, label, held back, features) of the candidates about what is written between the text's words."""
    words = text[:100_000].split()
    for n in range(rounds):
        r = random.Random(f"{seed}:{n}")
        held = zlib.crc32(f"{seed}:{n}".encode()) % 5 == 0
        for family, patterns in ((f, p) for f in FAMILIES for p in (POSITIVES[f], NEGATIVES[f])):
            item, span = _written(r, r.choice(patterns))
            at = r.randint(0, max(0, len(words) - 2 * _CONTEXT))
            left, right = " ".join(words[at : at + _CONTEXT]), " ".join(words[at + _CONTEXT : at + 2 * _CONTEXT])
            low = len(left) + 1
            whole = f"{left} {item} {right}"
            base = [(a, b) for _, a, b in base_spans(whole)]
            for kind, a, b in candidates(whole):
                if a < low + len(item) and b > low:
                    good = kind == family and span is not None and _same(a, b, low + span[0], low + span[1])
                    yield kind, float(good or (kind != "secret" and any(_same(a, b, x, y) for x, y in base))), held, features(whole, a, b)


def own(text: str, seed: str) -> Iterator[tuple[str, float, bool, list[float]]]:
    """The same of a document's own candidates: addresses and numbers, positive where they are base spans."""
    held = zlib.crc32(f"{seed}:own".encode()) % 5 == 0
    found = [c for c in candidates(text) if c[0] != "secret"]
    found.sort(key=lambda c: zlib.crc32(text[c[1] : c[2]].encode("utf-8", "replace")))
    base = sorted((a, b) for _, a, b in base_spans(text)) if found else []
    for kind, a, b in found[:OWN]:
        near = base[max(0, bisect.bisect_left(base, (a - 1, 0)) - 1) :]
        yield kind, float(any(_same(a, b, x, y) for x, y in itertools.takewhile(lambda s: s[0] <= a + 1, near))), held, features(text, a, b)


@dataclass
class Trees:
    """Boosted regression trees of one family: per tree, arrays over its nodes; a leaf points to itself.

    ``learned`` says how many positives and negatives they learned from, ``precision`` and ``recall`` what the threshold
    reached on the rows held back.
    """

    start: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0
    learned: tuple[int, int] = (0, 0)
    precision: float = 0.0
    recall: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, left, value in zip(self.feature, self.cut, self.left, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                down = left[at]
                at = np.where(down < 0, at, down + (x[rows, feature[at]] > cut[at]))
            total += value[at]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -50, 50)))


class Bins:
    """Features cut at quantiles, so that a node's splits are sums over bins."""

    def __init__(self, x: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(column, np.linspace(0.0, 1.0, _BINS + 1)))[:-1] for column in x.T]
        self.codes = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(self.cuts, x.T)], axis=1) + np.arange(x.shape[1]) * (_BINS + 1)

    def sums(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        width = self.codes.shape[1]
        return np.bincount(self.codes[rows].ravel(), np.repeat(weights[rows], width), width * (_BINS + 1)).reshape(width, _BINS + 1)


def _grow(bins: Bins, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """One tree of second-order boosting: splits at quantiles that gain most, leaves at the Newton step."""
    nodes: list[list[float]] = []

    def build(at: int, rows: np.ndarray, depth: int) -> None:
        g, h = gradient[rows].sum(), weight[rows].sum()
        nodes[at] = [0, 0.0, -1, float(SHRINK * g / (h + 1.0))]
        if not depth or len(rows) < 10:
            return
        low_g, low_h = np.cumsum(bins.sums(rows, gradient), axis=1), np.cumsum(bins.sums(rows, weight), axis=1)
        count = np.cumsum(bins.sums(rows, np.ones(len(gradient))), axis=1)
        gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h + 1) - g * g / (h + 1)
        gain[(count < 3) | (count > len(rows) - 3)] = 0.0
        f, cut = divmod(int(np.argmax(gain)), _BINS + 1)
        if gain[f, cut] > 1e-6:
            down = len(nodes)
            nodes.extend([[], []])
            nodes[at] = [f, float(bins.cuts[f][cut]), down, 0.0]
            low = bins.codes[rows, f] - f * (_BINS + 1) <= cut
            build(down, rows[low], depth - 1)
            build(down + 1, rows[~low], depth - 1)

    nodes.append([])
    build(0, np.arange(len(gradient)), DEPTH)
    return tuple(np.array([n[i] for n in nodes], kind) for i, kind in enumerate((np.int64, np.float64, np.int64, np.float64)))


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Trees from the rows that are not held back; scaling and threshold from those that are."""
    learn, truth = x[~held], y[~held]
    if not 0 < truth.sum() < len(truth):
        raise ValueError(f"boosting needs positives and negatives, got {int(truth.sum())} of {len(truth)}")
    rate = truth.mean()
    trees = Trees(math.log(rate / (1 - rate)), learned=(int(truth.sum()), int(len(truth) - truth.sum())))
    bins, margin = Bins(learn), np.full(len(learn), trees.start)
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        parts = _grow(bins, truth - p, p * (1 - p))
        for held_list, part in zip((trees.feature, trees.cut, trees.left, trees.value), parts):
            held_list.append(part)
        margin += Trees(0.0, *([part] for part in parts)).margin(learn)
    if held.any() and y[held].any():
        z, t = trees.margin(x[held]), y[held]
        goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        for _ in range(60):  # Newton steps of Platt scaling
            p = 1 / (1 + np.exp(-np.clip(trees.slope * z + trees.offset, -50, 50)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.linalg.solve(h, np.array([((goal - p) * z).sum(), (goal - p).sum()]))
            trees.slope, trees.offset = trees.slope + float(np.clip(a, -1, 1)), trees.offset + float(np.clip(b, -1, 1))
        p = trees.chance(x[held])
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        last = np.flatnonzero((right >= PRECISION) & np.append(np.diff(p[order]) < 0, True))
        trees.threshold = max(0.5, float(p[order][last[-1]])) if len(last) else 2.0
        taken = p >= trees.threshold
        trees.precision, trees.recall = float(t[taken].mean()) if taken.any() else 0.0, float(t[taken].sum() / t.sum())
    return trees


def fit(docs: DataFrame) -> dict[str, Trees]:
    total = docs.count()
    rate = sample_rate(total, SAMPLE_ROWS)
    rounds = max(1, min(MOST_ROUNDS, math.ceil(ROUNDS / max(1, min(total, SAMPLE_ROWS)))))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [*built(text, str(doc_id), rounds), *own(text, str(doc_id))]
            if rows:
                kinds = (pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["family", "y", "held", "x"])

    sampled = hash_sampled(docs, rate).select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, "family string, y double, held boolean, x array<double>")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group.x.tolist(), np.float64)
        order = np.lexsort((group.y.to_numpy(), group.held.to_numpy(), *x.T))  # the rows' order decides nothing
        trees = boost(x[order], group.y.to_numpy()[order], group.held.to_numpy()[order])
        return pd.DataFrame({"family": [group.family.iloc[0]], "trees": [pickle.dumps(trees)]})

    return {r.family: pickle.loads(r.trees) for r in sampled.groupBy("family").applyInPandas(train, "family string, trees binary").collect()}


def _disjoint(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(texts: list[str], model: dict[str, Trees]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the base ones, then those that the trees add, by family, then start."""
    proposed = [candidates(t) for t in texts]
    flat = [(i, c) for i, found in enumerate(proposed) for c in found]
    chance = np.zeros(len(flat))
    for family in FAMILIES:
        rows = [k for k, (_, c) in enumerate(flat) if c[0] == family]
        if rows and family in model:
            p = model[family].chance(np.array([features(texts[flat[k][0]], flat[k][1][1], flat[k][1][2]) for k in rows], np.float64))
            chance[rows] = np.where(p >= model[family].threshold, p, 0.0)
    out = []
    added: dict[int, list[tuple[float, int, str, int, int]]] = {}
    for k in np.flatnonzero(chance):
        i, (family, a, b) = flat[k]
        added.setdefault(i, []).append((-float(chance[k]), a - b, family, a, b))
    for i, text in enumerate(texts):
        spans = base_spans(text)
        taken = _disjoint(spans) if i in added else []
        more = []
        for _, _, family, a, b in sorted(added.get(i, ())):
            at = bisect.bisect_left(taken, (a, b))  # taken spans are disjoint and in order: only two neighbours can overlap
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                more.append((family, a, b))
        out.append(spans + sorted(more))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: dict[str, Trees]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and a digest of base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = spans_of(batch.column(1).to_pylist(), shared.value)
            base = [[s for s in spans if s[0] in KINDS] for spans in found]
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(map(listed, found), pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(batches, _FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    merged: list[list] = []
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in reversed(merged):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def redact(docs: DataFrame, model: dict[str, Trees]) -> DataFrame:
    """The documents, columns as given, with spans replaced in ``text`` and ``n_chars`` (where present) set anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    texts = docs.select(*(F.col(f"`{c}`") for c in docs.columns[:at]), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in docs.columns[at + 1 :]))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            held = batch.column(at).to_pylist()
            found = spans_of([t or "" for t in held], shared.value)
            clean = pa.array([None if t is None else redacted(t, s) for t, s in zip(held, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 :]], schema=batch.schema)

    out = texts.mapInArrow(batches, texts.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
