"""DuckDB SQL for the rows of the queries that SQL can express.

The others have none: trained models (1, 4, 6), rolling hashes over bytes (2), byte-pair merges (5, 13) and XXH64 (10) are held
against brute force, an exact round trip or held-out accuracy in the tests.
"""

from graphloom.llm import mixing, phrases, quality, urls

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

ORACLES: dict[str, str] = {}

ORACLES["op3_chat"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS t, replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
CAST(sum(length('### ' || r || ': ' || t || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

ORACLES["op8_substrings"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 12), 'string_agg', ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM s JOIN f USING (s) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM d),
y AS (SELECT x.doc_id, count(*) - count(g.k) AS n_kept, string_agg(CASE WHEN g.k IS NULL THEN word END, ' ' ORDER BY x.k) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.k = x.k GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""

_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)) + " END"
ORACLES["op9_mixing"] = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS k, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST({_WEIGHT} AS DOUBLE) AS weight FROM d GROUP BY source),
m AS (SELECT *, CAST(source_size * {mixing.CAP} AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM s),
r AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS nth FROM m),
l AS (SELECT arg_min((whole - stopped) / open, nth) AS level FROM r WHERE (whole - stopped) / open <= most / weight),
t AS (SELECT source, source_size, least(most, coalesce(level, 0.0) * weight) AS target FROM r CROSS JOIN l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CAST(floor(budget / greatest(source_size, 1)) AS BIGINT) * size + greatest(0, least(size, budget - CAST(floor(budget / greatest(source_size, 1)) AS BIGINT) * source_size - before)) AS BIGINT) AS taken FROM j"""

_RATES = {
    "symbols_per_word": "n_symbols / n_words",
    "exclamations_per_word": "n_ex / n_words",
    "repeated_line_share": "n_dup_lines / n_lines",
    "repeated_word_share": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "-(word_chars / n_words)",
}
_GRID = " UNION ALL ".join(f"SELECT doc_id, stratum, mark, base_failed, '{r}' AS rule, {_RATES[r]} AS rate, {c!r} AS cutoff FROM m" for r, cuts in quality.RULES.items() for c in cuts)
_ALPHA = quality.ALPHA / len(quality.RULES)
ORACLES["op7_quality"] = f"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
s AS (SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS s FROM p),
t AS (SELECT doc_id, s FROM s GROUP BY doc_id, s HAVING count(*) > 1),
g AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT s.doc_id, unnest(generate_series(i, i + 4)) AS k FROM s JOIN t ON s.doc_id = t.doc_id AND s.s = t.s) GROUP BY doc_id),
b AS (SELECT d.doc_id, stratum, md5(text) AS mark, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_ex, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
grid AS ({_GRID}),
e AS (SELECT doc_id, bool_and(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
a AS (SELECT stratum, rule, cutoff, mark, any_value(rate) AS rate, bool_and(good) AS good FROM grid JOIN e USING (doc_id) WHERE NOT base_failed GROUP BY stratum, rule, cutoff, mark),
c AS (SELECT stratum, rule, cutoff, count(CASE WHEN good THEN 1 END) AS n, count(CASE WHEN good AND rate > cutoff THEN 1 END) AS k, count(CASE WHEN NOT good AND rate > cutoff THEN 1 END) AS bad
FROM a GROUP BY stratum, rule, cutoff),
q AS (SELECT *, (SELECT count(DISTINCT stratum) FROM c) * {len(quality.RULES)} AS tests FROM c WHERE n > 0 AND k <= n * {_ALPHA!r}),
u AS (SELECT stratum, rule, cutoff, any_value(bad) AS bad, any_value(k) AS k, any_value(tests) AS tests, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_ALPHA!r}) + (n - j) * ln(1 - {_ALPHA!r}))) AS chance
FROM (SELECT *, unnest(generate_series(0, k)) AS j FROM q) GROUP BY stratum, rule, cutoff),
v AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM u WHERE chance <= {quality.DELTA!r} / tests AND bad > k GROUP BY stratum, rule),
z AS (SELECT DISTINCT g.doc_id FROM grid g JOIN v ON g.stratum = v.stratum AND g.rule = v.rule AND g.cutoff = v.cutoff WHERE g.rate > v.cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND z.doc_id IS NULL AS kept FROM m LEFT JOIN z ON z.doc_id = m.doc_id"""

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST = rf"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_FOLD})"
_REST = rf"regexp_replace(translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)$', 1), {_FOLD}), '[0-9]+', '0', 'g')"
_CUT = "list_transform(list_filter({}, lambda w: w <> ''), lambda w: '{}' || w)"
_TOKENS = f"list_distinct(list_concat({_CUT.format(f"string_split({_HOST}, '.')", 'h:')}, {_CUT.format(f"string_split_regex({_REST}, '[/.?&=#]+')", 't:')}))"
_FITS = [
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'"
    for rule, _ in sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))
    for name, _, rest in [rule.partition("/")]
]
# All combinations of a bad URL's rarest frequent tokens are counted, which are those that FP-growth finds; rules that hold smaller
# ones change no verdict and stay.
ORACLES["op11_urls"] = rf"""WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {_TOKENS} AS tokens FROM pages),
r AS (SELECT *, CASE {' '.join(_FITS)} END AS rule FROM p),
m AS (SELECT doc_id, max(coalesce(quality = 0, FALSE) OR coalesce(toxic = 1, FALSE)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
k AS (SELECT url, any_value(tokens) AS tokens, CAST(max(bad) AS INTEGER) AS bad FROM p JOIN m ON m.doc_id = try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) WHERE len(tokens) > 0 GROUP BY url),
n AS (SELECT greatest({urls.LEAST_COUNT}, ceil(count(*) * {urls.LEAST_SHARE})) AS least FROM k),
t AS (SELECT url, unnest(tokens) AS token FROM k WHERE bad = 1),
f AS (SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= (SELECT least FROM n)),
o AS (SELECT url, token, row_number() OVER (PARTITION BY url ORDER BY f.n, token) AS nth FROM t JOIN f USING (token)),
b AS (SELECT url, list_sort(list(token)) AS items FROM o WHERE nth <= {urls.MOST_ITEMS} GROUP BY url),
x AS (SELECT url, items, unnest(generate_series(1, (1 << len(items)) - 1)) AS mask FROM b),
c AS (SELECT list_filter(items, lambda w, i: (mask >> (i - 1)) & 1 = 1) AS items FROM x UNION ALL SELECT [token] FROM f),
s AS (SELECT items FROM c GROUP BY items HAVING count(*) >= (SELECT least FROM n) OR len(items) = 1),
g AS (SELECT s.items FROM s JOIN k ON list_has_all(k.tokens, s.items) GROUP BY s.items HAVING sum(bad) >= (SELECT least FROM n) AND sum(bad) * 100 >= count(*) * {urls.CONFIDENCE}),
h AS (SELECT DISTINCT url FROM r WHERE rule IS NULL AND EXISTS (SELECT 1 FROM g WHERE list_has_all(r.tokens, g.items)))
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{a}' THEN '{v}'" for a, v in urls.RULES)} WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN h ON h.url = r.url AND r.rule IS NULL"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, w[i : i + {m - 1}] AS p FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {m - 1})) AS i FROM w WHERE len(w) >= {m})" for m in range(1, phrases.LONGEST + 1))
_INNER = " UNION ALL ".join(
    f"SELECT lang, p[{i} : {i + j - 1}] AS p, a FROM f WHERE len(p) = {m}" for m in range(3, phrases.LONGEST + 1) for j in range(2, m) for i in range(1, m - j + 2)
)
ORACLES["op12_phrases"] = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, p, count(*) AS a FROM ({_GRAMS}) GROUP BY lang, p HAVING count(*) >= {phrases.LEAST}),
k AS (SELECT lang, p, a, unnest(generate_series(1, len(p) - 1)) AS k FROM f WHERE len(p) > 1),
s AS (SELECT k.lang, k.p, k.a, x.a AS l, y.a AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score, k.k FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[1 : k.k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k.k + 1 :]),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM s),
i AS (SELECT lang, p, max(a) AS cover FROM ({_INNER}) GROUP BY lang, p),
o AS (SELECT c.lang, array_to_string(c.p, ' ') AS phrase, a, l, r, score FROM c LEFT JOIN i ON i.lang = c.lang AND i.p = c.p WHERE nth = 1 AND (cover IS NULL OR 100 * cover < {phrases.SHARE} * a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= {phrases.MOST_RANK}"""
