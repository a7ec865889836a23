"""DuckDB SQL of the operators that it can express; the others are tested against brute force."""

from __future__ import annotations

LETTERS = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}


def any_case(word: str) -> str:
    """ASCII letters in either case, without Unicode folding."""
    return "".join(LETTERS.get(c, c) for c in word)


ASSIGN = "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
KINDS = [
    ("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16),
    ("privkey", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 23), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
]

SECRETS = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS ("
    + " UNION ALL ".join(
        f"SELECT r, {i} AS k, '{kind}' AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {g}) AS held, {least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        for i, (kind, p, g, least) in enumerate(KINDS)
    )
    + """), placed AS (
 SELECT r, k, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n
 FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found) WHERE length(held[i]) >= least),
named AS (SELECT r, k, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM placed),
grouped AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
 string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN grouped USING (r)"""
)

def rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END"


def host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({rest(url)}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def path(url: str) -> str:
    return f"coalesce(regexp_extract({rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def slashed(url: str) -> str:
    return f"coalesce(nullif({path(url)}, ''), '/')"


def address(url: str) -> str:
    """Host without a default port, path without dot segments, and query."""
    parts = f"string_split({slashed(url)}, '/')[2:]"
    kept = f"list_reduce(list_concat([[]::VARCHAR[]], list_transform({parts}, lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"
    plain = f"CASE WHEN contains({slashed(url)}, '/.') THEN '/' || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END ELSE {slashed(url)} END"
    port = f"regexp_replace({host(url)}, CASE WHEN regexp_matches({url}, '^(?i)http:') THEN ':80$' WHEN regexp_matches({url}, '^(?i)https:') THEN ':443$' ELSE 'never^' END, '')"
    return f"CASE WHEN {host(url)} <> '' THEN {port} || {plain} || coalesce(regexp_extract({rest(url)}, '^[^?#]*(\\??[^#]*)', 1), '') END"


def unescaped(text: str) -> str:
    ref = "'^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos));?'"
    number = f"coalesce(try_cast(regexp_extract(p, {ref}, 1) AS INT), try_cast('0x' || regexp_extract(p, {ref}, 2) AS INT))"
    char = f"CASE regexp_extract(p, {ref}, 3) WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN chr(34) WHEN 'apos' THEN chr(39) ELSE CASE WHEN {number} > 0 AND {number} < 1114112 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr({number}) END END"
    return f"array_to_string(list_concat(string_split({text}, '&')[1:1], list_transform(string_split({text}, '&')[2:], lambda p: coalesce({char} || regexp_replace(p, {ref}, ''), '&' || p))), '')"


def target(href: str, url: str) -> str:
    scheme = f"regexp_extract({url}, '^([^:/?#]+)://', 1)"
    site = f"{scheme} || '://' || {host(url)}"
    return (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {href} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href}"
        f" WHEN starts_with({href}, '/') THEN {site} || {href} WHEN starts_with({href}, '#') THEN {url} WHEN starts_with({href}, '?') THEN {site} || {slashed(url)} || {href} ELSE {site} || regexp_replace({slashed(url)}, '[^/]*$', '') || {href} END"
    )


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WS = "[ \\t\\n\\f\\r]"
RAW = "|".join(f"<{e}\\b[^>]*>.*?(?:</{e}{WS}*>|\\z)" for e in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
ELEMENT = """(?i)<(?:link|meta|base)\\b(?:[^>"']|"[^"]*"|'[^']*'|["'])*>"""
PART = f"""([^ \\t\\n\\f\\r"'<>/=]+){WS}*(?:={WS}*(?:"([^"]*)"|'([^']*)'|([^ \\t\\n\\f\\r"'>]*)))?"""
REFRESH_URL = f"""(?i)\\burl{WS}*={WS}*["']?([^"' \\t\\n\\f\\r]+)"""


def attribute(name: str) -> str:
    """Of a tag t: the trimmed value of the first attribute of that name, else empty."""
    names = f"list_transform(regexp_extract_all(t, {quoted(PART)}, 1), lambda n: lower(n))"
    value = " || ".join(f"coalesce(regexp_extract_all(t, {quoted(PART)}, {k})[list_position({names}, '{name}')], '')" for k in (2, 3, 4))
    return f"regexp_replace(coalesce({value}, ''), '^{WS}+|{WS}+$', '', 'g')"


def read_of(element: str, test: str, value: str) -> str:
    return f"list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<{element}\\b') AND {test}), lambda t: {value})"


def linked(element: str, test: str, value: str) -> str:
    return f"list_transform({read_of(element, test, value)}, lambda h: {unescaped('h')})"


IS_CANONICAL = f"list_contains(regexp_split_to_array(lower({attribute('rel')}), '{WS}+'), 'canonical')"
IS_REFRESH = f"lower({attribute('http-equiv')}) = 'refresh'"

URLS = f"""
WITH RECURSIVE pg AS (SELECT row_number() OVER () AS r, page_id, url, html, {host('url')} AS host, {path('url')} AS path, {address('url')} AS address FROM pages),
rules(allow, rh, rp) AS (VALUES (true, 'org', '/'), (false, 'example.org', '/es/'), (false, 'example.org', '/en/1'), (true, 'com', '/fr/'), (false, 'com', '/de/')),
tagged AS (SELECT url, regexp_extract_all(regexp_replace(html, {quoted('(?is)<!--.*?(?:-->|' + chr(92) + 'z)|' + RAW)}, ' ', 'g'), {quoted(ELEMENT)}) AS tags FROM pg WHERE html IS NOT NULL AND instr(url, '://') > 0),
named AS (SELECT url, list_filter({linked('base', 'true', attribute('href'))}, lambda h: h <> '')[1] AS base, list_concat({linked('link', IS_CANONICAL, attribute('href'))}, {linked('meta', IS_REFRESH, f"regexp_extract({attribute('content')}, {quoted(REFRESH_URL)}, 1)")}) AS links FROM tagged),
based AS (SELECT url, coalesce({target('base', 'url')}, url) AS base, links FROM named WHERE len(links) > 0),
led AS (SELECT url, {target('href', 'base')} AS goal FROM (SELECT url, base, unnest(list_distinct(links)) AS href FROM based) WHERE href <> ''),
edges AS (SELECT DISTINCT {address('url')} AS a, {address('goal')} AS b FROM led),
ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(n, m) AS (SELECT a, a FROM ways UNION SELECT reach.n, ways.b FROM reach JOIN ways ON reach.m = ways.a),
nodes AS (SELECT DISTINCT m, {host("'x://' || m")} AS host, {path("'x://' || m")} AS path FROM reach),
judged AS (SELECT m, max_by(allow, length(rh || rp) * 2 + allow::INT) AS allow FROM nodes JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY m),
classes AS (SELECT n, coalesce(bool_or(NOT allow), false) AND NOT coalesce(bool_or(allow), false) AS by_alias FROM reach LEFT JOIN judged USING (m) GROUP BY n),
ruled AS (SELECT r, max_by(rh || rp, length(rh || rp) * 2 + allow::INT) AS rule, max_by(allow, length(rh || rp) * 2 + allow::INT) AS allow FROM pg JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN coalesce(NOT allow, by_alias, false) THEN 'block' ELSE 'allow' END AS verdict
FROM pg LEFT JOIN ruled USING (r) LEFT JOIN classes ON address = n
"""

TOPK = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS held, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, held, 2.0::DOUBLE * held AS cap, [5, 2, 1][i % 3 + 1]::DOUBLE AS weight, 1.5::DOUBLE * sum(held) OVER () AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS spent, sum(weight) OVER r AS open_weight FROM w WHERE held > 0 WINDOW p AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, (total - spent) / open_weight AS unit, (total - spent) / open_weight * weight >= cap AS is_full FROM f),
t AS (SELECT source, held, CASE WHEN is_full THEN cap ELSE (SELECT unit FROM u WHERE NOT is_full ORDER BY cap / weight, source LIMIT 1) * weight END AS target FROM u UNION ALL SELECT source, held, 0 FROM w WHERE held = 0),
k AS (SELECT d.doc_id, d.size, t.held, t.target, CASE WHEN t.held = 0 THEN 0 ELSE least(floor(t.target / t.held + 1e-9), 2) END AS passes,
 sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('/', '11', d.name, d.size::VARCHAR)), d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, held AS source_size, target::DOUBLE AS target, (size * least(2, passes + CASE WHEN upto - size / 2 <= greatest(0, target - held * passes) THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""

NEAR = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT r, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r, b.r AS q FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(r, q) AS (SELECT r, r FROM v UNION SELECT reach.r, l.q FROM reach JOIN l ON reach.q = l.r),
c AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.q GROUP BY reach.r),
n AS (SELECT r, count(*) AS n_links FROM l GROUP BY r)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""

PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))))) AS phrase FROM c WHERE m > 2) GROUP BY lang, phrase),
own AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < f),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM own)),
scored AS (SELECT cuts.*, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
 FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN n ON n.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score FROM weakest
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SPELLING = """
WITH RECURSIVE crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS bytes(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
times AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
coded AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS bytes FROM times),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, crcs),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.i = b.i AND a.key = b.key AND a.word <> b.word
 UNION SELECT k.word, v.word FROM k JOIN v ON v.word = k.key UNION SELECT v.word, k.word FROM k JOIN v ON v.word = k.key),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM one JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
path(word, stop) AS (SELECT word, word FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.stop WHERE f.form IS NOT NULL)
SELECT f.word, form, stop AS root, n, n_near, form_n FROM f JOIN path ON path.word = f.word JOIN (SELECT word AS last FROM f WHERE form IS NULL) ON stop = last
"""

SQL = {"op11_phrase_collocations": PHRASES, "op13_spelling_variants": SPELLING, "op3_source_mix": MIX, "op7_embedding_near_dedup": NEAR, "op2_url_filter": URLS, "op4_secret_scan": SECRETS, "op10_exact_top_k": TOPK}
