"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import quality_rules as q
from tidemark.llm import url_filter as u

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(text, '{u.UPPER}', '{u.LOWER}')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) r USING (doc_id)"""


def _spans(kind: str, pattern: str, keep: str) -> str:
    """Rows (doc_id, kind, a, b) of the matches m that pass keep, from what stands between matches."""
    return rf"""SELECT doc_id, '{kind}' AS kind, a, a + length(m) AS b FROM (
      SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a
      FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL))) WHERE {keep}"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(_any_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
_HEAD = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"

#: Checksummed kinds are beyond it; the test tables hold none, so spans are the base ones here.
SECRETS = rf"""
WITH f AS ({_spans('assign', f'{_HEAD}{_VALUE}', f"length(regexp_extract(m, '^{_HEAD}({_VALUE})', 1)) >= 8")}
  UNION ALL {_spans('access', 'AKIA[A-Z0-9]+', 'length(m) >= 16')} UNION ALL {_spans('hex', '[0-9a-f]+', 'length(m) >= 32')}),
j AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, list_position(['assign', 'access', 'hex'], kind)) AS spans FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id"""


def _rules() -> str:
    cases = ""
    for kind, rule in sorted(u.RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        cases += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}') THEN ['{rule}', '{kind}']"
    return f"CASE{cases} END"


def _level(name: str, groups: str, above: str, key: str) -> str:
    """Posterior mean and strength of each group, given the groups and their prior means."""
    low, high = u.STRENGTH
    p = "greatest(least(prior, 1 - 1e-6), 1e-6)"
    return f"""
{name}_in AS (SELECT g.*, a.mean AS prior FROM {groups} g JOIN {above} a ON g.{key} = a.name),
{name}_m AS (SELECT CASE WHEN s IS NULL OR s <= o THEN {high} ELSE greatest({low}, least({high}, (q - s) / (s - o))) END AS m
  FROM (SELECT sum((b - n * {p}) ** 2) AS s, sum(n * {p} * (1 - {p})) AS o, sum(n * n * {p} * (1 - {p})) AS q FROM {name}_in WHERE n > 0)),
{name} AS (SELECT name, (b + m * prior) / (n + m) AS mean, n + m AS strength FROM {name}_in, {name}_m)"""


URLS = rf"""
WITH p AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS plain FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(r, '^([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') ELSE '' END AS host,
                  CASE WHEN contains(url, '://') THEN regexp_extract(r, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
           FROM (SELECT page_id, url, substr(url, strpos(url, '://') + 3) AS r FROM pages))),
o AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
hosts AS (SELECT plain AS name, CASE WHEN ip THEN plain WHEN long THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
                 CASE WHEN ip THEN '' WHEN long THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix, n, b
          FROM (SELECT plain, string_split(plain, '.') AS labels, regexp_matches(plain, '{u.IP_ADDRESS}') AS ip, array_to_string(string_split(plain, '.')[-2:], '.') IN {u.LONG_SUFFIXES} AS long,
                       CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS b FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY 1)),
domains AS (SELECT domain AS name, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix AS name, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1),
whole AS (SELECT s.name, (sum(h.b) + {u.START_BAD}) / (sum(h.n) + {u.START_PAGES}) AS mean FROM suffixes s, hosts h GROUP BY 1),
{_level('by_suffix', 'suffixes', 'whole', 'name')}, {_level('by_domain', 'domains', 'by_suffix', 'suffix')}, {_level('by_host', 'hosts', 'by_domain', 'domain')}
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN mean - {u.Z} * sqrt(mean * (1 - mean) / (strength + 1)) > {u.BAD_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, {_rules()} AS r FROM p) p JOIN by_host ON p.plain = by_host.name"""

_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '')"
WARC = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body, {_BITS} AS bits FROM pages),
f AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY body) AS first_id,
             array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INT) * (1 << (4 - k)))) AS INT), 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


def _count(line: str, pattern: str) -> str:
    return f"(length({line}) - length(regexp_replace({line}, '{pattern}', '', 'g')))"


_GAP = r"[\x20\x09-\x0D]+"
_N = f"len(string_split_regex(trim(x, ' '), '{_GAP}'))"
_PHRASES = " OR ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for p in q.BOILERPLATE)
_CODE = f"""CASE WHEN {_count('x', '[|»›]')} * 100 > {_N} * {q.BAR_PERCENT} OR {_count('x', q.SYMBOLS)} * 100 > length(x) * {q.SYMBOL_PERCENT}
  OR ({_count('x', '!')} * 100 >= {_N} * {q.SHOUT_PERCENT} AND x = upper(x) AND lower(x) <> x) OR {_PHRASES}
  OR ({_N} >= {q.UNPUNCTUATED_WORDS} AND NOT regexp_matches(x, '{q.CLAUSE_END}')) THEN 1
  WHEN NOT regexp_matches(x, '{q.CLAUSE_END}') AND len(regexp_extract_all(x, '{WORD}')) BETWEEN 1 AND {q.LINK_WORDS} THEN 2 ELSE 0 END"""
_LINKS = " OR ".join("(" + " AND ".join(f"coalesce(lag(code, {-k}) OVER w, 0) = 2" if k < 0 else f"coalesce(lead(code, {k}) OVER w, 0) = 2" for k in range(first, first + q.LINK_LINES) if k) + ")" for first in range(1 - q.LINK_LINES, 1))

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
x AS (SELECT doc_id, i, x, {_CODE} AS code FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
left_over AS (SELECT doc_id, CASE WHEN code = 0 OR (code = 2 AND NOT ({_LINKS})) THEN length(x) + 1 END AS size FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, coalesce(sum(size) - 1, 0) AS clean FROM left_over GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls, clean FROM d JOIN c USING (doc_id)),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_GAP}', '', 'g')) AS BIGINT) AS word_chars, CAST({_count('t', q.SYMBOLS)} AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, clean * 100 >= length(t) * {q.KEPT_PERCENT} AS stays
      FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT * EXCLUDE (stays), n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEATED_PERCENT} * n_words) AND stays AS kept FROM r"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}')) AS t FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t), s GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""

# CRC-32 of a decimal number, byte by byte over the table of the reversed polynomial.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"


def _crc32(number: str) -> str:
    bytes_of = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


PERIODS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, {_crc32('doc_id')} AS h FROM documents, {_CRC_TABLE}),
a AS (SELECT *, CAST(len(ws) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
v AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS ws FROM a),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM v),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same) GROUP BY doc_id, p, g),
runs AS (SELECT doc_id, s, l, min(p) AS p FROM stretch WHERE l >= greatest(6, 4 * p) GROUP BY 1, 2, 3),
best AS (SELECT doc_id, s, l, p FROM runs r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS HUGEINT) * 1000000000000 // p DESC, s, p) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, v.n AS n_words, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM v LEFT JOIN best b USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op1_ngram_jaccard": JACCARD, "op2_secret_scan": SECRETS, "op3_url_filter": URLS, "op6_warc": WARC, "op7_quality_rules": QUALITY, "op11_ranked_search": SEARCH, "op13_periodic_runs": PERIODS}
