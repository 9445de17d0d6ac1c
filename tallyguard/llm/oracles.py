"""DuckDB SQL that checks the registered queries, written from their definitions."""

from __future__ import annotations

from .license_scan import TEMPLATES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH sized AS (SELECT doc_id, text, source, len({_WORDS}) AS size FROM documents),
per_source AS (
  SELECT source, sum(size) AS source_size, 3.0 * sum(size) AS cap,
         ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
stepped AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
  FROM per_source
  WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size, least(cap, w * (
    SELECT arg_min(level, place) FROM stepped WHERE cap >= level * w)) AS target FROM stepped),
placed AS (
  SELECT s.*, p.source_size, p.target, CAST(round(p.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

LICENSES = (
    """
WITH templates(license, body) AS (VALUES """
    + ", ".join(f"('{name}', '{body}')" for name, body in TEMPLATES.items())
    + r"""),
worded AS (
  SELECT 0 AS kind, doc_id, '' AS license, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS parts FROM documents
  UNION ALL
  SELECT 1, NULL, license, string_split_regex(lower(body), '[^a-z0-9]+') FROM templates),
listed AS (SELECT kind, doc_id, license, list_filter(parts, lambda w: w <> '') AS w FROM worded),
shingled AS (
  SELECT DISTINCT kind, doc_id, license, unnest(list_transform(range(1, len(w) - 3),
    lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) AS s
  FROM listed WHERE len(w) >= 5),
sized AS (SELECT license, count(*) AS n FROM shingled WHERE kind = 1 GROUP BY license),
found AS (
  SELECT d.doc_id, t.license, count(*) AS hits
  FROM shingled d JOIN shingled t ON d.s = t.s AND d.kind = 0 AND t.kind = 1 GROUP BY ALL),
kept AS (SELECT doc_id, license, hits / n AS containment FROM found JOIN sized USING (license) WHERE hits / n >= 0.8)
SELECT d.doc_id, count(k.license) AS n_licenses,
  coalesce(string_agg(k.license, ',' ORDER BY k.license), '') AS licenses, max(k.containment) AS best
FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id
"""
)

COVER_TREE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v)
    / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y)
SELECT e.vec_id, (SELECT count(*) FROM linked WHERE x = e.vec_id) AS n_links,
  (SELECT min(y) FROM reached WHERE x = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(y) FROM reached WHERE x = e.vec_id) AS kept
FROM embeddings e
"""

# The function words and limits of the quality rules.
_STOP = (
    "the of and to in is that it for on with as was le la les de des et que qui une du est pour "
    "dans el los las y en por con una se del der die das und ist von zu den mit ein im"
)
_STOP_LIST = ", ".join(f"'{w}'" for w in _STOP.split())

QUALITY = rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS times FROM windows) WHERE times > 1)
  GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_LIST}))) AS stops, len(lines) AS n_lines,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest
  FROM worded LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.25
    AND (n_words < 30 OR stops / n_words BETWEEN 0.005 AND 0.95)
    AND n_dup_lines / n_lines <= 0.5 AND longest <= 1000 AND n_words / n_lines >= 1 AS kept
FROM judged
"""


def _url_level(k: int) -> str:
    """One level of the template tree: branches, groups of alike branches, purities."""
    return f"""
named{k} AS (
  SELECT *, CASE WHEN len(segments) > {k} THEN CASE WHEN regexp_matches(segments[{k + 1}],
    '^([0-9]+([._-][0-9]+)*|[0-9a-f]{{8,}}|[0-9a-f-]{{32,}})(\\.[a-z]{{1,5}})?$')
    THEN '*' ELSE segments[{k + 1}] END END AS branch FROM tree{k}),
branch{k} AS (
  SELECT host, template, branch, sum(n) AS n, sum(b) AS b FROM named{k} WHERE branch IS NOT NULL GROUP BY ALL),
group{k} AS (
  SELECT *, sum(n) OVER g AS all_n, sum(b) OVER g AS all_b FROM (
    SELECT *, CASE WHEN b / n >= 0.875 THEN 3 WHEN b / n >= 0.5 THEN 2 WHEN b / n >= 0.125 THEN 1 ELSE 0 END AS grp
    FROM branch{k} WHERE branch <> '*' AND n >= 5)
  WINDOW g AS (PARTITION BY host, template, grp)),
own{k} AS (
  SELECT host, template, branch, CASE WHEN all_n > n AND abs(b / n - (all_b - b) / (all_n - n))
    > 3.0 * sqrt((all_b / all_n) * (1 - all_b / all_n) * (1.0 / n + 1.0 / (all_n - n)))
    THEN branch ELSE '*' || grp END AS own FROM group{k}),
tree{k + 1} AS (
  SELECT host, path, n, b, segments, next_template AS template,
    CASE WHEN ended THEN purity
      ELSE (sum(b) OVER t + 10.0 * purity) / (sum(n) OVER t + 10.0) END AS purity
  FROM (SELECT d.*, d.branch IS NULL AS ended,
          CASE WHEN d.branch IS NULL THEN d.template ELSE d.template || '/' || coalesce(o.own, '*') END AS next_template
        FROM named{k} d LEFT JOIN own{k} o
          ON o.host = d.host AND o.template = d.template AND o.branch = d.branch)
  WINDOW t AS (PARTITION BY host, next_template, ended))"""


URLS = (
    r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM split),
marked AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said
  FROM ruled),
paths AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (said = 'block') AS b,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM marked GROUP BY host, path),
prior AS (SELECT sum(b) / sum(n) AS p FROM paths),
tree0 AS (
  SELECT host, path, n, b, segments, '' AS template,
    (sum(b) OVER (PARTITION BY host) + 10.0 * p) / (sum(n) OVER (PARTITION BY host) + 10.0) AS purity
  FROM paths, prior),"""
    + ",".join(_url_level(k) for k in range(3))
    + """
SELECT page_id, m.host, m.path, rule,
  coalesce(said, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM marked m JOIN tree3 t ON t.host = m.host AND t.path = m.path
"""
)

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM worded
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
halves AS (
  SELECT lang, phrase, f, 1 AS k, w[1] AS first, array_to_string(w[2:size], ' ') AS rest FROM candidates
  UNION ALL
  SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
cuts AS (
  SELECT h.lang, h.phrase, h.f AS a, h.k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * h.f * h.f) // (l.f::HUGEINT * r.f) AS score
  FROM halves h JOIN counts l ON l.lang = h.lang AND l.phrase = h.first
  JOIN counts r ON r.lang = h.lang AND r.phrase = h.rest),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
covered AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM candidates WHERE size = 3),
kept AS (
  SELECT * FROM lowest x WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.lang = x.lang AND c.phrase = x.phrase AND 100 * c.f >= 50 * x.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# the unsigned CRC-32 of an ASCII text, bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  string_split({text}, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))),
  lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))))"""

PREFIX_TRIE = f"""
WITH ordered AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(text="CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
rebuilt AS (
  SELECT c.conv_id, o.pos, o.said FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos + 9, o.said FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h),
listed AS (
  SELECT c.conv_id, coalesce(list(r.said ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY 1),
prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends
  FROM listed, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(strlen(path[depth].text), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path),
families AS (
  SELECT p.depth, p.conv_id, count(*) AS n_children
  FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path GROUP BY ALL),
below AS (
  SELECT x.depth, x.conv_id, count(*) FILTER (f.n_children IS NULL) AS n_leaves,
         sum((y.n_convs - 1) * y.bytes) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM nodes) y
  JOIN nodes x ON x.depth = y.above AND x.path = y.path[1:y.above]
  LEFT JOIN families f ON f.depth = y.depth AND f.conv_id = y.conv_id GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(f.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, conv_id) LEFT JOIN families f USING (depth, conv_id)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
