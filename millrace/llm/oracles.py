"""DuckDB SQL for the queries that it can express. Written from the contracts, apart from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from millrace.llm.license_texts import PHRASES, TEXTS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
#: Rows of `documents` numbered, each with its list of words.
_DOCS = rf"""docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents)"""


def op1() -> str:
    head = r"'WARC/1.0' || e'\r\n' || 'WARC-Type: resource' || e'\r\n' || 'WARC-Target-URI: ' || coalesce(url, '') || e'\r\n' || 'Content-Type: text/html' || e'\r\n' || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || e'\r\n\r\n' || coalesce(html, '') || e'\r\n\r\n'"
    levels, below = [], "leaves"
    for n, width in enumerate((1 << 16, 1 << 19, 1 << 22, None)):
        place = f"(pos // {width}) * {width}" if width else "CAST(0 AS BIGINT)"
        levels.append(f"l{n} AS (SELECT side, archive, pos, sha256(string_agg(CAST(c AS VARCHAR) || ':' || hash, ',' ORDER BY c, hash)) AS hash FROM (SELECT side, archive, {place} AS pos, pos AS c, hash FROM {below}) GROUP BY side, archive, pos)")
        below = f"l{n}"
    return f"""
WITH recs AS (
  SELECT page_id AS key, rec, CASE WHEN page_id % 2003 = 5 THEN NULL WHEN page_id % 101 = 7 THEN 'w' || substr(rec, 2)
    WHEN page_id % 1009 = 11 THEN substr(rec, 1, length(rec) - 1) ELSE rec END AS other
  FROM (SELECT page_id, {head} AS rec FROM pages)),
sized AS (
  SELECT key, len, h, len2, h2, count(*) AS copies, CASE WHEN key IS NULL THEN 'n' || h[1:4] ELSE 'k' || CAST(CAST(floor(key / 512) AS BIGINT) AS VARCHAR) END AS home
  FROM (SELECT key, CAST(octet_length(encode(rec)) AS BIGINT) AS len, sha256(rec) AS h, CAST(octet_length(encode(other)) AS BIGINT) AS len2, sha256(other) AS h2 FROM recs)
  GROUP BY key, len, h, len2, h2),
shared AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY home) / 2048) AS BIGINT) AS shards FROM sized),
placed AS (SELECT *, home || CASE WHEN shards > 1 THEN '.' || CAST(CAST('0x' || h[5:11] AS BIGINT) % shards AS VARCHAR) ELSE '' END AS archive FROM shared),
laid AS (
  SELECT *, CAST(coalesce(sum(len * copies) OVER o, 0) AS BIGINT) AS off, CAST(coalesce(sum(len2 * copies) OVER o, 0) AS BIGINT) AS off2
  FROM placed WINDOW o AS (PARTITION BY archive ORDER BY key NULLS FIRST, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sides AS (
  SELECT 'a' AS side, archive, off, len, copies, key, h FROM laid
  UNION ALL SELECT 'b', archive, off2, len2, copies, key, h2 FROM laid WHERE h2 IS NOT NULL),
leaves AS (SELECT side, archive, off AS pos, sha256(off || ':' || len || ':' || copies || ':' || h) AS hash FROM sides),
{", ".join(levels)},
odd AS (
  SELECT *, row_number() OVER (PARTITION BY side, archive, key ORDER BY off, h) AS nth FROM sides x
  WHERE NOT EXISTS (SELECT 1 FROM sides y WHERE y.side <> x.side AND y.archive = x.archive AND y.off = x.off AND y.len = x.len AND y.copies = x.copies AND y.h = x.h)),
bad AS (
  SELECT coalesce(x.archive, y.archive) AS archive, coalesce(x.off, y.off) AS off, coalesce(x.key, y.key) AS key,
    CASE WHEN y.h IS NULL THEN 'missing' WHEN x.h IS NULL THEN 'extra' WHEN x.len = y.len AND x.copies = y.copies AND x.h = y.h THEN 'moved' ELSE 'changed' END AS kind
  FROM (FROM odd WHERE side = 'a') x FULL JOIN (FROM odd WHERE side = 'b') y ON y.archive = x.archive AND y.key IS NOT DISTINCT FROM x.key AND y.nth = x.nth),
named AS (SELECT archive, off, kind, kind || ':' || coalesce(CAST(key AS VARCHAR), '') || ':' || off AS name FROM bad)
SELECT s.archive, CAST(s.n_records AS BIGINT) AS n_records, s.n_bytes, a.hash AS root_ours, b.hash AS root_theirs,
  coalesce(d.n, 0) AS n_damaged, coalesce(d.moved, 0) AS n_moved, coalesce(d.names, '') AS damaged
FROM (SELECT archive, sum(copies) AS n_records, CAST(sum(len * copies) AS BIGINT) AS n_bytes FROM laid GROUP BY archive) s
JOIN l3 a ON a.side = 'a' AND a.archive = s.archive
LEFT JOIN l3 b ON b.side = 'b' AND b.archive = s.archive
LEFT JOIN (
  SELECT archive, count(*) FILTER (WHERE kind <> 'moved') AS n, count(*) FILTER (WHERE kind = 'moved') AS moved,
    string_agg(name, ',' ORDER BY off, name) FILTER (WHERE kind <> 'moved') AS names
  FROM named GROUP BY archive) d ON d.archive = s.archive"""


def op5() -> str:
    words = _DOCS.replace("docs AS", "items AS").replace("doc_id", "item_id").replace("documents", "benchmark")
    return f"""
WITH {_DOCS}, {words},
grams AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS gram FROM (
    SELECT item_id, unnest([w[i:i + least(len(w), 10) - 1] FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT a.r, a.i, a.n, g.item_id FROM places a JOIN grams g USING (n, gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


def op7() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    told = [*[(p, label, 2, 1.0, "true") for p, label in PHRASES.items()], *[(t, label, 4, 0.6, "false") for label, t in TEXTS.items()]]
    rows = ", ".join(f"({n}, {quoted(label)}, {quoted(t)}, {k}, {share}, {base})" for n, (t, label, k, share, base) in enumerate(told))
    cut = rf"regexp_extract_all({_LOW.format('body')}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return f"""
WITH {_DOCS},
told(t, label, body, k, share, base) AS (VALUES {rows}),
about AS (SELECT t, label, k, share, base, {cut} AS tw FROM told),
known AS (SELECT t, k, i - 1 AS t_at, array_to_string(tw[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(tw) - k + 2)) AS i FROM about)),
places AS (
  SELECT r, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM about) WHERE len(w) >= k)),
votes AS (SELECT r, t, p, t_at, p - t_at AS d FROM places JOIN known USING (k, gram)),
gaps AS (
  SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d, p) <= CASE WHEN base THEN 0 ELSE 4 END THEN 0 ELSE 1 END AS new_band
  FROM votes JOIN about USING (t)),
bands AS (SELECT *, sum(new_band) OVER (PARTITION BY r, t ORDER BY d, p ROWS UNBOUNDED PRECEDING) AS band FROM gaps),
breaks AS (
  SELECT *, CASE WHEN p - max(p) OVER (PARTITION BY r, t, band ORDER BY p, t_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 4 + k THEN 0 ELSE 1 END AS new_run FROM bands),
runs AS (SELECT *, sum(new_run) OVER (PARTITION BY r, t, band ORDER BY p, t_at ROWS UNBOUNDED PRECEDING) AS run FROM breaks),
seen AS (
  SELECT *, max(t_at) OVER (PARTITION BY r, t, band, run ORDER BY p, t_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM runs),
spans AS (
  SELECT r, label, base, min(p) AS a, CAST(count(*) FILTER (WHERE far IS NULL OR t_at > far) AS DOUBLE) / (any_value(len(tw)) - any_value(k) + 1) AS score, any_value(share) AS share
  FROM seen GROUP BY r, t, label, base, band, run),
held AS (SELECT * FROM spans WHERE score >= share)
SELECT doc_id, len(any_value(w)) AS n_words, count(*) FILTER (WHERE base) AS n_base,
  CAST(min(a) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(a) FILTER (WHERE base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM docs LEFT JOIN held USING (r) GROUP BY r, doc_id"""


def op9(rules: Sequence[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {values}),
cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (
  SELECT r, max_by(h || p, len(string_split(h, '.')) * 1000000 + length(p)) AS rule, max_by(verdict, len(string_split(h, '.')) * 1000000 + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)"""


def op12() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH RECURSIVE cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN [array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END)) AS s FROM cut),
kinds AS (SELECT s, row_number() OVER () AS c, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT c, n, unnest(s) AS item FROM kinds),
links AS (
  SELECT x.c AS a, y.c AS b FROM items x JOIN items y ON x.item = y.item AND x.c <> y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM kinds UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS c, min(least) AS component_id FROM reach JOIN kinds ON kinds.c = reach.b GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM (SELECT sets.doc_id, sets.s, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS component_id
  FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN named ON named.c = kinds.c)"""


def op13() -> str:
    blank, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    draws = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    piece = lambda a, b: f"array_to_string(t[{a}:{b}], '')"
    return rf"""
WITH cut AS (
  SELECT doc_id, body, h, regexp_extract_all(body, '{blank}*{other}+|{blank}+') AS t
  FROM (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)),
drawn AS (SELECT doc_id, body, t, CAST(len(t) AS BIGINT) AS n, {draws} FROM cut),
dealt AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (SELECT doc_id, body, n, form, {piece(1, "a")} AS p, {piece("a + 1", "b")} AS m, {piece("b + 1", "n")} AS s FROM dealt)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM pieces"""
