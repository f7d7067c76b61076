"""DuckDB SQL for the operators that SQL can express: substring dedup (2), decontamination (4),
secret scans (6), quality rules (7), URL filters (9, with 100 rounds of the link graph) and lexical search (12). Patterns
and thresholds are written out again here. Token ids (1, 5, 8), XXH64 (10) and a trained model (3)
can't be expressed; their queries are tested against plain Python."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op2_substring_dedup"] = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
own AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN own USING (h) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (
  SELECT word.doc_id, count(gone.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op4_decontaminate"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_NORMAL}') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_NORMAL}') AS words
  FROM benchmark),
p AS (
  SELECT DISTINCT id, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT id, words, least(13, len(words)) AS n, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
hit AS (SELECT doc_id, i, dw.n, id FROM dw JOIN p ON p.win = dw.win AND p.n = dw.n),
pos AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id"""

#: kind, pattern, group whose length counts, its least length
_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}", 0, 0),
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s\x0b/:@]+:[^\s\x0b/@]{3,}@", 0, 0),
)


def _spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Where a kind's matches are: the pieces between them and the matches, added up."""
    return f"""
  SELECT doc_id, {k} AS k, '{kind}' AS kind, first AS s, first + length(m) AS e
  FROM (SELECT doc_id, m, v, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(pieces[1 : len(ms)]) AS piece, generate_subscripts(ms, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs,
                           string_split_regex(text, '{pattern}') AS pieces
                    FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{pattern}')))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE length(v) >= {least}"""


SQL["op6_secrets"] = "WITH span AS (" + " UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_KINDS)) + f"""),
agg AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans
  FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN agg ON agg.doc_id = d.doc_id"""

_NAV = ("home menu login logout sign register search about contact help faq sitemap next previous prev back top share tweet subscribe "
        "newsletter archive categories tags rss privacy terms cookies skip").split()
_BOILER = ("all rights reserved|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|"
           "javascript is (?:disabled|required)|subscribe to our newsletter|click here|powered by|lorem ipsum|copyright (?:©|\\(c\\))|"
           "released under the .{0,40}licen[cs]e")
_BLANK = r"[\x20\x09-\x0D]"


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQL["op7_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
line AS (
  SELECT doc_id, ln, line, regexp_extract_all(line, '{WORD}') AS words, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d)),
judged AS (
  SELECT doc_id, again, chars,
         again > 1 OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > CAST(0.1 AS DOUBLE) * chars
         OR regexp_matches(line, '(?i){_BOILER}')
         OR len(words) <= 12 AND (len(list_filter(words, lambda x: x IN ('|', '>', '»', '›', '·', '•', '/', '-'))) >= 2
              OR len(list_filter(words, lambda x: lower(trim(x, '.,:;|>»')) NOT IN ({_in(_NAV)}))) = 0)
         OR len(words) >= 5 AND NOT regexp_matches(line, '[.!?:;…。！？؟।]') AS fails
  FROM (SELECT *, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars FROM line WHERE len(words) > 0)),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again > 1) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_removed_lines,
         coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id),
gram AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS spot FROM gram WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
         CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= CAST(0.5 AS DOUBLE) * word_chars AS kept
FROM base"""


#: of the link graph; the operator goes on until nothing changes
ROUNDS = 100


def _rank(name: str, seed: str, src: str, dst: str) -> str:
    """Personalised PageRank by rounds; ``src`` passes its score on to ``dst`` by the links' counts."""
    return f"""
{name}_edge AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM links),
{name}_round AS (
  SELECT 0 AS k, host, 0.15 * {seed} AS score FROM seeds WHERE {seed} > 0
  UNION ALL
  SELECT k + 1, host, sum(score)
  FROM (SELECT k, dst AS host, 0.85 * score * share AS score FROM {name}_round JOIN {name}_edge ON src = host
        UNION ALL SELECT k, seeds.host, 0.15 * {seed} FROM (SELECT DISTINCT k FROM {name}_round), seeds WHERE {seed} > 0)
  WHERE k < {ROUNDS} GROUP BY k, host),
{name} AS (SELECT host, score AS {name} FROM {name}_round WHERE k = {ROUNDS})"""


SQL["op9_url_filters"] = f"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host) + length(r.path)) AS f
  FROM cut JOIN rules r ON (cut.host = r.host OR ends_with(cut.host, '.' || r.host)) AND starts_with(cut.path, r.path) GROUP BY page_id),
ruled AS (SELECT cut.page_id, host, path, f.rule AS rule, f.verdict AS verdict FROM cut LEFT JOIN fit ON fit.page_id = cut.page_id),
seeds AS (
  SELECT host, CAST(count(*) FILTER (WHERE verdict = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (WHERE verdict = 'block') AS DOUBLE) AS distrust
  FROM ruled WHERE verdict IS NOT NULL GROUP BY host),
links AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT DISTINCT page_id, host AS src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst
        FROM (SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM cut))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
{_rank('good', 'trust', 'src', 'dst')},
{_rank('bad', 'distrust', 'dst', 'src')},
sizes AS (SELECT host, count(*) AS n_pages FROM ruled GROUP BY host),
blocked AS (
  SELECT bad.host FROM bad LEFT JOIN good ON good.host = bad.host LEFT JOIN sizes ON sizes.host = bad.host
  WHERE bad > 0.75 * (bad + coalesce(good, 0.0) + CAST(1e-6 AS DOUBLE) * coalesce(n_pages, 0)))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL["op12_lexical_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS words FROM documents),
total AS (SELECT count(*) AS big_n, CAST(sum(len(words)) AS BIGINT) AS big_l FROM d WHERE len(words) > 0),
norm AS (SELECT r, doc_id, 100 - 25 + (25 * len(words) * big_n) // big_l AS m FROM d, total WHERE len(words) > 0),
post AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY r, word),
weight AS (
  SELECT word, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT word, count(*) AS df FROM post GROUP BY word), total),
ask AS (
  SELECT k, item_id, word, count(*) AS times
  FROM (SELECT k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS word
        FROM (SELECT row_number() OVER () AS k, item_id, text FROM benchmark))
  GROUP BY k, item_id, word),
hit AS (
  SELECT k, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM ask JOIN weight USING (word) JOIN post USING (word) JOIN norm USING (r) GROUP BY k, item_id, doc_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM hit WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
