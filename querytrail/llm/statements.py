"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE, LEAST_WORDS, LOST_SHARE, NAV_SEPARATOR, SENTENCE_END
from .redirects import RULES

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


QUALITY = rf"""
    WITH lines AS (
        SELECT doc_id, i, text_lines[i] AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS text_lines,
                     unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
              FROM documents)),
    parts AS (
        SELECT doc_id, i, line, regexp_extract_all(line, '{WORD}') AS w,
               len(regexp_extract_all(line, '{SYMBOL}')) AS symbols
        FROM lines),
    judged AS (
        SELECT *, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars,
               len(w) > 0 AND (
                   len(regexp_extract_all(line, '{NAV_SEPARATOR.pattern}')) >= 3
                   OR symbols > 0.1 * list_sum(list_transform(w, lambda x: length(x)))
                   OR len(list_filter(w, lambda x: contains(x, '!!'))) > 0.3 * len(w)
                   OR len(w) < 3 AND NOT regexp_matches(rtrim(line), '{_quoted(SENTENCE_END.pattern)}')
                   OR regexp_matches(trim(line), '{_quoted(BOILERPLATE.pattern)}')) AS failed,
               row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
        FROM parts),
    by_line AS (
        SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars,
               CAST(sum(symbols) AS BIGINT) AS n_symbols,
               count(*) FILTER (WHERE len(w) > 0 AND again) AS n_dup_lines,
               count(*) FILTER (WHERE failed) AS n_failed_lines,
               CAST(coalesce(sum(chars) FILTER (WHERE failed), 0) AS BIGINT) AS lost_chars
        FROM judged GROUP BY doc_id),
    words AS (
        SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, len(w) AS n
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
                    FROM documents))),
    windows AS (
        SELECT doc_id, i, i <= n - 2 AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice
        FROM words),
    covered AS (
        SELECT doc_id, count(*) FILTER (WHERE inside) AS n_repeat_words
        FROM (SELECT doc_id, bool_or(twice) OVER (
                  PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside
              FROM windows)
        GROUP BY doc_id)
    SELECT *, NOT base_failed AND lost_chars <= {LOST_SHARE} * word_chars AS kept
    FROM (SELECT l.doc_id, n_words, word_chars, n_symbols, n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words,
                 n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words
                     AS base_failed, n_failed_lines, lost_chars
          FROM by_line l LEFT JOIN covered c ON c.doc_id = l.doc_id)"""

JOIN = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'),
                                   lambda x: x <> '') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) >= 5
                 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    near AS (
        SELECT h.a, h.b FROM shared h JOIN sizes p ON p.doc_id = h.a JOIN sizes q ON q.doc_id = h.b
        WHERE 10 * h.n >= 8 * (p.n + q.n - h.n)),
    reached AS (
        SELECT doc_id AS node, doc_id AS root FROM documents
        UNION
        SELECT n.b, r.root FROM reached r JOIN near n ON n.a = r.node)
    SELECT r.node AS doc_id, min(r.root) AS class_id,
           (SELECT count(*) FROM near n WHERE n.a = r.node) AS n_links
    FROM reached r GROUP BY r.node"""

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)


def _url_parts(source: str, url: str) -> str:
    """The rows of ``source`` with host, path and node of a url."""
    return rf"""
        SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
                       || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) END AS node
        FROM (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
              FROM (SELECT *, CASE WHEN contains({url}, '://')
                                   THEN substr({url}, instr({url}, '://') + 3) ELSE '' END AS rest
                    FROM {source}))"""


def _ruled(source: str, key: str) -> str:
    """Per key the longest rule that fits host and path."""
    return f"""
        SELECT {key}, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM (SELECT s.{key}, r.verdict, r.host || r.path AS rule
              FROM {source} s JOIN rules r
                ON (s.host = r.host OR ends_with(s.host, '.' || r.host))
               AND starts_with(s.path, r.path))
        GROUP BY {key}"""


URLS = rf"""
    WITH RECURSIVE rules(verdict, host, path) AS (VALUES {_RULES}),
    parts AS ({_url_parts('pages', 'url')}),
    tags AS (
        SELECT url, host, path, node,
               unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
        FROM parts),
    links AS (
        SELECT url, host, path, node,
               CASE WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b')
                    THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                    WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b')
                    THEN regexp_extract(tag,
                        '(?is)\bcontent\s*=\s*[^>]*?\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS link
        FROM tags),
    targets AS (
        SELECT node AS a, CASE
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
            WHEN starts_with(link, '//') THEN 'http:' || link
            WHEN starts_with(link, '/') THEN 'http://' || host || link
            WHEN regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL
            ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/'
                 ELSE regexp_replace(path, '[^/]*$', '') END || link END AS goal
        FROM links WHERE link <> ''),
    edges AS (
        SELECT a, node AS b FROM ({_url_parts('targets', 'goal')})
        WHERE a IS NOT NULL AND node IS NOT NULL),
    ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reached AS (
        SELECT a AS node, a AS other FROM ways
        UNION
        SELECT r.node, w.b FROM reached r JOIN ways w ON w.a = r.other),
    urls AS (SELECT DISTINCT other AS node, 'http://' || other AS whole FROM reached),
    known AS ({_url_parts('(SELECT whole FROM urls)', 'whole')}),
    verdicts AS ({_ruled('known', 'node')}),
    aliases AS (
        SELECT r.node, min(v.verdict) AS verdict
        FROM reached r JOIN verdicts v ON v.node = r.other GROUP BY r.node),
    own AS ({_ruled('parts', 'page_id')})
    SELECT p.page_id, p.host, p.path, o.rule,
           coalesce(o.verdict, a.verdict, 'allow') AS verdict,
           CASE WHEN o.verdict IS NOT NULL THEN 'rule' WHEN a.verdict IS NOT NULL THEN 'alias'
                ELSE 'default' END AS decided_by
    FROM parts p LEFT JOIN own o ON o.page_id = p.page_id LEFT JOIN aliases a ON a.node = p.node"""


_CHARS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31), 1)"
                   for s in (15, 10, 5, 0))
WARC = f"""
    WITH payloads AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha1(coalesce(html, '')) AS hex
        FROM pages),
    digests AS (
        SELECT *, array_to_string(list_transform(list_transform(
                   range(0, 8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)),
                   lambda v: concat({_CHARS})), '') AS payload_digest,
               max(page_id) OVER (PARTITION BY hex) AS best
        FROM payloads)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < best THEN best END AS refers_to
    FROM digests"""


def _field(value: str) -> str:
    return (f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || "
            f"{value} END")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(text, '{_UPPER}', '{_LOWER}')"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# One step per bit: a byte enters with the first of its eight.
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384)
                      ELSE xor(a, x) >> 1 END))"""
MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, sha256({_LEAF} || {_field('text')}) AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 5 = 0
                    THEN sha256({_LEAF} || {_field(_FOLDED)}) END AS tampered
        FROM documents),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n
        FROM leaves),
    levels AS (
        SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
        UNION ALL
        SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)),
               (any_value(n) + 15) // 16
        FROM levels WHERE n > 1 GROUP BY tree, level, pos // 16),
    tops AS (
        SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM levels WHERE n = 1
        UNION ALL
        SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)),
               (any_value(n) + 15) // 16
        FROM tops WHERE n > 1 GROUP BY level, pos // 16),
    nodes AS (
        SELECT tree, level, pos, digest FROM levels WHERE n > 1
        UNION ALL
        SELECT -1, level, pos, digest FROM tops WHERE n > 1),
    siblings AS (
        SELECT a.tree, a.level, a.pos,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS prior,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS later
        FROM nodes a JOIN nodes b
          ON b.tree = a.tree AND b.level = a.level AND b.pos // 16 = a.pos // 16
        GROUP BY a.tree, a.level, a.pos),
    climb AS (
        SELECT tree AS home, pos AS leaf_at, tree, 0 AS level, pos,
               coalesce(tampered, leaf) AS folded, '' AS proof
        FROM placed
        UNION ALL
        SELECT c.home, c.leaf_at, CASE WHEN s.tree IS NULL THEN -1 ELSE c.tree END,
               CASE WHEN s.tree IS NULL THEN 0 ELSE c.level + 1 END,
               CASE WHEN s.tree IS NULL THEN c.home ELSE c.pos // 16 END,
               CASE WHEN s.tree IS NULL THEN c.folded
                    ELSE sha256(s.prior || c.folded || s.later) END,
               c.proof || coalesce(s.prior || s.later, '')
        FROM climb c LEFT JOIN siblings s
          ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos
        WHERE s.tree IS NOT NULL OR c.tree <> -1)
    SELECT p.doc_id, p.leaf, l.digest AS subroot, r.digest AS root,
           sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.digest AS verified
    FROM placed p JOIN levels l ON l.tree = p.tree AND l.n = 1
    JOIN tops r ON r.n = 1
    JOIN climb c ON c.home = p.tree AND c.leaf_at = p.pos AND c.tree = -1 AND c.level = r.level"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '{TERM}')) AS term FROM documents),
    lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts, totals GROUP BY term),
    wants AS (
        SELECT item_id, term, count(*) AS times
        FROM (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, '{TERM}')) AS term FROM benchmark)
        GROUP BY item_id, term),
    scores AS (
        SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
                   // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
        FROM wants JOIN counts USING (term) JOIN weights USING (term)
        JOIN lengths USING (doc_id), totals
        GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (
               PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
    QUALIFY rank <= 10"""

STATEMENTS = {
    "op6_bayes_jaccard_join": JOIN,
    "op7_line_first_quality": QUALITY,
    "op8_redirect_equivalence": URLS,
    "op10_seekable_warc": WARC,
    "op11_merkle_climb": MERKLE,
    "op12_nra_search": SEARCH,
}
