"""SQL for the answers of the corpus queries that SQL can express, written apart from them."""

from __future__ import annotations

OP6_LINE_DEDUP = r"""
WITH pages AS (
    SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
page_lines AS (
    SELECT DISTINCT doc_id, source, line
    FROM (SELECT doc_id, source, unnest(lines) AS line FROM pages)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
common AS (
    SELECT c.source, c.line
    FROM (SELECT source, line, count(*) AS n FROM page_lines GROUP BY source, line) c
    JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
    WHERE c.n >= 5 AND c.n / t.pages >= 0.1
),
marks AS (
    SELECT p.doc_id, list(p.line) AS gone
    FROM page_lines p JOIN common c ON p.line = c.line AND p.source IS NOT DISTINCT FROM c.source
    GROUP BY p.doc_id
),
cut AS (
    SELECT p.doc_id, p.text, p.lines,
           [x FOR x IN p.lines IF NOT list_contains(coalesce(m.gone, []), x)] AS kept
    FROM pages p LEFT JOIN marks m ON p.doc_id = m.doc_id
)
SELECT doc_id,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       len(lines) - len(kept) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
"""

OP7_QUALITY_RULES = r"""
WITH split AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
    FROM documents
),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS spot FROM split),
windows AS (
    SELECT doc_id, spot, [word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w,
                        lead(word, 4) OVER w] AS gram
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
),
counted AS (
    SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows WHERE gram[5] IS NOT NULL
),
repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(spot, spot + 5)) AS place FROM counted WHERE n > 1) GROUP BY doc_id
),
measured AS (
    SELECT s.doc_id, lang, source, len(words) AS n_words,
           coalesce(list_sum([length(w) FOR w IN words]), 0)::BIGINT AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
),
based AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
),
ratios AS (
    SELECT doc_id, lang, source, base_failed, unnest([
        {'rule': 'symbol', 'least': 0.08::DOUBLE, 'high': 0.16::DOUBLE,
         'value': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END},
        {'rule': 'line', 'least': 0.3::DOUBLE, 'high': 0.6::DOUBLE,
         'value': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END},
        {'rule': 'length', 'least': 18::DOUBLE, 'high': 1e308::DOUBLE,
         'value': CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END}
    ]) AS r
    FROM based
),
buckets AS (
    SELECT lang, source, r.rule AS rule, ceil(8 * log2(greatest(r.value, 1 / 1024)) - 1e-9) AS bucket
    FROM ratios WHERE NOT base_failed
),
edges AS (
    SELECT DISTINCT lang, source, rule,
           quantile_disc(bucket, 0.75) OVER own AS own_edge, count(*) OVER own AS own_n,
           quantile_disc(bucket, 0.75) OVER tongue AS lang_edge, count(*) OVER tongue AS lang_n,
           quantile_disc(bucket, 0.75) OVER every AS all_edge
    FROM buckets
    WINDOW own AS (PARTITION BY lang, source, rule), tongue AS (PARTITION BY lang, rule),
           every AS (PARTITION BY rule)
),
verdicts AS (
    SELECT r.doc_id, bool_and(coalesce(
        r.r.value <= greatest(r.r.least, least(r.r.high, 4 * pow(2, CASE WHEN own_n >= 50 THEN own_edge
            WHEN lang_n >= 50 THEN lang_edge ELSE all_edge END / 8))), false)) AS inside
    FROM ratios r LEFT JOIN edges e ON r.lang IS NOT DISTINCT FROM e.lang
         AND r.source IS NOT DISTINCT FROM e.source AND r.r.rule = e.rule
    GROUP BY r.doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND inside AS kept
FROM based b JOIN verdicts v ON b.doc_id = v.doc_id
"""

OP13_URL_FILTERS = r"""
WITH split AS (
    SELECT row_number() OVER () AS rk, page_id, lower(coalesce(url, '')) AS low,
           translate(coalesce(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
sites(rule_host, rule_path, site_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
           ('org', '/fr/', 'allow')
),
fits AS (
    SELECT rk, rule, site_verdict FROM (
        SELECT rk, rule_host || rule_path AS rule, site_verdict,
               row_number() OVER (PARTITION BY rk ORDER BY length(rule_host || rule_path) DESC,
                                  rule_host || rule_path DESC) AS place
        FROM split JOIN sites
             ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ) WHERE place = 1
),
patterns(id, verdict, pattern, regex) AS (
    VALUES (0, 'block', '||spam-farm.*', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.'),
           (1, 'block', '||cheap-pills^', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?cheap-pills([^a-z0-9_.%-]|$)'),
           (2, 'block', 'adult-x.', 'adult-x\.'),
           (3, 'block', '/ads/*', '/ads/'),
           (4, 'block', '^banner^', '([^a-z0-9_.%-]|$)banner([^a-z0-9_.%-]|$)'),
           (5, 'block', '*utm_source=feed', 'utm_source=feed'),
           (6, 'block', '|http://*/go.php?*', '^http://(?s).*/go\.php\?'),
           (7, 'allow', '||help.*/faq^', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?help\.(?s).*/faq([^a-z0-9_.%-]|$)'),
           (8, 'block', '*.exe|', '\.exe$')
),
hits AS (
    SELECT rk, min(id) FILTER (WHERE verdict = 'allow') AS allow_id, min(id) AS any_id
    FROM split JOIN patterns ON regexp_matches(low, regex)
    GROUP BY rk
)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.site_verdict, p.verdict, 'allow') AS verdict,
       CASE WHEN f.rule IS NULL THEN p.pattern END AS pattern
FROM split s LEFT JOIN fits f ON s.rk = f.rk
     LEFT JOIN hits h ON s.rk = h.rk
     LEFT JOIN patterns p ON p.id = coalesce(h.allow_id, h.any_id)
"""

OP11_HARD_NEGATIVES = r"""
WITH clean AS (
    SELECT DISTINCT vec_id::BIGINT AS vec_id,
           (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
           coalesce(list_sum([a.q[i] * r.q[i] FOR i IN range(1, least(len(a.q), len(r.q)) + 1)]), 0)::BIGINT AS score,
           (a.vec_id = r.vec_id AND a.q = r.q AND a.label = r.label) AS own
    FROM clean a, clean r
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT * FROM (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
        FROM scores WHERE label = anchor_label AND NOT own
    ) WHERE place <= 5
),
windows AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
         AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM windows WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op11_hard_negatives": OP11_HARD_NEGATIVES,
    "op6_line_dedup": OP6_LINE_DEDUP, "op7_quality_rules": OP7_QUALITY_RULES, "op13_url_filters": OP13_URL_FILTERS,
}
