"""SQL that the registered queries must equal, for those that SQL can express."""

from __future__ import annotations

MIXTURE = r"""
WITH sized AS (
    SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR) || '/mix') AS key,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS words,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sized GROUP BY source
), levels AS (  -- sources by the level at which they close; those ahead are closed
    SELECT *, coalesce(sum(3 * words) OVER ahead, 0) AS closed,
           sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0) AS open_weight,
           sum(words) OVER () AS total
    FROM sources
    WINDOW ahead AS (ORDER BY 3.0 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (  -- the first source that stays open sets the level
    SELECT coalesce(arg_min(level, nth) FILTER (level * weight <= 3 * words), 0) AS level
    FROM (SELECT weight, words, row_number() OVER (ORDER BY 3.0 * words / weight, source) AS nth,
                 CAST(total - closed AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level
          FROM levels)
), targets AS (
    SELECT source, words, least(CAST(3 * words AS DOUBLE), level * weight) AS target
    FROM sources, level
), ordered AS (
    SELECT s.doc_id, s.size, t.words, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
       CAST(CASE WHEN words = 0 THEN 0
                 ELSE size * (budget // words)
                      + greatest(0, least(size, budget % words - ahead)) END AS BIGINT) AS taken
FROM ordered
"""

EXACT_DEDUP = r"""
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM n WINDOW same AS (PARTITION BY text)
"""

REPEATS = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
    SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT doc_id, list(DISTINCT k) AS ks
    FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k
          FROM windows JOIN firsts USING (win) WHERE doc_id > first_id)
    GROUP BY doc_id
), kept AS (
    SELECT d.doc_id, d.w, coalesce(len(ks), 0) AS n_removed,
           list_filter(d.w, lambda x, k: ks IS NULL OR NOT list_contains(ks, k)) AS kept
    FROM words d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256
FROM kept
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixture": MIXTURE,
    "op7_exact_dedup": EXACT_DEDUP,
    "op8_repeats": REPEATS,
}
