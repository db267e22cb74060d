"""SQL that DuckDB runs on the same tables, for the operators that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op9_exact_dedup": r"""
        WITH keyed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM keyed
    """,
    "op4_phrase_index": r"""
        WITH doc AS (
            SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), item AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS width,
                   array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
            FROM item, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS u(i)
            WHERE len(w) > 0
        ), place AS (
            SELECT r, i, width, array_to_string(w[i : i + width - 1], ' ') AS phrase
            FROM doc, (SELECT DISTINCT width FROM win) AS widths, unnest(range(1, len(w) - width + 2)) AS u(i)
        ), hit AS (
            SELECT r, i, place.width AS width, item_id FROM place JOIN win
            ON place.phrase = win.phrase AND place.width = win.width
        ), words AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM hit, unnest(range(i, i + width)) AS u(p) GROUP BY r
        ), items AS (
            SELECT r, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names
            FROM hit GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
    """,
    "op11_host_rules": r"""
        WITH doc AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(source, '') AS host, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), tri AS (
            SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase
            FROM doc, unnest(range(1, len(w) - 1)) AS u(i)
        ), twice AS (
            SELECT r, phrase FROM tri GROUP BY r, phrase HAVING count(*) > 1
        ), rep AS (
            SELECT r, count(DISTINCT i + k) AS n
            FROM tri JOIN twice USING (r, phrase), unnest([0, 1, 2]) AS u(k) GROUP BY r
        ), line AS (
            SELECT r, count(*) AS n, count(DISTINCT line) AS n_distinct
            FROM doc, unnest(string_split(text, chr(10))) AS u(line)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), counted AS (
            SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                   coalesce(line.n, 0) AS n_lines, coalesce(line.n, 0) - coalesce(line.n_distinct, 0) AS n_dup_lines,
                   coalesce(rep.n, 0) AS n_repeat_words
            FROM doc LEFT JOIN line USING (r) LEFT JOIN rep USING (r)
        ), failed AS (
            SELECT counted.*, rule.name AS rule, CASE rule.name
                WHEN 'repeats' THEN 100 * n_repeat_words > 50 * n_words
                WHEN 'symbols' THEN 10 * n_symbols > n_words
                WHEN 'word_length' THEN word_chars < 3 * n_words OR word_chars > 12 * n_words
                ELSE 2 * n_dup_lines > n_lines END AS hit
            FROM counted, (VALUES ('repeats'), ('symbols'), ('word_length'), ('dup_lines')) AS rule(name)
        ), host AS (
            SELECT rule, host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(hit AS INT)) AS DOUBLE) AS f
            FROM failed GROUP BY rule, host
        ), moments AS (
            SELECT rule, count(*) AS k, sum(n) AS t, sum(n * n) AS nn, sum(f) AS f, sum(f * f / n) AS ff,
                   sum(f) / sum(n) AS m, sum(f) / sum(n) * (1 - sum(f) / sum(n)) AS w
            FROM host GROUP BY rule
        ), prior AS (
            SELECT rule, m, CASE WHEN k < 2 OR f <= 0 OR f >= t THEN NULL
                WHEN t - nn / t - (k - 1) <= 0 THEN 1e-6
                ELSE least(1.0, greatest(1e-6, (ff - f * f / t - (k - 1) * w) / ((t - nn / t - (k - 1)) * w))) END AS rho
            FROM moments
        ), rate AS (
            SELECT rule, host, (f + coalesce(m * (1 - rho) / rho, 0)) / (n + coalesce((1 - rho) / rho, 0)) AS rate
            FROM host JOIN prior USING (rule)
        ), verdict AS (
            SELECT host, max(rate) >= 0.5 AS rejected FROM rate GROUP BY host
        ), suspect AS (
            SELECT rule, host FROM rate WHERE rate >= 0.01
        ), judged AS (
            SELECT counted.*, rejected, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',',
                   CASE WHEN 100 * n_repeat_words > 50 * n_words AND host IN (SELECT host FROM suspect WHERE rule = 'repeats') THEN 'repeats' END,
                   CASE WHEN 10 * n_symbols > n_words AND host IN (SELECT host FROM suspect WHERE rule = 'symbols') THEN 'symbols' END,
                   CASE WHEN (word_chars < 3 * n_words OR word_chars > 12 * n_words)
                       AND host IN (SELECT host FROM suspect WHERE rule = 'word_length') THEN 'word_length' END,
                   CASE WHEN 2 * n_dup_lines > n_lines AND host IN (SELECT host FROM suspect WHERE rule = 'dup_lines') THEN 'dup_lines' END
               ) AS suspect_rules
            FROM counted JOIN verdict USING (host)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
               rejected AS host_rejected, suspect_rules,
               NOT base_failed AND NOT rejected AND suspect_rules = '' AS kept
        FROM judged
    """,
    "op12_divergence": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), token AS (
            SELECT r, lang, source, w[i] AS term FROM doc, unnest(range(1, len(w) + 1)) AS u(i)
        ), own AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM token GROUP BY lang, source, term
        ), kept AS (
            SELECT lang, term, sum(n) AS n FROM own GROUP BY lang, term HAVING sum(docs) >= 3
        ), size AS (
            SELECT lang, count(*) AS v, sum(n) AS t FROM kept GROUP BY lang
        ), grp AS (
            SELECT lang, source, coalesce(sum(n), 0) AS t
            FROM (SELECT DISTINCT lang, source FROM doc) AS g
            LEFT JOIN (SELECT own.* FROM own JOIN kept USING (lang, term)) AS o USING (lang, source)
            GROUP BY lang, source
        ), cell AS (
            SELECT grp.lang AS lang, grp.source AS source, kept.term AS term, coalesce(own.n, 0) AS n,
                   CAST(1 + (1000000000 * (CAST(coalesce(own.n, 0) AS HUGEINT) + 1)) // (grp.t + size.v) AS BIGINT) AS p,
                   CAST(1 + (1000000000 * (CAST(kept.n AS HUGEINT) + 1)) // (size.t + size.v) AS BIGINT) AS q
            FROM grp JOIN size ON grp.lang = size.lang JOIN kept ON grp.lang = kept.lang
            LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source AND own.term = kept.term
        ), pair AS (
            SELECT a.lang AS lang, a.source AS source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
            FROM cell AS a JOIN cell AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), pairs AS (
            SELECT a.lang AS lang, a.source AS source, b.source AS item, coalesce(value, 0) AS value
            FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
        ), both_parts AS (
            SELECT lang, source, 'pair' AS part, item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
            UNION ALL
            SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
            FROM cell WHERE n > 0 AND p > q
        )
        SELECT * FROM both_parts WHERE part = 'pair' OR rank <= 200
    """,
}
