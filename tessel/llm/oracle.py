"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: Counts of op3 for every row of a relation `src` with doc_id, text and source.
QUALITY_COUNTS = r"""
base AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM src),
parts AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
windows AS (SELECT k, p, array_to_string(w[p : p + 7], ' ') AS s
            FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS p FROM parts WHERE len(w) >= 8)),
twice AS (SELECT k, p FROM windows QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
covered AS (SELECT k, sum(least(8, coalesce(nxt - p, 8))) AS n
            FROM (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS nxt FROM twice) GROUP BY k),
counts AS (SELECT parts.k, doc_id, lower(regexp_extract(coalesce(source, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)) AS host,
                  len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
           FROM parts LEFT JOIN covered ON parts.k = covered.k),
ruled AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                 n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 10 * n_words AS failed FROM counts),
hosts AS (SELECT host, count(*) AS n, sum(failed::INT) AS f, sum(failed::INT) / count(*) AS r FROM ruled GROUP BY host),
moments AS (SELECT avg(r) AS m, avg(r) * (1 - avg(r)) AS within, var_pop(r) - avg(r) * (1 - avg(r)) * avg(1 / n) AS between FROM hosts),
prior AS (SELECT m, CASE WHEN between > 0 THEN least(greatest(within / between - 1, 2), 10000) ELSE 10000 END AS s FROM moments),
strict AS (SELECT host, (f + m * s) / (n + s) > 0.5 AS host_strict FROM hosts, prior),
verdicts AS (SELECT ruled.*, host_strict, NOT base_failed AND NOT (host_strict AND failed) AS kept FROM ruled JOIN strict USING (host))
"""

QUALITY = f"""
WITH src AS (SELECT doc_id, text, source FROM documents),
{QUALITY_COUNTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_strict FROM verdicts
"""

DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p : p + 12], ' ') AS s
            FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT k, p, windows.n, item FROM windows JOIN phrases ON windows.n = phrases.n AND windows.s = phrases.s),
spans AS (SELECT k, p, max(n) AS n FROM hits GROUP BY k, p),
reach AS (SELECT k, p, p + n AS e, max(p + n) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
hit AS (SELECT k, sum(greatest(0, e - greatest(p, coalesce(before, p)))) AS n FROM reach GROUP BY k),
named AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.k = hit.k LEFT JOIN named ON d.k = named.k
"""

SQL = {"op3_quality_rules": QUALITY, "op8_decontamination": DECONTAMINATION}
