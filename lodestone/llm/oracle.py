"""SQL for the queries of this subpackage that SQL can express over whole tables."""

TOPK = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_dot_product(q.v, c.v) AS BIGINT)) AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(p.h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM p JOIN f ON p.h = f.h"""

_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT win.r, i FROM win JOIN (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1) g ON g.r = win.r AND g.s = win.s),
cov AS (SELECT r, count(DISTINCT j) AS c FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
"""

RULES = _RULES + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits % 32 = 0 AS kept_v2, fail_bits FROM b"""

ABLATIONS = _RULES + """, p(policy, mask) AS (VALUES ('base', 3), ('v1', 63), ('v2', 31)), q(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbol_share', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32))
SELECT policy, rule, CAST(count(CASE WHEN fail_bits & bit <> 0 THEN 1 END) AS BIGINT) AS failed, CAST(count(CASE WHEN fail_bits & mask = bit THEN 1 END) AS BIGINT) AS failed_alone FROM p JOIN q ON mask & bit <> 0, b GROUP BY policy, rule"""

SQL = {"op1_threshold_topk": TOPK, "op2_warc_bundles": WARC, "op5_rule_ledger": RULES, "rule_ablations": ABLATIONS}
