"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, bpe, contamination, huffman, infill, jaccard, lm, media, mixing, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_quality": quality.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_lm": lm.op4_lm,
    "op5_bpe": bpe.op5_bpe,
    "op6_mix": mixing.op6_mix,
    "op7_shards": sharding.op7_shards,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_huffman_ids": huffman.op9_huffman_ids,
    "op10_media": media.op10_media,
    "op11_contamination": contamination.op11_contamination,
    "op12_audit": audit.op12_audit,
    "op13_infill": infill.op13_infill,
}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Pairs by shared shingles, then their components.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS seen FROM s UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links FROM s JOIN c ON c.id = s.doc_id LEFT JOIN k ON k.a = s.doc_id
"""

#: The level at which clamped sources and weighted shares meet the total is the greatest over all prefixes of clamped sources.
MIX = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM g),
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
c AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS full_size, sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS left_weight FROM o),
lv AS (SELECT max(level) AS level FROM (SELECT (t.total * 1.5::DOUBLE - c.full_size) / c.left_weight AS level FROM c, (SELECT sum(source_size)::DOUBLE AS total FROM g) t WHERE c.left_weight > 0 UNION ALL SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE / sum(weight) FROM s)),
f AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM s, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0.0 END AS whole FROM f),
q AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, greatest(0.0, e.target - e.whole * e.source_size) AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN whole < 2 THEN greatest(0, least(size, round(rest)::BIGINT - before)) ELSE 0 END)::BIGINT AS taken FROM q
"""

#: Windows of all lengths that items have, joined by their words; hit words are counted once.
CONTAMINATION = r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS x FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS j FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT k FROM p),
d AS (SELECT r, l.k, n.w, unnest(generate_series(1, len(n.w) - l.k + 1)) AS j FROM n JOIN l ON len(n.w) >= l.k),
m AS MATERIALIZED (SELECT d.r, d.j, d.k, p.item FROM (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS x FROM d) d JOIN p ON d.k = p.k AND d.x = p.x),
h AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(generate_series(j, j + k - 1)) AS word FROM (SELECT DISTINCT r, j, k FROM m)) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN h ON n.r = h.r LEFT JOIN o ON n.r = o.r
"""

#: Failed filters as a mask, all orders of the letters, and sums over both.
AUDIT = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
k AS (SELECT array_to_string(o, '') AS filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(1, bit_count(mask))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley FROM s, k GROUP BY part, filter_order, step
"""

#: Units by their pattern, parts as slices of the list of units.
INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 100 THEN 'plain' WHEN h4[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

ORACLES: dict[str, str] = {"op1_jaccard": JACCARD, "op6_mix": MIX, "op11_contamination": CONTAMINATION, "op12_audit": AUDIT, "op13_infill": INFILL}
