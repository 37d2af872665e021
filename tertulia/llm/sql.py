"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, text,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: length(trim(translate(x, chr(9)||chr(13)||chr(11)||chr(12), '    '))) > 0) AS ls
      FROM d),
w AS (SELECT doc_id, coalesce(text, chr(0)) AS t, p, ls[p] AS a, ls[p+1] AS b, ls[p+2] AS c
      FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3)),
f AS (SELECT *, min(coalesce(doc_id, 9223372036854775807)) OVER g AS fd FROM w WINDOW g AS (PARTITION BY a, b, c)),
f2 AS (SELECT *, min(CASE WHEN coalesce(doc_id, 9223372036854775807) = fd THEN p END) OVER (PARTITION BY a, b, c) AS fp
       FROM f),
gone AS (SELECT DISTINCT doc_id, t, q FROM (
           SELECT doc_id, t, unnest([p, p+1, p+2]) AS q FROM f2
           WHERE NOT (coalesce(doc_id, 9223372036854775807) = fd AND p = fp))),
keep AS (SELECT r, x.doc_id, x.text, ls, coalesce(g.qs, []) AS qs FROM l x
         LEFT JOIN (SELECT doc_id, t, list(q) AS qs FROM gone GROUP BY 1, 2) g
         ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(x.text, chr(0)) = g.t)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(qs) AS BIGINT) AS n_removed,
  CASE WHEN len(qs) = 0 THEN text ELSE
    coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(qs, i)), chr(10)), '') END AS text
FROM keep
"""

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS wt,
        3 * source_size AS cap FROM r),
g AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER fills, 0) AS DOUBLE)
        / (sum(wt) OVER () - coalesce(sum(wt) OVER fills, 0)) AS lvl FROM w
      WINDOW fills AS (ORDER BY cap / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, max(CASE WHEN cap > wt * lvl THEN lvl END) OVER () AS lv FROM g),
t AS (SELECT source, rk, source_size, CASE WHEN cap > wt * lv THEN wt * lv ELSE CAST(cap AS DOUBLE) END AS target FROM h),
q AS (SELECT doc_id, size, source_size, target, rk, k,
        row_number() OVER (PARTITION BY rk ORDER BY k, doc_id, size) AS rn,
        sum(size) OVER (PARTITION BY rk ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST((ep - 1) * source_size + e AS DOUBLE) / target AS finish
      FROM q, (VALUES (1), (2), (3)) v(ep) WHERE target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, ep, rn ROWS UNBOUNDED PRECEDING) AS cum FROM x),
y AS (SELECT rk, rn, count(*) AS n FROM c WHERE cum <= (SELECT sum(size) FROM d) GROUP BY rk, rn)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(y.n, 0) AS BIGINT) AS taken
FROM q LEFT JOIN y ON q.rk = y.rk AND q.rn = y.rn
"""

URL_FILTER_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
        try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})([^/0-9][^/]*)?/?\z', 1), '') AS BIGINT) AS doc_id FROM h),
o AS (SELECT doc_id, min(CASE WHEN toxic = 1 OR quality = 0 THEN 0 WHEN quality = 1 THEN 1 END) AS good
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(o.good) AS n, coalesce(sum(o.good), 0) AS g FROM r LEFT JOIN o ON r.doc_id = o.doc_id GROUP BY host),
nm AS (SELECT *, string_split(nm, '.') AS ls, nm NOT LIKE '%.%' OR regexp_matches(nm, '^[0-9.]+\z') OR starts_with(nm, '[') AS own
       FROM (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.*(:[0-9]*)?\z', '') AS nm FROM c)),
k AS (SELECT *, CASE WHEN len(ls) >= 2 AND ls[-2] || '.' || ls[-1] IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za',
        'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'org.uk') THEN 2 ELSE 1 END AS m FROM nm),
hosts AS (SELECT host, CAST(n AS DOUBLE) AS n, CAST(g AS DOUBLE) AS g,
            CASE WHEN own THEN nm ELSE array_to_string(list_slice(ls, greatest(len(ls) - m, 1), len(ls)), '.') END AS dom,
            CASE WHEN own THEN '' ELSE array_to_string(list_slice(ls, greatest(len(ls) - m + 1, 1), len(ls)), '.') END AS suf FROM k),
doms AS (SELECT dom, suf, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY dom, suf),
sufs AS (SELECT suf, sum(n) AS n, sum(g) AS g FROM doms GROUP BY suf),
lv AS (SELECT 'h' AS lv, dom AS up, n, g FROM hosts UNION ALL SELECT 'd', suf, n, g FROM doms UNION ALL SELECT 's', '', n, g FROM sufs),
pp AS (SELECT lv, sum(n) AS n, sum(g) AS g, count(*) AS k, sum(g * g / n) AS q, sum(n * n) AS nn FROM lv WHERE n > 0 GROUP BY lv, up),
st AS (SELECT lv, sum(q - g * g / n - (k - 1) * (g / n) * (1 - g / n)) AS ex,
         sum((n - nn / n) * (g / n) * (1 - g / n)) AS no, sum(CASE WHEN k > 1 THEN k END) AS sev FROM pp GROUP BY lv),
s AS (SELECT l.lv, CASE WHEN sev IS NULL THEN 10.0 WHEN ex * 1001 <= no THEN 1000.0 ELSE greatest(1.0, no / ex - 1) END AS w
      FROM (VALUES ('h'), ('d'), ('s')) l(lv) LEFT JOIN st ON st.lv = l.lv),
w AS (SELECT max(w) FILTER (lv = 'h') AS wh, max(w) FILTER (lv = 'd') AS wd, max(w) FILTER (lv = 's') AS ws FROM s),
root AS (SELECT (coalesce(sum(g), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM sufs),
ps AS (SELECT suf, (ws * p + g) / (ws + n) AS p FROM sufs, root, w),
pd AS (SELECT dom, (wd * ps.p + g) / (wd + n) AS p FROM doms JOIN ps USING (suf), w),
ph AS (SELECT host, wh * pd.p + g AS a, wh * (1 - pd.p) + n - g AS b FROM hosts JOIN pd USING (dom), w),
v AS (SELECT host, round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) >= 0.5 AS ok FROM ph)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN ok THEN 'allow' ELSE 'block' END AS verdict
FROM r JOIN v ON r.host = v.host
"""

HARD_NEGATIVES_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM e a, e b WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS nth FROM s WHERE same AND ar <> br),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
