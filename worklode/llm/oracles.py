"""SQL of the queries that SQL can express, for the comparison engine."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPLIT = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents), b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM win),
  grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  hit AS (SELECT grams.doc_id, grams.i, grams.n, win.item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
  least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON least_id.a = d.doc_id
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
  m AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
  r AS (SELECT DISTINCT w.doc_id, i FROM w JOIN m ON w.s = m.s WHERE m.m < w.doc_id),
  g AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
  runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
  parts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
    UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(length(h) // 2) FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id GROUP BY 1),
  kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s, e) AS x FROM d JOIN parts ON parts.doc_id = d.doc_id GROUP BY 1),
  n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Covered words: in a 10-word window found twice. One repeat of at least 50 words and over a fiftieth: a window of the least such length found twice.
QUALITY = f"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n, greatest(50, len(w) // 50 + 1) AS far FROM d),
  g AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS x FROM (SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS i FROM (SELECT doc_id, w, n, unnest([5, 10, far]) AS k FROM n) WHERE n >= k)),
  r AS (SELECT doc_id, k, i FROM (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, x) AS c FROM g) WHERE c > 1),
  p AS (SELECT doc_id, count(DISTINCT p) FILTER (k = 5) AS n5, count(DISTINCT p) FILTER (k = 10) AS n10, count(*) FILTER (k >= 50) > 0 AS long FROM (SELECT doc_id, k, unnest(range(i, i + least(k, 10))) AS p FROM r) GROUP BY 1),
  l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
  m AS (SELECT n.doc_id, n, coalesce(n5, 0) AS n5, coalesce(n10, 0) AS n10, coalesce(long, false) AS long, n < 10 OR 100 * coalesce(n5, 0) > 20 * n AS base_failed FROM n LEFT JOIN p ON p.doc_id = n.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, n5 AS n_repeat_words, n10 AS n_covered_words,
  base_failed, NOT base_failed AND NOT long AND n10 <= 0.10 * n AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""

#: (host, path) rules by rising length, the later the stronger.
_RULES = "CASE WHEN {f[4]} THEN 'www.example.com/en/' WHEN {f[3]} THEN 'example.com/en/' WHEN {f[2]} THEN 'net/fr/' WHEN {f[1]} THEN 'net/es/' WHEN {f[0]} THEN 'com/' END"
_FITS = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p in (("com", "/"), ("net", "/es/"), ("net", "/fr/"), ("example.com", "/en/"), ("www.example.com", "/en/"))]


def _witten_bell(k: int) -> str:
    """Probabilities of order ``k`` grams, smoothed into those of the order below."""
    lower = "1 / 256.0" if not k else "l.p{c}"
    p = ", ".join(f"CASE WHEN t{c} > 0 THEN (n{c} + u{c} * {lower.format(c=c)}) / (t{c} + u{c}) ELSE {lower.format(c=c)} END AS p{c}" for c in (0, 1))
    below = f" JOIN p{k - 1} l ON substr(s.g, 3) = l.g" if k else ""
    return f"p{k} AS MATERIALIZED (SELECT s.g, {p} FROM stat s{below} WHERE k = {k})"


URLS = f"""
WITH h AS (SELECT page_id, coalesce(url, '') AS u, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  r AS (SELECT *, row_number() OVER () AS i, {_RULES.format(f=_FITS)} AS rule, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 5 = 0 AS fifth FROM h),
  b AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS c FROM r),
  full_g AS (SELECT i, c, fifth, substr('________' || hex(encode(u)), 2 * o + 1, 10) AS g FROM (SELECT *, unnest(range(0, strlen(u))) AS o FROM b)),
  seen AS (SELECT g, count(*) FILTER (c = 0 AND NOT fifth) AS n0, count(*) FILTER (c = 1 AND NOT fifth) AS n1 FROM full_g GROUP BY 1),
  grams AS (SELECT k, substr(g, 9 - 2 * k) AS g, sum(n0) AS n0, sum(n1) AS n1 FROM (SELECT g, n0, n1, unnest(range(0, 5)) AS k FROM seen) GROUP BY 1, 2),
  stat AS MATERIALIZED (SELECT *, sum(n0) OVER w AS t0, sum(n1) OVER w AS t1, count(*) FILTER (n0 > 0) OVER w AS u0, count(*) FILTER (n1 > 0) OVER w AS u1 FROM grams WINDOW w AS (PARTITION BY k, substr(g, 1, 2 * k))),
  {", ".join(_witten_bell(k) for k in range(5))},
  ratio AS (SELECT i, sum(ln(p0) - ln(p1)) / count(*) AS x FROM full_g JOIN p4 USING (g) GROUP BY 1),
  bins AS (SELECT q, count(*) FILTER (c = 0) AS a, count(*) FILTER (c = 1) AS z FROM (SELECT c, CAST(greatest(0, least(399, floor((coalesce(x, 0) + 4) / 8 * 400))) AS INTEGER) AS q FROM b LEFT JOIN ratio USING (i) WHERE c IS NOT NULL AND fifth) GROUP BY 1),
  edges AS (SELECT e, coalesce(sum(a) FILTER (q < e), 0) / greatest(coalesce(sum(a), 0), 1) + coalesce(sum(z) FILTER (q >= e), 0) / greatest(coalesce(sum(z), 0), 1) AS wrong FROM (SELECT unnest(range(0, 401)) AS e) LEFT JOIN bins ON true GROUP BY 1),
  cut AS (SELECT min(e) / 400.0 * 8 - 4 AS t FROM edges WHERE wrong = (SELECT min(wrong) FROM edges)),
  used AS (SELECT count(*) FILTER (c = 0 AND NOT fifth AND u <> '') > 0 AND count(*) FILTER (c = 1 AND NOT fifth AND u <> '') > 0 AS usable FROM b)
SELECT page_id, host, path, rule, CASE WHEN c = 0 THEN 'allow' WHEN c = 1 THEN 'block' WHEN NOT usable OR u = '' OR coalesce(x, 0) >= t THEN 'allow' ELSE 'block' END AS verdict
FROM b LEFT JOIN ratio USING (i), cut, used
"""

SQL = {"op5_url_filter": URLS, "op7_quality_rules": QUALITY, "op1_suffix_dedup": SUBSTRINGS, "op6_decontamination": DECONTAMINATION, "op8_minhash_near_dedup": NEAR_DUPLICATES}
