"""SQL for the operators that it can express."""
from .quality import LANGS, MIN_DUP_LINES, MIN_STOP_WORDS, PUNCT, STOP

_BLANK = r"[\x20\x09-\x0D]"
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_count = lambda cls: f"length(regexp_replace(t, '{cls}', '', 'g'))"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
x AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM x WHERE len(words) >= 5) z),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) z WHERE c > 1),
n AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) z GROUP BY r),
m AS (SELECT doc_id, lang, words, len(lines) AS n_lines, len(words)::BIGINT AS n_words, {_count(_BLANK)}::BIGINT AS word_chars, {_count('[^#*$%&|<>]')}::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
  {_count(r'[\x00-\x{36F}\P{L}\p{Latin}]')} AS n_foreign, {_count(r'[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')} AS n_unspaced FROM x LEFT JOIN n USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS k FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_symbols / k <= 0.1
  AND (n_lines < {MIN_DUP_LINES} OR n_dup_lines / greatest(n_lines, 1) <= 0.3) AND len(list_filter(words, lambda w: w = '|')) / k <= 0.5
  AND (2 * n_unspaced >= greatest(word_chars, 1) OR word_chars / k BETWEEN 1 AND 20)
  AND (n_words < {MIN_STOP_WORDS} OR NOT (lang IS NULL OR regexp_extract(lower(lang), '^[a-z]*') IN ('', {_quoted(LANGS)})) OR 2 * n_foreign > word_chars
    OR len(list_filter(words, lambda w: list_contains([{_quoted(STOP)}], lower(trim(w, {_quoted([PUNCT])}))))) / k >= 0.005)
  AND len(list_filter(words, lambda w: ends_with(w, '!!'))) / k <= 0.5 AS kept FROM v"""

JACCARD = rf"""
WITH RECURSIVE x AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM x WHERE len(w) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
k AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT x.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.y, x.doc_id) AS component_id FROM x LEFT JOIN n ON n.doc_id = x.doc_id LEFT JOIN k ON k.x = x.doc_id"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1098) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS o FROM d) z),
w AS (SELECT doc_id, o + i AS i, substr(c, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, c, unnest(range(0, least(500, length(c) // 2 - 49))) AS i FROM c) z),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
o AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g) z),
v AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM o GROUP BY doc_id, isle),
u AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM v),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM u JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(words) < 100)::INTEGER + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INTEGER + 4 * (100 * {_count('[^A-Z]')} > 10 * length(t))::INTEGER
  + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(w.doc_id > first, false)::INTEGER AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM k a JOIN k b ON b.x <> a.x JOIN k c ON c.x NOT IN (a.x, b.x) JOIN k d ON d.x NOT IN (a.x, b.x, c.x) JOIN k e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, step, substr(o, step, 1) AS letter, (1 << (strpos('ABCDE', substr(o, step, 1)) - 1))::INTEGER AS bit, coalesce(list_sum(list_transform(string_split(substr(o, 1, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (strpos('ABCDE', x) - 1) END)), 0)::INTEGER AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM o) z),
r AS (SELECT part, o AS filter_order, step::INTEGER AS step, letter, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant,
  sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY part, o, step, letter)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM r"""

#: A row of the CRC-32 table from its index: eight shifts (the polynomial is a fixed value).
_CRC_ROW = "list_reduce(range(1, 9), lambda c, s: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i)"

RANKING = f"""
WITH z AS (SELECT list({_CRC_ROW} ORDER BY i) AS crc FROM (SELECT unnest(range(0, 256))::BIGINT AS i) y),
x AS (SELECT sale_lines.*, coalesce(xor(list_reduce(list_transform(string_split(sale_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0, false) AS one FROM sale_lines, z),
g AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END::BIGINT AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 5, -1) END::BIGINT AS part, CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month,
  floor(quantity / 10.0)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, sale_id::BIGINT AS sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(100 * amount + 0.5)::BIGINT AS amount_cents FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST)::BIGINT AS pos,
  count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent)::BIGINT AS tied FROM g)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= 2"""
