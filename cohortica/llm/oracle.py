"""DuckDB SQL for the queries that SQL can express at the size of the comparison.

Words of documents are ``w``; every statement works on the whole tables.
"""

WORDS = r"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d)"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH {WORDS},
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
stay AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN stay USING (doc_id)"""

OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(nx.n) + any_value(ny.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reach JOIN link ON other = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY 1"""

OP6 = """WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS a FROM t GROUP BY 1),
e AS (SELECT *, list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) AS last FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) - 1 AS place, count(*) OVER () AS m FROM e WHERE last IS NOT NULL),
p AS (SELECT x.conv_id AS pair_id, x.conv_id AS chosen_id, y.conv_id AS rejected_id, x.a AS a, list_append(x.a[1:x.last - 1], y.a[y.last]) AS b FROM o x JOIN o y ON y.place = (x.place + 1) % x.m),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM p)
SELECT pair_id, chosen_id, rejected_id, n AS n_prompt_turns, """ + ", ".join(
    f"array_to_string(list_transform({part}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS {name}" for part, name in (("a[1:n]", "prompt"), ("a[n+1:]", "chosen"), ("b[n+1:]", "rejected"))
) + ", " + ", ".join(
    f"""list_transform(list_filter(range(n + 1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: list_transform([13 + length({x}[i].role), 23 + length({x}[i].role) + length({x}[i].text)],
  lambda e: CAST(e + coalesce(list_sum(list_transform({x}[n+1:i-1], lambda t: 24 + length(t.role) + length(t.text))), 0) AS INTEGER))) AS {name}"""
    for x, name in (("a", "chosen_mask"), ("b", "rejected_mask"))
) + " FROM n"

_ITEM = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP7 = f"""WITH w AS (SELECT doc_id, {_ITEM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_ITEM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bw))),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS m, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(m, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n IS NOT NULL AS contaminated FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)"""

OP10 = rf"""WITH {WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
c AS (SELECT l.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS letters FROM l LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 2 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 10 * upper_ <= 7 * letters AND 2 * letters >= word_chars AS kept FROM f"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, 3988292384 * (v % 2) + z))))"""

OP11 = rf"""WITH {WORDS},
h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, {_CRC32} AS h FROM w),
g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h),
x AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM g),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM x),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.v = b.v AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
stay AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n, list({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period)[1] AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM run GROUP BY 1)
SELECT x.doc_id, coalesce(r.n, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(r.s, '')) AS runs_sha256, sha256(coalesce(stay.s, '')) AS collapsed_sha256
FROM x LEFT JOIN r USING (doc_id) LEFT JOIN stay USING (doc_id)"""

OP12 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""

_TERM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""WITH d AS (SELECT doc_id, {_TERM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_TERM.format(_LOWER.format("coalesce(text, '')"))}) AS t FROM benchmark),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) SEMI JOIN b USING (t) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY 1),
c AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS c FROM p JOIN f USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM c JOIN b USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50"""
