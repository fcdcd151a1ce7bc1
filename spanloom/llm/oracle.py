"""DuckDB counterparts of those corpus queries that SQL can express."""

WORD_RUN = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
hex AS (SELECT page_id, html, first, sha1(html) AS h FROM p JOIN first USING (html))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((instr('0123456789abcdef', substr(h, (i * 5) // 4 + 1, 1)) - 1) * 16 + greatest(instr('0123456789abcdef', substr(h, (i * 5) // 4 + 2, 1)) - 1, 0)) >> (3 - (i * 5) % 4)) % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM hex""",
    "op2_top_k_search": """
WITH codes AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
pairs AS (SELECT q.id AS query_id, r.id AS neighbor_id, len(list_filter(list_zip(q.code, r.code), lambda x: x[1] <> x[2])) AS distance
    FROM codes q JOIN codes r ON q.id <> r.id WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{WORD_RUN}') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS k FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i FROM win WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM often, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) AS n_lines FROM line WHERE regexp_matches(l, '{WORD_RUN}') GROUP BY doc_id),
s AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS soft FROM s),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft THEN 1 ELSE 0 END)::DOUBLE AS k FROM j GROUP BY source),
moments AS (SELECT least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(k * k / n) / sum(n) AS square, count(*) AS hosts, sum(n) AS total, sum(n * n) AS squares FROM hosts),
spread AS (SELECT mean, (square - mean * mean - mean * (1 - mean) * hosts / total) / greatest(1 - squares / (total * total), 1e-9) AS between_hosts FROM moments),
prior AS (SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE 1e4 END, 1), 1e4) AS size FROM spread),
verdict AS (SELECT source, (k + mean * size) / (n + size) AS rate, rate > least(greatest(mean + 3 * sqrt(mean * (1 - mean) / (size + 1)), 0.3), greatest(0.6, (1 + mean) / 2)) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, round(rate, 6) AS host_rate, rejected AS host_rejected
FROM j JOIN verdict ON j.source IS NOT DISTINCT FROM verdict.source""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_RUN}') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 18, 1))) AS i, ws FROM w),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 19], ' ')) AS k FROM starts),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, (SELECT unnest(range(20)) AS j)),
kept AS (SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos.i) FILTER (gone.i IS NULL), '') AS left_over
    FROM pos LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tok AS (SELECT row, unnest(ts) AS term FROM d),
totals AS (SELECT count(*)::HUGEINT AS big_n, sum(len(ts))::HUGEINT AS big_l FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
tf AS (SELECT row, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
m AS (SELECT row, doc_id, 100 - 25 + (25 * len(ts) * big_n) // big_l AS m FROM d, totals WHERE len(ts) > 0),
s AS (SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s JOIN m USING (row) WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p, unnest(range(length(text) + 1)) AS nr FROM d),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece WHERE p IS NOT NULL),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
runs AS (SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM cut, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM runs GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT * FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, f AS a, w, m, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000 * c.a::HUGEINT) // (x.f + y.f))::BIGINT AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f AS b, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))))) AS phrase FROM cand WHERE m > 2),
longer AS (SELECT lang, phrase, max(b) AS b FROM inside GROUP BY lang, phrase),
stay AS (SELECT w.* FROM weakest w LEFT JOIN longer o USING (lang, phrase) WHERE o.b IS NULL OR 100 * o.b::HUGEINT < 80 * w.a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM stay JOIN sizes USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000""",
}
