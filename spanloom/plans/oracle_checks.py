"""DuckDB counterparts of the queries in ``checks``."""

from __future__ import annotations

from spanloom.plans.oracle import AGREEMENT, ARGS, CANON, CASES, DIVERGENCE, EDGES, FORMS, FRAMES, GROUPED, HEADS, LINES, MORPH, PRF, QUOTES, SPANS

CLAUSES = HEADS

SQL: dict[str, str] = {
    "table_merge": f"""WITH {LINES}, t AS (SELECT doc_id, line, length(text) AS n, min(line) OVER (PARTITION BY doc_id) AS first FROM lines),
        rows AS (SELECT doc_id, line, 0 AS k, '| line | size |' AS text FROM t WHERE line = first UNION ALL SELECT doc_id, line, 1, '|---|---|' FROM t WHERE line = first
            UNION ALL SELECT doc_id, line, 2, '' FROM t WHERE line <> first AND (doc_id + n) % 4 <> 0 AND n % 5 = 0 UNION ALL SELECT doc_id, line, 3, '| ' || line || ' | ' || n || ' |' FROM t)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS place, text FROM rows""",
    "pos_predicates": f"""WITH {MORPH} SELECT pos, note, count(*) AS n, count(*) FILTER (regexp_matches(pos, 'noun')) AS nominal, count(*) FILTER (regexp_matches(pos, 'noun|adjective|verb')) AS can_head,
        count(*) FILTER (pos = 'noun' AND note NOT LIKE '%NO_NP%' AND note <> 'CONT_NEXT') AS needs_span, count(*) FILTER (pos LIKE '%noun%' OR note = 'RELCL_HEAD') AS relative_head FROM morph GROUP BY ALL""",
    "preposition_forms": f"""WITH {MORPH}, {FORMS}, firsts AS (SELECT lower(trim(split_part(lemma, '+', 1))) AS lemma FROM morph) SELECT lemma, name AS normal, count(*) AS n FROM firsts JOIN forms ON lemma = form GROUP BY ALL""",
    "fixed_cells": f"""WITH {MORPH} SELECT CASE h % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN ' **' || word || '** ' WHEN 2 THEN word || '*' WHEN 3 THEN ' - ' WHEN 4 THEN '*' || word || '**' ELSE ' ' || word END AS cell,
        CASE h % 6 WHEN 0 THEN '' WHEN 3 THEN '' WHEN 4 THEN '*' || word || '**' ELSE word END AS fixed, count(*) AS n FROM numbered GROUP BY ALL""",
    "header_columns": """WITH cells AS (SELECT unnest([' Head Token ', 'Part of Speech', 'relation', 'NP', lang, 'Pred Line']) AS cell FROM documents), known(cell, layer, col) AS (VALUES (' Head Token ', 'edges', 'head_token'),
        ('Part of Speech', 'morph', 'pos'), ('relation', 'edges', 'deprel'), ('NP', 'spans', 'text'), ('Pred Line', 'frames', 'line'))
        SELECT c.cell, l.layer, coalesce(col, '') AS "column", count(*) AS n FROM cells c CROSS JOIN (SELECT unnest(['morph', 'spans', 'edges', 'frames', 'cases']) AS layer) l LEFT JOIN known k ON k.cell = c.cell AND k.layer = l.layer GROUP BY ALL""",
    "marked_lines": f"""WITH {LINES}, each AS (SELECT doc_id, line, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM (SELECT doc_id, line, regexp_extract_all(text, '''?\\p{{L}}+''?|.', 0, 's') AS ts FROM lines))
        SELECT doc_id, line, md5(string_agg(CASE WHEN regexp_matches(t, '\\p{{L}}') AND length(t) % 2 = 0 THEN '**' || t || '**' ELSE t END, '' ORDER BY k)) AS marked FROM each GROUP BY ALL""",
    "turn_snippets": """WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS snippet FROM f""",
    "native_calls": """SELECT conv_id, turn, CASE n % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'find' ELSE '' END AS name, CASE WHEN n % 5 < 2 THEN n ELSE -1 END AS n,
        ['', '', 'unparsable arguments', 'arguments are no object', 'no usable name'][n % 5 + 1] AS error FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""",
    "field_notes": """WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, n % 7 AS "index", -1 AS token, 'first note' AS note FROM t UNION ALL SELECT conv_id, turn, n % 5, n % 3, 'other note' FROM t""",
    "token_json": f"""WITH {MORPH} SELECT doc_id, '{{"line":' || line || ',"token":' || token || ',"word":"' || word || '"}}' AS json FROM numbered""",
    "selected_lines": f"""WITH {LINES} SELECT doc_id, line, md5(text) AS text FROM lines WHERE line BETWEEN 2 AND 4 AND doc_id IN (SELECT doc_id FROM lines GROUP BY doc_id HAVING max(line) >= 4)""",
    "unit_membership": f"""WITH {GROUPED}, bounds AS (SELECT doc_id, unit, min(line) AS first_line, max(line) AS last_line FROM grouped GROUP BY ALL) SELECT l.doc_id, l.line, b.unit, b.first_line, b.last_line FROM lines l JOIN bounds b ON l.doc_id = b.doc_id AND l.line BETWEEN b.first_line AND b.last_line""",
    "predicate_ordinals": f"""WITH RECURSIVE {FRAMES} SELECT doc_id, line, token, row_number() OVER (PARTITION BY doc_id, line ORDER BY token) AS ordinal FROM edges JOIN preds USING (doc_id, unit, u)""",
    "member_positions": f"""WITH RECURSIVE {FRAMES}{SPANS} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, head AS token FROM spans UNION SELECT doc_id, line, token FROM edges WHERE pos LIKE '%pronoun%' OR deprel IN {ARGS}
        OR (doc_id, unit, u) IN (SELECT doc_id, unit, u FROM preds)) GROUP BY doc_id""",
    "first_uses": f"""WITH {MORPH}, ranked AS (SELECT lower(word) AS word, doc_id, line, token, row_number() OVER (PARTITION BY lower(word) ORDER BY doc_id, line, token) AS k, count(*) OVER (PARTITION BY lower(word)) AS n FROM numbered) SELECT word, doc_id, line, token, n FROM ranked WHERE k = 1""",
    "relative_antecedents": f"""WITH {EDGES} SELECT h.pos, count(*) AS n FROM edges e JOIN edges h ON e.doc_id = h.doc_id AND e.unit = h.unit AND e.head = h.u WHERE e.deprel = 'acl:relcl' GROUP BY ALL""",
    "conjunct_clusters": f"""WITH RECURSIVE {EDGES}, up AS (SELECT doc_id, unit, u, u AS place, 0 AS steps FROM edges WHERE deprel = 'conj'
            UNION ALL SELECT p.doc_id, p.unit, p.u, e.head, p.steps + 1 FROM up p JOIN edges e ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.place WHERE p.steps < 16 AND e.deprel = 'conj' AND e.head > 0),
        tops AS (SELECT doc_id, unit, u, arg_max(place, steps) AS top FROM up GROUP BY ALL), members AS (SELECT * FROM tops UNION SELECT doc_id, unit, top, top FROM tops)
        SELECT doc_id, unit, top, count(*) AS size, max(u) AS last FROM members GROUP BY ALL""",
    "conjunct_resolves": f"""WITH RECURSIVE {EDGES}, up AS (SELECT doc_id, unit, u, head AS place, 1 AS steps FROM edges WHERE deprel = 'conj' AND head > 0
            UNION ALL SELECT p.doc_id, p.unit, p.u, e.head, p.steps + 1 FROM up p JOIN edges e ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.place WHERE p.steps < 16 AND e.deprel = 'conj' AND e.head > 0),
        met AS (SELECT DISTINCT p.doc_id, p.unit, p.u FROM up p JOIN edges e ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.place WHERE e.deprel IN {CLAUSES})
        SELECT c.doc_id, m.u IS NOT NULL AS resolves, count(*) AS n FROM edges c LEFT JOIN met m ON m.doc_id = c.doc_id AND m.unit = c.unit AND m.u = c.u WHERE c.deprel = 'conj' GROUP BY ALL""",
    "preposition_stacks": f"""WITH RECURSIVE {EDGES}, {FORMS}, links AS (SELECT e.doc_id, e.unit, e.u, e.head, coalesce(f.name, lower(e.word)) AS form FROM edges e LEFT JOIN edges h ON e.doc_id = h.doc_id AND e.unit = h.unit AND e.head = h.u LEFT JOIN forms f ON f.form = lower(e.word)
            WHERE e.head > 0 AND (e.deprel = 'case' OR (e.deprel = 'fixed' AND h.deprel = 'case'))),
        below AS (SELECT doc_id, unit, head AS u, u AS kid, form, 1 AS steps FROM links UNION ALL SELECT b.doc_id, b.unit, l.head, b.kid, b.form, b.steps + 1 FROM below b JOIN links l ON l.doc_id = b.doc_id AND l.unit = b.unit AND l.u = b.u WHERE b.steps < 8)
        SELECT doc_id, unit, u, string_agg(DISTINCT form, '+' ORDER BY form) AS lemmas FROM below GROUP BY ALL""",
}

ROLE_SET = ARGS
SOFT = "('tag', 'head_pos', 'uncovered', 'mention', 'many_roots', 'vocabulary', 'relative_head', 'several_objects', 'agreement', 'role', 'member', 'dual_role')"
VALID = "(role IN ('subj', 'obj', 'iobj', 'attr', 'xcomp', 'ccomp', 'obl') OR regexp_full_match(role, 'obl:[a-zàèéìòù'']+'))"
BY_KIND = f"SELECT doc_id, kind, CASE WHEN kind IN {SOFT} THEN 'soft' ELSE 'hard' END AS severity, count(*) AS n FROM found GROUP BY ALL"


def _edge_faults(edges: str) -> str:
    """Faults of ``moved`` edges; edges that leave the unit end there."""
    return f""", moved AS ({edges}), closed AS (SELECT * REPLACE (CASE WHEN head > n THEN 0 ELSE head END AS head) FROM moved),
    up_to_root AS (SELECT doc_id, unit, u FROM closed WHERE head = 0 UNION ALL SELECT e.doc_id, e.unit, e.u FROM closed e JOIN up_to_root r ON e.doc_id = r.doc_id AND e.unit = r.unit AND e.head = r.u),
    found AS (SELECT doc_id, unit, 'root_label' AS kind FROM moved WHERE (head = 0) <> (deprel = 'root')
        UNION ALL SELECT doc_id, unit, 'not_in_unit' FROM moved WHERE head > n UNION ALL SELECT doc_id, unit, 'self_head' FROM moved WHERE head = u
        UNION ALL SELECT doc_id, unit, 'vocabulary' FROM moved WHERE deprel = 'unheard'
        UNION ALL SELECT e.doc_id, e.unit, 'relative_head' FROM moved e JOIN moved h ON e.doc_id = h.doc_id AND e.unit = h.unit AND e.head = h.u WHERE e.deprel = 'acl:relcl' AND h.pos NOT LIKE '%noun%' AND h.note <> 'RELCL_HEAD'
        UNION ALL SELECT doc_id, unit, 'cycle' FROM closed WHERE (doc_id, unit, u) NOT IN (SELECT doc_id, unit, u FROM up_to_root)
        UNION ALL SELECT doc_id, unit, CASE WHEN r = 0 THEN 'no_root' ELSE 'many_roots' END FROM (SELECT doc_id, unit, count(*) FILTER (head = 0) AS r FROM moved GROUP BY ALL) WHERE r <> 1
        UNION ALL SELECT doc_id, unit, 'several_objects' FROM moved WHERE deprel = 'obj' AND head > 0 GROUP BY doc_id, unit, head HAVING count(*) > 1
        UNION ALL SELECT doc_id, unit, 'agreement' FROM (WITH RECURSIVE edges AS (SELECT * FROM closed), {AGREEMENT} SELECT doc_id, unit FROM judged WHERE v[1] = 'disagree'))"""


GIVEN = """, rows AS (SELECT doc_id, unit, pred, role, CASE WHEN (pred + arg) % 19 = 0 THEN arg + 4000 ELSE arg END AS arg FROM given),
    span_heads AS (SELECT DISTINCT doc_id, line, head AS token FROM spans), places AS (SELECT e.doc_id, e.unit, e.u AS arg, e.pos, e.deprel, s.token IS NOT NULL AS held FROM edges e LEFT JOIN span_heads s USING (doc_id, line, token)),
    sizes AS (SELECT doc_id, unit, max(u) AS n FROM edges GROUP BY ALL),
    known AS (SELECT r.*, p.pos, p.deprel, coalesce(p.held, false) AS held, coalesce(z.n, 0) AS n FROM rows r LEFT JOIN places p USING (doc_id, unit, arg) LEFT JOIN sizes z USING (doc_id, unit))"""

CANDIDATES = (
    GIVEN
    + f""", slots AS (SELECT doc_id, unit, pred, role, arg, count(*) AS k FROM rows GROUP BY ALL),
    licences AS (SELECT DISTINCT doc_id, unit, u AS arg FROM cases WHERE "case" = 'genitive+acc'),
    found AS (SELECT doc_id, unit, 'role' AS kind, 'error' AS level FROM known WHERE role <> '' AND NOT {VALID}
        UNION ALL SELECT doc_id, unit, 'zero_marker', 'error' FROM known WHERE role = '' AND arg <> 0
        UNION ALL SELECT doc_id, unit, 'argument', 'error' FROM known WHERE arg <> 0 AND pos IS NULL
        UNION ALL SELECT doc_id, unit, 'anchor', 'error' FROM known WHERE pos IS NOT NULL AND {VALID} AND role NOT IN ('attr', 'xcomp', 'ccomp', 'obl') AND NOT held AND pos NOT LIKE '%pronoun%'
        UNION ALL SELECT doc_id, unit, 'slot', 'error' FROM (SELECT *, unnest(range(1, k)) FROM slots)
        UNION ALL SELECT doc_id, unit, 'zero_coexists', 'error' FROM slots GROUP BY doc_id, unit, pred HAVING count(*) > 1 AND bool_or(role = '')
        UNION ALL SELECT s.doc_id, s.unit, 'dual_role', 'error' FROM slots s LEFT JOIN licences l USING (doc_id, unit, arg) WHERE s.arg <> 0 AND l.arg IS NULL GROUP BY s.doc_id, s.unit, s.pred, s.arg HAVING count(*) > 1
        UNION ALL SELECT doc_id, unit, 'role_repeated', 'warning' FROM rows WHERE role <> '' GROUP BY doc_id, unit, pred, role HAVING count(*) > 1)"""
)

CLASSED = (
    DIVERGENCE
    + """, classed AS (SELECT d.*, CASE WHEN role <> '' THEN role ELSE given_role END AS slot, CASE WHEN kind = 'missing_tuple' AND p.pos NOT LIKE 'verb%' THEN 'missing_tuple_nominal'
        WHEN kind = 'extra_tuple' AND p.pos = 'adverb' THEN 'extra_tuple_adverb' WHEN kind = 'extra_tuple' AND p.pos = 'adjective' THEN 'extra_tuple_adjective'
        WHEN kind = 'extra_arg' AND given_role IN ('xcomp', 'attr') AND a.pos = 'adjective' THEN 'extra_arg_adjective' WHEN kind = 'missing_arg' AND a.pos = 'adverb' THEN 'missing_arg_adverb'
        WHEN kind IN ('missing_arg', 'extra_arg') AND role || given_role = 'subj' THEN kind || '_subject' ELSE kind END AS class
        FROM divergence d JOIN edges p ON d.doc_id = p.doc_id AND d.unit = p.unit AND d.pred = p.u LEFT JOIN edges a ON d.doc_id = a.doc_id AND d.unit = a.unit AND d.arg = a.u),
    conflicts AS (SELECT doc_id, unit, pred, slot FROM classed WHERE slot <> '' GROUP BY ALL HAVING count(*) FILTER (kind = 'extra_arg') > 0 AND count(*) FILTER (kind = 'missing_arg') > 0),
    ranked AS (SELECT c.*, k.slot IS NOT NULL AS clash, row_number() OVER (PARTITION BY c.doc_id, c.unit, c.pred, c.slot, c.kind ORDER BY c.class = 'extra_arg_adjective' DESC, c.arg DESC) AS r
        FROM classed c LEFT JOIN conflicts k ON c.doc_id = k.doc_id AND c.unit = k.unit AND c.pred = k.pred AND c.slot = k.slot),
    joined AS (SELECT doc_id, unit, CASE WHEN clash AND kind = 'extra_arg' AND r = 1 THEN 'arg_slot' ELSE class END AS class FROM ranked WHERE NOT (clash AND kind = 'missing_arg'))"""
)

SUBMITTED = ", submitted AS (SELECT *, (pred * 7 + arg) % 3 + 1 AS submission FROM given)"

SQL |= {
    "morph_violations": f"""WITH {MORPH}, rows AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY token) AS ord, CASE WHEN h % 41 = 0 THEN reverse(word) ELSE word END AS w, h % 43 = 0 AS odd FROM morph WHERE h % 50 <> 49),
        found AS (SELECT doc_id, 'count' AS kind FROM morph GROUP BY doc_id, line HAVING count(*) FILTER (h % 50 = 49) > 0 UNION ALL SELECT doc_id, 'tag' FROM rows WHERE odd
        UNION ALL SELECT r.doc_id, 'word' FROM rows r JOIN morph m ON r.doc_id = m.doc_id AND r.line = m.line AND r.ord = m.token WHERE r.w <> m.word) {BY_KIND}""",
    "case_violations": f"""WITH {MORPH}{CASES}, rows AS (SELECT doc_id, line, CASE WHEN h % 17 = 5 THEN token + 1 ELSE token END AS token, CASE WHEN h % 23 = 7 THEN reverse(word) ELSE word END AS w,
            CASE WHEN h % 29 = 11 THEN '' ELSE {CANON} END AS c FROM cases WHERE h % 20 <> 3),
        slots AS (SELECT doc_id, line, token, word, CASE WHEN pos = 'pronoun + pronoun' THEN 2 WHEN pos LIKE '%pronoun' THEN 1 ELSE 0 END AS k FROM morph),
        known AS (SELECT r.*, s.word, coalesce(s.k, 0) AS k, CASE WHEN c = '' THEN 0 WHEN c LIKE '%+%' THEN 2 ELSE 1 END AS v FROM rows r LEFT JOIN slots s USING (doc_id, line, token)),
        found AS (SELECT doc_id, 'twice' AS kind FROM (SELECT doc_id, unnest(range(1, count(*))) FROM rows GROUP BY doc_id, line, token) UNION ALL SELECT doc_id, 'no_pronoun' FROM known WHERE k = 0
        UNION ALL SELECT doc_id, 'word' FROM known WHERE k > 0 AND w <> word UNION ALL SELECT doc_id, 'slot' FROM known WHERE k > 0 AND v <> k UNION ALL SELECT doc_id, 'case' FROM known WHERE k > 0 AND c = 'unheard'
        UNION ALL SELECT doc_id, 'empty' FROM known WHERE k > 0 AND v = 0
        UNION ALL SELECT doc_id, 'count' FROM (SELECT doc_id, line, 1 AS need, 0 AS have FROM slots WHERE k > 0 UNION ALL SELECT doc_id, line, 0, 1 FROM rows) GROUP BY doc_id, line HAVING sum(need) <> sum(have)) {BY_KIND}""",
    "span_soft_violations": f"""WITH {MORPH}{SPANS}, heads AS (SELECT DISTINCT doc_id, line, head AS token FROM spans), known AS (SELECT m.*, h.token IS NOT NULL AS held FROM morph m LEFT JOIN heads h USING (doc_id, line, token)),
        found AS (SELECT doc_id, 'head_pos' AS kind FROM known WHERE held AND pos IN ('conjunction', 'preposition', 'article') UNION ALL SELECT doc_id, 'uncovered' FROM known WHERE NOT held AND pos = 'noun' AND NOT regexp_matches(note, 'NO_NP|CONT_NEXT')
        UNION ALL SELECT doc_id, 'mention' FROM known WHERE pos = 'verb + pronoun' AND token % 3 = 0) {BY_KIND}""",
    "edge_violations": f"WITH RECURSIVE {EDGES}{_edge_faults('SELECT * REPLACE (CASE WHEN h % 47 = 0 THEN n + 5 ELSE head END AS head) FROM edges')} {BY_KIND}",
    "clean_units": f"""WITH RECURSIVE {EDGES}{_edge_faults('SELECT * FROM edges')} SELECT doc_id, count(*) AS n, count(DISTINCT unit) AS units FROM edges WHERE (doc_id, unit) NOT IN (SELECT doc_id, unit FROM found WHERE kind NOT IN {SOFT}) GROUP BY doc_id""",
    "frame_violations": f"""WITH RECURSIVE {FRAMES}{SPANS}{GIVEN}, named AS (SELECT DISTINCT doc_id, unit, pred AS arg FROM rows), judged AS (SELECT k.*, m.arg IS NOT NULL AS is_pred, row_number() OVER (PARTITION BY k.doc_id, k.unit, k.pred, k.role, k.arg) > 1 AS again
            FROM known k LEFT JOIN named m ON k.doc_id = m.doc_id AND k.unit = m.unit AND k.arg = m.arg),
        found AS (SELECT doc_id, 'dup' AS kind FROM judged WHERE again OR arg = pred UNION ALL SELECT doc_id, 'position' FROM judged WHERE (arg = 0 AND role NOT IN ('subj', '')) OR arg > n
        UNION ALL SELECT doc_id, 'clausal' FROM judged WHERE role IN ('ccomp', 'xcomp') AND NOT is_pred UNION ALL SELECT doc_id, 'role' FROM judged WHERE role <> '' AND NOT {VALID}
        UNION ALL SELECT doc_id, 'member' FROM judged WHERE role NOT IN ('', 'attr', 'xcomp', 'ccomp') AND arg > 0 AND arg <> pred AND NOT (held OR is_pred OR coalesce(pos LIKE '%pronoun%' OR deprel IN {ROLE_SET} OR (role LIKE 'obl%' AND pos = 'adverb'), false))
        UNION ALL SELECT doc_id, 'dual_role' FROM rows WHERE arg > 0 AND arg <> pred AND role <> '' GROUP BY doc_id, unit, pred, arg HAVING count(DISTINCT role) > 1) {BY_KIND}""",
    "candidate_checks": f"WITH RECURSIVE {FRAMES}{SPANS}{CANDIDATES} SELECT doc_id, kind, level, count(*) AS n FROM found GROUP BY ALL",
    "candidate_valid": f"""WITH RECURSIVE {FRAMES}{SPANS}{CANDIDATES}, units AS (SELECT DISTINCT doc_id, unit FROM rows) SELECT doc_id, count(*) AS units, count(*) FILTER ((doc_id, unit) NOT IN (SELECT doc_id, unit FROM found WHERE level = 'error')) AS valid FROM units GROUP BY doc_id""",
    "violation_classes": f"WITH RECURSIVE {CLASSED} SELECT class, 'before' AS stage, count(*) AS n FROM classed GROUP BY ALL UNION ALL SELECT class, 'after', count(*) FROM joined GROUP BY ALL",
    "fix_gains": f"""WITH RECURSIVE {CLASSED}, counts AS (SELECT doc_id, unit, class, sum(b) AS b, sum(a) AS a FROM (SELECT doc_id, unit, class, 1 AS b, 0 AS a FROM classed UNION ALL SELECT doc_id, unit, class, 0, 1 FROM joined) GROUP BY ALL),
        verdicts AS (SELECT doc_id, unit, sum(a) < sum(b) AND count(*) FILTER (b = 0 AND a > 0) = 0 AS improved FROM counts GROUP BY ALL) SELECT doc_id, improved, count(*) AS n FROM verdicts GROUP BY ALL""",
    "role_micro_macro": f"""WITH RECURSIVE {FRAMES}, g AS (SELECT DISTINCT *, 1 AS g FROM derived), m AS (SELECT DISTINCT *, 1 AS m FROM given),
        counts AS (SELECT role, count(*) FILTER (g = 1 AND m = 1) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (m IS NULL) AS fn FROM g FULL JOIN m USING (doc_id, unit, pred, role, arg) GROUP BY role),
        each_role AS (SELECT *, {PRF} FROM counts), sums AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round_even(avg(f1), 4) AS macro_f1 FROM each_role) SELECT tp, fp, fn, macro_f1, {PRF} FROM sums""",
    "accumulated_rows": f"""WITH RECURSIVE {FRAMES}{SUBMITTED}, last AS (SELECT doc_id, unit, pred, max(submission) AS submission FROM submitted GROUP BY ALL) SELECT doc_id, count(*) AS n, sum(submission)::BIGINT AS submissions FROM submitted JOIN last USING (doc_id, unit, pred, submission) GROUP BY doc_id""",
    "predicate_first_pass": f"""WITH RECURSIVE {FRAMES}{SUBMITTED}, first AS (SELECT doc_id, unit, pred, min(submission) AS submission FROM submitted GROUP BY ALL),
        mine AS (SELECT doc_id, unit, pred, string_agg(DISTINCT role || '=' || arg, ' ' ORDER BY role || '=' || arg) AS rows FROM submitted JOIN first USING (doc_id, unit, pred, submission) GROUP BY ALL),
        gold AS (SELECT doc_id, unit, pred, string_agg(DISTINCT role || '=' || arg, ' ' ORDER BY role || '=' || arg) AS rows FROM derived GROUP BY ALL)
        SELECT g.doc_id, count(*) AS preds, count(*) FILTER (g.rows = m.rows) AS passed FROM gold g LEFT JOIN mine m USING (doc_id, unit, pred) GROUP BY ALL""",
    "exact_units": f"""WITH RECURSIVE {FRAMES}, odd AS (SELECT doc_id, unit FROM (SELECT DISTINCT * FROM given) g FULL JOIN (SELECT DISTINCT *, 1 AS d FROM derived) d USING (doc_id, unit, pred, role, arg) WHERE d IS NULL OR g.doc_id IS NULL),
        units AS (SELECT doc_id, unit FROM given UNION SELECT doc_id, unit FROM derived) SELECT doc_id, count(*) AS units, count(*) FILTER ((doc_id, unit) NOT IN (SELECT * FROM odd)) AS exact FROM units GROUP BY doc_id""",
}

SQL |= {
    "search_corpus": f"""WITH {EDGES}{CASES} SELECT e.doc_id, e.line, e.token, e.word, {CANON.replace('"case"', 'c."case"')} AS "case" FROM edges e JOIN cases c USING (doc_id, unit, u)
        WHERE e.doc_id <> 3 AND e.deprel = 'obj' AND c."case" = '*dat*' ORDER BY e.doc_id, e.line, e.token LIMIT 50""",
    "span_layer_files": f"""WITH {MORPH}{SPANS}, sizes AS (SELECT doc_id, count(*) AS n, sum("end" - start)::BIGINT AS width FROM spans GROUP BY doc_id)
        SELECT doc_id, count(*) AS lines, coalesce(any_value(n), 0) AS n, coalesce(any_value(width), 0) AS width FROM lines LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "morph_layer_files": f"WITH {MORPH} SELECT doc_id, count(*) AS n, count(*) AS same, count(*) FILTER (note = '') AS bare FROM morph GROUP BY doc_id",
}

NAMED_QUOTES = (
    QUOTES
    + """, counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY col) AS k, count(*) OVER (PARTITION BY doc_id, line) AS n FROM forest),
    worded AS (SELECT c.*, regexp_extract_all(substr(r.text, c.col + 2), '''?\\p{L}+''?') AS ws FROM counted c JOIN raw_lines r ON c.doc_id = r.doc_id AND c.line = r.line),
    apart AS (SELECT a.doc_id, a.line, coalesce(list_position(list_transform(list_zip(a.ws, b.ws), lambda x: x[1] IS DISTINCT FROM x[2]), true), 0) AS p FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND a.line = b.line AND a.k < b.k),
    least AS (SELECT doc_id, line, CASE WHEN min(p) = 0 THEN 1000000 ELSE max(p) END AS w FROM apart GROUP BY ALL),
    named AS (SELECT q.*, q.line || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr((64 + k)::INTEGER) ELSE k::VARCHAR END AS quote_id,
        CASE WHEN n = 1 THEN '' WHEN len(ws) = 0 THEN '?' ELSE array_to_string(ws[1:l.w], ' ') END AS head FROM worded q LEFT JOIN least l ON q.doc_id = l.doc_id AND q.line = l.line)"""
)
MARKER = "mark || CASE mark WHEN '«' THEN '»' WHEN '“' THEN '”' ELSE '’' END"

SQL |= {
    "quote_heads": f"WITH {NAMED_QUOTES} SELECT doc_id, quote, quote_id, head FROM named",
    "quote_xml_scan": f"WITH {NAMED_QUOTES} SELECT doc_id, quote_id, line, end_line, col, end_col, {MARKER} AS marker, head, (SELECT count(*) FROM named o WHERE o.error = '' AND o.doc_id = i.doc_id AND (o.line, o.col) <= (i.line, i.col) AND (o.end_line, o.end_col) >= (i.end_line, i.end_col)) AS depth FROM named i WHERE error = ''",
    "quote_xml": f"""WITH {NAMED_QUOTES}, good AS (SELECT *, coalesce((lead(line) OVER w, lead(col) OVER w) > (end_line, end_col), true) OR lead(line) OVER w IS NULL AS leaf FROM named WHERE error = '' WINDOW w AS (PARTITION BY doc_id ORDER BY line, col)),
        tags AS (SELECT doc_id, line AS l, col AS c, repeat('  ', depth) || '<q id="' || quote_id || '" line="' || line || CASE WHEN end_line <> line THEN '-' || end_line ELSE '' END || '" col="' || col || '-' || end_col || '" marker="' || {MARKER} || '"'
            || CASE WHEN head = '' THEN '' ELSE ' head="' || head || '"' END || CASE WHEN leaf THEN '/>' ELSE '>' END AS tag FROM good UNION ALL SELECT doc_id, end_line, end_col, repeat('  ', depth) || '</q>' FROM good WHERE NOT leaf)
        SELECT doc_id, string_agg(tag, chr(10) ORDER BY l, c) AS xml FROM tags GROUP BY doc_id""",
}

SQL |= {
    "short_cells": """WITH c("column", cell, fixed) AS (VALUES ('number', 'Plural', 'pl.'), ('gender', ' feminine ', 'f.'), ('person', '3rd', '3'), ('person', 'plural', 'plural'), ('note', 'first', 'first'))
        SELECT lang, "column", cell, fixed, count(*) AS n FROM documents CROSS JOIN c GROUP BY ALL""",
    "first_tables": """SELECT conv_id, turn, CASE WHEN n % 4 < 2 OR n % 3 = 2 THEN 'none' ELSE 'A,B;---,:---:;' || CASE n % 3 WHEN 0 THEN 'x,' ELSE 'x,y' END || ';' || n || ',w' END AS cells
        FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""",
}

STACKS = SQL["preposition_stacks"].split("links AS", 1)[1].rsplit("SELECT doc_id, unit, u,", 1)[0]

SQL |= {
    "guarded_walks": f"""WITH RECURSIVE {EDGES}, v AS (SELECT *, pos LIKE 'verb%' AS verb FROM edges),
        co AS (SELECT doc_id, unit, u, u AS place, [u] AS path FROM v UNION ALL SELECT w.doc_id, w.unit, w.u, h.u, list_append(w.path, h.u) FROM co w JOIN v e ON e.doc_id = w.doc_id AND e.unit = w.unit AND e.u = w.place
            JOIN v h ON h.doc_id = e.doc_id AND h.unit = e.unit AND h.u = e.head WHERE len(w.path) < 9 AND e.deprel IN ('conj', 'appos', 'flat', 'compound') AND NOT list_contains(w.path, h.u)
            AND NOT (e.deprel = 'conj' AND NOT e.verb AND h.verb AND h.deprel NOT IN {ARGS})),
        pr AS (SELECT doc_id, unit, u, u AS place, [u] AS path FROM v WHERE deprel = 'fixed' OR (deprel = 'case' AND (doc_id, unit, u) IN (SELECT doc_id, unit, head FROM edges WHERE deprel = 'fixed'))
            UNION ALL SELECT w.doc_id, w.unit, w.u, e.head, list_append(w.path, e.head) FROM pr w JOIN v e ON e.doc_id = w.doc_id AND e.unit = w.unit AND e.u = w.place
            WHERE len(w.path) < 9 AND e.deprel IN ('fixed', 'case') AND e.head > 0 AND NOT list_contains(w.path, e.head)),
        c AS (SELECT doc_id, unit, u, arg_max(place, len(path)) AS coord_head FROM co GROUP BY ALL), p AS (SELECT doc_id, unit, u, arg_max(place, len(path)) AS nominal FROM pr GROUP BY ALL)
        SELECT doc_id, unit, u, coord_head, coalesce(nominal, u) AS nominal FROM c LEFT JOIN p USING (doc_id, unit, u) WHERE coord_head <> u OR coalesce(nominal, u) <> u""",
    "frame_repairs": f"""WITH RECURSIVE {DIVERGENCE}, verdicts AS (SELECT * FROM (WITH RECURSIVE {AGREEMENT} SELECT doc_id, unit, u, v FROM judged)), links AS{STACKS}, stacks AS (SELECT doc_id, unit, u AS arg, list(DISTINCT form) AS fs FROM below_case GROUP BY ALL),
        empty AS (SELECT doc_id, unit, pred, min(arg) FILTER (kind = 'missing_arg' AND role = 'subj' AND arg > 0) AS arg FROM divergence GROUP BY ALL
            HAVING count(*) FILTER (kind = 'missing_arg' AND role = 'subj' AND arg > 0) = 1 AND count(*) FILTER (kind = 'extra_arg' AND given_role = 'subj' AND arg = 0) = 1)
        SELECT e.doc_id, e.unit, e.pred, 'null_subject' AS kind, e.arg, 'subj' AS role FROM empty e JOIN verdicts j ON e.doc_id = j.doc_id AND e.unit = j.unit AND e.arg = j.u JOIN edges s ON s.doc_id = j.doc_id AND s.unit = j.unit AND s.u = j.u AND s.head = e.pred WHERE j.v[1] = 'agree'
        UNION ALL SELECT doc_id, unit, pred, CASE WHEN given_role = 'obl' THEN 'role_label' ELSE 'prep_stack' END, arg, role FROM divergence LEFT JOIN stacks USING (doc_id, unit, arg) WHERE kind = 'role_mismatch' AND role LIKE 'obl:%'
            AND (given_role = 'obl' OR (given_role LIKE 'obl:%' AND list_contains(fs, role[5:]) AND list_contains(fs, given_role[5:])))""".replace("below AS (SELECT doc_id, unit, head AS u, u AS kid", "below_case AS (SELECT doc_id, unit, head AS u, u AS kid").replace("FROM below b JOIN links l", "FROM below_case b JOIN links l"),
}
