"""DuckDB counterparts of the queries, stated from the meaning of each and not from its plan."""

from __future__ import annotations

from spanloom.functions.text import PREPOSITIONS

FORMS = "forms(form, name) AS (VALUES " + ", ".join("('" + f.replace("'", "''") + "', '" + n + "')" for n, fs in PREPOSITIONS.items() for f in fs.split()) + ")"

LINES = """
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
lines AS (SELECT doc_id, line, text FROM raw_lines WHERE trim(text) <> '')"""

GROUPED = (
    LINES
    + """,
grouped AS (SELECT *, (coalesce(sum(CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS unit FROM lines)"""
)

MORPH = (
    GROUPED
    + """,
each AS (SELECT doc_id, unit, line, unnest(ws) AS word, generate_subscripts(ws, 1) AS token
    FROM (SELECT *, regexp_extract_all(text, '''?\\p{L}+''?') AS ws FROM grouped)),
numbered AS (SELECT *, (doc_id * 7 + line * 31 + token * 17 + length(word) * 13 + ascii(lower(word)) * 5) % 101 AS h,
    row_number() OVER (PARTITION BY doc_id, unit ORDER BY line, token) AS u, count(*) OVER (PARTITION BY doc_id, unit) AS n FROM each),
placed AS (SELECT *, ['noun', 'conjunction', 'verb', 'adjective', 'pronoun', 'preposition', 'article', 'noun', 'adverb', 'verb + pronoun', 'pronoun + pronoun'][(h + u) % 11 + 1] AS pos FROM numbered),
morph AS (SELECT *, CASE WHEN pos = 'verb' AND h % 17 = 0 THEN 'essere' WHEN pos = 'pronoun' AND h % 19 = 0 THEN 'che' WHEN pos = 'pronoun' AND h % 13 = 0 THEN 'ciascuno'
        WHEN pos = 'adjective' AND h % 3 = 0 THEN 'molto' WHEN pos = 'preposition' AND h % 3 = 0 THEN 'con' WHEN pos = 'verb + pronoun' THEN lower(word) || ' + si' ELSE lower(word) END AS lemma, ['m.', 'f.', ''][h % 3 + 1] AS gender,
    ['sg.', 'pl.'][length(word) % 2 + 1] AS number,
    CASE WHEN pos IN ('verb', 'pronoun', 'verb + pronoun') THEN ['1', '2', '3', ''][ascii(lower(word)) % 4 + 1] ELSE '' END AS person,
    CASE WHEN h % 143 = 0 THEN 'NO_NP, CONT_NEXT' WHEN h % 11 = 0 THEN 'NO_NP' WHEN h % 13 = 0 THEN 'CONT_NEXT' WHEN h % 29 = 0 THEN 'AD_SENSUM'
        WHEN h % 31 = 0 THEN 'x, impersonal' WHEN h % 37 = 0 THEN 'RELCL_HEAD' ELSE '' END AS note,
    CASE WHEN pos LIKE 'verb%' AND h % 2 = 0 THEN 'present' ELSE '' END AS tense, CASE WHEN pos LIKE 'verb%' AND h % 4 = 0 THEN 'indicative' ELSE '' END AS mood FROM placed)"""
)

EDGES = (
    MORPH
    + """,
aimed AS (SELECT *, CASE WHEN h = 100 THEN u WHEN h % 7 = 0 THEN u + 1 + h % 2 ELSE u - 1 - h % 3 END AS aim FROM morph),
headed AS (SELECT *, CASE WHEN aim < 1 OR aim > n THEN 0 ELSE aim END AS head FROM aimed),
edges AS (SELECT *, CASE WHEN head = 0 AND h % 10 <> 9 THEN 'root'
    ELSE ['nsubj', 'obj', 'obl', 'case', 'conj', 'aux', 'cop', 'amod', 'acl:relcl', 'xcomp', 'ccomp', 'fixed',
        'advmod', 'nmod', 'advcl', 'expl', 'mark', 'attr', 'obl', 'nsubj', 'obj', 'parataxis', 'orphan',
        'cc', 'det', 'nummod', 'appos', 'nsubj:pass', 'expl:impers', 'iobj', 'conj', 'unheard',
        'csubj', 'acl', 'obl:agent', 'orphan', 'aux:pass', 'csubj:pass', 'conj'][h % 39 + 1] END AS deprel FROM headed)"""
)

SPANS = """,
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS size FROM numbered),
bare_spans AS (SELECT doc_id, line, token AS start, least(token + h % 5, size) AS "end", h FROM sized WHERE h % 4 = 0
    UNION ALL SELECT doc_id, line, token, least(token + h % 3, size), h FROM sized WHERE h % 12 = 0),
spans AS (SELECT doc_id, line, start, "end", start + h % ("end" - start + 1) AS head FROM bare_spans),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY start, "end" DESC, head) AS ord FROM spans)"""

CASES = """,
cases AS (SELECT doc_id, unit, line, token, u, word, pos, h,
    ['nom', 'acc.', '*dat*', 'oblique', 'expletive', 'genitive+acc', 'unheard', 'ablative'][(u + length(word)) % 8 + 1] AS "case" FROM morph WHERE pos LIKE '%pronoun%')"""

CANON = """(CASE "case" WHEN 'nom' THEN 'nominative' WHEN 'acc.' THEN 'accusative' WHEN '*dat*' THEN 'dative' WHEN 'oblique' THEN 'ablative'
    WHEN 'expletive' THEN 'reflexive' WHEN 'genitive+acc' THEN 'genitive+accusative' ELSE "case" END)"""

#: Verdicts on subjects, from the edges alone.
AGREEMENT = """preps AS (SELECT doc_id, unit, head AS u, arg_min(lemma, u) AS prep FROM edges WHERE deprel = 'case' AND head > 0 GROUP BY ALL),
        up AS (SELECT doc_id, unit, u, u AS place, 0 AS steps FROM edges WHERE deprel = 'conj'
            UNION ALL SELECT p.doc_id, p.unit, p.u, e.head, p.steps + 1 FROM up p JOIN edges e ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.place WHERE p.steps < 16 AND e.deprel = 'conj' AND e.head > 0),
        tops AS (SELECT doc_id, unit, u, arg_max(place, steps) AS top FROM up GROUP BY ALL),
        members AS (SELECT t.doc_id, t.unit, t.top, list(CASE WHEN e.person = '' THEN '3' ELSE e.person END) AS persons FROM tops t JOIN edges e ON e.doc_id = t.doc_id AND e.unit = t.unit AND e.u = t.u WHERE t.top <> t.u GROUP BY ALL),
        below AS (SELECT e.doc_id, e.unit, e.head AS u, count(*) FILTER (deprel IN ('nsubj', 'nsubj:pass')) AS n_nsubj, bool_or(deprel = 'cc') AS cc, bool_or(deprel IN ('nmod', 'conj', 'appos')) AS linked,
            bool_or(deprel IN ('obl', 'nmod') AND coalesce(prep, '') = 'con') AS comitative, bool_or(deprel = 'nummod') AS numbered, bool_or(deprel IN ('det', 'amod') AND lemma = 'molto') AS measured,
            bool_or(deprel = 'attr' AND number = 'sg.') AS attr_sg, bool_or(deprel = 'attr' AND number = 'pl.') AS attr_pl, bool_or(deprel = 'expl:impers' OR (deprel = 'expl' AND note = 'x, impersonal')) AS impersonal
            FROM edges e LEFT JOIN preps p ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.u WHERE head > 0 GROUP BY ALL),
        pairs AS (SELECT s.doc_id, s.unit, s.u, s.pos AS sp, v.pos AS vp, s.lemma AS sl, s.number AS sn, v.number AS vn, CASE WHEN s.person = '' THEN '3' ELSE s.person END AS sper, v.person AS vper, s.note AS sno, v.note AS vno,
            s.tense || s.mood AS st, v.tense || v.mood AS vt, m.persons, coalesce(sb.cc, false) AND coalesce(sb.linked, false) AS inner_coord, coalesce(sb.numbered, false) OR coalesce(sb.measured, false) AS quantified,
            coalesce(vb.comitative, false) AS comitative, coalesce(vb.impersonal, false) AS impersonal, CASE v.number WHEN 'sg.' THEN coalesce(vb.attr_sg, false) WHEN 'pl.' THEN coalesce(vb.attr_pl, false) ELSE false END AS nominal, coalesce(vb.n_nsubj, 0) AS n_nsubj
            FROM edges s JOIN edges v ON s.doc_id = v.doc_id AND s.unit = v.unit AND s.head = v.u LEFT JOIN below sb ON sb.doc_id = s.doc_id AND sb.unit = s.unit AND sb.u = s.u
            LEFT JOIN below vb ON vb.doc_id = v.doc_id AND vb.unit = v.unit AND vb.u = v.u LEFT JOIN members m ON m.doc_id = s.doc_id AND m.unit = s.unit AND m.top = s.u WHERE s.deprel IN ('nsubj', 'nsubj:pass')),
        judged AS (SELECT doc_id, unit, u, CASE WHEN vper = '' OR vp NOT LIKE '%verb%' THEN ['undecidable', 'head not finite'] WHEN (vp LIKE '%+%' AND vt = '') OR (sp LIKE '%+%' AND st = '') THEN ['undecidable', 'fused token']
            WHEN sl IN ('che', 'chi', 'cui', 'quale') THEN ['undecidable', 'person of the antecedent'] WHEN vper <> '3' AND vn = 'pl.' AND sper <> '3' AND persons IS NULL THEN ['undecidable', 'member of a plural']
            WHEN n_nsubj > 1 THEN ['undecidable', 'several subjects'] WHEN sno = 'AD_SENSUM' OR vno = 'AD_SENSUM' THEN ['undecidable', 'exempt']
            WHEN sl IN ('ciascuno', 'ognuno', 'catuno', 'ambedue', 'amendue', 'uno', 'tutto') AND vn = 'pl.' THEN ['undecidable', 'distributive']
            WHEN persons IS NOT NULL THEN CASE WHEN list_contains(list_append(persons, sper), vper) THEN ['undecidable', 'coordinated subject'] ELSE ['disagree', 'person'] END
            WHEN sper <> vper THEN ['disagree', 'person'] WHEN sn = vn THEN ['agree', '']
            WHEN sn = 'sg.' AND inner_coord THEN ['undecidable', 'coordination inside the subject'] WHEN sn = 'sg.' AND comitative THEN ['undecidable', 'comitative phrase']
            WHEN sn = 'pl.' AND quantified THEN ['undecidable', 'quantified subject'] WHEN nominal THEN ['undecidable', 'predicate nominal'] WHEN sn = 'pl.' AND impersonal THEN ['undecidable', 'impersonal']
            ELSE ['disagree', 'number'] END AS v FROM pairs)"""

ADJUDICATED = """CASE WHEN deprel = 'obl' AND "case" = 'nominative' THEN 'impossible'
    WHEN (deprel = 'obj' AND "case" LIKE '%accusative%') OR (deprel = 'iobj' AND "case" = 'dative') OR (deprel = 'nsubj' AND "case" = 'nominative') THEN 'agree'
    WHEN deprel IN ('obj', 'iobj', 'nsubj') AND regexp_matches("case", 'nominative|accusative|dative') THEN 'contradict' ELSE 'open' END"""

#: Fixed values of the derivation.
ARGS = "('nsubj', 'nsubj:pass', 'csubj', 'csubj:pass', 'obj', 'iobj', 'attr', 'xcomp', 'ccomp', 'obl', 'obl:agent')"
SUBJ = "('nsubj', 'nsubj:pass', 'csubj', 'csubj:pass')"
FUNC = "('aux', 'aux:pass', 'cop')"
HEADS = "('root', 'ccomp', 'xcomp', 'csubj', 'csubj:pass', 'advcl', 'acl', 'acl:relcl', 'parataxis')"
RANK = "(CASE role WHEN '' THEN -1 WHEN 'subj' THEN 0 WHEN 'obj' THEN 1 WHEN 'iobj' THEN 2 WHEN 'attr' THEN 3 WHEN 'xcomp' THEN 4 WHEN 'ccomp' THEN 5 ELSE 6 END)"

FRAMES = (
    EDGES
    + CASES
    + ", "
    + FORMS
    + """,
kid AS (SELECT doc_id, unit, head AS u, count(*) FILTER (deprel IN ARGS) AS n_args, min(u) FILTER (deprel IN SUBJ) AS subj, bool_or(deprel = 'mark') AS marked, bool_or(deprel IN FUNC) AS aux,
    bool_or(deprel IN FUNC AND person <> '') AS aux_person, bool_or(deprel = 'orphan') AS gapped, bool_or(deprel = 'case') AS cased, arg_min(lemma, {'t': token, 'u': u}) FILTER (deprel = 'case') AS first_case, list(DISTINCT deprel) AS rels
    FROM edges WHERE head > 0 GROUP BY ALL),
node AS (SELECT e.*, coalesce(n_args, 0) AS n_args, subj, coalesce(marked, false) AS marked, coalesce(aux, false) AS aux, coalesce(aux_person, false) AS aux_person, coalesce(gapped, false) AS gapped, coalesce(cased, false) AS cased,
    coalesce(rels, []) AS rels, pos LIKE '%conjunction%' AS connective, pos LIKE 'verb%' AS verb,
    CASE WHEN deprel IN SUBJ THEN 'subj' WHEN deprel NOT LIKE 'obl%' THEN deprel WHEN coalesce(trim(split_part(first_case, '+', 1)), '') = '' THEN 'obl' ELSE 'obl:' || coalesce(f.name, lower(trim(split_part(first_case, '+', 1)))) END AS role
    FROM edges e LEFT JOIN kid k ON e.doc_id = k.doc_id AND e.unit = k.unit AND e.u = k.u LEFT JOIN forms f ON f.form = lower(trim(split_part(first_case, '+', 1)))),
clauses AS (SELECT * FROM node WHERE deprel IN HEADS AND NOT (connective AND n_args = 0) AND NOT (gapped AND NOT verb)),
conj_above AS (SELECT doc_id, unit, u, head AS place FROM edges WHERE deprel = 'conj' AND head > 0
    UNION SELECT a.doc_id, a.unit, a.u, e.head FROM conj_above a JOIN edges e ON e.doc_id = a.doc_id AND e.unit = a.unit AND e.u = a.place WHERE e.deprel = 'conj' AND e.head > 0),
on_clause AS (SELECT DISTINCT a.doc_id, a.unit, a.u FROM conj_above a JOIN edges e ON e.doc_id = a.doc_id AND e.unit = a.unit AND e.u = a.place WHERE e.deprel IN HEADS),
sure_preds AS (SELECT doc_id, unit, u FROM clauses UNION SELECT doc_id, unit, u FROM node JOIN on_clause USING (doc_id, unit, u) WHERE NOT connective AND NOT gapped AND (verb OR n_args > 0 OR aux)
    UNION SELECT doc_id, unit, u FROM node WHERE verb AND deprel NOT IN FUNC AND n_args > 0),
on_chain AS (SELECT doc_id, unit, u FROM on_clause UNION SELECT a.doc_id, a.unit, a.u FROM conj_above a JOIN sure_preds t ON t.doc_id = a.doc_id AND t.unit = a.unit AND t.u = a.place),
preds AS (SELECT doc_id, unit, u FROM sure_preds UNION SELECT doc_id, unit, u FROM node JOIN on_chain USING (doc_id, unit, u) WHERE deprel = 'conj' AND verb AND person <> '' AND NOT connective AND NOT gapped),
p AS (SELECT node.* FROM node JOIN preds USING (doc_id, unit, u)),
brother AS (SELECT doc_id, unit, head AS u, min(u) AS near FROM node WHERE deprel = 'conj' AND subj IS NOT NULL GROUP BY ALL),
sought AS (SELECT doc_id, unit, u, head AS place FROM p WHERE deprel = 'conj' AND verb AND NOT marked AND subj IS NULL AND head > 0
    UNION SELECT s.doc_id, s.unit, s.u, n.head FROM sought s JOIN node n ON n.doc_id = s.doc_id AND n.unit = s.unit AND n.u = s.place LEFT JOIN brother b ON b.doc_id = s.doc_id AND b.unit = s.unit AND b.u = s.place
        WHERE coalesce(b.near >= s.u, true) AND n.subj IS NULL AND n.deprel = 'conj' AND NOT n.marked AND n.head > 0),
inherited AS (SELECT s.doc_id, s.unit, s.u, n.subj AS arg FROM sought s JOIN node n ON n.doc_id = s.doc_id AND n.unit = s.unit AND n.u = s.place LEFT JOIN brother b ON b.doc_id = s.doc_id AND b.unit = s.unit AND b.u = s.place
    WHERE n.subj IS NOT NULL AND coalesce(b.near >= s.u, true)),
own_args AS (SELECT c.doc_id, c.unit, c.head AS pred, c.role, c.u AS arg FROM node c JOIN p ON p.doc_id = c.doc_id AND p.unit = c.unit AND p.u = c.head WHERE c.deprel IN ARGS),
stranded AS (SELECT c.doc_id, c.unit, p.u AS pred, c.role, c.u AS arg FROM node c JOIN edges x ON x.doc_id = c.doc_id AND x.unit = c.unit AND x.u = c.head JOIN p ON p.doc_id = x.doc_id AND p.unit = x.unit AND p.u = x.head
    WHERE x.deprel IN FUNC AND c.deprel IN ARGS AND c.deprel NOT IN SUBJ AND NOT list_contains(p.rels, c.deprel)),
own_subjects AS (SELECT p.doc_id, p.unit, p.u AS pred, 'subj' AS role, coalesce(i.arg, 0) AS arg FROM p LEFT JOIN inherited i USING (doc_id, unit, u) WHERE p.subj IS NULL AND (i.arg IS NOT NULL OR p.person <> '' OR p.aux_person)),
plain_rows AS (SELECT * FROM own_args UNION ALL SELECT * FROM stranded UNION ALL SELECT * FROM own_subjects),
gapping AS (SELECT c.doc_id, c.unit, c.u AS conjunct, c.head AS pred, c.cased AS shared FROM node c JOIN preds p ON p.doc_id = c.doc_id AND p.unit = c.unit AND p.u = c.head WHERE c.deprel = 'conj' AND c.gapped),
open_slots AS (SELECT g.doc_id, g.unit, g.pred, g.conjunct, s.role, row_number() OVER (PARTITION BY g.doc_id, g.unit, g.pred, g.conjunct ORDER BY s.first = 0, s.rank, s.first) AS place FROM gapping g JOIN
    (SELECT doc_id, unit, pred, role, min(arg) AS first, min(RANKED) AS rank FROM plain_rows GROUP BY ALL) s USING (doc_id, unit, pred) WHERE NOT (g.shared AND s.role = 'subj')),
remnant AS (SELECT g.doc_id, g.unit, g.pred, g.conjunct, n.u AS arg, row_number() OVER (PARTITION BY g.doc_id, g.unit, g.pred, g.conjunct ORDER BY n.u <> g.conjunct, n.u) AS nth,
    CASE WHEN n.cased THEN CASE WHEN n.case_role LIKE 'obl:%' THEN n.case_role ELSE 'obl' END END AS label, CASE k.c WHEN 'nominative' THEN 'subj' WHEN 'accusative' THEN 'obj' WHEN 'dative' THEN 'iobj' END AS core
    FROM gapping g JOIN (SELECT n.*, CASE WHEN coalesce(trim(split_part(q.first_case, '+', 1)), '') = '' THEN 'obl' ELSE 'obl:' || coalesce(f.name, lower(trim(split_part(q.first_case, '+', 1)))) END AS case_role
        FROM node n LEFT JOIN kid q ON n.doc_id = q.doc_id AND n.unit = q.unit AND n.u = q.u LEFT JOIN forms f ON f.form = lower(trim(split_part(q.first_case, '+', 1)))) n
        ON n.doc_id = g.doc_id AND n.unit = g.unit AND (n.u = g.conjunct OR (n.deprel = 'orphan' AND n.head = g.conjunct))
    LEFT JOIN (SELECT doc_id, unit, u, CANONICAL AS c FROM cases) k ON k.doc_id = n.doc_id AND k.unit = n.unit AND k.u = n.u),
by_label AS (SELECT r.doc_id, r.unit, r.pred, r.conjunct, r.label AS role, arg_min(r.arg, r.nth) AS arg FROM remnant r JOIN open_slots s ON s.doc_id = r.doc_id AND s.unit = r.unit AND s.pred = r.pred AND s.conjunct = r.conjunct AND s.role = r.label GROUP BY ALL),
by_case AS (SELECT r.doc_id, r.unit, r.pred, r.conjunct, r.core AS role, arg_min(r.arg, r.nth) AS arg FROM remnant r JOIN open_slots s ON s.doc_id = r.doc_id AND s.unit = r.unit AND s.pred = r.pred AND s.conjunct = r.conjunct AND s.role = r.core
    WHERE (r.doc_id, r.unit, r.pred, r.conjunct, r.arg) NOT IN (SELECT doc_id, unit, pred, conjunct, arg FROM by_label) GROUP BY ALL),
claimed AS (SELECT * FROM by_label UNION ALL SELECT * FROM by_case),
queued AS (SELECT doc_id, unit, pred, conjunct, arg, row_number() OVER (PARTITION BY doc_id, unit, pred, conjunct ORDER BY nth) AS k FROM remnant WHERE (doc_id, unit, pred, conjunct, arg) NOT IN (SELECT doc_id, unit, pred, conjunct, arg FROM claimed)),
left_slots AS (SELECT doc_id, unit, pred, conjunct, role, row_number() OVER (PARTITION BY doc_id, unit, pred, conjunct ORDER BY place) AS k FROM open_slots WHERE (doc_id, unit, pred, conjunct, role) NOT IN (SELECT doc_id, unit, pred, conjunct, role FROM claimed)),
filled AS (SELECT * FROM plain_rows UNION ALL SELECT doc_id, unit, pred, role, arg FROM claimed UNION ALL SELECT doc_id, unit, pred, role, arg FROM queued JOIN left_slots USING (doc_id, unit, pred, conjunct, k)),
raw_frames AS (SELECT * FROM filled UNION ALL SELECT doc_id, unit, u, '', 0 FROM preds WHERE (doc_id, unit, u) NOT IN (SELECT doc_id, unit, pred FROM filled)),
args AS (SELECT doc_id, unit, pred, CASE role WHEN 'iobj' THEN 'obl:a' WHEN 'attr' THEN 'xcomp' ELSE role END AS role, arg FROM own_args),
derived AS (SELECT doc_id, unit, pred, CASE role WHEN 'iobj' THEN 'obl:a' WHEN 'attr' THEN 'xcomp' ELSE role END AS role, arg FROM raw_frames),
preps AS (SELECT doc_id, unit, head AS u, arg_min(lemma, u) AS prep FROM edges WHERE deprel = 'case' AND head > 0 GROUP BY ALL),
marked AS (SELECT *, (doc_id + unit * 3 + pred * 5 + arg * 11) % 30 AS k FROM derived),
given AS (SELECT m.doc_id, m.unit, pred, CASE WHEN role = 'obj' AND k = 7 THEN 'iobj' WHEN role IN ('obj', 'obl') AND k = 8 THEN 'xcomp' WHEN role = 'obj' AND k = 14 THEN 'ccomp'
            WHEN role = 'ccomp' AND k = 15 THEN 'xcomp' WHEN role = 'obl' AND k = 16 THEN 'obl:a' WHEN role = 'subj' AND k = 17 THEN 'obj'
            WHEN role IN ('subj', 'obj', 'xcomp') AND k > 17 AND prep IS NOT NULL THEN 'obl:' || prep ELSE role END AS role,
        CASE WHEN k = 9 AND role = 'subj' THEN 0 ELSE arg END AS arg FROM marked m LEFT JOIN preps q ON m.doc_id = q.doc_id AND m.unit = q.unit AND m.arg = q.u WHERE k <> 4
    UNION ALL SELECT doc_id, unit, pred, 'obl', arg FROM marked WHERE k = 12 AND arg > 0
    UNION ALL SELECT e.doc_id, e.unit, e.head, CASE WHEN prep IS NOT NULL AND e.h % 2 = 0 THEN 'obl:' || prep ELSE ['obl', 'xcomp', 'obl:a', 'iobj'][(e.h + e.u) % 4 + 1] END, e.u
        FROM edges e JOIN preds p ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.head = p.u LEFT JOIN preps q ON e.doc_id = q.doc_id AND e.unit = q.unit AND e.u = q.u
        WHERE e.deprel NOT IN ('nsubj', 'nsubj:pass', 'csubj', 'csubj:pass', 'obj', 'iobj', 'attr', 'xcomp', 'ccomp', 'obl', 'obl:agent') AND e.u % 3 = 0
    UNION ALL SELECT e.doc_id, e.unit, e.u, 'subj', 0 FROM edges e WHERE e.h % 9 = 0 AND (doc_id, unit, u) NOT IN (SELECT doc_id, unit, u FROM preds))"""
).replace("RANKED", RANK).replace("CANONICAL", CANON)
for _name, _list in (("IN ARGS", ARGS), ("IN SUBJ", SUBJ), ("IN FUNC", FUNC), ("IN HEADS", HEADS)):
    FRAMES = FRAMES.replace(_name, "IN " + _list)

DIVERGENCE = (
    FRAMES
    + f""",
best_given AS (SELECT doc_id, unit, pred, arg, arg_min(role, {{'r': {RANK}, 'n': role}}) AS given_role FROM given GROUP BY ALL),
best_derived AS (SELECT doc_id, unit, pred, arg, arg_min(role, {{'r': {RANK}, 'n': role}}) AS role FROM derived GROUP BY ALL),
gp AS (SELECT DISTINCT doc_id, unit, pred FROM given), dp AS (SELECT DISTINCT doc_id, unit, pred FROM derived),
met AS (SELECT * FROM gp INTERSECT SELECT * FROM dp),
pairs AS (SELECT doc_id, unit, pred, arg, role, given_role FROM best_given FULL JOIN best_derived USING (doc_id, unit, pred, arg)),
divergence AS (SELECT doc_id, unit, pred, 0 AS arg, 'extra_tuple' AS kind, '' AS role, '' AS given_role FROM (SELECT * FROM gp EXCEPT SELECT * FROM dp)
    UNION ALL SELECT doc_id, unit, pred, 0, 'missing_tuple', '', '' FROM (SELECT * FROM dp EXCEPT SELECT * FROM gp)
    UNION ALL SELECT doc_id, unit, pred, arg, CASE WHEN given_role IS NULL THEN 'missing_arg' WHEN role IS NULL THEN 'extra_arg' ELSE 'role_mismatch' END,
        coalesce(role, ''), coalesce(given_role, '') FROM pairs JOIN met USING (doc_id, unit, pred) WHERE role IS DISTINCT FROM given_role)"""
)

QUOTES = """
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM
    (SELECT doc_id, replace(replace(replace(replace(text, ' the ', ' «the '), ' of ', ' of» '), ' de ', ' “de '), ' en ', ' en” ') AS text FROM documents)),
chars AS (SELECT doc_id, line, unnest(string_split(text, '')) AS mark, generate_subscripts(string_split(text, ''), 1) - 1 AS col FROM raw_lines),
steps AS (SELECT *, CASE WHEN mark IN ('«', '“', '‘') THEN 1 ELSE -1 END AS step FROM chars WHERE mark IN ('«', '»', '“', '”', '‘', '’')),
levels AS (SELECT *, (sum(step) OVER (PARTITION BY doc_id ORDER BY line, col) + CASE WHEN step > 0 THEN 0 ELSE 1 END)::BIGINT AS depth FROM steps),
ends AS (SELECT *, lead(line) OVER w AS end_line, lead(col) OVER w AS end_col, lead(mark) OVER w AS end_mark FROM levels WINDOW w AS (PARTITION BY doc_id, depth ORDER BY line, col)),
forest AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, col) AS quote, line, col, end_line, end_col, mark, depth,
    CASE WHEN end_mark IS NULL THEN 'unclosed' WHEN mark || end_mark IN ('«»', '“”', '‘’') THEN '' ELSE 'mismatch' END AS error FROM ends WHERE step > 0 AND depth > 0)"""

CALLS = """
turns AS (SELECT conv_id, turn, length(text) AS n, '{"name": "read", "arguments": {"n": ' || length(text) || '}}' AS body FROM conversations),
blocks AS (SELECT conv_id, turn, 1 AS block, 'read' AS name, n, '' AS error FROM turns WHERE n % 5 IN (0, 3)
    UNION ALL SELECT conv_id, turn, 2, '', -1, 'no name' FROM turns WHERE n % 5 = 0
    UNION ALL SELECT conv_id, turn, 1, '', -1, 'unterminated' FROM turns WHERE n % 5 = 1
    UNION ALL SELECT conv_id, turn, 1, '', -1, 'not an object' FROM turns WHERE n % 5 = 2)"""

PRF = """round_even(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision, round_even(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall,
    round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1"""

CHILDREN = """SELECT doc_id, unit, head AS u, count(*) AS n_children, count(*) FILTER (deprel = 'nsubj') AS n_subj, count(*) FILTER (deprel = 'obj') AS n_obj,
    count(*) FILTER (deprel = 'case') AS n_case, count(*) FILTER (deprel IN ('aux', 'aux:pass', 'cop')) AS n_aux FROM edges WHERE head > 0 GROUP BY ALL"""

#: Nodes that hang from a root, level by level: what is left never reaches one.
ROOTED = """,
rooted AS (SELECT doc_id, unit, u FROM edges WHERE head = 0
    UNION ALL SELECT e.doc_id, e.unit, e.u FROM edges e JOIN rooted r ON e.doc_id = r.doc_id AND e.unit = r.unit AND e.head = r.u)"""


def climb(name: str, over: str, most: int = 8) -> str:
    """Walks up along some relations: every place on the way with the number of steps."""
    return f""",
{name} AS (SELECT doc_id, unit, u, u AS place, 0 AS steps FROM edges
    UNION ALL SELECT w.doc_id, w.unit, w.u, e.head, w.steps + 1 FROM {name} w JOIN edges e ON e.doc_id = w.doc_id AND e.unit = w.unit AND e.u = w.place
    WHERE w.steps < {most} AND e.deprel IN ({over}) AND e.head > 0)"""


SQL: dict[str, str] = {
    "pro_drop_features": f"""WITH {EDGES}, aux AS (SELECT doc_id, unit, head AS u, arg_min(person, u) AS ap, arg_min(number, u) AS an FROM edges
            WHERE deprel IN ('aux', 'aux:pass', 'cop') AND head > 0 AND person <> '' GROUP BY ALL)
        SELECT CASE WHEN person <> '' THEN person ELSE coalesce(ap, '') END AS person, CASE WHEN person <> '' THEN number ELSE coalesce(an, '') END AS number, count(*) AS n
        FROM edges LEFT JOIN aux USING (doc_id, unit, u) GROUP BY ALL""",
    "resolve_rows": f"""WITH {EDGES}, worded AS (SELECT a.*, coalesce(b.word, '') AS head_word FROM edges a LEFT JOIN edges b ON a.doc_id = b.doc_id AND a.unit = b.unit AND a.head = b.u),
        claimed AS (SELECT doc_id, unit, CASE WHEN h % 40 = 0 THEN head + 500 ELSE head END AS head, CASE WHEN h % 9 = 0 THEN reverse(head_word) ELSE lower(head_word) END AS head_word FROM worded)
        SELECT c.doc_id, CASE WHEN c.head = 0 THEN 'root' WHEN e.word IS NULL THEN 'no_such_token' WHEN lower(e.word) = lower(c.head_word) THEN 'ok' ELSE 'word_differs' END AS status, count(*) AS n
        FROM claimed c LEFT JOIN edges e ON c.doc_id = e.doc_id AND c.unit = e.unit AND c.head = e.u GROUP BY ALL""",
    "membership": f"""WITH RECURSIVE {FRAMES}{SPANS} SELECT g.doc_id, count(*) AS n FROM given g JOIN edges e ON g.doc_id = e.doc_id AND g.unit = e.unit AND g.arg = e.u WHERE g.arg > 0 AND e.pos NOT LIKE '%pronoun%'
        AND e.deprel NOT IN ('nsubj', 'nsubj:pass', 'csubj', 'csubj:pass', 'obj', 'iobj', 'attr', 'xcomp', 'ccomp', 'obl', 'obl:agent') AND (e.doc_id, e.unit, e.u) NOT IN (SELECT doc_id, unit, u FROM preds)
        AND (e.doc_id, e.line, e.token) NOT IN (SELECT doc_id, line, head FROM spans) GROUP BY ALL""",
    "section_lines": f"""WITH {LINES}, marked AS (SELECT *, length(text) < 40 AS is_header, max(CASE WHEN length(text) < 40 THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS header_line FROM lines)
        SELECT m.doc_id, m.line, m.header_line, h.text AS title, row_number() OVER (PARTITION BY m.doc_id, m.header_line ORDER BY m.line) AS place
        FROM marked m JOIN lines h ON m.doc_id = h.doc_id AND m.header_line = h.line WHERE NOT m.is_header""",
    "context_lines": f"WITH {LINES} SELECT doc_id, line, coalesce(lag(md5(text)) OVER (PARTITION BY doc_id ORDER BY line), '') AS before, md5(text) AS here FROM lines",
    "document_sample": "SELECT doc_id, lang FROM documents ORDER BY sha256('s' || doc_id), doc_id LIMIT 50",
    "span_violations": f"""WITH {MORPH}{SPANS}, moved AS (SELECT doc_id, line, start - CASE WHEN start % 5 = 1 THEN 1 ELSE 0 END AS start, "end" + CASE WHEN head % 4 = 0 THEN 2 ELSE 0 END AS "end",
            head + CASE WHEN start % 7 = 0 THEN 9 ELSE 0 END AS head FROM spans), per_line AS (SELECT doc_id, line, count(*) AS size FROM numbered GROUP BY ALL)
        SELECT doc_id, CASE WHEN start < 1 THEN 'start_out_of_line' WHEN "end" > size THEN 'end_out_of_line' ELSE 'head_outside' END AS kind, count(*) AS n FROM moved JOIN per_line USING (doc_id, line)
        WHERE start < 1 OR "end" > size OR head < start OR head > "end" GROUP BY ALL""",
    "span_occurrences": f"""WITH {MORPH}{SPANS}, worded AS (SELECT o.doc_id, o.line, o.ord, o.start, string_agg(n.word, ' ' ORDER BY n.token) AS words FROM ordered o JOIN numbered n
            ON o.doc_id = n.doc_id AND o.line = n.line AND n.token BETWEEN o.start AND o."end" GROUP BY ALL)
        SELECT doc_id, line, ord, words, row_number() OVER (PARTITION BY doc_id, line, words ORDER BY start, ord) AS occurrence FROM worded""",
    "violation_totals": f"""WITH RECURSIVE {DIVERGENCE} SELECT kind, count(*) AS n, count(*) FILTER (arg = 0) AS n_empty FROM divergence GROUP BY kind
        UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (arg = 0) FROM divergence""",
    "call_round_trip": "SELECT conv_id, turn, role AS name, true AS same FROM conversations",
    "lines_scan": f"WITH {LINES} SELECT doc_id, line, text FROM lines",
    "tokens_alpha": f"WITH {MORPH} SELECT doc_id, line, token, word FROM numbered",
    "tokens_full_elision": f"""WITH {LINES} SELECT doc_id, token, count(*) AS n FROM
        (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'th', ''''), '''?\\p{{L}}+''?|.', 0, 's')) AS token FROM lines) GROUP BY ALL""",
    "token_offsets": """SELECT item_id, "at", token, (stop - length(token))::BIGINT AS start_char, stop AS end_char FROM
        (SELECT *, sum(length(token)) OVER (PARTITION BY item_id ORDER BY "at")::BIGINT AS stop FROM
        (SELECT item_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS "at" FROM (SELECT item_id, regexp_extract_all(text, '''?\\p{L}+''?|.', 0, 's') AS ts FROM benchmark)))""",
    "lang_token_census": """SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens, count(DISTINCT word) AS n_types FROM
        (SELECT doc_id, lang, unnest(regexp_extract_all(text, '''?\\p{L}+''?')) AS word FROM documents) GROUP BY lang""",
    "top_tokens": """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '''?\\p{L}+''?')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20""",
    "sentence_units": f"WITH {GROUPED} SELECT doc_id, unit, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines FROM grouped GROUP BY ALL",
    "unit_split_long": """WITH RECURSIVE each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS ws FROM documents)),
        worded AS (SELECT doc_id, line, CASE WHEN length(word) % 7 = 0 THEN word || ';' ELSE word END AS text FROM each WHERE word <> ''),
        grouped AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS unit FROM worded),
        placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY line) AS p, regexp_matches(rtrim(text), '[;:]$') AS soft FROM grouped),
        lists AS (SELECT doc_id, unit, list(line ORDER BY p) AS ls, list(p ORDER BY p) FILTER (soft) AS softs, count(*) AS n FROM placed GROUP BY ALL),
        parts AS (SELECT doc_id, unit, ls, softs, n, 1 AS part, 0::BIGINT AS start FROM lists
            UNION ALL SELECT doc_id, unit, ls, softs, n, part + 1, coalesce(list_max(list_filter(coalesce(softs, []), lambda s: s > start AND s <= start + 12)), start + 12) FROM parts WHERE n - start > 12)
        SELECT doc_id, unit, part::BIGINT AS part, ls[start + 1] AS first_line, lead(start, 1, n) OVER (PARTITION BY doc_id, unit ORDER BY part) - start AS n_lines FROM parts""",
    "chunk_fixed": f"""WITH {LINES} SELECT doc_id, chunk, min(line) AS first_line, count(*) AS n_lines FROM
        (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) // 3 + 1 AS chunk FROM lines) GROUP BY ALL""",
    "chunk_packed": f"""WITH RECURSIVE {GROUPED}, sizes AS (SELECT doc_id, unit, count(*) AS n_lines FROM grouped GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS k FROM sizes),
        packed AS (SELECT doc_id, unit, n_lines, k, 1::BIGINT AS chunk, 4 - n_lines AS room FROM ranked WHERE k = 1
            UNION ALL SELECT r.doc_id, r.unit, r.n_lines, r.k, CASE WHEN r.n_lines <= p.room THEN p.chunk ELSE p.chunk + 1 END, CASE WHEN r.n_lines <= p.room THEN p.room ELSE 4 END - r.n_lines
            FROM ranked r JOIN packed p ON r.doc_id = p.doc_id AND r.k = p.k + 1)
        SELECT doc_id, unit, n_lines, chunk FROM packed""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "changed_artifacts": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING min(doc_id) = max(doc_id))",
    "range_spec": f"WITH {LINES} SELECT line, count(*) AS n, sum(length(text))::BIGINT AS chars FROM lines WHERE line = 1 OR line BETWEEN 3 AND 5 OR line >= 11 GROUP BY line",
    "roman_numbers": f"""WITH {LINES} SELECT doc_id, line, repeat('M', line // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][line // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][line // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][line % 10 + 1] AS roman,
        line AS parsed FROM lines""",
    "apostrophe_dictionary": f"""WITH {LINES} SELECT doc_id, line, coalesce((SELECT upper(min(b.text)) FROM benchmark b WHERE b.text = lines.text), replace(text, 'th', '''')) AS text FROM lines""",
    "table_cells": f"""WITH {LINES}, cut AS (SELECT doc_id, line, string_split(regexp_replace(trim(text), '^\\||\\|$', '', 'g'), '|') AS cs FROM lines WHERE contains(text, '|'))
        SELECT doc_id, line, len(cs) AS n_cells, generate_subscripts(cs, 1) AS "column", trim(unnest(cs)) AS cell, TRY_CAST(regexp_replace(trim(unnest(cs)), '[^0-9]', '', 'g') AS INTEGER)::BIGINT AS number FROM cut""",
    "loose_word_match": f"""WITH {MORPH}, surfaces AS (SELECT doc_id, line, unnest(string_split(text, ' ')) AS surface, generate_subscripts(string_split(text, ' '), 1) AS token FROM lines)
        SELECT doc_id, CASE WHEN surface = word OR (starts_with(surface, word) AND NOT regexp_matches(substr(surface, length(word) + 1), '[\\p{{L}}'']')) OR word = surface || '''' OR word = '''' || surface
            OR surface = word || '''' OR surface = '''' || word THEN 'same' ELSE 'other' END AS verdict, count(*) AS n FROM surfaces JOIN numbered USING (doc_id, line, token) GROUP BY ALL""",
    "quote_forest": f"WITH {QUOTES} SELECT * FROM forest",
    "quote_ids": f"""WITH {QUOTES}, counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY col) AS k, count(*) OVER (PARTITION BY doc_id, line) AS n FROM forest)
        SELECT doc_id, quote, line || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr((64 + k)::INTEGER) ELSE k::VARCHAR END AS quote_id FROM counted""",
    "quote_overlap": f"WITH {QUOTES} SELECT doc_id, quote, line, end_line FROM forest WHERE error = '' AND line <= 3 AND end_line >= 2",
    "pos_census": f"""WITH {MORPH} SELECT pos, count(*) AS n, sum(CASE WHEN pos = 'pronoun + pronoun' THEN 2 WHEN pos LIKE '%pronoun' THEN 1 ELSE 0 END)::BIGINT AS slots, count(*) FILTER (pos LIKE 'verb%') AS verbs,
        count(*) FILTER (pos LIKE '%noun%' AND NOT contains(note, 'NO_NP') AND NOT contains(note, 'CONT_NEXT')) AS content FROM morph GROUP BY pos""",
    "case_canon": f'WITH {MORPH}{CASES} SELECT "case", {CANON} AS canonical, count(*) AS n FROM cases GROUP BY ALL',
    "case_value_census": f"WITH {MORPH}{CASES} SELECT word, value, count(*) AS n FROM (SELECT word, unnest(string_split({CANON}, '+')) AS value FROM cases) GROUP BY ALL",
    "clitic_mentions": f"WITH {MORPH} SELECT doc_id, line, token, '+si' AS mention FROM morph WHERE pos = 'verb + pronoun'",
    "coverage_left_join": f"""WITH {MORPH}{CASES} SELECT doc_id, line, coalesce(n, 0) AS n_cases FROM lines LEFT JOIN (SELECT doc_id, line, count(*) AS n FROM cases GROUP BY ALL) USING (doc_id, line)""",
    "np_nesting": f"""WITH {MORPH}{SPANS} SELECT doc_id, line, ord, start, "end", head, coalesce((SELECT max(o.ord) FROM ordered o WHERE o.doc_id = i.doc_id AND o.line = i.line AND o.ord < i.ord
        AND o.start <= i.start AND o."end" >= i."end" AND NOT (o.start = i.start AND o."end" = i."end")), 0) AS parent FROM ordered i""",
    "np_widest_head": f"""WITH {MORPH}{SPANS} SELECT doc_id, line, head, start, "end" FROM ordered QUALIFY row_number() OVER (PARTITION BY doc_id, line, head ORDER BY "end" - start DESC, ord) = 1""",
    "np_first_head": f"""WITH {MORPH}{SPANS} SELECT doc_id, line, head, start, "end" FROM ordered QUALIFY row_number() OVER (PARTITION BY doc_id, line, head ORDER BY ord) = 1""",
    "np_role_join": f"""WITH {EDGES}{SPANS} SELECT coalesce(deprel, '') AS role, count(*) AS n, sum("end" - start + 1)::BIGINT AS tokens FROM spans s
        LEFT JOIN edges e ON s.doc_id = e.doc_id AND s.line = e.line AND s.head = e.token GROUP BY ALL""",
    "head_word_join": f"""WITH {EDGES} SELECT a.doc_id, a.unit, a.u, a.word, a.deprel, a.head, coalesce(b.word, '') AS head_word FROM edges a
        LEFT JOIN edges b ON a.doc_id = b.doc_id AND a.unit = b.unit AND a.head = b.u""",
    "dep_children": f"WITH {EDGES} {CHILDREN}",
    "dep_multi_obj": f"WITH {EDGES} SELECT doc_id, unit, u, n_obj FROM ({CHILDREN}) WHERE n_obj > 1",
    "dep_cycle_check": f"""WITH RECURSIVE {EDGES}{ROOTED} SELECT doc_id, rooted, n FROM (
        SELECT e.doc_id, r.u IS NOT NULL AS rooted, count(*) AS n FROM edges e LEFT JOIN rooted r ON e.doc_id = r.doc_id AND e.unit = r.unit AND e.u = r.u GROUP BY ALL)""",
    "dep_violations": f"""WITH RECURSIVE {EDGES}{ROOTED}, found AS (
        SELECT doc_id, CASE WHEN n = 0 THEN 'no_root' ELSE 'many_roots' END AS kind FROM (SELECT doc_id, unit, count(*) FILTER (head = 0) AS n FROM edges GROUP BY ALL) WHERE n <> 1
        UNION ALL SELECT doc_id, 'root_label' FROM edges WHERE (head = 0) <> (deprel = 'root')
        UNION ALL SELECT doc_id, 'self_head' FROM edges WHERE head = u
        UNION ALL SELECT e.doc_id, 'cycle' FROM edges e LEFT JOIN rooted r ON e.doc_id = r.doc_id AND e.unit = r.unit AND e.u = r.u WHERE r.u IS NULL
        UNION ALL SELECT doc_id, 'double_obj' FROM ({CHILDREN}) WHERE n_obj > 1) SELECT doc_id, kind, count(*) AS n FROM found GROUP BY ALL""",
    "bounded_walks": f"""WITH RECURSIVE {EDGES}{climb("c", "'conj', 'appos', 'flat', 'compound'")}{climb("a", "'aux', 'aux:pass', 'cop'")}{climb("p", "'fixed', 'case'")}
        SELECT doc_id, unit, u, coord_head, aux_head, prep_head FROM (SELECT doc_id, unit, u, arg_max(place, steps) AS coord_head FROM c GROUP BY ALL)
        JOIN (SELECT doc_id, unit, u, arg_max(place, steps) AS aux_head FROM a GROUP BY ALL) USING (doc_id, unit, u)
        JOIN (SELECT doc_id, unit, u, arg_max(place, steps) AS prep_head FROM p GROUP BY ALL) USING (doc_id, unit, u)""",
    "agreement_verdict": f"WITH RECURSIVE {EDGES}, {AGREEMENT} SELECT v[1] AS verdict, v[2] AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "case_dep_adjudication": f"""WITH {EDGES}{CASES} SELECT c."case", deprel, verdict, count(*) AS n FROM (SELECT {CANON} AS "case", doc_id, unit, u FROM cases) c
        JOIN (SELECT doc_id, unit, u, deprel FROM edges) USING (doc_id, unit, u), LATERAL (SELECT {ADJUDICATED} AS verdict) GROUP BY ALL""",
    "agreement_rates": f"""WITH {EDGES}{CASES}, v AS (SELECT deprel, {ADJUDICATED} AS verdict FROM (SELECT {CANON} AS "case", doc_id, unit, u FROM cases) c JOIN (SELECT doc_id, unit, u, deprel FROM edges) USING (doc_id, unit, u)),
        counts AS (SELECT deprel, count(*) FILTER (verdict = 'agree') AS agree, count(*) FILTER (verdict = 'contradict') AS contradict FROM v WHERE deprel IN ('obj', 'iobj', 'nsubj') GROUP BY deprel)
        SELECT *, CASE WHEN agree + contradict = 0 THEN 0.0 ELSE round_even(agree / (agree + contradict), 4) END AS rate FROM counts""",
    "case_supports": f"""WITH RECURSIVE {FRAMES}, held AS (SELECT {CANON} AS value, CASE WHEN role LIKE 'obl:%' AND role <> 'obl:a' THEN 'obl:x' ELSE role END AS role FROM cases c JOIN args a ON c.doc_id = a.doc_id AND c.unit = a.unit AND c.u = a.arg)
        SELECT value, role, (value = 'nominative' AND role = 'subj') OR (value = 'accusative' AND role = 'obj') OR (value = 'dative' AND role IN ('iobj', 'obl:a')) OR (value IN ('ablative', 'locative') AND role LIKE 'obl%') AS supports, count(*) AS n FROM held GROUP BY ALL""",
    "derive_predicates": f"WITH RECURSIVE {FRAMES} SELECT * FROM preds",
    "derive_args": f"WITH RECURSIVE {FRAMES} SELECT * FROM args",
    "derive_frames": f"WITH RECURSIVE {FRAMES} SELECT * FROM derived",
    "control_subjects": f"""WITH RECURSIVE {FRAMES}, silent AS (SELECT doc_id, unit, pred AS u FROM raw_frames GROUP BY ALL HAVING NOT bool_or(role = 'subj')),
        ends AS (SELECT doc_id, unit, pred AS u, bool_or(arg = 0) AS void FROM raw_frames WHERE role = 'subj' GROUP BY ALL),
        steps AS (SELECT s.doc_id, s.unit, s.u, e.head AS place, e.deprel LIKE 'acl%' AS hangs, 1 AS k, [s.u] AS seen FROM silent s JOIN edges e USING (doc_id, unit, u) WHERE e.head > 0 AND e.head <> s.u
            UNION ALL SELECT s.doc_id, s.unit, s.u, e.head, e.deprel LIKE 'acl%', s.k + 1, list_append(s.seen, s.place) FROM steps s JOIN edges e ON e.doc_id = s.doc_id AND e.unit = s.unit AND e.u = s.place
                WHERE s.k < 8 AND e.head > 0 AND e.head <> s.place AND NOT list_contains(s.seen, e.head) AND (s.doc_id, s.unit, s.place) NOT IN (SELECT doc_id, unit, u FROM ends)),
        pronoun AS (SELECT r.doc_id, r.unit, c.head AS place, r.u FROM edges r JOIN edges c ON c.doc_id = r.doc_id AND c.unit = r.unit AND c.u = r.head WHERE r.deprel IN {SUBJ} AND rtrim(lower(r.word), ) IN ('che', 'ch', 'cui', 'chi') AND c.deprel = 'acl:relcl')
        SELECT s.doc_id, s.unit, s.u, f.arg AS candidate, false AS open FROM steps s JOIN raw_frames f ON f.doc_id = s.doc_id AND f.unit = s.unit AND f.pred = s.place WHERE f.arg > 0 AND (f.role IN ('subj', 'obj', 'iobj') OR f.role LIKE 'obl%')
        UNION SELECT doc_id, unit, u, place, false FROM steps WHERE hangs UNION SELECT s.doc_id, s.unit, s.u, p.u, false FROM steps s JOIN pronoun p ON p.doc_id = s.doc_id AND p.unit = s.unit AND p.place = s.place WHERE hangs
        UNION SELECT s.doc_id, s.unit, s.u, place, false FROM steps s JOIN edges e ON e.doc_id = s.doc_id AND e.unit = s.unit AND e.u = s.place WHERE e.pos IN ('verb + pronoun', 'pronoun + pronoun')
        UNION SELECT s.doc_id, s.unit, s.u, NULL, true FROM steps s JOIN ends e ON e.doc_id = s.doc_id AND e.unit = s.unit AND e.u = s.place WHERE void""",
    "frame_derivation": f"WITH RECURSIVE {FRAMES} SELECT * FROM raw_frames",
    "tuple_grouping": f"""WITH RECURSIVE {FRAMES} SELECT doc_id, unit, pred, coalesce(string_agg(role || '=' || arg, ' ' ORDER BY {RANK}, arg, role) FILTER (role <> ''), '') AS args FROM derived GROUP BY ALL""",
    "divergence_classes": f"WITH RECURSIVE {DIVERGENCE} SELECT * FROM divergence",
    "violation_stats": f"WITH RECURSIVE {DIVERGENCE} SELECT kind, role, given_role, count(*) AS n, count(*) FILTER (arg = 0) AS n_empty FROM divergence GROUP BY ALL",
    "null_subject_repair": f"""WITH RECURSIVE {DIVERGENCE} SELECT doc_id, unit, pred, min(arg) FILTER (kind = 'missing_arg' AND role = 'subj' AND arg > 0) AS arg FROM divergence GROUP BY ALL
        HAVING count(*) FILTER (kind = 'missing_arg' AND role = 'subj' AND arg > 0) = 1 AND count(*) FILTER (kind = 'extra_arg' AND given_role = 'subj' AND arg = 0) = 1""",
    "dual_role": f"WITH RECURSIVE {FRAMES} SELECT doc_id, unit, pred, arg, count(DISTINCT role) AS n_roles FROM given WHERE arg > 0 GROUP BY ALL HAVING count(DISTINCT role) > 1",
    "role_prf": f"""WITH RECURSIVE {FRAMES}, g AS (SELECT DISTINCT *, 1 AS g FROM derived), m AS (SELECT DISTINCT *, 1 AS m FROM given),
        counts AS (SELECT role, count(*) FILTER (g = 1 AND m = 1) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (m IS NULL) AS fn FROM g FULL JOIN m USING (doc_id, unit, pred, role, arg) GROUP BY role)
        SELECT *, {PRF} FROM counts""",
    "set_diff_rows": f"WITH RECURSIVE {FRAMES} SELECT doc_id, unit, pred, role, arg FROM derived EXCEPT ALL SELECT doc_id, unit, pred, role, arg FROM given",
    "role_canon": f"""WITH {EDGES}, each_role AS (SELECT unnest([deprel, 'obl:' || lemma, 'attr', 'iobj']) AS role FROM edges), {FORMS}
        SELECT role, CASE role WHEN 'attr' THEN 'xcomp' WHEN 'iobj' THEN 'obl:a' ELSE coalesce('obl:' || f.name, role) END AS canonical, {RANK}::BIGINT AS rank,
            role IN ('subj', 'obj', 'iobj', 'attr', 'xcomp', 'ccomp', 'obl') OR regexp_full_match(role, 'obl:[a-zàèéìòù'']+') AS valid, count(*) AS n FROM each_role LEFT JOIN forms f ON role = 'obl:' || f.form GROUP BY ALL""",
    "search_tokens": f"""WITH {EDGES} SELECT doc_id, line, token, word, lemma, deprel FROM edges WHERE doc_id <> 7 AND pos LIKE '%verb%' AND deprel = 'obl' AND person = '3' ORDER BY doc_id, line, token LIMIT 40""",
    "read_unit": f"""WITH {EDGES}{SPANS}{CASES}, wide AS (SELECT doc_id, line, head AS token, start, "end" FROM ordered QUALIFY row_number() OVER (PARTITION BY doc_id, line, head ORDER BY "end" - start DESC, ord) = 1)
        SELECT a.doc_id, a.unit, a.line, a.token, a.word, a.pos, a.deprel, coalesce(b.word, '') AS head_word, coalesce(c."case", '') AS "case", coalesce(w.start, 0) AS start, coalesce(w."end", 0) AS "end"
        FROM edges a LEFT JOIN edges b ON a.doc_id = b.doc_id AND a.unit = b.unit AND a.head = b.u LEFT JOIN cases c ON a.doc_id = c.doc_id AND a.unit = c.unit AND a.u = c.u
        LEFT JOIN wide w ON a.doc_id = w.doc_id AND a.line = w.line AND a.token = w.token""",
    "resume_pending": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_prf": f"""WITH counts AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fn
        FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT *, {PRF} FROM counts""",
    "majority_vote": f"""WITH {LINES}, counts AS (SELECT doc_id, 'a' || length(text) % 3 AS answer, count(*) AS votes, min(line) AS seen FROM lines GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, seen) AS k, sum(votes) OVER (PARTITION BY doc_id)::BIGINT AS n FROM counts)
        SELECT doc_id, answer AS winner, votes, n, CASE WHEN votes = n THEN 'unanimous' WHEN votes * 2 > n THEN 'majority' ELSE 'split' END AS verdict FROM ranked WHERE k = 1""",
    "latest_submission": "SELECT conv_id, turn, role, length(text) AS chars FROM conversations QUALIFY rank() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    "first_pass": """WITH a AS (SELECT conv_id, role, length(text) AS first_chars FROM conversations QUALIFY rank() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1),
        z AS (SELECT conv_id, role, length(text) AS last_chars FROM conversations QUALIFY rank() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1)
        SELECT *, first_chars >= last_chars AS held FROM a JOIN z USING (conv_id, role)""",
    "session_metrics": """WITH per AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id)
        SELECT turns, count(*) AS sessions, sum(answers)::BIGINT AS answers, max(chars) AS max_chars, round(avg(chars), 4) AS mean_chars FROM per GROUP BY turns""",
    "toolcall_parse": f"WITH {CALLS} SELECT conv_id, turn, block::BIGINT AS block, name, n, error FROM blocks",
    "turn_classification": f"""WITH {CALLS}, counts AS (SELECT t.conv_id, t.turn, count(b.block) AS blocks, count(*) FILTER (b.error = '') AS good FROM turns t LEFT JOIN blocks b USING (conv_id, turn) GROUP BY ALL),
        seen AS (SELECT *, coalesce(sum(good) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)
        SELECT conv_id, turn, CASE WHEN good > 0 THEN 'call' WHEN blocks > 0 THEN 'malformed' WHEN before > 0 THEN 'prose_after_call' ELSE 'prose' END AS kind FROM seen""",
}
