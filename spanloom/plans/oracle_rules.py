"""DuckDB counterparts of the rule queries. The rules are stated here anew, from what they mean."""

from __future__ import annotations

from spanloom.plans.oracle import ARGS, CANON, DIVERGENCE, climb

CONTEXT = (
    DIVERGENCE
    + climb("a", "'aux', 'aux:pass', 'cop'", 8)
    + climb("c", "'conj', 'appos', 'flat', 'compound'", 8)
    + climb("j", "'conj'", 16)
    + """,
aux_ends AS (SELECT doc_id, unit, u, arg_max(place, steps) AS aux FROM a GROUP BY ALL), coord_ends AS (SELECT doc_id, unit, u, arg_max(place, steps) AS coord FROM c GROUP BY ALL),
tops AS (SELECT doc_id, unit, u, arg_max(place, steps) AS top FROM j GROUP BY ALL),
kids AS (SELECT doc_id, unit, head AS u, list(lemma) FILTER (deprel = 'case') AS preps, list(lemma) FILTER (deprel IN ('case', 'mark')) AS marks, count(*) FILTER (deprel = 'case') AS n_case, count(*) FILTER (deprel = 'cop') AS n_cop,
    count(*) FILTER (deprel IN ('det', 'amod')) AS n_det, count(*) FILTER (deprel IN ('obl', 'ccomp', 'xcomp', 'advcl')) AS n_comp, count(*) FILTER (deprel = 'orphan') AS n_orphan,
    count(*) FILTER (deprel IN ARGSLIST) AS n_args FROM edges WHERE head > 0 GROUP BY ALL),
tok AS (SELECT e.doc_id, e.unit, e.u, e.pos, e.lemma, e.deprel, e.head, x.aux, coalesce(h.aux, 0) AS host, o.coord, t.top, k.preps, k.marks, coalesce(k.n_case, 0) AS n_case, coalesce(k.n_cop, 0) AS n_cop, coalesce(k.n_det, 0) AS n_det,
    coalesce(k.n_comp, 0) AS n_comp, coalesce(k.n_orphan, 0) AS n_orphan, coalesce(k.n_args, 0) AS n_args, string_split(CANON, '+') AS slots, p.u IS NOT NULL AS is_pred
    FROM edges e JOIN aux_ends x USING (doc_id, unit, u) JOIN coord_ends o USING (doc_id, unit, u) JOIN tops t USING (doc_id, unit, u) LEFT JOIN aux_ends h ON e.doc_id = h.doc_id AND e.unit = h.unit AND e.head = h.u
    LEFT JOIN kids k ON e.doc_id = k.doc_id AND e.unit = k.unit AND e.u = k.u LEFT JOIN cases c ON e.doc_id = c.doc_id AND e.unit = c.unit AND e.u = c.u LEFT JOIN preds p ON e.doc_id = p.doc_id AND e.unit = p.unit AND e.u = p.u),
dl AS (SELECT doc_id, unit, pred, list({'a': arg, 'r': role}) AS d, list(arg ORDER BY arg) FILTER (role = 'subj' AND arg > 0) AS subs FROM best_derived GROUP BY ALL),
gl AS (SELECT doc_id, unit, pred, list({'a': arg, 'r': given_role}) AS g FROM best_given GROUP BY ALL),
void AS (SELECT doc_id, unit, pred FROM derived GROUP BY ALL HAVING bool_and(role = '')),
cited AS (SELECT DISTINCT t.doc_id, t.unit, t.aux AS pred FROM tok t JOIN gp ON t.doc_id = gp.doc_id AND t.unit = gp.unit AND t.u = gp.pred WHERE t.deprel IN ('aux', 'aux:pass', 'cop')),
rel AS (SELECT doc_id, unit, u AS pred, head AS other, 'control' AS link FROM edges WHERE deprel = 'xcomp' AND head > 0 AND head <> u UNION SELECT doc_id, unit, head, u, CASE WHEN deprel = 'xcomp' THEN 'control' ELSE 'aux' END FROM edges
    WHERE deprel IN ('xcomp', 'aux', 'aux:pass', 'cop') AND head > 0 AND head <> u),
near AS (SELECT r.doc_id, r.unit, r.pred, b.arg, list(link || '>' || side || '>' || role) AS near FROM rel r JOIN (SELECT doc_id, unit, pred, arg, 'g' AS side, given_role AS role FROM best_given UNION ALL SELECT doc_id, unit, pred, arg, 'd', role FROM best_derived) b
    ON r.doc_id = b.doc_id AND r.unit = b.unit AND r.other = b.pred GROUP BY ALL),
ctx AS (SELECT v.doc_id, v.unit, v.pred, v.arg, v.kind, v.role, v.given_role AS grole, coalesce(a.pos, '') AS apos, coalesce(a.lemma, '') AS alem, coalesce(a.deprel, '') AS arel, coalesce(a.head, 0) AS ahead, coalesce(a.head = v.pred OR a.host = v.pred, false) AS hosted,
    coalesce(a.preps, []) AS preps, coalesce(a.marks, []) AS marks, coalesce(a.n_case, 0) AS acase, coalesce(a.n_det, 0) AS adet, coalesce(a.n_orphan, 0) AS aorphan, coalesce(a.n_args, 0) AS aargs, coalesce(a.slots, []) AS slots,
    coalesce(h.deprel, '') AS hrel, coalesce(h.head, 0) AS hhead, coalesce(h.n_case, 0) AS hcase, coalesce(h.coord, 0) AS hcoord, p.pos AS ppos, p.lemma AS plem, p.deprel AS prel, p.head AS phead, p.n_cop AS pcop, p.n_comp AS pcomp,
    x.n_cop AS xcop, p.aux <> v.pred AND x.is_pred AS xpred, t.deprel AS trel, t.pos AS tpos, coalesce(dl.d, []) AS d, coalesce(dl.subs, []) AS subs, coalesce(gl.g, []) AS g, void.pred IS NOT NULL AS void, cited.pred IS NOT NULL AS cited, coalesce(near.near, []) AS near, gp.pred IS NOT NULL AS agiven
    FROM divergence v JOIN tok p ON v.doc_id = p.doc_id AND v.unit = p.unit AND v.pred = p.u LEFT JOIN tok a ON v.doc_id = a.doc_id AND v.unit = a.unit AND v.arg = a.u LEFT JOIN tok h ON a.doc_id = h.doc_id AND a.unit = h.unit AND a.head = h.u
    LEFT JOIN tok x ON p.doc_id = x.doc_id AND p.unit = x.unit AND p.aux = x.u LEFT JOIN tok t ON p.doc_id = t.doc_id AND p.unit = t.unit AND p.top = t.u
    LEFT JOIN dl ON v.doc_id = dl.doc_id AND v.unit = dl.unit AND v.pred = dl.pred LEFT JOIN gl ON v.doc_id = gl.doc_id AND v.unit = gl.unit AND v.pred = gl.pred LEFT JOIN void ON v.doc_id = void.doc_id AND v.unit = void.unit AND v.pred = void.pred
    LEFT JOIN cited ON v.doc_id = cited.doc_id AND v.unit = cited.unit AND v.pred = cited.pred LEFT JOIN near ON v.doc_id = near.doc_id AND v.unit = near.unit AND v.pred = near.pred AND v.arg = near.arg
    LEFT JOIN gp ON v.doc_id = gp.doc_id AND v.unit = gp.unit AND v.arg = gp.pred)""".replace("ARGSLIST", ARGS).replace("CANON", CANON.replace('"case"', 'c."case"'))
)

#: By kind of difference: what makes it acceptable. ``X`` is the preposition of a given oblique.
X = "split_part(grole, ':', 2)"
NOM = "regexp_matches(apos, 'adjective|noun') AND NOT contains(apos, 'pronoun')"
BARE = "grole LIKE 'obl:%'"
AVERB, PVERB = "regexp_matches(apos, '(^|[^a-z])verb')", "regexp_matches(ppos, '(^|[^a-z])verb')"
CLITIC = "arel IN ('obj', 'iobj', 'obl') AND hosted AND contains(apos, 'pronoun') AND list_contains(slots, 'reflexive')"
NARROW = "IN ('obj', 'iobj', 'obl', 'obl:a')"


def fits(case: str, role: str) -> str:
    return (
        f"(({role} = 'subj' AND {case} = 'nominative') OR ({role} = 'obj' AND {case} = 'accusative') OR ({role} IN ('iobj', 'obl:a') AND {case} = 'dative') "
        f"OR ({role} LIKE 'obl%' AND {case} IN ('ablative', 'locative')))"
    )


def able(role: str) -> str:
    return f"list_filter(slots, lambda s: {fits('s', role)} OR (s = 'reflexive' AND {role} IN ('obj', 'iobj', 'obl:a')))"


def role_in(frame: str, arg: str, role: str) -> str:
    return f"len(list_filter({frame}, lambda e: e.a = {arg} AND e.r = {role})) > 0"


RULES: dict[str, dict[str, str]] = {
    "missing_tuple": {"CS": "void", "AV": "cited"},
    "extra_tuple": {
        "I": "xpred",
        "Y": f"(prel IN ('conj', 'appos', 'attr') AND NOT {PVERB}) OR pcop + xcop > 0",
        "Z1": f"{PVERB} AND prel IN ('nsubj', 'obj', 'iobj', 'obl', 'nmod', 'appos', 'attr', 'expl')",
        "AY": "prel = 'amod' AND ppos = 'adjective' AND pcomp > 0",
        "CH": f"prel = 'conj' AND {PVERB} AND trel IN ('amod', 'acl', 'acl:relcl') AND tpos LIKE 'verb%'",
    },
    "missing_arg": {
        "CY": "role[2:] = 'comp' AND agiven",
        "Z2": f"{AVERB} AND agiven",
        "BM": "role LIKE 'obl%' AND contains(apos, 'conjunction')",
        "AW": f"role {NARROW} AND {CLITIC}",
        "BX": "role = 'obl' AND arel = 'obl' AND apos = 'adjective' AND hosted AND acase = 0",
        "DW": "role = 'xcomp' AND arel = 'attr' AND apos = 'adjective' AND hosted AND acase = 0 AND len(list_filter(d, lambda e: e.r <> 'subj' AND e.r <> 'xcomp')) > 0",
        "BA": "role = 'subj' AND arg > 0 AND len(subs) > 1 AND len(list_filter(g, lambda e: e.r = 'subj' AND list_contains(subs, e.a))) > 0",
        "CW": "len(subs) > 1 AND arg > subs[-1]",
        "DH": f"arg > 0 AND len(subs) > 1 AND arg < subs[-1] AND {role_in('g', 'subs[-1]', chr(39) + 'subj' + chr(39))}",
        "DI": "agiven AND aorphan > 0 AND ahead = pred AND arg > 0",
        "AX1": "list_contains(near, 'control>g>' || role)",
        "BY": "list_contains(near, 'aux>g>' || role)",
    },
    "role_mismatch": {
        "L": f"role = 'obl' AND {BARE} AND acase = 0",
        "M": "grole = 'xcomp' AND role IN ('subj', 'obj')",
        "N": f"{BARE} AND role IN ('subj', 'obj') AND list_contains(preps, {X})",
        "O": f"{BARE} AND role LIKE 'obl:%' AND list_contains(preps, {X})",
        "P": "(grole = 'ccomp' AND role = 'xcomp') OR (grole = 'xcomp' AND role = 'ccomp')",
        "Q": f"grole = 'ccomp' AND role IN ('subj', 'obj') AND {AVERB}",
        "U": f"apos = 'pronoun' AND len(slots) = 1 AND {fits('slots[1]', 'role')} AND NOT {fits('slots[1]', 'grole')}",
        "AL": f"apos = 'pronoun + pronoun' AND ((grole = 'obj' AND role = 'obl:a') OR (grole = 'obl:a' AND role = 'obj') OR (len(slots) = 2 AND len({able('role')}) > 0 AND len({able('grole')}) > 0 AND {able('role')} <> {able('grole')}))",
        "AZ": f"grole = 'xcomp' AND role = 'obl' AND arel = 'obl' AND {NOM} AND hosted AND acase = 0",
        "CQ": f"{BARE} AND role = 'xcomp' AND hosted AND list_contains(marks, {X})",
        "BD": f"{CLITIC} AND grole {NARROW} AND role {NARROW}",
        "DB": "plem = 'essere' AND grole = 'xcomp' AND role LIKE 'obl%' AND arel = 'obl' AND hosted AND len(list_filter(d, lambda e: e.r = 'xcomp' AND e.a <> arg)) = 0",
    },
    "extra_arg": {
        "J": "grole LIKE 'obl%' AND arel = 'advmod' AND hosted AND regexp_matches(apos, 'adverb|noun')",
        "R": f"grole = 'xcomp' AND arel = 'advmod' AND hosted AND {NOM}",
        "S": f"{BARE} AND arel = 'nmod' AND hosted AND list_contains(preps, {X})",
        "T": f"{BARE} AND arel = 'advcl' AND hosted AND list_contains(marks, {X})",
        "AA": "grole IN ('xcomp', 'ccomp') AND arel IN ('acl', 'acl:relcl') AND len(list_filter(d, lambda e: e.a = ahead OR e.a = hcoord)) > 0",
        "AU": "grole = 'xcomp' AND arel IN ('amod', 'advmod') AND apos = 'adjective' AND len(list_filter(d, lambda e: e.a = ahead OR e.a = hcoord)) > 0",
        "BH": "grole = 'subj' AND arg = 0 AND len(list_filter(g, lambda e: e.r = 'xcomp' AND len(list_filter(d, lambda f: f.a = e.a AND f.r = 'subj')) > 0)) > 0",
        "BI": "grole = 'obj' AND arel IN ('nsubj', 'nsubj:pass') AND hrel IN ('xcomp', 'ccomp') AND hhead = pred",
        "BF": f"grole = 'xcomp' AND arel = 'cop' AND hosted AND {NOM} AND NOT contains(apos, 'verb')",
        "AB": f"arel = 'expl' AND contains(apos, 'pronoun') AND hosted AND (grole IN ('obj', 'iobj', 'obl:a') OR (len(slots) > 1 AND len(list_filter(slots, lambda s: {fits('s', 'grole')})) > 0))",
        "AD": "plem = 'essere' AND grole = 'xcomp' AND arel = 'advmod' AND apos = 'adverb' AND hosted",
        "AE": f"contains(apos, 'pronoun') AND arel IN ('nsubj', 'nsubj:pass') AND ahead <> pred AND {role_in('d', 'ahead', 'grole')}",
        "BT": "prel = 'acl:relcl' AND phead = arg AND contains(apos, 'pronoun') AND alem IN ('chi', 'che', 'quale') AND adet = 0",
        "CT": f"grole = 'xcomp' AND plem = 'essere' AND prel IN ('root', 'ccomp', 'xcomp', 'advcl', 'acl:relcl', 'parataxis') AND phead = arg AND arg > 0 AND {NOM}",
        "BW": "arel = 'mark' AND hosted AND regexp_matches(apos, 'pronoun|adjective|adverb')",
        "AX2": "list_contains(near, 'control>d>' || grole)",
        "CG": f"arel IN ('amod', 'det', 'nummod') AND hcase > 1 AND {role_in('d', 'ahead', 'grole')}",
        "CC": f"arel = 'conj' AND ahead = pred AND NOT {AVERB} AND apos <> 'conjunction' AND aargs = 0",
        "DA": "grole <> 'subj' AND void",
        "DD": "grole LIKE 'obl%' AND arel = 'case' AND ahead = pred AND (contains(apos, 'adverb') OR alem IN ('dove', 'ove', 'onde'))",
        "EA": f"grole <> 'subj' AND prel = 'parataxis' AND NOT {PVERB} AND len(d) = 1 AND {role_in('d', '0', chr(39) + 'subj' + chr(39))}",
    },
}
IDS = [r for rules in RULES.values() for r in rules]
HITS = "list_filter(CASE kind " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules.items()) + "]" for k, rules in RULES.items()) + " END, lambda x: x IS NOT NULL)"

SQL: dict[str, str] = {
    "rule_census": f"""WITH RECURSIVE {CONTEXT}, hits AS (SELECT {HITS} AS rs FROM ctx), counts AS (SELECT unnest(rs) AS rule_id, len(rs) = 1 AS sole FROM hits)
        SELECT rule_id, count(counts.rule_id) AS hits, count(*) FILTER (sole) AS sole FROM (SELECT unnest({IDS}) AS rule_id) LEFT JOIN counts USING (rule_id) GROUP BY rule_id""",
    "residual_violations": f"""WITH RECURSIVE {CONTEXT} SELECT doc_id, unit, pred, arg, kind, role, grole AS given_role FROM ctx WHERE len({HITS}) = 0""",
    "rule_ablation": f"""WITH RECURSIVE {CONTEXT}, hits AS (SELECT kind, {HITS} AS rs FROM ctx), off AS (SELECT unnest({['', *IDS]}) AS disabled)
        SELECT disabled, kind, count(*) AS n FROM hits, off WHERE len(list_filter(rs, lambda x: x <> disabled)) = 0 GROUP BY ALL""",
}
