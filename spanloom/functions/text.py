"""Tokens, cells and closed vocabularies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cases and other names for them.
CASE_NAMES = {
    "nominative": "nom nominativo",
    "accusative": "acc accusativo",
    "dative": "dat dativo",
    "genitive": "gen genitivo",
    "ablative": "abl ablativo oblique partitive comitative instrumental",
    "locative": "loc locativo",
    "vocative": "voc vocativo",
    "reflexive": "refl riflessivo expletive impersonal reciprocal",
}
CASE_ALIASES = {alias: name for name, aliases in CASE_NAMES.items() for alias in aliases.split()}
#: Prepositions and their written forms.
PREPOSITIONS = {
    "senza": "sanza sanz sanz' sans",
    "sopra": "sovra sovr' sovr sor sovresso",
    "di": "de de' d' del dei dello della delle degli",
    "da": "dal da' dai dallo dalla dalle dagli",
    "a": "ad al a' ai alo allo alla alle agli ab",
    "con": "col coi co' co collo colla",
    "su": "sul su' sù sui sullo sulla",
    "per": "pel pei pe'",
    "contro": "contra contr contr'",
    "verso": "ver ver'",
    "in": "nel nei ne ne' n' nella nello nelle 'n inver inver' 'nver 'nver' inverso 'nverso invero",
    "fino": "fin infin infine infino 'nfino insin insino",
    "tra": "tr' fra intra infra",
    "incontra": "incontr incontr' incontro 'ncontro",
    "innanzi": "'nnanzi nnanzi",
    "intorno": "dintorno d'intorno",
    "lungo": "lunghesso lungh'",
    "sotto": "sott'",
    "appresso": "apo",
}
PREPOSITION_OF = {form: name for name, forms in PREPOSITIONS.items() for form in forms.split()}
#: Short forms of cells by column.
SHORT = {
    "number": {"singular": "sg.", "plural": "pl."},
    "gender": {"masculine": "m.", "feminine": "f.", "neuter": "n."},
    "person": {"first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3"},
}
#: Column names of tables by layer, and what their headers may say.
HEADERS = {
    "morph": {"word": "word", "lemma": "lemma", "part of speech": "pos", "pos": "pos", "gender": "gender", "number": "number", "person": "person", "tense": "tense", "mood": "mood", "note": "note"},
    "spans": {"line": "line", "noun phrase": "text", "phrase": "text", "np": "text", "head": "head"},
    "edges": {"line": "line", "token": "token", "word": "word", "deprel": "deprel", "relation": "deprel", "head line": "head_line", "head token": "head_token", "head word": "head_word"},
    "frames": {"pred line": "line", "pred token": "token", "pred word": "word", "role": "role", "arg line": "arg_line", "arg token": "arg_token", "arg word": "arg_word"},
    "cases": {"line": "line", "word": "word", "case": "case"},
}
CASES = ("nominative", "accusative", "dative", "genitive", "ablative", "locative", "vocative", "reflexive")
#: Roles in canonical order.
ROLE_RANK = {"": -1, "subj": 0, "obj": 1, "iobj": 2, "attr": 3, "xcomp": 4, "ccomp": 5}
ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def all_tokens(text: Column) -> Column:
    """Words with a binding apostrophe on either side; every other character by itself."""
    return F.regexp_extract_all(text, F.lit(r"(?s)'?\p{L}+'?|."), F.lit(0))


WORD = r"'?\p{L}+'?"


def alpha_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def has_alpha(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def straight_apostrophe(text: Column) -> Column:
    return F.replace(text, F.lit("’"), F.lit("'"))


def lenient_int(value: Column) -> Column:
    """Digits of a cell as a number; null if it has none."""
    return F.regexp_replace(value, r"\D", "").try_cast("int")


def parts(value: Column, sep: str = r"\+") -> Column:
    """Trimmed parts of a joined cell, without empty ones."""
    return F.filter(F.transform(F.split(value, sep), lambda x: F.trim(x)), lambda x: x != "")


def canonical_case(value: Column) -> Column:
    """Full case names of a ``+``-joined cell; unknown names stay."""
    pairs = F.create_map(*(F.lit(x) for pair in CASE_ALIASES.items() for x in pair))

    def one(x: Column) -> Column:
        bare = F.lower(F.regexp_replace(F.regexp_replace(x, r"\*", ""), r"\.$", ""))
        return F.coalesce(F.try_element_at(pairs, bare), bare)

    return F.array_join(F.transform(parts(value), one), "+")


def pronoun_slots(pos: Column) -> Column:
    return F.size(F.filter(parts(F.lower(pos)), lambda p: p.endswith("pronoun"))).cast("int")


def is_verb(pos: Column) -> Column:
    """By whole parts: an adverb is no verb."""
    return F.array_contains(F.split(F.lower(pos), "[^a-z]+"), "verb")


def flags(note: Column) -> Column:
    return F.transform(F.split(note, ","), lambda x: F.trim(x))


def loose_equal(word: Column, token: Column) -> Column:
    """Equal up to a tail of punctuation or one apostrophe on either side."""
    tail = F.substring(word, F.length(token) + 1, F.length(word))
    quote = F.lit("'")
    return (
        (word == token)
        | (word.startswith(token) & ~tail.rlike(r"[\p{L}']"))
        | (token == F.concat(word, quote))
        | (token == F.concat(quote, word))
        | (word == F.concat(token, quote))
        | (word == F.concat(quote, token))
    )


def role_rank(role: Column) -> Column:
    out = F.lit(6)
    for name, rank in ROLE_RANK.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def valid_role(role: Column) -> Column:
    return role.isin(*[r for r in ROLE_RANK if r], "obl") | role.rlike(r"^obl:[a-zàèéìòù']+$")


def looked_up(pairs: dict[str, str], value: Column) -> Column:
    """What a fixed table says of a value; null where it says nothing."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), value)


def normal_preposition(lemma: Column) -> Column:
    return F.coalesce(looked_up(PREPOSITION_OF, lemma), lemma)


def first_lemma(lemma: Column) -> Column:
    """The first part of a joined lemma."""
    return F.lower(F.trim(F.split(lemma, r"\+")[0]))


def canonical_role(role: Column) -> Column:
    oblique = F.concat(F.lit("obl:"), normal_preposition(F.substring(role, F.lit(5), F.length(role))))
    return F.when(role == "attr", "xcomp").when(role == "iobj", "obl:a").when(role.rlike(r"^obl:[a-zàèéìòù']+$"), oblique).otherwise(role)


def column_of(header: Column, layer: str) -> Column:
    """The column that a table's header cell names; null for one to be ignored."""
    return looked_up(HEADERS[layer], F.lower(F.trim(header)))


def fixed_cell(column: Column, cell: Column) -> Column:
    """A body cell without blanks, placeholders and emphasis marks; by column in its short form."""
    bare = F.trim(cell)
    starred = F.regexp_extract(bare, r"^(?:([^*]+)\*|\*\*([^*]+)\*\*)$", 0) != ""
    short = F.lit(None).cast("string")
    for name, pairs in SHORT.items():
        short = F.when(column == name, looked_up(pairs, F.lower(bare))).otherwise(short)
    return F.when(bare.isin("-", "n/a", "N/A"), "").when(short.isNotNull(), short).when(starred, F.trim(F.replace(bare, F.lit("*")))).otherwise(bare)


def nominal(pos: Column) -> Column:
    return F.lower(pos).contains("noun")


def can_head(pos: Column) -> Column:
    """Whether a token can be the head of a span."""
    return nominal(pos) | F.lower(pos).rlike("adjective|verb|adverb|numeral")


def needs_span(pos: Column, note: Column) -> Column:
    """Nouns that have to head a span, unless a flag exempts them."""
    exempt = F.arrays_overlap(flags(note), F.array(F.lit("NO_NP"), F.lit("CONT_NEXT")))
    return nominal(pos) & ~F.lower(pos).contains("pronoun") & ~exempt


def relative_head(pos: Column, note: Column) -> Column:
    """Whether a relative clause can hang on a token."""
    return nominal(pos) | F.array_contains(flags(note), "RELCL_HEAD")


def nominal_anchor(role: Column) -> Column:
    """Roles whose argument has to be a span's head or a pronoun."""
    return role.isin("subj", "obj", "iobj") | role.rlike(r"^obl:[a-zàèéìòù']+$")


def snippet(text: Column, most: int = 200) -> Column:
    """White space folded, cut after ``most`` characters."""
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(folded) > most, F.concat(F.substring(folded, 1, most), F.lit("..."))).otherwise(folded)


def marked_text(text: Column, marked: Column) -> Column:
    """A line with the tokens whose numbers are in the array ``marked`` set between double stars."""

    def put(numbers: Column) -> Column:
        words = F.transform(alpha_tokens(text), lambda t, k: F.when(F.array_contains(numbers, k + 1), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t))
        pairs = F.arrays_zip(F.split(text, WORD).alias("gap"), words.alias("word"))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit("")))), "")

    # bound by a lambda, so that it is not computed again for each token
    return F.transform(F.array(marked), put)[0]


def native_call(item: Column) -> Column:
    """``struct<name, arguments, error>`` of a native tool call in JSON: under ``function`` or flat, its
    arguments an object or a text that holds one."""
    inner = F.get_json_object(item, "$.function")
    own = F.coalesce(inner, item)
    name = F.trim(F.coalesce(F.get_json_object(own, "$.name"), F.lit("")))
    arguments = F.coalesce(F.get_json_object(own, "$.arguments"), F.lit("{}"))
    error = F.when(name == "", "no usable name").when(F.get_json_object(arguments, "$").isNull(), "unparsable arguments").when(~arguments.rlike(r"^\s*\{"), "arguments are no object")
    return F.struct(F.when(error.isNull(), name).alias("name"), F.when(error.isNull(), arguments).alias("arguments"), F.coalesce(error, F.lit("")).alias("error"))


def first_table(text: Column) -> Column:
    """``array<array<string>>``: header, separator and body of the first pipe table of a text.

    Short rows are filled up and blank cells beyond the header's go; null where there is no table of three
    rows, a separator cell is none, or a row holds more than the header.
    """
    lines = F.split(text, "\n")
    piped = lambda xs: F.transform(xs, lambda x: x.startswith("|"))
    start = F.array_position(piped(lines), True)
    tail = F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))
    stop = F.array_position(piped(tail), False)
    rows = F.when(start > 0, F.slice(tail, 1, F.when(stop > 0, stop - 1).otherwise(F.size(tail)).cast("int"))).otherwise(F.array().cast("array<string>"))
    cells = F.transform(rows, lambda r: F.transform(F.slice(F.split(r, r"\|"), F.lit(2), F.greatest(F.size(F.split(r, r"\|")) - 2, F.lit(0))), lambda c: F.trim(c)))
    width = F.size(F.get(cells, F.lit(0)))
    fits = F.forall(cells, lambda c: F.forall(F.slice(c, width + 1, F.greatest(F.size(c), F.lit(1))), lambda x: x == ""))
    even = F.transform(cells, lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), width)), F.lit(1), width))
    separator = F.get(even, F.lit(1))
    good = (F.size(rows) >= 3) & fits & F.forall(separator, lambda c: c.contains("---"))
    return F.when(good, F.transform(even, lambda c, i: F.when(i == 1, F.transform(c, lambda x: F.regexp_replace(x, "-+", "---"))).otherwise(c)))


def field_notes(text: Column) -> Column:
    """``array<struct<line, token, note>>`` of the lines ``N3: …`` and ``N3.4: …`` of an answer."""
    pattern = r"(?m)^[ \t]*N(\d+)(?:[ \t]*\.[ \t]*(\d+))?[ \t]*[:.)][ \t]*(.+?)[ \t]*$"
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "line"), (2, "token"), (3, "note"))))
    return F.transform(found, lambda x: F.struct(x["line"].cast("int").alias("line"), x["token"].try_cast("int").alias("token"), F.substring(F.trim(F.regexp_replace(x["note"], r"\s+", " ")), 1, 300).alias("note")))


def to_roman(n: Column) -> Column:
    """Numbers from 1 on; M is repeated beyond 3,999."""
    out, rest = F.lit(""), n
    for sign, value in ROMAN:
        times = F.floor(rest / value).cast("int")
        out, rest = F.concat(out, F.repeat(F.lit(sign), times)), rest % value
    return out


def from_roman(text: Column) -> Column:
    """The number of a well-formed numeral; null for other text."""
    worth = lambda c: F.when(c == "M", 1000).when(c == "D", 500).when(c == "C", 100).when(c == "L", 50).when(c == "X", 10).when(c == "V", 5).otherwise(1)
    signs = F.split(text, "")
    value = F.aggregate(
        F.reverse(signs),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, c: F.struct((a["sum"] + F.when(worth(c) < a["last"], -worth(c)).otherwise(worth(c))).alias("sum"), worth(c).alias("last")),
    )["sum"]
    return F.when(text.rlike("^(?=.)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), value)


def ratio(top: Column, bottom: Column) -> Column:
    """A share rounded to four places, halves to even; 0 where nothing is counted."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.bround(top / bottom, 4))


def range_filter(spec: str, column: Column) -> Column:
    """Ranges such as ``1,3-5,11-`` or ``-20`` as a filter; a malformed list is an error."""
    import re

    out = F.lit(False)
    for item in spec.split(","):
        found = re.fullmatch(r"(\d+)|(\d+)-(\d*)|-(\d+)", item.strip())
        if not found:
            raise ValueError(f"not a range: {item!r} in {spec!r}")
        one, low, high, upto = found.groups()
        if one:
            out |= column == int(one)
        elif upto:
            out |= column <= int(upto)
        elif high and int(high) < int(low):
            raise ValueError(f"a range that runs backwards: {item!r}")
        else:
            out |= (column >= int(low)) & (column <= int(high)) if high else column >= int(low)
    return out
