"""Surrogates for personal data, with DataFrame functions only.

Detected entities get keyed replacements of the same kind: digits for digits in the same format,
names of the same gender and script, addresses of the same shape. One entity has one surrogate in
the whole corpus, however it is written (case, punctuation of numbers, with or without the country
code 1). A person's name is replaced part by part; each part is also found where it stands alone in
the same text, with either apostrophe, in capitals or not. Parts that are names of months or days stay
where a date is told, particles and other short common words stay. Names of scripts without capitals are
known by honorifics and given names. A check over all entities finds surrogates that two entities share or that are
somebody's real data; these are drawn again, longer after some attempts, until there are none, so
that different entities stay different.

A text is searched once; only texts that look as if they held anything are joined with what was found.

Defined results: null texts stay null; texts without entities are untouched; repeated rows are
replaced alike; an empty table gives an empty table; other columns are kept whatever their names are.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import at, drop_staged, plain, restored, staged, table

KEY = "spanloom"

#: Given names by gender and script, honorifics before and after a name, particles, family
#: names and honorifics of scripts without capitals, names of months and days, short words that are no names
#: alone, and sixteen syllables of invented surnames by script.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Peter Paul George Kevin Brian Pierre François Jürgen Wolfgang Heinrich Hans Klaus Stefan Carlos Javier Miguel José Antonio Luis Ahmed Mohammed Ali Omar Hassan Giovanni Marco Luca".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Emily Michelle Dorothy Anna Maria Laura Julia Emma Sophie Françoise Brigitte Ursula Ingrid Monika Petra Carmen Dolores Lucía Pilar Ana Fatima Aisha Leila Zainab Giulia Francesca Chiara Marie Camille Isabelle".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Владимир Павел Виктор Юрий Борис".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Людмила Галина Марина Вера".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Αντώνης".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Άννα Γεωργία Δήμητρα".split(),
    ("m", "arabic"): "محمد أحمد علي حسن حسين عمر خالد يوسف إبراهيم محمود".split(),
    ("f", "arabic"): "فاطمة عائشة مريم زينب ليلى سارة خديجة هدى".split(),
}
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sra Sr Κύριος Κυρία Господин Госпожа".split()
HONORIFICS_ARABIC = "السيد السيدة الدكتور الدكتورة الأستاذ الأستاذة".split()
HONORIFICS_HAN = "先生 女士 小姐 博士 教授".split()
FAMILY_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
PARTICLES = "von van der den de del della di da dos du la le al el bin ibn".split()
CALENDAR = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
SHORT_WORDS = "am an as at be by do go he if in is it me my no of oh ok on or so to up us we".split()
SYLLABLES = {
    "latin": "bar den fel gor hal kim lan mor nes pol ras sin tor val wes zan".split(),
    "cyrillic": "бар ден фел гор хал ким лан мор нес пол рас син тор вал вес зан".split(),
    "greek": "βαρ δεν φελ γορ χαλ κιμ λαν μορ νεσ πολ ρασ σιν τορ θελ ξεν ζαν".split(),
    "armenian": "բար դեն ֆել գոր հալ կիմ լան մոր նես պոլ րաս սին տոր վալ թես զան".split(),
    "hebrew": "בר דן פל גר הל קם לן מר נס פל רס סן טר ול שז זן".split(),
    "arabic": "بار دان فال غور هال كيم لان مور نيس بول راس سين تور وال شيز زان".split(),
    "devanagari": "बार देन फेल गोर हाल किम लान मोर नेस पोल रास सिन तोर वाल शेस जान".split(),
    "hangul": "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황".split(),
    "hiragana": "あか いけ うえ おか かわ きし くら さと しま たけ なか にし のむ はし まつ やま".split(),
    "katakana": "アカ イケ ウエ オカ カワ キシ クラ サト シマ タケ ナカ ニシ ノム ハシ マツ ヤマ".split(),
    "han": "王李张刘陈杨赵黄周吴徐孙林何高郭",
}
#: Endings of invented surnames: of the script, for names with that ending, for all others.
ENDINGS = {"cyrillic": ("а", "ова", "ов"), "greek": ("ς", "όπουλος", "οπούλου"), "armenian": ("", "յան", "յան")}

ALL_GIVEN = [n for names in GIVEN.values() for n in names]
_ARABIC_GIVEN = "|".join(n for (_, script), names in GIVEN.items() if script == "arabic" for n in names)
_AFTER_HAN = "|".join(HONORIFICS_HAN)
#: A letter with its marks.
_LETTER = r"\p{L}\p{M}*"
#: A capitalised part of a name, and family names with particles before and hyphens inside.
_PART = rf"\p{{Lu}}\p{{M}}*(?:['’]?{_LETTER})+"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) )*+{_PART}(?:-{_PART})*+"
_GIVEN = rf"(?iu:{'|'.join(n for (_, script), names in GIVEN.items() if script != 'arabic' for n in names)})(?![\p{{L}}\p{{M}}])(?:-{_PART})?+"
#: A name of a script without capitals after an honorific: two or three Han signs, else a word.
_UNCASED = r"(?:\p{IsHan}{2,3}|(?:(?!\p{IsHan})\p{Lo}\p{M}*)+)"
#: A given name with all that follows it, or an honorific with a name.
_CASED = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_GIVEN}(?: (?=\p{{Lu}}){_GIVEN})?(?: \p{{Lu}}\.)?+ {_FAMILY}|(?:{'|'.join(HONORIFICS)})\.? (?:(?:{_PART}(?:-{_PART})?+ )?{_FAMILY}|{_UNCASED}))"
#: Ranges of letters stand before what is looked up by script, as they are tried at every place of a text.
#: Two Arabic given names or one with a name of origin; after an honorific one is enough.
_ORIGIN = rf"(?:{_ARABIC_GIVEN}|ال\p{{IsArabic}}+ي)(?!\p{{L}})"
_ARABIC = rf"(?=[ؠ-ي])(?<!\p{{L}})(?:(?:{'|'.join(HONORIFICS_ARABIC)}) (?:{_ARABIC_GIVEN})(?!\p{{L}})(?: {_ORIGIN})*+|(?:{_ARABIC_GIVEN})(?: {_ORIGIN})++)"
#: A Chinese family name, at most two more signs, and the honorific.
_HAN = rf"(?=[一-鿿])[{FAMILY_HAN}]\p{{IsHan}}{{0,2}}?(?:{_AFTER_HAN})"
PERSON = rf"(?:{_CASED}|{_ARABIC}|{_HAN})"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried at a place. Each begins where no longer token goes on.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "token": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{8,}+){2})(?![\p{L}\p{N}])",
    "phone": "|".join(
        (
            r"(?<![\p{N}+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
            r"(?<![\p{N}+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
            r"(?<![\p{N}+\-.])(?:1[.\-])?\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
            r"(?<![\p{N}+\-.])(?<!\d )(?:1 )?\d{3} \d{3} \d{4}(?![\d\-]| \d)",
            r"(?<![\p{N}+\-.])(?<!\d )0\d{1,4}[ /\-](?:\d{6,8}|\d{3,4}[ \-]\d{3,5})(?![\d\-]| \d)",
            r"(?<=(?i:tel|phone|call|fax|mobile|cell)[.:]? ?)\d{10}(?!\d)",
        )
    ),
    "ip": r"(?<![\p{N}.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\p{N}]|\.\p{N})",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:|::(?:{_HEX}:){{0,6}}{_HEX})(?![\p{{L}}\p{{N}}:])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "number": r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "person": PERSON,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text needs to hold an entity at all; much cheaper to look for.
HINT = rf"[0-9@]|{PERSON}"
#: Letters of one part of a name.
_TOKEN = rf"(?:{_AFTER_HAN})|\p{{IsHan}}+?(?={_AFTER_HAN}|\P{{IsHan}}|\z)|(?!\p{{IsHan}}){_LETTER}(?:['’]?(?!\p{{IsHan}}){_LETTER})*"


def found(text: Column) -> Column:
    """All entities of a text in order; an empty array if there is none."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    """The kind of a mention; what is none of the others is (a part of) a person's name."""
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return F.when(value.rlike(r"^\d{10}$"), "phone").otherwise(out)


def part_kind(token: Column) -> Column:
    """given, name, or null for a part of a person's name that stays: honorifics, particles, initials."""
    titles = [*HONORIFICS, *HONORIFICS_ARABIC, *HONORIFICS_HAN]
    stays = token.isin(titles) | ~token.rlike(r"^(?:\p{Lu}\p{M}*.|\p{Lo})")
    return F.when(stays, None).when(F.lower(token).isin([n.lower() for n in ALL_GIVEN]), "given").otherwise("name")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: digits of a number, letters without case else."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind.isin("ssn", "number"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(value, " ", "")))
        .when(kind == "token", value)
        .otherwise(F.lower(F.replace(value, F.lit("’"), F.lit("'"))))
    )


def parts_of(kind: Column, mention: Column) -> Column:
    """``array<struct<k, kind, name>>``: the entities of a mention, of a person's name each part."""
    tokens = F.transform(F.regexp_extract_all(mention, F.lit(_TOKEN), F.lit(0)), lambda t, k: F.struct(k.alias("k"), part_kind(t).alias("kind"), canonical(F.lit("name"), t).alias("name")))
    one = F.array(F.struct(F.lit(0).alias("k"), kind.alias("kind"), canonical(kind, mention).alias("name")))
    return F.when(kind == "person", F.filter(tokens, lambda x: x["kind"].isNotNull())).otherwise(one)


def _title(name: Column) -> Column:
    """Each part between apostrophes with a capital first."""
    return F.array_join(F.transform(F.split(F.lower(name), "'"), lambda x: F.initcap(x)), "'")


def alone(mentions: Column) -> Column:
    """A pattern for the parts of the names in ``mentions`` where they stand alone; empty if there are none.

    A part is sought as written, in capitals and with one capital, with either apostrophe. Names of months
    and days are left where a date is told, and a single sign of a script without capitals is no name alone.
    """
    people = F.filter(mentions, lambda m: m.rlike(rf"^(?:{PERSON})$"))
    tokens = F.flatten(F.transform(people, lambda m: F.regexp_extract_all(m, F.lit(_TOKEN), F.lit(0))))
    common = [*PARTICLES, *SHORT_WORDS]
    own = F.filter(tokens, lambda t: part_kind(t).isNotNull() & (F.length(t) > 1) & ~F.lower(t).isin(common))
    plain_ = F.transform(own, lambda t: F.replace(t, F.lit("’"), F.lit("'")))
    spelt = F.array_distinct(F.flatten(F.transform(plain_, lambda t: F.array(t, F.upper(t), _title(t)))))
    # longer parts first, as of two that begin alike the first one is taken
    spelt = F.transform(F.reverse(F.array_sort(F.transform(spelt, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))), lambda x: x["t"])
    before = r"(?<!(?:\b(?i:in|of|on|since|until|till|by|last|next|this|early|late|mid|during|from|to|every)|\d|\d(?:st|nd|rd|th))[ \-])"
    dated = lambda t: F.lower(t).isin([x.lower() for x in CALENDAR])
    unbounded = lambda t: t.rlike(r"\p{IsHan}|\p{IsHangul}|\p{IsHiragana}|\p{IsKatakana}")

    def group(words: Column, start: str, end: str) -> Column:
        """One alternative for all words, so that what must stand around them is tried once at a place."""
        spelling = F.transform(words, lambda t: F.replace(t, F.lit("'"), F.lit("['’]")))
        return F.when(F.size(words) > 0, F.concat(F.lit("|" + start + "(?:"), F.array_join(spelling, "|"), F.lit(")" + end))).otherwise("")

    return F.concat(
        group(F.filter(spelt, lambda t: ~dated(t) & ~unbounded(t)), r"(?=[\p{Lu}\p{Lo}])(?<!\p{L})", r"(?![\p{L}\p{M}])"),
        group(F.filter(spelt, dated), rf"(?=\p{{Lu}}){before}(?<!\p{{L}})", r"(?![\p{L}\p{M}])(?!,? \d)"),
        group(F.filter(spelt, unbounded), r"(?=\p{Lo})", ""),
    )


def _stream(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """Hex digits, 128 for every 32 characters of the name, that only the key can foretell."""
    seed = F.concat_ws("\x01", F.lit(key), kind, name, attempt.cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(name) / 32).cast("int")), lambda i: F.sha2(F.concat_ws("\x01", seed, i.cast("string")), 512)), "")


def _number(stream: Column, i: Column) -> Column:
    """The i-th number below 65,536 of the stream."""
    return F.conv(F.substring(stream, (4 * i + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _shape(text: Column, stream: Column, start: Column) -> Column:
    """Each digit and letter replaced by another of its sort and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i + start)
        return (
            F.when(c.rlike(r"\d"), _pick("0123456789", n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", n))
            .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _cased(text: Column, stream: Column, keep: int) -> Column:
    """Letters and digits after the first ``keep`` replaced by others of their case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        other = F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)
        return F.when(i < keep, c).otherwise(other)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(name: Column, stream: Column, keep: Column) -> Column:
    """Other digits, the first ``keep`` ones the same."""
    return F.array_join(F.transform(F.split(name, ""), lambda c, i: F.when(i < keep, c).otherwise(_pick("0123456789", _number(stream, i)))), "")


def _more(stream: Column, attempt: Column, letters: bool) -> Column:
    """Nothing at first; one more letter or digit after every fourth attempt, so that no kind runs out."""
    drawn = F.translate(F.substring(stream, 65, 64), "0123456789", "ghijklmnop") if letters else F.translate(F.substring(stream, 65, 64), "abcdef", "012345")
    return F.substring(drawn, F.lit(1), F.floor(attempt / 4).cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x), F.lit(10))


def permuted(key: str) -> dict[str, str]:
    """Given names to others of the same gender and script: one cycle in an order that only the key tells."""
    out = {}
    for names in GIVEN.values():
        ring = sorted((n.lower() for n in names), key=lambda n: hmac.digest(key.encode(), n.encode(), "sha256"))
        out |= dict(zip(ring, ring[1:] + ring[:1], strict=True))
    # a name of both lists goes where the last list sends it
    return out


def surrogate(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """The replacement, in canonical form, of an entity in canonical form."""
    s = _stream(key, kind, name, attempt)
    letters, figures = _more(s, attempt, True), _more(s, attempt, False)
    local, domain = F.substring_index(name, "@", 1), F.substring_index(name, "@", -1)
    d = _stream(key, F.lit("domain"), domain, F.lit(0))
    sub = F.regexp_replace(domain, r"(?:^|\.)[^.]+\.[^.]+$", "")
    # a host of its own for every domain, under a zone that is nobody's
    own = F.concat(_shape(F.substring_index(domain, ".", 1), d, F.lit(1)), F.substring(F.translate(F.substring(d, 65, 64), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(F.lit(0), 8 - F.length(F.substring_index(domain, ".", 1)))))
    host = F.concat(F.when(sub == "", own).otherwise(_shape(sub, d, F.lit(1))), F.lit("."))
    zone = F.concat(F.lit("example."), F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), (F.pmod(_number(d, F.lit(0)), F.lit(3)) + 1).cast("int")))
    ip = F.concat_ws(".", F.pmod(_number(s, F.lit(0)), F.lit(223)) + 1, *(F.pmod(_number(s, F.lit(k)), F.lit(256)) for k in (1, 2, 3)))
    hexes = F.array_join(F.transform(F.split(name, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(s, (4 * i + 1).cast("int"), F.lit(1)))), "")
    wide = F.concat_ws(":", F.lit("fd00"), *(F.substring(s, 4 * k + 65, 4) for k in range(7)))
    drawn = _digits(name, s, F.lit(1))
    # the last digit makes the Luhn sum what it was
    card = F.concat(F.substring(drawn, F.lit(1), F.length(name) - 1), F.pmod(_luhn(name) - _luhn(F.concat(F.substring(drawn, F.lit(1), F.length(name) - 1), F.lit("0"))), F.lit(10)).cast("string"))
    phone = _digits(name, s, F.when(name.startswith("0"), 1).when(F.length(name) == 10, 0).otherwise(2))
    iban = F.concat(F.substring(name, 1, 2), _shape(F.substring(name, F.lit(3), F.length(name)), s, F.lit(0)))
    token = F.when(name.startswith("ey"), _cased(name, s, 3)).otherwise(_cased(name, s, 4))

    def per_script(make, other):
        out = other
        for script in reversed([x for x in SYLLABLES if x != "latin"]):
            out = F.when(name.rlike(rf"\p{{Is{script.capitalize()}}}"), make(script)).otherwise(out)
        return out

    syllables = per_script(lambda x: F.array(*map(F.lit, SYLLABLES[x])), F.array(*map(F.lit, SYLLABLES["latin"])))
    # longer ones are drawn only after many collisions, so that there is always room
    many = F.when(attempt > 10, 8).when(attempt > 3, 6).otherwise(3)
    part = F.array_join(F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.element_at(syllables, (F.pmod(_number(s, k), F.lit(16)) + 1).cast("int"))), "")
    tail = per_script(lambda x: F.translate(F.substring(F.substring(s, 65, 64), F.lit(1), F.floor(attempt / 4).cast("int")), "0123456789abcdef", "".join(y[0] for y in SYLLABLES[x])), letters)
    ending = F.lit("")
    for script, (end, like, other) in ENDINGS.items():
        ending = F.when(name.rlike(rf"\p{{Is{script.capitalize()}}}"), F.when(name.endswith(end), like).otherwise(other)).otherwise(ending)
    prefix = F.when(name.contains("'"), F.concat(F.substring_index(name, "'", 1), F.lit("'"))).otherwise("")
    invented = F.concat(prefix, part, F.when(attempt > 16, tail).otherwise(""), ending)
    pairs = F.create_map(*(F.lit(x) for pair in permuted(key).items() for x in pair))
    return (
        F.when(kind == "email", F.concat(_shape(local, s, F.lit(0)), letters, F.lit("@"), host, zone))
        .when(kind == "token", F.concat(token, figures))
        .when(kind == "ip", F.when(attempt > 8, wide).otherwise(ip))
        .when(kind == "ipv6", F.when(attempt > 2, wide).otherwise(hexes))
        .when(kind == "secret", F.concat(hexes, figures))
        .when(kind == "number", F.concat(card, figures))
        .when(kind == "phone", F.concat(phone, figures))
        .when(kind == "ssn", F.concat(_digits(name, s, F.lit(0)), figures))
        .when(kind == "iban", F.concat(iban, figures))
        .when(kind == "given", F.try_element_at(pairs, name))
        .otherwise(invented)
    )


def _named(token: Column, new: Column) -> Column:
    """A part of a name written as the part that it replaces."""
    shown = F.when(token == F.upper(token), F.upper(new)).otherwise(_title(new))
    return F.when(token.contains("’"), F.replace(shown, F.lit("'"), F.lit("’"))).otherwise(shown)


def rendered(kind: Column, mention: Column, news: Column) -> Column:
    """The replacement written as the mention is: same punctuation of numbers, same case. ``news``:
    ``array<struct<k, plain>>``, of a person's name the parts that change."""
    first = F.element_at(news, 1)["plain"]
    coded = (kind == "phone") & F.regexp_replace(mention, r"\D", "").rlike(r"^1\d{10}$")
    filler = F.when(coded, F.concat(F.lit("1"), first)).otherwise(first)
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(a: Column, c: Column) -> Column:
        taken = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(a.out, F.when(taken, F.substring(filler, a.at, F.lit(1))).otherwise(c)).alias("out"), F.when(taken, a.at + 1).otherwise(a.at).alias("at"))

    folded = F.aggregate(F.split(mention, ""), state, put)
    filled = F.concat(folded.out, F.substring(filler, folded.at, F.length(filler)))
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention)) & (kind != "token")
    numbers = F.when(kind.isin("phone", "ssn", "number", "iban"), filled).otherwise(first)
    numbers = F.when(upper & (F.length(mention) > 1), F.upper(numbers)).otherwise(numbers)

    tokens, gaps = F.regexp_extract_all(mention, F.lit(_TOKEN), F.lit(0)), F.split(mention, _TOKEN, -1)
    by = F.map_from_entries(news)
    name = F.transform(tokens, lambda t, k: F.coalesce(_named(t, F.try_element_at(by, k)), t))
    person = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.concat(name, F.array(F.lit(""))).alias("t")), lambda x: F.concat(x["g"], x["t"])), "")
    return F.when(kind == "person", person).otherwise(numbers)


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, name, plain)`` for ``entities(kind, name)``, none shared and none a real entity.

    Given names are permuted among themselves and need no check. Surrogates grow with the attempts, so
    the rounds come to an end however many entities there are.
    """
    now = staged(entities.select("kind", "name").distinct().withColumn("attempt", F.lit(0)), "entities")
    while True:
        drawn = staged(now.withColumn("plain", surrogate(key, F.col("kind"), F.col("name"), F.col("attempt"))), "surrogates")
        checked = drawn.filter("kind <> 'given'")
        shared = checked.groupBy("kind", "plain").agg(F.min("name").alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "plain", "first")
        again = checked.join(shared, ["kind", "plain"]).filter("name <> first").select("kind", "name")
        real = checked.join(now.select("kind", F.col("name").alias("plain")), ["kind", "plain"], "left_semi").select("kind", "name")
        again = staged(again.union(real).distinct().withColumn("more", F.lit(1)), "again")
        if again.isEmpty():
            drop_staged(now, again)
            return drawn.select("kind", "name", "plain")
        after = staged(drawn.join(again, ["kind", "name"], "left").select("kind", "name", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
        drop_staged(now, drawn, again)
        now = after


def replaced(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; ``count`` names a column for the number of mentions."""
    rows, own, t = plain(docs), at(docs, text), F.col(at(docs, text))
    hits = rows.select(F.col(at(docs, doc_id)).alias("id"), F.xxhash64(t).alias("mark"), t.alias("text"), found(t).alias("seen")).filter(F.size("seen") > 0)
    hits = hits.withColumn("alone", alone(F.col("seen")))
    # with names in it a text is searched again for their parts
    seen = F.when(F.col("alone") == "", F.col("seen")).otherwise(F.regexp_extract_all(F.col("text"), F.concat(F.lit(ANY), F.col("alone")), F.lit(0)))
    hits = staged(hits.select("id", "mark", "alone", seen.alias("seen")), "hits")
    mentions = hits.select("id", "mark", F.posexplode("seen").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    parts = mentions.select("id", "mark", "at", "mention", F.col("kind").alias("sort"), F.inline(parts_of(F.col("kind"), F.col("mention"))))
    parts = staged(parts, "parts")
    named = distinct_surrogates(parts, key)
    # rows that stand twice put the same thing at the same place
    put = parts.join(named, ["kind", "name"]).groupBy("id", "mark", "at", "mention", "sort").agg(F.sort_array(F.collect_set(F.struct("k", "plain"))).alias("news"))
    put = put.select("id", "mark", F.struct("at", rendered(F.col("sort"), F.col("mention"), F.col("news")).alias("new")).alias("put"))
    lists = put.groupBy("id", "mark").agg(F.sort_array(F.collect_list("put")).alias("put"))
    lists = lists.join(hits.select(F.col("id").alias("same"), F.col("mark").alias("marked"), "alone").distinct(), F.col("id").eqNullSafe(F.col("same")) & (F.col("mark") == F.col("marked"))).select("id", "mark", "alone", "put")

    likely = F.coalesce(t.rlike(HINT), F.lit(False))
    clean = rows.filter(~likely)
    joined = rows.filter(likely).join(lists, F.col(at(docs, doc_id)).eqNullSafe(F.col("id")) & (F.xxhash64(t) == F.col("mark")), "left")
    pieces = F.when(F.col("alone") == "", F.split(t, ANY, -1)).otherwise(F.split(t, F.concat(F.lit(ANY), F.col("alone")), -1))
    new = F.concat(F.transform("put", lambda x: x["new"]), F.array(F.lit("")))
    changed = F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), new.alias("b")), lambda x: F.concat(x["a"], x["b"])), "")
    fixed = joined.withColumn(own, F.when(F.col("put").isNull(), t).otherwise(changed))
    if not count:
        return restored(clean.select(rows.columns).union(fixed.select(rows.columns)), docs)
    n = F.coalesce(F.size("put"), F.lit(0)).cast("long")
    both = clean.select(*rows.columns, F.lit(0).cast("long")).union(fixed.select(*rows.columns, F.when(F.col("put").isNull(), 0).otherwise(n).cast("long")))
    return both.toDF(*docs.columns, count)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
