"""Surrogates for personal data, with DataFrame functions only.

Every detected entity is replaced by a keyed pseudo-random one of its type that
keeps its format: digits stay digits, letters keep case and script, separators
stay, a card number keeps its issuer digit and whether its Luhn sum holds, an
address part stays in 0..255, an IBAN keeps its country and whether its check
digits hold, a titled name keeps the gender of its title, its script, white
space, particles and hyphens. The surrogate is a function of key, type and
canonical form (lower case, without spaces, or digits alone, after a + where a
phone has one), so mentions of one entity agree in every document and in every
format. Each given name and the family name of a person are forms of their own,
so "Mr John Smith" and "Mr Smith" get the same family name, as do a man and a
woman of one family whose name has a gender ending; a full name that a text has
with a title is replaced there without it too.

A name is what follows a title: up to five capitalised words, initials and
particles, the last of them a word. It ends before a function word or a weekday
(NOT_NAMES), so a sentence that follows without a stop is not part of it, and
after two words where the title is in capitals, as then all words may be.

Distinct entities could get one surrogate, or a surrogate could be another
entity of the corpus. All distinct canonical forms are checked for both; those
that collide draw again, with a higher attempt number, until none collides;
later attempts draw longer surrogates, so there is always room. Only these few
are looked up; every other surrogate is computed in place, so no text is shuffled.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored

#: Titles by gender; those of scholars and clergy have none.
TITLES = {
    "man": "Mr|MR|Herr|HERR|Monsieur|Señor|Sr|Господин",
    "woman": "Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|Mme|Señora|Sra|Госпожа",
    "person": "Dr|DR|Prof|PROF|Professor|Doctor|Rev|Доктор|Профессор",
}
ANY_TITLE = "|".join(TITLES.values())
#: Capitalised words that end a name, as they begin a sentence or follow names.
NOT_NAMES = (
    "A About After Again All Also Although An And Any Are As At Because Before Both But By Can Did Do Does Each Even Every Few For From Had Has Have He Her Here His How However I If In Is It Its "
    "Later Many More Most Moreover My Nevertheless No Not Now Of On Once One Only Or Other Our She Since So Some Still Such Than That The Their Then There These They This Those Though Through Thus To "
    "Under Until Was We Were What When Where Which While Who Why Will With Yet You Your Jr Esq Inc Ltd "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "Aber Auch Das Dann Der Die Ein Eine Er Es Ich Sie Und Wir Il Elle Ils Mais Et Les Nous Vous El Ella Pero Los Las Y Он Она Они Но И Это Мы Вы В На"
).split()
#: Particles of family names.
PARTICLES = "de|du|des|da|di|del|della|der|den|dem|dos|das|la|le|van|von|vom|zu|zum|zur|ter|ten|af|av|bin|ibn|al|el|y"
GAP = r"(?:[ \t\u00A0]+(?:\r?\n[ \t\u00A0]*)?|\r?\n[ \t\u00A0]*)"
#: A word of a name, with inner capitals, apostrophes and hyphens.
SPELLED = r"(?:[dlDLO]['’](?=\p{Lu}))?\p{Lu}\p{L}+(?:['’-]\p{Lu}\p{L}*)*"
#: What stands right after a title is a name even if it looks like a function word (He, El).
FIRST = rf"(?!(?:{ANY_TITLE})(?!\p{{L}})){SPELLED}"
WORD = rf"(?!(?:{'|'.join(NOT_NAMES)}|{ANY_TITLE})(?!\p{{L}})){SPELLED}"
MORE = rf"(?:(?:\p{{Lu}}|{FIRST}){GAP})?(?:(?:(?:\p{{Lu}}\.)+|(?:{PARTICLES})(?!\p{{L}})|{WORD}){GAP}){{0,4}}"


def titled(titles: str) -> str:
    """Pattern of a name after one of titles, and maybe a scholar's title."""
    loud = "|".join(t for t in titles.split("|") if t.isupper())
    more = rf"(?:(?:{TITLES['person']})\.?{GAP})*"
    return rf"(?<!\p{{L}})(?:(?:{loud})\.?{GAP}{more}(?:(?:(?:\p{{Lu}}\.)+|{WORD}){GAP})?{WORD}|(?:{titles})\.?{GAP}{more}(?:{MORE}{WORD}|{FIRST}))"


#: What an entity looks like, by type, the first that matches.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )*PRIVATE KEY-----",
    "secret": r"(?<![\p{L}\p{N}])(?:(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|(?=[a-z]*\d)(?=\d*[a-z])[0-9a-f]{32,})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d )[2-9]\d{2} \d{3} \d{4}(?! \d))(?![\p{L}\d])",
    "card": r"(?<![\p{L}\d])(?:3[47]\d{2}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\p{L}\d])",
} | {kind: titled(titles) for kind, titles in TITLES.items()}
#: Given names by gender and script; letters by script.
NAMES = {
    ("man", "latin"): "Adam Albert Anton Bruno Carl David Emil Felix Georg Hugo Jacob Jonas Leo Lucas Martin Max Oscar Paul Peter Simon Theo Thomas Victor Walter",
    ("woman", "latin"): "Ada Alice Anna Bella Clara Diana Elena Emma Eva Flora Greta Helena Ida Irene Julia Laura Lena Maria Nina Nora Olga Paula Rosa Sara",
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей Фёдор Юрий",
    ("woman", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Юлия",
}
#: Letters of scripts with case; other scripts by ranges of code points.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
RANGES = {"Han": (0x4E00, 0x8E00, 64), "Hiragana": (0x3042, 0x3094, 1), "Katakana": (0x30A2, 0x30F4, 1), "Hangul": (0xAC00, 0xD700, 56), "Arabic": (0x0627, 0x063B, 1), "Hebrew": (0x05D0, 0x05EB, 1), "Devanagari": (0x0915, 0x093A, 1), "Thai": (0x0E01, 0x0E2F, 1)}
#: Consonants and vowels of made-up names, and family name endings with gender.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζθκλμνπρστφ", "αεηιο")}
ENDINGS = r"(ов|ев|ёв|ин|ын)$"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The Spark setting of the secret key.
KEY_SETTING = "spark.panelspine.surrogateKey"
#: More than ever needed, as attempts after WIDER draw longer surrogates.
ATTEMPTS, WIDER = 60, 6
#: The country code that a number after + begins with.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What every entity has a match of: cheap, so that most texts are read once only.
HINT = rf"[@0-9]|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{{16}}|AKIA[A-Z0-9]{{16}}|AIza[A-Za-z0-9_-]{{35}}|eyJ[A-Za-z0-9_-]{{8}}|-----BEGIN |(?:{ANY_TITLE})\.?[ \t\u00A0\r\n]"
PEOPLE = list(TITLES)
#: A title that stands before each gender's names where only a name is at hand.
TITLE_OF = {"man": "Mr", "woman": "Mrs", "person": "Dr"}
#: The names between title and family name of a matched person.
GIVEN = rf"(?<=[\s\u00A0])(?!(?:{ANY_TITLE})(?!\p{{L}}))(?:[dlDLO]['’](?=\p{{Lu}}))?\p{{Lu}}\p{{L}}[^\s\u00A0]*(?=[\s\u00A0])"
BEFORE_NAME = rf"^(?:(?:{ANY_TITLE})\.?[\s\u00A0]+)+"


def kind_of(e: Column) -> Column:
    """The type of an entity. 'number' is what looks like a card without
    separators, has not sixteen digits and fails the Luhn sum: it stays."""
    out = F.lit(PEOPLE[-1])
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        value = F.lit(name)
        if name == "card":
            value = F.when(e.rlike(r"^(?!\d{16}$)\d+$"), F.when(_luhn(e) == 0, name).otherwise("number")).otherwise(name)
        out = F.when(e.rlike(f"^(?:{pattern})$"), value).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """What mentions of one entity have in common; the type comes first. Of a
    person it is the family name, without a woman's ending. A number has none."""
    digits = F.regexp_replace(e, r"\D", "")
    family = F.lower(F.regexp_replace(F.regexp_extract(e, r"([^\s\u00A0]+)$", 1), "’", "'"))
    family = F.when(kind == "woman", F.regexp_replace(F.regexp_replace(family, r"(ов|ев|ёв|ин|ын)а$", "$1"), "ская$", "ский")).otherwise(family)
    squeezed = F.upper(F.regexp_replace(e, " ", ""))
    number = F.regexp_replace(e, r"(?!^\+)\D", "")
    form = F.when(kind.isin("ssn", "card"), digits).when(kind == "phone", number).when(kind == "iban", squeezed).when(kind.isin("secret", "pem"), e).otherwise(F.lower(e))
    return F.when(kind == "number", None).when(kind.isin(PEOPLE), F.concat(F.lit("family:"), family)).otherwise(F.concat(kind, F.lit(":"), form))


def given_form(word: Column, kind: Column) -> Column:
    """The form of a given name, which has the gender of its title."""
    return F.concat(kind, F.lit(":"), F.lower(F.regexp_replace(word, "’", "'")))


def given_names(e: Column, kind: Column) -> Column:
    """The given names of a person, without initials; none of other types."""
    return F.when(kind.isin(PEOPLE), F.regexp_extract_all(e, F.lit(GIVEN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def forms_of(e: Column, kind: Column) -> Column:
    """All forms of a mention: struct(form, e), where e is a mention of that form
    alone, and given, which says that the form is of a given name."""
    title = F.create_map(*[F.lit(x) for pair in TITLE_OF.items() for x in pair])
    own = F.array(F.struct(canonical(e, kind).alias("form"), e.alias("e"), F.lit(False).alias("given")))
    more = F.transform(given_names(e, kind), lambda w: F.struct(given_form(w, kind).alias("form"), F.concat_ws(" ", F.try_element_at(title, kind), w, F.lit("Xx")).alias("e"), F.lit(True).alias("given")))
    return F.concat(own, more)


def _stream(key: str, form: Column, attempt: Column) -> Column:
    """256 pseudo-random hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}|{k}|"), attempt.cast("string"), F.lit("|"), form), 256) for k in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _same_class(c: Column, b: Column, hexadecimal: bool = False) -> Column:
    """A character of c's class: digit, letter of its script and case, or c. A
    letter of a script that is not listed becomes a Latin one."""
    latin = LETTERS["latin"][:6] if hexadecimal else LETTERS["latin"]
    out = F.when(c.between("a", "z"), _pick(latin, b)).when(c.between("A", "Z"), _pick(latin.upper(), b)).when(c.between("0", "9"), _pick("0123456789", b))
    for script, (first, last, step) in RANGES.items():
        letters = "".join(map(chr, range(first, last, step)))
        out = out.when(c.rlike(rf"^[\p{{Is{script}}}&&\p{{L}}]$"), _pick(letters, b))
    letter = F.when(c.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["cyrillic"], b)).when(c.rlike(r"\p{IsGreek}"), _pick(LETTERS["greek"], b)).otherwise(_pick(latin, b))
    letter = F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)
    return F.when(c < "\x7f", F.coalesce(out, c)).otherwise(F.coalesce(out, F.when(c.rlike(r"^\p{Nd}$"), _pick("0123456789", b)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _by_class(s: Column, stream: Column, shift: int = 0, hexadecimal: bool = False) -> Column:
    return F.array_join(F.transform(_chars(s), lambda c, i: _same_class(c, _byte(stream, i + shift), hexadecimal)), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    n = F.length(digits)
    values = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _filled(e: Column, new: Column, separator: str = r"\D") -> Column:
    """e with its characters but for separators replaced by those of new, in
    order; what new has more follows."""
    more = F.substr(new, F.length(F.regexp_replace(e, separator, "")) + 1, F.length(new))
    return F.concat(F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike(separator), c).otherwise(F.substr(new, F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), separator, "")), F.lit(1)))), ""), more)


def _digits(digits: Column, stream: Column, kept: Column) -> Column:
    return F.array_join(F.transform(_chars(digits), lambda c, i: F.when(i < kept, c).otherwise(_pick("0123456789", _byte(stream, i)))), "")


def _with(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in names], *[v.alias(k) for k, v in more.items()])


def surrogates(found: Column, attempt_of: Callable[[Column], Column], key: str) -> Column:
    """For each mention in the array found: struct(e, kind, form, new).

    Done in steps over the array, each binding what the next one uses more
    than once, so that no expression is repeated inside another. parts are the
    words of a person's mention, each with the white space after it.
    """
    v = F.transform(found, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    v = F.transform(v, lambda x: _with(x, ("e", "kind"), form=canonical(x["e"], x["kind"]), words=F.when(x["kind"].isin(PEOPLE), F.regexp_extract_all(x["e"], F.lit(r"[^\s\u00A0]+[\s\u00A0]*"), F.lit(0)))))
    v = F.transform(v, lambda x: _with(x, ("e", "kind", "form"), a=attempt_of(x["form"]), parts=F.transform(x["words"], lambda w: _part(x, w))))
    v = F.transform(v, lambda x: _with(x, ("e", "kind", "form", "a"), parts=F.transform(x["parts"], lambda p: _with(p, ("word", "gap", "form", "script"), a=attempt_of(p["form"])))))
    v = F.transform(v, lambda x: _with(x, ("e", "kind", "form", "a"), s=_stream(key, x["form"], x["a"]), plain=F.regexp_replace(x["e"], r"\D", ""), parts=F.transform(x["parts"], lambda p: _with(p, ("word", "gap", "form", "script", "a"), s=_stream(key, p["form"], p["a"])))))
    v = F.transform(v, lambda x: _with(x, ("e", "kind", "form", "a", "s", "plain", "parts"), number=_number(x), squeezed=F.when(x["kind"] == "iban", F.regexp_replace(x["e"], " ", ""))))
    v = F.transform(v, lambda x: _with(x, ("e", "kind", "form", "a", "s", "plain", "parts", "number", "squeezed"), account=_by_class(F.substr(x["squeezed"], F.lit(5), F.length(x["squeezed"])), x["s"])))
    return F.transform(v, lambda x: _with(x, ("e", "kind", "form"), new=_surrogate(x)))


def _part(x: Column, token: Column) -> Column:
    """A word of a mention with its form: the family name's for the last word,
    a given name's or an initial's before it, none for titles and particles."""
    word, gap = F.regexp_extract(token, r"^([^\s\u00A0]+)", 1), F.regexp_extract(token, r"([\s\u00A0]*)$", 1)
    form = F.when(gap == "", x["form"]).when(word.rlike(rf"^(?:{ANY_TITLE})\.?$"), None).when(word.rlike(r"^(?:(?:\p{Lu}\.)+|\p{Lu})$"), F.concat(F.lit("initial:"), word)).when(word.rlike(r"\p{Lu}"), given_form(word, x["kind"]))
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return F.struct(word.alias("word"), gap.alias("gap"), form.alias("form"), script.alias("script"))


def _longer(x: Column) -> Column:
    """How many characters a surrogate has more than its entity, at late attempts."""
    return F.greatest(x["a"] - WIDER, F.lit(0))


def _made_up(stream: Column, script: Column, syllables: Column, shift: int) -> Column:
    """A pronounceable word of so many syllables."""
    out = F.lit("")
    for name, (consonants, vowels) in SYLLABLES.items():
        syllable = lambda i: F.concat(_pick(consonants, _byte(stream, 2 * i + shift)), _pick(vowels, _byte(stream, 2 * i + shift + 1)))  # noqa: E731, B023
        out = F.when(script == name, F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), syllable), "")).otherwise(out)
    return out


def _given(p: Column, kind: Column) -> Column:
    """A given name: of NAMES at the first attempt, made up at later ones."""
    lists = [(kind == g, script, names) for (g, script), names in NAMES.items()]
    lists += [(kind == "person", script, " ".join(names for (_, of), names in NAMES.items() if of == script)) for script in ("latin", "cyrillic")]
    byte = _byte(p["s"], F.lit(100))
    listed = [F.when(wanted & (p["script"] == script), F.element_at(F.split(F.lit(names), " "), byte % len(names.split()) + 1)) for wanted, script, names in lists]
    man = kind != "woman"
    last = F.when(p["script"] == "cyrillic", F.when(man, "н").otherwise("а")).when(p["script"] == "greek", F.when(man, "ς").otherwise("α")).otherwise(F.when(man, "n").otherwise("a"))
    made = F.initcap(F.concat(_made_up(p["s"], p["script"], F.lit(1) + p["a"], 0), last))
    return F.when(p["a"] == 0, F.coalesce(*listed, made)).otherwise(made)


def _family(p: Column, kind: Column) -> Column:
    """A made-up family name with the gender ending, prefix (O') and hyphen of its original."""
    own = F.substr(p["form"], F.lit(len("family:") + 1), F.length(p["form"]))
    ending = F.when(own.rlike("ский$"), "ский").otherwise(F.regexp_extract(own, ENDINGS, 1))
    changed = F.when((kind != "woman") | (ending == ""), ending).when(ending == "ский", "ская").otherwise(F.concat(ending, F.lit("а")))
    close = F.when(p["script"] == "cyrillic", "к").when(p["script"] == "greek", "ς").otherwise("n")
    stem = F.initcap(F.concat(_made_up(p["s"], p["script"], F.lit(3) + p["a"], 32), F.when(ending != "", "").otherwise(close), changed))
    double = F.when(p["word"].contains("-"), F.concat(F.initcap(F.concat(_made_up(p["s"], p["script"], F.lit(2), 72), close)), F.lit("-"))).otherwise("")
    return F.concat(F.regexp_extract(p["word"], r"^((?:[dlDLO]['’](?=\p{Lu}))?)", 1), double, stem)


def _person(x: Column) -> Column:
    """Titles, particles and white space as they are, names and initials replaced."""

    def new(p: Column) -> Column:
        name = F.when(p["gap"] == "", _family(p, x["kind"])).when(p["form"].startswith("initial:"), _by_class(p["word"], p["s"])).otherwise(_given(p, x["kind"]))
        loud = F.length(p["word"]) == F.length(F.regexp_replace(p["word"], r"\p{Ll}", ""))
        return F.concat(F.when(p["form"].isNull(), p["word"]).when(loud, F.upper(name)).otherwise(name), p["gap"])

    return F.array_join(F.transform(x["parts"], new), "")


def _remainder(s: Column) -> Column:
    """The number of s, in which letters count from 10, modulo 97."""
    step = lambda a, c: F.when(c <= "9", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(s), F.lit(0), step)


def _iban(x: Column) -> Column:
    """The country stays, and the check digits hold where they did."""
    country = F.substr(x["squeezed"], F.lit(1), F.lit(2))
    holds = _remainder(F.concat(F.substr(x["squeezed"], F.lit(5), F.length(x["squeezed"])), F.substr(x["squeezed"], F.lit(1), F.lit(4)))) == 1
    check = F.when(holds, F.lpad((98 - _remainder(F.concat(x["account"], country, F.lit("00")))).cast("string"), 2, "0")).otherwise(_by_class(F.substr(x["squeezed"], F.lit(3), F.lit(2)), x["s"], 100))
    return _filled(x["e"], F.concat(country, check, x["account"]), " ")


def _number(x: Column) -> Column:
    """The digits of a number's surrogate: a country code or issuer digit stays."""
    code = F.length(F.regexp_extract(F.substr(x["form"], F.lit(len("phone:") + 1), F.length(x["form"])), COUNTRY, 1))
    plain = F.concat(x["plain"], F.repeat(F.lit("0"), _longer(x)))
    return F.when(x["kind"].isin("phone", "card", "ssn"), _digits(plain, x["s"], F.when(x["kind"] == "phone", code).when(x["kind"] == "card", 1).otherwise(0)))


def _surrogate(x: Column) -> Column:
    e, kind, s, number = x["e"], x["kind"], x["s"], x["number"]
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.concat(body, ((check + F.when(_luhn(x["plain"]) == 0, 0).otherwise(1 + _byte(s, F.lit(120)) % 9)) % 10).cast("string"))
    name = F.substr(e, F.lit(1), F.instr(e, "@") - 1)
    mail = F.concat(
        _by_class(F.concat(name, F.repeat(F.lit("a"), _longer(x))), s),
        F.lit("@"),
        _by_class(F.regexp_extract(e, r"@(.*)\.[^.]+$", 1), s, 64),
        F.regexp_extract(e, r"(\.[^.]+)$", 1),
    )
    address = F.array_join(F.transform(F.split(e, r"\."), lambda c, i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    prefix = F.regexp_extract(e, r"^((?:sk|pk|ghp|gho|xoxb|xoxp|AKIA|AIza|eyJ)?)", 1)
    rest = F.substr(e, F.length(prefix) + 1, F.length(e))
    secret = F.concat(prefix, F.when(e.rlike("^[0-9a-f]+$"), _by_class(rest, s, 0, True)).otherwise(_by_class(rest, s)))
    frame = r"^(-----[A-Z ]+-----)([^-]+)(-----[A-Z ]+-----)$"
    pem = F.concat(F.regexp_extract(e, frame, 1), _by_class(F.regexp_extract(e, frame, 2), s), F.regexp_extract(e, frame, 3))
    return (
        F.when(kind == "number", e)
        .when(kind == "email", mail)
        .when(kind == "ip6", _by_class(e, s, 0, True))
        .when(kind == "pem", pem)
        .when(kind == "ip", address)
        .when(kind == "card", _filled(e, card))
        .when(kind.isin("phone", "ssn"), _filled(e, number))
        .when(kind == "secret", secret)
        .when(kind == "iban", _iban(x))
        .otherwise(_person(x))
    )


def entities(text: Column) -> Column:
    """All entities of a text, in order; an empty array where there are none."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def attempts(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(form, attempt) of the canonical forms whose first surrogate collides.

    All distinct forms of the corpus take part. In each round the forms that
    share a surrogate, but for the least of them, and those whose surrogate is
    a form of the corpus, draw again. Fails if ATTEMPTS rounds do not suffice.
    """
    found = docs.select(F.explode(entities(F.col(text_col).cast("string"))).alias("e"))
    found = stored(found.distinct().withColumn("kind", kind_of(F.col("e"))), "mentions")
    forms = found.select("kind", F.explode(forms_of(F.col("e"), F.col("kind"))).alias("f"))
    forms = forms.where("f.form is not null").groupBy("f.form").agg(F.min(F.struct("f.e", "kind", "f.given")).alias("m"))
    forms = stored(forms.select("form", "m.*"), "entities")
    drawn = forms.withColumn("attempt", F.lit(0))
    new = surrogates(F.array("e"), lambda form: F.col("attempt"), key)[0]["new"]
    for _ in range(ATTEMPTS):
        drawn = stored(drawn.withColumn("new", new), "surrogates")
        now = drawn.withColumn("new_form", F.when(F.col("given"), given_form(F.get(given_names(F.col("new"), F.col("kind")), 0), F.col("kind"))).otherwise(canonical(F.col("new"), F.col("kind"))))
        least = now.groupBy("new_form").agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        shared = now.join(least, "new_form").where("form != first").select("form")
        taken = now.join(forms.select(F.col("form").alias("new_form")), "new_form", "left_semi").select("form")
        again = stored(shared.union(taken).distinct(), "collisions")
        if again.isEmpty():
            return drawn.where("attempt > 0").select("form", "attempt")
        drawn = drawn.drop("new").join(again.withColumn("more", F.lit(1)), "form", "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def key_of(spark: SparkSession) -> str:
    """The secret key of the session (KEY_SETTING); where it is unset, a published
    one, with a warning, as anyone can then compute the surrogates again."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn with a published key", stacklevel=3)
    return key or "surrogate-key"


def replace_pii(docs: DataFrame, *, text_col: str = "text", key: str | None = None, lookup_rows: int = 2000, count_col: str | None = "n_entities") -> DataFrame:
    """docs with entities replaced in text_col, and their number in count_col.

    A null text stays null with 0 entities; texts without entities stay as
    they are; texts of any length are read whole; rows are independent, so
    repeated rows give repeated results; no rows: no rows. All columns of docs
    stay: where one has the name count_col, the number is in count_col with
    underscores after it, and without count_col it is left out. Collided forms
    up to lookup_rows are looked up in a literal map; more are joined to the
    mentions of the documents that have one. Without a key the session's is taken.
    """
    key = key_of(docs.sparkSession) if key is None else key
    redrawn = stored(attempts(docs, text_col, key), "redrawn")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found, changed, hash_, map_ = (free_name(docs, c) for c in ("pii_found", "pii_changed", "pii_hash", "pii_map"))
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.withColumn(found, entities(text))
    n = redrawn.limit(lookup_rows + 1).count()
    if n > lookup_rows:
        # A document with collided forms gets its own small map; the join is on forms, the result on texts.
        mentions = docs.select(F.xxhash64(text).alias("h"), F.explode(entities(text)).alias("e")).distinct()
        mentions = mentions.withColumn("kind", kind_of(F.col("e"))).select("h", F.explode(forms_of(F.col("e"), F.col("kind"))["form"]).alias("form")).distinct().join(redrawn, "form")
        maps = mentions.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("form", "attempt"))).alias(map_)).withColumnRenamed("h", hash_)
        out = out.withColumn(hash_, F.xxhash64(text)).join(maps, hash_, "left")
        known = F.col(map_)
    elif n:
        flat = [F.lit(x) for r in redrawn.collect() for x in (r["form"], r["attempt"])]
        known = F.create_map(*flat)
    else:
        known = None

    attempt_of = (lambda form: F.lit(0)) if known is None else (lambda form: F.coalesce(F.try_element_at(known, form), F.lit(0)))
    some = F.size(found) > 0
    out = out.withColumn(changed, F.when(some, surrogates(F.col(found), attempt_of, key)))
    news = F.concat(F.transform(changed, lambda x: x["new"]), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ENTITY, -1), news, lambda a, b: F.array(a, b))), "")
    several = rf"{BEFORE_NAME}[^\s\u00A0]+[\s\u00A0]"
    people = F.transform(F.filter(changed, lambda x: x["kind"].isin(PEOPLE) & x["e"].rlike(several)), lambda x: F.struct(F.regexp_replace(x["e"], BEFORE_NAME, "").alias("e"), F.regexp_replace(x["new"], BEFORE_NAME, "").alias("new")))
    quoted = lambda e: F.concat(F.lit(r"(?<!\p{L})\Q"), F.regexp_replace(e, r"[\s\u00A0]+", r"\\E[\\s\\u00A0]+\\Q"), F.lit(r"\E(?!\p{L})"))
    patterns = F.array_distinct(F.transform(people, lambda x: F.struct(quoted(x["e"]).alias("e"), F.regexp_replace(x["new"], r"[\s\u00A0]+", " ").alias("new"))))
    untitled = F.aggregate(patterns, joined, lambda t, x: F.regexp_replace(t, x["e"], x["new"]))
    number = [F.coalesce(F.size(F.filter(changed, lambda x: x["kind"] != "number")), F.lit(0)).cast("long").alias(free_name(docs, count_col))] if count_col else []
    new = F.when(some, untitled).otherwise(text).alias(text_col)
    return out.select(*[new if c == text_col else columns[i] for i, c in enumerate(docs.columns)], *number)
