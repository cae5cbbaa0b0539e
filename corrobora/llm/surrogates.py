r"""Surrogates for personal data: keyed, type-consistent replacements, in SQL functions only.

Entities are found by one pattern over the whole text (addresses, cards, accounts, phones,
numbers of the form ddd-dd-dddd, IPv4 and IPv6, secrets, keys with an issuer's prefix, names after a title or after words such as
"my name is", in scripts with capitals and without). Each distinct entity gets one replacement
everywhere. Its characters come from an HMAC-SHA-512 stream under the caller's key: digits
become digits, letters become letters of the same case and script, the rest of the format
stays; cards and accounts keep valid check digits. A name is replaced part by part, so that the family
name alone and the full name share a surrogate: given and family names follow the title's
gender and the name's script; particles (van, de) stay. Collision checks compare all
replacements with one another and with all real entities: of those that clash, all but one
are drawn again with the next attempt number, until none clash. Equal entities thus stay
equal, different ones stay different.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import durable

# Titles by gender, as used in English, German, French, Spanish, Russian, Greek.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "Sir", "Господин", "г-н", "Κύριος", "Κος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Madam", "Госпожа", "г-жа", "Κυρία", "Κα")
OTHER_TITLES = ("Dr", "Prof")
# Titles count in capitals too, as in headings.
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = (
    tuple(dict.fromkeys((*titles, *(t.upper() for t in titles)))) for titles in (MALE_TITLES, FEMALE_TITLES, OTHER_TITLES)
)
# Titles before names in scripts without capitals (Arabic, Hebrew, Hindi).
MALE_CASELESS = ("السيد", "מר", "श्री")
FEMALE_CASELESS = ("السيدة", "גברת", "श्रीमती")
# Titles after Chinese and Korean names, and the commonest family names before them.
MALE_SUFFIXES, FEMALE_SUFFIXES, OTHER_SUFFIXES = ("先生",), ("女士", "小姐"), ("씨",)
HAN_FAMILIES = "王李张刘陈杨赵黄周吴徐孙马朱胡林郭何高罗"
HANGUL_FAMILIES = "김이박최정강조윤장임"
# Words that introduce a name without a title.
CUES = ("my name is", "My name is", "Name:", "name:", "Mein Name ist", "mein Name ist", "je m'appelle", "Je m'appelle",
        "me llamo", "Me llamo", "меня зовут", "Меня зовут")
PARTICLES = ("van", "von", "der", "den", "de", "del", "la", "le", "da", "di", "bin", "ibn", "al", "el")

# Family names in Latin letters: each beginning with each ending.
_ROOTS = "Al Berg Brand Dal Eber Ever Fal Feld Grim Hal Hart Holm Kel Lang Lind Mar Mel Nor Ost Rem Ros Sand Stein Tor Wal Wes"
_ENDINGS = "berg by dahl den feld gard ham hart holm lund man mann mer more ner quist rick rup sen son stad stein ström ter ton vik ward well"
# Common given and family names by script.
NAMES = {
    "latin": {
        "m": "Adam Albert Andre Anton Arthur Bruno Carl Cesar Daniel David Edgar Emil Erik Felix Frank Georg Gustav Henri Hugo Ivan "
        "Jakob Jonas Julian Karl Kurt Leo Louis Lukas Marc Martin Max Noel Olaf Oscar Otto Paul Peter Rafael Robert Samuel Simon Theo "
        "Thomas Tomas Victor Walter Wilhelm Xavier",
        "f": "Adele Agnes Alma Anita Anna Bella Carla Celia Clara Diana Edith Elena Emma Erika Eva Flora Frida Greta Hanna Helen "
        "Ida Ines Irma Irene Julia Karin Klara Laura Lena Lucia Maria Marta Mona Nina Nora Olga Paula Petra Rita Rosa Sara Silvia "
        "Sofia Stella Teresa Vera Viola Wilma",
        "family": " ".join(a + b for a in _ROOTS.split() for b in _ENDINGS.split()),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Тимур",
        "f": "Анна Вера Галина Дарья Ева Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья",
        "family": "Белов Волков Громов Дроздов Ежов Жуков Зимин Ильин Котов Лосев Маслов Носов Орлов Попов Рыбин Сомов",
    },
    "greek": {
        "m": "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσονας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος Στέλιος Τάσος Φώτης",
        "f": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Σοφία Χριστίνα",
        "family": "Αγγέλου Βλάχος Γεωργίου Δήμου Ζέρβας Ηλιάδης Θεοδώρου Ιωάννου Καρράς Λάμπρου Μακρής Νικολάου Παππάς Ρήγας Σταύρου Χρήστου",
    },
    "arabic": {
        "m": "أحمد محمد علي حسن خالد عمر يوسف سامي",
        "f": "فاطمة مريم ليلى سارة هدى نور أمل زينب",
        "family": "حداد نجار خوري منصور صالح ناصر عباس كريم",
    },
    "hebrew": {
        "m": "דוד יוסף משה אברהם יעקב דניאל אורי עמית",
        "f": "שרה רחל לאה מרים נועה תמר יעל מיכל",
        "family": "כהן לוי מזרחי פרץ ביטון דהן אברמוב פרידמן",
    },
    "devanagari": {
        "m": "राम अमित विजय सुरेश रोहन अर्जुन मोहन राजेश",
        "f": "सीता प्रिया अनीता मीरा कविता राधा पूजा सुनीता",
        "family": "शर्मा वर्मा गुप्ता सिंह पटेल मेहता जोशी यादव",
    },
    "han": {"m": "", "f": "", "family": " ".join(HAN_FAMILIES)},
    "hangul": {"m": "", "f": "", "family": " ".join(HANGUL_FAMILIES)},
}
#: Syllables that a first draw adds: none where the lists are long.
_BARE_FROM = {"latin": 0, "cyrillic": 1, "greek": 1, "arabic": 1, "hebrew": 1, "devanagari": 1}
_SYLLABLES = {
    "latin": "an ber dal en fer gan hol in kar lin mar nel or per ros sen",
    "cyrillic": "ан бер дал ен фер ган хол ин кар лин мар нел ор пер рос сен",
    "greek": "αν βερ δαλ εν φερ γαν χολ ιν καρ λιν μαρ νελ ορ περ ρος σεν",
    "arabic": "ان بر دل ين فر غن هل كر لن مر نل ور",
    "hebrew": "אן בר דל ין פר גן הל קר לן מר נל ור",
    "devanagari": "अन बर दल एन फर गन हल कर लन मर",
    "han": "伟 芳 娜 敏 静 强 磊 洋 艳 勇 军 杰 娟 涛 明 超",
    "hangul": "민 서 준 지 우 현 수 영 진 호 은 희",
}



def _any_of(*words: str) -> str:
    return "|".join(sorted(set(words), key=len, reverse=True))


_TITLE = _any_of(*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)
_CASELESS = _any_of(*MALE_CASELESS, *FEMALE_CASELESS)
_SUFFIX = _any_of(*MALE_SUFFIXES, *FEMALE_SUFFIXES)
# A name starts with one of these or outside ASCII; saves a trial of all titles at each letter.
_FIRST = "".join(sorted({w[0] for w in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *CUES) if w[0].isascii()}))
_BEFORE = rf"^(?:(?:{_TITLE})\.?|{_any_of(*CUES)}|{_CASELESS}) "
_AFTER = rf" ?(?:{_SUFFIX}|{_any_of(*OTHER_SUFFIXES)})$"
_WORD = r"\p{Lu}(?:\p{L}+(?:['’-]\p{L}+)*|['’]\p{L}+(?:-\p{L}+)*)"
_FULL = rf"(?:\p{{Lu}}\.(?: ?\p{{Lu}}\.){{0,2}} )?{_WORD}(?: (?:(?:{_any_of(*PARTICLES)}) ){{0,2}}(?:\p{{Lu}}\. )?{_WORD}){{0,3}}"
_PLAIN = r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}]{2,}"
PATTERNS = {
    # An address starts where its run of letters, digits and marks does, so that each run is read once.
    # What stands before is looked at only where a letter or digit follows a mark.
    "email": r"(?=[\p{L}\p{N}])(?<![\p{L}\p{N}])(?:(?<![._%+-])|(?<![\p{L}\p{N}][._%+-]{1,64}))[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "token": r"(?<![0-9A-Za-z_-])(?:(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?[0-9A-Za-z_-]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_[0-9A-Za-z_]{20,}"
    r"|xox[abprs]-[0-9A-Za-z-]{10,}|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))",
    "secret": r"(?<![0-9A-Za-z])(?=[a-fA-F]{0,63}[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "social": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
    r"|\+[0-9]{1,3}(?=(?:[ .()-]{1,3}[0-9]{1,4}){2,6}(?![0-9]))(?=(?:[^0-9]{0,3}[0-9]){7,13}(?![0-9]|[ .()-]{1,3}[0-9]))(?:[ .-]{1,2}\(?[0-9]{1,4}\)?){2,6}"
    r"|0[1-9](?:[ .-][0-9]{2}){4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[a-fA-F:]{0,39}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "name": rf"(?=[{_FIRST}]|[^\x00-\x7F])(?:(?<!\p{{L}})(?:(?:(?:{_TITLE})\.?|{_any_of(*CUES)}) (?:(?:{_any_of(*PARTICLES)}) ){{0,2}}{_FULL}|(?:{_CASELESS}) {_PLAIN}(?: {_PLAIN})?"
    rf"|[{HANGUL_FAMILIES}]\p{{IsHangul}}{{2}} ?씨)|[{HAN_FAMILIES}]\p{{IsHan}}{{0,2}}(?:{_SUFFIX}))",
}
#: What a key's issuer puts before it.
_PREFIX = r"^(?:(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?|gh[pousr]_|github_pat_|xox[abprs]-|AKIA)"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _rest() -> str:
    """What stands before the next entity, for Java: words, numbers and marks in which none can start go whole, other text after a trial.

    A word goes whole where neither a letter, a digit nor a mark of addresses, keys or IPv6 follows:
    an address has an at-sign after its run, other entities have a digit, a capital or a mark, names a title.
    """
    titles = [w for w in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *MALE_CASELESS, *FEMALE_CASELESS) if w[0] < "Ā"]
    cues = [w for w in CUES if w[0] < "Ā"]
    letters = [chr(i) for i in range(0x100) if chr(i).isalpha() and chr(i) not in "ªºµ"]
    lower = "".join(c for c in letters if c == c.lower())
    first = "".join(sorted({w[0] for w in (*titles, *cues)}))
    plain = "".join(c for c in letters if c not in first)
    ends = "".join(rf"\x{i:02x}" for i in range(0x80) if not chr(i).isalnum() and chr(i) not in "_%+@:-.(")
    after = rf"(?:[{ends}]+|\.[{ends}]+)"
    titled = rf"(?:{_any_of(*titles)})\.? |(?:{_any_of(*cues)}) "
    return (
        rf"(?<![{''.join(letters)}])(?:[{plain}]|(?!{titled})[{first}])[{lower}]*{after}"
        r"|[^0-9A-Za-z(+\x80-\x{10FFFF}]+|[(+](?![0-9])|[^\x00-\x7F\p{L}\p{N}]+"
        # Other scripts: an address or a name may start at a word's first letter, a Chinese name at any.
        rf"|(?<!\p{{L}})(?!{PATTERNS['name']})[\p{{L}}&&[ɐ-￿]&&[^{HAN_FAMILIES}]]+(?:{after}|[^\x00-\x7F\p{{L}}\p{{N}}]+)"
        # Letters beyond 16 bits start addresses only.
        r"|[\p{L}\p{N}&&[\x{10000}-\x{10FFFF}]]++(?![\p{L}\p{N}._%+@-])"
        # Within letters or digits of ASCII nothing starts.
        rf"|(?!{ENTITY})(?s:[A-Za-z]+|[0-9]+|.)"
    )


#: Each match is a stretch of text (group 1) and the entity after it (group 2; empty after a last stretch).
STRETCH = rf"\G(?!\z)((?:{_rest()})*+)({ENTITY}|\z)"

_ALPHABETS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "accented": "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿ",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}


def kind(entity: Column) -> Column:
    """The type of an entity: the first whose pattern matches all of it."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def _bare(entity: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(F.regexp_replace(entity, _BEFORE, ""), _AFTER, "")


def _gender(entity: Column) -> Column:
    """mr, mrs or, where the title leaves it open, dr."""
    title = F.regexp_extract(entity, rf"^({_TITLE}|{_CASELESS})\.? ", 1)
    male = title.isin(*MALE_TITLES, *MALE_CASELESS) | entity.rlike(rf"(?:{_any_of(*MALE_SUFFIXES)})$")
    female = title.isin(*FEMALE_TITLES, *FEMALE_CASELESS) | entity.rlike(rf"(?:{_any_of(*FEMALE_SUFFIXES)})$")
    return F.when(male, "mr").when(female, "mrs").otherwise("dr")


def identity(name: Column, entity: Column) -> Column:
    """What two mentions of one entity share: letters in lower case, numbers without their layout.

    Names: mr, mrs or dr by the title's gender, then the words without particles.
    """
    digits = F.regexp_replace(entity, "[^0-9]", "")
    tight = F.upper(F.regexp_replace(entity, " ", ""))
    words = F.filter(F.split(F.lower(_bare(entity)), " "), lambda w: ~w.isin(*PARTICLES))
    spoken = F.concat_ws(" ", _gender(entity), F.array_join(words, " "))
    return (
        F.when(name.isin("card", "social"), digits)
        .when(name == "phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(name == "account", tight)
        .when(name == "name", spoken)
        .when(name == "token", entity)
        .otherwise(F.lower(entity))
    )


def parts(name: Column, who: Column) -> Column:
    """Array of (type, who): a name's given names and, last, its family name; any other entity itself."""
    words = F.split(who, " ")
    lead = F.element_at(words, 1)
    given = F.transform(
        F.slice(words, 2, F.size(words) - 2), lambda w: F.struct(F.lit("given").alias("type"), F.concat_ws(" ", lead, w).alias("who"))
    )
    family = F.struct(F.lit("name").alias("type"), F.concat_ws(" ", lead, F.element_at(words, -1)).alias("who"))
    own = F.array(F.struct(name.alias("type"), who.alias("who")))
    return F.when(name == "name", F.concat(given, F.array(family))).otherwise(own)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha512(secret).digest() if len(secret) > 128 else secret).ljust(128, b"\0")
    pad = lambda by: F.lit(bytes(c ^ by for c in secret))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 512)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 512)


def _stream(key: str, name: Column, who: Column, attempt: Column) -> Column:
    """512 hexadecimal digits that key, type, identity and attempt determine."""
    seed = F.concat_ws("|", name, attempt.cast("string"), who)
    return F.concat(*[_hmac(key, F.concat_ws("|", F.lit(str(i)), seed)) for i in range(4)])


def _byte(stream: Column, place: Column) -> Column:
    return F.conv(F.substring(stream, (place * 2 % 512) + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def _pick(words: str, byte: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words.split()]), byte % len(words.split()) + 1)


def _redrawn(who: Column, stream: Column, hexadecimal: Column) -> Column:
    """``who`` with each character replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), _letter("0123456789abcdef", b))
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), _letter(_ALPHABETS["lower"], b))
            .when(c.rlike("[A-Z]"), F.upper(_letter(_ALPHABETS["lower"], b)))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter(_ALPHABETS["cyrillic"], b))
            .when(c.rlike(r"\p{IsGreek}"), _letter(_ALPHABETS["greek"], b))
            .when(c.rlike(r"\p{IsLatin}"), _letter(_ALPHABETS["accented"], b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(who, ""), one), "")


def _checked(digits: Column) -> Column:
    """``digits`` with the last one made a valid check digit (Luhn)."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(0), F.length(body) - 1)
    return F.concat(body, ((10 - F.aggregate(places, F.lit(0), add) % 10) % 10).cast("string"))


def _account(country: Column, body: Column) -> Column:
    """An account number of a country with valid check digits (modulo 97, letters count from 10)."""

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    letters = F.split(F.concat(body, country, F.lit("00")), "")
    check = 98 - F.aggregate(letters, F.lit(0), add)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _new_name(name: Column, who: Column, stream: Column, attempt: Column) -> Column:
    """One part of a name, given or family; attempts after the first add syllables. Hyphenated parts stay so."""
    lead, word = F.element_at(F.split(who, " "), 1), F.element_at(F.split(who, " "), -1)
    is_male = (lead == "mr") | ((lead != "mrs") & (_byte(stream, F.lit(0)) % 2 == 0))
    is_given = name == "given"
    out = None
    for script, lists in NAMES.items():

        def one(at: int) -> Column:
            family = _pick(lists["family"], _byte(stream, F.lit(at)) * 256 + _byte(stream, F.lit(at + 7)))
            if not lists["m"]:
                return family
            given = F.when(is_male, _pick(lists["m"], _byte(stream, F.lit(at)))).otherwise(_pick(lists["f"], _byte(stream, F.lit(at))))
            return F.when(is_given, given).otherwise(family)

        # Chinese and Korean names keep their length at first
        n = attempt + (F.lit(_BARE_FROM[script]) if lists["m"] else F.length(word) - 1)
        some = F.transform(F.sequence(F.lit(1), n), lambda i: _pick(_SYLLABLES[script], _byte(stream, i + 2)))
        made = F.concat(one(1), F.when(n > 0, F.array_join(some, "")).otherwise(""))
        if lists["m"]:
            made = F.when(word.contains("-"), F.concat(made, F.lit("-"), one(2))).otherwise(made)
        out = made if out is None else F.when(who.rlike(rf" \p{{Is{script.title()}}}"), made).otherwise(out)
    return out


def _draw(key: str, name: Column, who: Column, attempt: Column) -> Column:
    """The replacement's identity for an attempt."""
    stream = F.col("stream")
    plain = _redrawn(who, stream, name.isin("secret", "ip6"))
    fixed = F.length(F.regexp_extract(who, _PREFIX, 0))
    token = F.concat(F.substring(who, F.lit(1), fixed), F.substring(plain, fixed + 1, F.length(who)))
    longer = F.regexp_replace(F.substring(stream, F.lit(3), F.greatest(attempt - 3, F.lit(0))), "[0-9]", "g")
    mail = F.concat(
        longer,  # short addresses have few look-alikes; later attempts lengthen them
        _redrawn(F.regexp_extract(who, r"^(.*)\.", 1), stream, F.lit(False)), F.lit("."), F.regexp_extract(who, r"([^.]*)$", 1)
    )
    octets = F.concat_ws(".", *[_byte(stream, F.lit(i)).cast("string") for i in range(4)])
    return (
        F.when(name == "email", mail)
        .when(name == "ip", octets)
        .when(name == "card", _checked(plain))
        .when(name == "token", token)
        .when(name == "account", _account(F.substring(who, 1, 2), F.substring(plain, F.lit(5), F.length(who))))
        .when(name.isin("name", "given"), _new_name(name, who, stream, attempt))
        .otherwise(plain)
    )


def _dressed(name: Column, entity: Column, made: Column) -> Column:
    """The replacement (its parts ``made``) in the layout and case of a mention.

    Phones keep what stands before the last ten digits, names their title and particles.
    """
    drawn = F.element_at(made, 1)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    country = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)))
    drawn = F.when(name == "phone", F.concat(country, drawn)).otherwise(drawn)
    layout = F.transform(F.split(entity, ""), lambda c: F.when(c.rlike("[0-9A-Za-z]"), 1).otherwise(0))
    poured = F.array_join(
        F.transform(
            F.split(entity, ""),
            lambda c, i: F.when(
                F.element_at(layout, i + 1) == 1,
                F.substring(drawn, F.aggregate(F.slice(layout, 1, i + 1), F.lit(0), lambda a, x: a + x), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    spoken = F.split(_bare(entity), " ")
    real = lambda w: ~w.isin(*PARTICLES)
    cased = lambda w, new: F.when(w.rlike(r"^\p{Lu}[\p{Lu}'’-]+$"), F.upper(new)).otherwise(new)
    renamed = F.transform(
        spoken, lambda w, i: F.when(real(w), cased(w, F.element_at(made, F.size(F.filter(F.slice(spoken, F.lit(1), i + 1), real))))).otherwise(w)
    )
    said = F.concat(F.regexp_extract(entity, _BEFORE, 0), F.array_join(renamed, " "), F.regexp_extract(entity, _AFTER, 0))
    return (
        F.when(name.isin("card", "social", "phone", "account"), poured)
        .when(name == "name", said)
        .when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(drawn))
        .otherwise(drawn)
    )


def _mark(drawn: Column) -> Column:
    """What replacements are told apart by: names also without regard to case."""
    return F.when(F.col("type").isin("name", "given"), F.lower(drawn)).otherwise(drawn)


def draw_surrogates(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(type, who, drawn) for distinct (type, who): replacements that clash with nothing; durable.

    Entities still clashing after ``most_attempts`` raise an error rather than share a replacement.
    """
    entities = durable(entities.select("type", "who").distinct())
    settled, open_ = None, entities
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(most_attempts):
        tries = F.lit(attempt)
        drawn = durable(
            # A draw takes far longer than reading what it is for: the small files are dealt to all tasks.
            open_.repartition(tasks, "type", "who")
            .withColumn("stream", _stream(key, F.col("type"), F.col("who"), tries))
            .select("type", "who", _draw(key, F.col("type"), F.col("who"), tries).alias("drawn"))
        )
        drawn = drawn.withColumn("mark", _mark(F.col("drawn")))
        real = entities.select("type", _mark(F.when(F.col("type").isin("name", "given"), F.regexp_replace("who", "^[^ ]* ", "")).otherwise(F.col("who"))).alias("mark"))
        taken = real if settled is None else real.unionByName(settled.select("type", "mark"))
        free = drawn.join(durable(taken), ["type", "mark"], "left_anti")
        won = durable(free.groupBy("type", "mark").agg(F.min_by(F.struct("who", "drawn"), "who").alias("w")).select("type", "mark", "w.*"))
        settled = won if settled is None else settled.unionByName(won)
        open_ = durable(open_.join(won.select("type", "who"), ["type", "who"], "left_anti"))
        if open_.isEmpty():
            return durable(settled.select("type", "who", "drawn"))
    raise RuntimeError(f"replacements still clash after {most_attempts} attempts")


def _one_person(found: DataFrame) -> DataFrame:
    """Names whose title leaves the gender open take that of the same family name in the same text, if only one stands there."""
    family = F.when(F.col("type") == "name", F.element_at(F.split("who", " "), -1))
    of = Window.partitionBy("uid", "type", "family")
    lead = F.element_at(F.split("who", " "), 1)
    seen = found.withColumn("family", family).withColumn("leads", F.collect_set(F.when(lead != "dr", lead)).over(of))
    taken = F.concat(F.element_at("leads", 1), F.substring("who", 3, 1 << 30))
    who = F.when((F.col("type") == "name") & (lead == "dr") & (F.size("leads") == 1), taken).otherwise(F.col("who"))
    return seen.withColumn("who", who).drop("family", "leads")


def replace_personal_data(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n_entities, n_distinct) per row: the text with every entity replaced.

    ``key`` is the secret that replacements depend on. Texts without entities, empty and null
    texts come back as they are (null stays null). Equal texts have equal results; null or
    repeated identifiers and other columns do not matter; an empty table gives an empty result.
    """
    text = F.col(text_col)
    uid = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    mentions = F.filter(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(2)), lambda e: e != "")
    found = durable(
        docs.select(uid.alias("uid"), F.explode(F.array_distinct(mentions)).alias("entity"))
        .distinct()
        .withColumn("type", kind(F.col("entity")))
        .withColumn("type", F.coalesce("type", F.lit("secret")))
        .withColumn("who", identity(F.col("type"), F.col("entity")))
    )
    found = _one_person(found)
    pieces = found.select("*", F.posexplode(parts(F.col("type"), F.col("who"))).alias("place", "p")).select(
        "uid", "entity", F.col("type").alias("whole"), F.col("who").alias("whose"), "place", "p.*"
    )
    drawn = draw_surrogates(pieces, key)
    made = F.transform(F.array_sort(F.collect_list(F.struct("place", "drawn"))), lambda x: x["drawn"])
    dressed = (
        pieces.join(drawn, ["type", "who"])
        .groupBy("uid", "entity", F.col("whole").alias("type"), F.col("whose").alias("who"))
        .agg(made.alias("made"))
        .select("uid", "entity", "who", _dressed(F.col("type"), F.col("entity"), F.col("made")).alias("new"))
    )
    plans = durable(
        dressed.groupBy("uid").agg(
            F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("plan"),
            F.countDistinct("who").alias("n_distinct"),
        )
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), uid.alias("uid"))
    joined = rows.join(plans.hint("merge"), "uid", "left")  # plans grow with the texts; alike at every size
    has = F.col("plan").isNotNull()
    cut = joined.withColumns({name: F.when(has, F.regexp_extract_all("text", F.lit(STRETCH), F.lit(at))) for name, at in (("pieces", 1), ("ents", 2))})
    rebuilt = F.array_join(F.zip_with("pieces", "ents", lambda p, e: F.concat(p, F.coalesce(F.element_at(F.col("plan"), e), e))), "")
    return cut.select(
        "doc_id",
        F.when(has, rebuilt).otherwise(F.col("text")).alias("text"),
        F.when(has, F.size(F.filter("ents", lambda e: e != ""))).otherwise(0).cast("long").alias("n_entities"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
    )
