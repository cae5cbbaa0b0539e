"""Text, name, place, link and date expressions as column functions, without UDFs.

Lengths and truncations count code points. Identity keys fold case and Latin accents and
romanise Cyrillic, Greek and Hangul; other scripts stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions import scripts

# The entities that occur in scraped text.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def clean(text: Column) -> Column:
    """Entities decoded, footnote marks and control characters dropped, white space collapsed."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"\[(?:\d{1,3}|[a-z])\]", "")
    text = F.regexp_replace(F.translate(text, " ", " "), r"[\x{200B}-\x{200D}\x{FEFF}\x00-\x08\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_paragraphs(text: Column) -> Column:
    """Like ``clean`` within paragraphs; blank lines between them become one."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), clean), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def fold(text: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def identity_key(text: Column) -> Column:
    """Letters and digits of the folded and romanised text; null if there are none."""
    return F.nullif(F.regexp_replace(scripts.romanised(fold(text)), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def restates(text: Column, other: Column, lead: str = "The mission: ") -> Column:
    """Whether a text only says what ``other`` says: equal but for a last full stop, or begun with ``lead`` and holding it."""
    bare = lambda c: F.rtrim(F.trim(c), F.lit("."))
    return (bare(text) == bare(other)) | (F.startswith(text, F.lit(lead)) & F.contains(F.substr(text, F.lit(len(lead) + 1)), bare(other)))


def entity_number(text: Column, low: int = 1, high: int = 2000) -> Column:
    """The number that a title names ('Episode 8', 'Ep. 8', 'E8', '#8', a bare number), if in range."""
    marked = F.regexp_extract(text, r"(?i)(?:\b(?:episode|ep\.?|e)\s*#?\s*|#\s*)0*(\d{1,4})(?![0-9])", 1)
    bare = F.regexp_extract(text, r"^\s*0*(\d{1,4})\s*$", 1)
    number = F.coalesce(F.nullif(marked, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("int")
    return F.when(number.between(low, high), number)


def canonical_title(text: Column, number: Column) -> Column:
    """'Episode #NNN - Descriptor'; a title that names another number loses its descriptor."""
    said = entity_number(text)
    rest = F.regexp_replace(clean(text), r"(?i)^.*?(?:\b(?:episode|ep\.?|e)\s*#?\s*|#\s*)\d{1,4}\s*[-:|]*\s*", "")
    head = F.concat(F.lit("Episode #"), F.format_string("%03d", number))
    keep = (rest != "") & (said.isNull() | (said == number))
    return F.when(keep, F.concat(head, F.lit(" - "), rest)).otherwise(head)


def person_name(raw: Column) -> Column:
    """A name without tags, bullets, numbering, trailing brackets and roles; null if nothing like a name is left."""
    name = F.regexp_replace(raw, r"<[^>]*>", " ")
    name = F.regexp_replace(name, r"^[\s*·•-]+|^\s*\d+[.)]\s*", "")
    name = F.regexp_replace(name, r"\s*[(\[][^)\]]*[)\]]\s*$|\s+[-–]\s+.*$", "")
    name = clean(name)
    ok = F.length(name).between(2, 60) & ~name.rlike(r"[{}<>;=]|^\W+$") & ~F.lower(name).isin("guest", "guests", "tba", "none", "n/a")
    return F.when(ok, name)


def spelling_score(name: Column) -> Column:
    """How carefully a name is spelt: capitals and hyphens count for it, one case throughout against it."""
    number = lambda c, n: F.when(c, n).otherwise(0)
    return (
        number(name.rlike(r"^\p{Lu}"), 2)
        + number(F.contains(name, F.lit("-")), 3)
        + number(name.rlike(r"^(?:\p{Lu}\p{Ll}+[ -]?)+$"), 3)
        - number((name == F.upper(name)) & (name != F.lower(name)), 3)
        - number((name == F.lower(name)) & (name != F.upper(name)), 2)
    )


def place(raw: Column, home: str = "South Korea", home_names=("korea", "south korea", "republic of korea")) -> Column:
    """struct(name, city, country, is_overseas) from 'Venue, City, Country'."""
    parts = F.transform(F.split(clean(raw), r"\s*,\s*"), lambda x: F.trim(x))
    last = F.element_at(parts, -1)
    at_home = F.lower(last).isin(*home_names) | (F.size(parts) == 1)
    country = F.when(at_home, F.lit(home)).otherwise(last)
    city = F.when(F.size(parts) > 2, F.element_at(parts, -2)).when((F.size(parts) == 2), F.element_at(parts, 1))
    city = F.regexp_replace(city, r"(?i)[- ](?:si|city|gun|gu)$", "")
    return F.struct(F.element_at(parts, 1).alias("name"), city.alias("city"), country.alias("country"), (~at_home).alias("is_overseas"))


def absolute_url(raw: Column, base: str) -> Column:
    """A link made absolute; null unless it is an http link without spaces or quotes."""
    link = F.trim(F.replace(raw, F.lit("&amp;"), F.lit("&")))
    link = (
        F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit(base.rstrip("/")), link))
        .otherwise(link)
    )
    return F.when(link.rlike(r"^https?://[^\s\"'<>]+$"), link)


def tag(raw: Column) -> Column:
    name = F.regexp_replace(clean(raw), r"^[#·\s-]+|[·\s-]+$", "")
    return F.when(F.length(name).between(2, 40) & ~F.lower(name).isin("home", "menu", "login", "search"), name)


def stable_hash(value: Column) -> Column:
    return F.sha1(F.lower(F.trim(value)).cast("binary"))


def stable_list_hash(values: Column) -> Column:
    """The hash of a list that ignores order and case."""
    return F.sha1(F.array_join(F.array_sort(F.transform(values, lambda v: F.lower(F.trim(v)))), "|").cast("binary"))


def comparison_key(text: Column, letters: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", ""), 1, letters)


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, width - 1)), F.lit("…")))


def spoken_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def redacted(text: Column) -> Column:
    """Values of secret-like settings, long hexadecimal strings and secret query parameters are masked."""
    text = F.regexp_replace(text, r"(?i)\b(token|secret|password|api_?key)(\s*[=:]\s*)\"?[^\s\"&]+\"?", "$1$2***")
    text = F.regexp_replace(text, r"(?i)([?&](?:key|token|sig)=)[^&\s]+", "$1***")
    return F.regexp_replace(text, r"\b[0-9a-f]{32,}\b", "***")


def lexical_variety(text: Column) -> Column:
    """Distinct words over words, to four digits; null without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.round(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), 4)


def parsed_date(raw: Column, low: int, high: int) -> Column:
    """A date from '2024-3-9', '2024.03.09', '9 March 2024', 'March 9, 2024' or '2024년 3월 9일', if its year is in range."""
    raw = F.regexp_replace(raw, r"\s*\([^)]*\)", "")
    months = [F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]
    month = lambda word: F.array_position(F.array(*months), F.lower(F.substring(word, 1, 3))).cast("string")
    got = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    iso, ko = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
    dmy, mdy = r"(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})", r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"
    shapes = [
        (iso, (got(iso, 1), got(iso, 2), got(iso, 3))),
        (ko, (got(ko, 1), got(ko, 2), got(ko, 3))),
        (dmy, (got(dmy, 3), month(got(dmy, 2)), got(dmy, 1))),
        (mdy, (got(mdy, 3), month(got(mdy, 1)), got(mdy, 2))),
    ]
    tried = [
        F.when(raw.rlike(p), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")) for p, (y, m, day) in shapes
    ]
    found = F.coalesce(*tried)
    return F.when(F.year(found).between(low, high), found)


def spoken_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s")))
    )


def truthy(value: Column) -> Column:
    """The value, or null where it is empty or '0'."""
    return F.when((value != "") & (value != "0"), value)


def weak_int(raw: Column) -> Column:
    """The whole number that a text begins with; 0 if it begins with none."""
    return F.coalesce(F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def title_descriptor(title: Column) -> Column:
    """What follows 'Episode #n - '; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(title), r"^Episode\s*#\d+\s*-\s*(.+)$", 1)), F.lit(""))


def title_key(title: Column) -> Column:
    """Letters and digits of a title's descriptor, or of the title without one, in lower case."""
    return F.regexp_replace(F.lower(clean(F.coalesce(title_descriptor(title), title))), r"[^\p{L}\p{N}]+", "")


def listed(raw: Column) -> Column:
    """The items of a list written with commas, '&', dots, new lines or 'and'."""
    return F.filter(F.transform(F.split(raw, r"\s*(?:[,&·\n]|\band\b)\s*"), F.trim), lambda x: x != "")


def unglued(raw: Column) -> Column:
    """Names that were run together, cut where a small letter meets a capital: only long texts with two such places."""
    cut = F.split(raw, r"(?<=[a-z])(?=[A-Z])")
    return F.when((F.length(raw) > 22) & (F.regexp_count(raw, F.lit("[a-z](?=[A-Z])")) >= 2), cut).otherwise(F.array(raw))


def merged(base: Column, own: Column) -> Column:
    """Two maps as one; a value of ``own`` that is not null wins."""
    keys = F.array_union(F.map_keys(base), F.map_keys(own))
    value = lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(own, k), F.element_at(base, k)).alias("value"))
    return F.map_from_entries(F.transform(keys, value))


def display_title(title: Column, untitled: str) -> Column:
    """A title without 'Episode #n - '; ``untitled`` where nothing else is left."""
    said = F.regexp_extract(title, r"(?i)^Episode\s*#\d+\s*-\s*(.+)$", 1)
    bare = F.coalesce(title, F.lit("")).rlike(r"(?i)^(?:Episode\s*#\d+)?$")
    return F.when(F.coalesce(said, F.lit("")) != "", said).when(bare, untitled).otherwise(title)


def source_title(raw: Column, sites: tuple[str, ...], show: str) -> Column:
    """A scraped title without a trailing site (patterns) and a leading show name (pattern); null for under four characters or nothing left."""
    s = F.trim(raw)
    cut = F.trim(F.regexp_replace(s, rf"(?i)\s*[-–|]\s*(?:{'|'.join(sites)})$", ""))
    cut = F.trim(F.regexp_replace(cut, rf"(?i)^(?:{show})\s*[–—:|-]?\s*", ""))
    return F.when(F.length(s) >= 4, F.nullif(cut, F.lit("")))


def plain_person(raw: Column, noise: tuple[str, ...] = ()) -> Column:
    """A scraped name without tags, bullets, numbers, a trailing (role), [note] or dash and role; null if it is noise or not 2 to 60 long."""
    s = F.regexp_replace(raw, "<[^>]+>", "")
    for pattern in (r"^[\s–—•*·,;:-]+|[\s–—•*·,;:-]+$", r"^\d+[.)]\s*", r"\s*\([^)]*\)\s*$", r"\s*\[[^\]]*\]\s*$", r"\s+[–—]\s+.*$"):
        s = F.regexp_replace(s, pattern, "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s).between(2, 60) & ~F.lower(s).isin("", *noise), s)


def plain_key(raw: Column, noise: tuple[str, ...] = ()) -> Column:
    """Latin letters, digits and Hangul of a plain name in lower case; empty for none."""
    return F.coalesce(F.regexp_replace(F.lower(plain_person(raw, noise)), r"[^a-z0-9가-힣]+", ""), F.lit(""))


# Numbers in addresses that are picture sizes.
SIZES = (150, 300, 360, 480, 600, 640, 720, 1080, 1280, 1920)


def relevant_url(url: Column, number: Column) -> Column:
    """Whether an address's path does not name another number: the first of its 2 to 4 digit numbers that tells decides.

    The number itself says yes; years (1900 to 2100), picture sizes and numbers within 2 say nothing.
    """
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    found = F.transform(F.regexp_extract_all(path, F.lit(r"(?<!\d)(\d{2,4})(?!\d)"), F.lit(1)), lambda x: x.cast("int"))
    tells = lambda n: (n == number) | ~(n.between(1900, 2100) | n.isin(*SIZES) | (F.abs(n - number) <= 2))
    first = F.get(F.filter(found, tells), F.lit(0))
    return F.coalesce(first == number, F.lit(True))


def import_date(raw: Column, after: str = "2009-01-01", before: str = "2030-01-01") -> Column:
    """A date as an import file writes it (with or without a time), if it lies between two days."""
    day = F.coalesce(F.substring(F.trim(raw), 1, 10).try_cast("date"), parsed_date(raw, 1900, 2100))
    return F.when((day > F.lit(after).cast("date")) & (day < F.lit(before).cast("date")), day)
