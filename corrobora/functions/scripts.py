"""Scripts and encodings: romanised names and texts that were encoded twice, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Hangul syllables by the Revised Romanisation, letter by letter; Cyrillic by ISO 9 and Greek, without marks.
INITIALS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
FINALS = " k kk ks n nj nh t l lk lm lb ls lt lp lh m p ps t t ng t t k t p t".split(" ")
_CYRILLIC = ("абвгґдеёжзиійклмнопрстуўфхцчшщыэюяїєјљњћђџѓќѕ", "abvggdeezziijklmnoprstuufhccssyeuaiejlncddgkz")
_GREEK = ("αβγδεζηικλμνξοπρσςτυωάέήίόύώϊϋΐΰ", "abgdezeiklmnxoprsstyoaeeioyoiyiy")
_LONG = {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps"}
_SILENT = "ъьʹʺ"
#: What Windows-1252 shows for the bytes 0x80 to 0x9F; the five that it lacks stand for themselves.
_SHOWN = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def _syllable(letter: Column) -> Column:
    """The Latin letters of a Hangul syllable; other characters stay."""
    code = F.ascii(letter) - 0xAC00
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    spelled = F.concat(pick(INITIALS, F.floor(code / 588)), pick(VOWELS, F.floor(code % 588 / 28)), pick(FINALS, code % 28))
    return F.when(code.between(0, 11171), spelled).otherwise(letter)


def romanised(text: Column) -> Column:
    """A lower-case text with Cyrillic, Greek and Hangul letters in Latin ones; other scripts stay.

    Hangul goes syllable by syllable, sounds that change between syllables are not followed.
    """
    source, target = _CYRILLIC[0] + _GREEK[0], _CYRILLIC[1] + _GREEK[1]
    latin = F.translate(text, source + _SILENT, target)
    for letter, letters in _LONG.items():
        latin = F.replace(latin, F.lit(letter), F.lit(letters))
    foreign = F.when(text.rlike(r"[\x{370}-\x{52F}]"), latin).otherwise(text)
    hangul = F.array_join(F.transform(F.split(foreign, ""), _syllable), "")
    return F.when(text.rlike(r"[\x{AC00}-\x{D7A3}]"), hangul).otherwise(foreign)


def _once(text: Column) -> Column:
    """The text whose UTF-8 bytes were read as single characters, if it is one; else the text itself.

    Every character must stand for a byte, and the bytes must be valid UTF-8: a text with
    accents of its own is not, as they would have to come in the pairs that UTF-8 makes.
    """
    bytes_ = F.translate(text, _SHOWN, _BYTES)
    wide = bytes_.rlike(r"[\x{80}-\x{FF}]") & ~bytes_.rlike(r"[^\x{00}-\x{FF}]")
    raw = F.encode(F.when(wide, bytes_), "ISO-8859-1").cast("string")
    return F.coalesce(F.try_validate_utf8(raw), text)


def charset_repaired(text: Column, times: int = 2) -> Column:
    """A text that was encoded as UTF-8 up to ``times`` times too often, as it was; other texts stay as they are."""
    for _ in range(times):
        text = _once(text)
    return text
