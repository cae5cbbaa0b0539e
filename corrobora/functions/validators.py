"""Field validators: each gives struct(valid, value, reason), with the value normalised and a reason only if invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions import text as t

# Words that tell page furniture from content.
NAV_WORDS = (
    "sign in", "log in", "login", "register", "subscribe", "cookie", "privacy policy", "terms of service",
    "all rights reserved", "copyright ©", "404", "page not found", "javascript is disabled",
    "enable javascript", "skip to content", "main menu", "navigation", "advertisement",
    "click here", "read more »", "您", "403 forbidden", "access denied", "just a moment",
    "under maintenance", "site maintenance", "temporarily unavailable", "service unavailable",
    "coming soon", "be right back", "checking your browser", "are you a robot",
    "no results found", "nothing found", "something went wrong",
)
# Bounds of lengths and counts.
SYNOPSIS_CHARS, TITLE_CHARS, GUESTS_AT_MOST, TAGS_AT_MOST = (15, 4000), (4, 300), 30, 20
PLACEHOLDER_IMAGE = r"(?i)/(?:logo|placeholder|default|no[-_]?image|blank|spacer|avatar)[-_.]"


def once(value: Column, of) -> Column:
    """``of(value)``, where the value is computed once however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def furniture(text: Column) -> Column:
    """Whether a text holds words of page furniture."""
    words = F.array(*[F.lit(w) for w in NAV_WORDS])
    return once(F.lower(text), lambda lower: F.exists(words, lambda w: F.contains(lower, w)))


def verdict(value: Column, *rules: tuple[Column, str]) -> Column:
    """struct(valid, value, reason): the reason of the first rule that holds, or the value."""
    reason = F.lit(None).cast("string")
    for failed, why in reversed(rules):
        reason = F.when(failed, why).otherwise(reason)
    return F.struct(reason.isNull().alias("valid"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def number(raw: Column, low: int = 1, high: int = 2000) -> Column:
    n = F.regexp_extract(F.trim(raw), r"^0*(\d{1,9})$", 1).try_cast("int")
    return verdict(
        n.cast("string"), (~F.coalesce(F.trim(raw).rlike(r"^[+-]?\d+(?:\.\d+)?$"), F.lit(False)), "not numeric"), (n.isNull(), "not a clean integer"), (~n.between(low, high), "out of range")
    )


def title(raw: Column) -> Column:
    return once(
        t.clean(raw),
        lambda v: verdict(
            v,
            (F.coalesce(F.length(v), F.lit(0)) < TITLE_CHARS[0], "too short"),
            (F.length(v) > TITLE_CHARS[1], "too long"),
            (furniture(v), "navigation"),
            (v.rlike(r"(?i)Episodes?\s*[-–]\s*Page\s*\d+"), "paged index"),
            (v.rlike(r"(?i)^\s*(?:home|episodes?|search|login|404|error)\s*$"), "navigation label"),
            (raw.rlike(r"(?i)<[a-z][^>]*>"), "raw HTML"),
        ),
    )


def other_title(raw: Column) -> Column:
    short, long = (lambda v: F.coalesce(F.length(v), F.lit(0)) < 2), (lambda v: F.length(v) > TITLE_CHARS[1])
    return once(t.clean(raw), lambda v: verdict(v, (short(v), "too short"), (long(v), "too long"), (furniture(v), "navigation")))


def air_date(raw: Column, today: Column, expected_year: Column, first: str = "2010-07-01") -> Column:
    off = lambda d: F.coalesce(F.abs(F.year(d) - expected_year) > 1, F.lit(False))
    return once(
        t.parsed_date(raw, 1900, 2100),
        lambda d: verdict(
            d.cast("string"),
            (d.isNull(), "no date"),
            (d < F.lit(first).cast("date"), "before the first"),
            (d > F.date_add(today, 60), "far in the future"),
            (off(d), "another year"),
        ),
    )


def synopsis(raw: Column) -> Column:
    def repeats(v: Column) -> Column:
        few = lambda w: (F.size(w) >= 25) & (F.size(F.array_distinct(w)) / F.size(w) < 0.35)
        return once(F.split(F.lower(v), r"\s+"), few)

    return once(
        t.clean_paragraphs(F.regexp_replace(raw, r"<[^<>]*>", "")),
        lambda v: verdict(
            v,
            (blank(v), "empty"),
            (F.length(v) < SYNOPSIS_CHARS[0], "too short"),
            (F.length(v) > SYNOPSIS_CHARS[1], "too long"),
            (v.rlike(r"(?i)members?\s+must\s+compete\s+in\s+a\s+series\s+of\s+games?\s+and\s+missions?\s+to\s+win\s+the\s+race"), "generic"),
            (furniture(v), "navigation"),
            (v.rlike(r"(?i)^\s*(?:watch|stream|download)\b.{0,40}(?:online|free|hd)\b"), "tagline"),
            (repeats(v), "repetitive"),
            ((F.regexp_count(v, F.lit(r"\|")) > 6) | (F.regexp_count(v, F.lit("•")) > 8), "menu"),
        ),
    )


def _last_of_each(items: Column, key) -> Column:
    """Items without earlier ones of the same key, in the order in which the keys first came."""
    pairs = F.filter(F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v"))), lambda x: x["k"].isNotNull())
    last = lambda keyed, k: F.element_at(F.filter(keyed, lambda x: x["k"] == k), -1)["v"]
    return once(pairs, lambda keyed: F.transform(F.array_distinct(F.transform(keyed, lambda x: x["k"])), lambda k: last(keyed, k)))


def guests(raw: Column) -> Column:
    """Of names with one identity the last spelling stays; years are no persons. Items are joined by ', '."""
    names = F.filter(F.transform(raw, t.person_name), lambda x: x.isNotNull() & ~x.rlike(r"\d{4}"))
    none, many = (lambda n: F.coalesce(F.size(n), F.lit(0)) < 1), (lambda n: F.size(n) > GUESTS_AT_MOST)
    said = lambda n: verdict(F.array_join(n, ", "), (none(n), "no usable names"), (many(n), "too many"))
    return once(_last_of_each(names, t.identity_key), said)


def tags(raw: Column) -> Column:
    names = F.filter(F.transform(raw, t.tag), lambda x: x.isNotNull())
    said = lambda n: verdict(F.array_join(n, ", "), (F.coalesce(F.size(n), F.lit(0)) < 1, "no usable tags"))
    return once(F.slice(_last_of_each(names, F.lower), 1, TAGS_AT_MOST), said)


def location(raw: Column) -> Column:
    said = lambda n: verdict(n, (blank(n), "unusable"), (furniture(n), "navigation"), (F.length(n) > 120, "too long"))
    return once(t.place(raw)["name"], said)


def image_url(raw: Column, base: str) -> Column:
    said = lambda u: verdict(u, (u.isNull(), "malformed"), (u.rlike(PLACEHOLDER_IMAGE), "placeholder"))
    return once(t.absolute_url(raw, base), said)


def short_text(raw: Column) -> Column:
    empty, html = (lambda v: F.coalesce(F.length(v), F.lit(0)) < 2), (lambda v: v.rlike(r"(?i)<[a-z][^>]*>"))
    said = lambda v: verdict(v, (empty(v), "empty"), (furniture(v), "navigation"), (html(v), "raw HTML"))
    return once(F.substring(t.clean(raw), 1, 300), said)


def check(field: Column, raw: Column, today: Column, base: str) -> Column:
    """The verdict for a value by the name of its field; unknown fields are short texts. Lists come joined by ' · '."""
    listed = F.split(raw, r"\s+·\s+")
    return (
        F.when(field == "episode_number", number(raw))
        .when(field == "title", title(raw))
        .when(field == "title_ko", other_title(raw))
        .when(field == "air_date", air_date(raw, today, F.lit(None).cast("int")))
        .when(field == "synopsis", synopsis(raw))
        .when(field == "guests", guests(listed))
        .when(field == "tags", tags(listed))
        .when(field == "location", location(raw))
        .when(field == "image_url", image_url(raw, base))
        .otherwise(short_text(raw))
    )
