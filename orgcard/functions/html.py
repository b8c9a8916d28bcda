"""HTML expressions that need no element tree: text, scripts, anchors, JSON-LD, relevance."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgcard.functions.contacts import first_email, first_phone_raw, is_valid_email, is_valid_phone
from orgcard.functions.text import (
    WIDE_BLANK_CODES, WIDE_BLANKS, contains_any, extract_all, first_where, let, strip,
)

# Named character references with their characters, as the HTML standard and the standard library have them; blanks of
# any width become plain ones. '&amp;' and its twin are decoded last.
ENTITIES = {
    f"&{name}": "".join(" " if ord(c) in WIDE_BLANK_CODES else c for c in text)
    for name, text in html5.items() if name.endswith(";") and name.lower() != "amp;"
}

# --- fixed values ---------------------------------------------------------------------------
# Weights of the seven relevance tests; the score is their sum over 7.
RELEVANCE_WEIGHTS = {
    "section": 1.0, "form": 1.0, "place": 1.0, "social": 0.5, "email": 1.5, "phone": 1.5, "map": 0.5,
}
RELEVANCE_MAX = 7
SECTION_WORDS = "contact|connect|reach|touch|location"
FORM_WORDS = "contact|enquiry|message"
PLACE_WORDS = r"(?i)(?:business|opening|office)\s*hours|location|address"
SOCIAL_WORDS = "social|follow"
MAP_WORDS = "map|location"
# --- end of fixed values --------------------------------------------------------------------

# All patterns below take what they match from left to right and run to the end of the page where something is never
# closed, so a scan is linear in the page whatever it holds; tags are searched before the last '>' only (see `tagged`).
INVISIBLE = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z))"
)
TAG = r"<[a-zA-Z/!?][^>]*>"
# Everything that is no text, in one pass: each match becomes one blank.
NO_TEXT = (
    r"<(?:!--(?s:.*?)(?:-->|\z)|(?i:script)\b[^>]*>(?is:.*?(?:</script\s*>|\z))|(?i:style)\b[^>]*>(?is:.*?(?:</style\s*>|\z))"
    r"|[a-zA-Z/!?][^>]*>)"
)
SCRIPT = r"(?is)<script\b[^>]*>(.*?)(?:</script\s*>|\z)"
SCRIPT_ELEMENT = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"
JSON_LD_TAG = r"(?is)^<script\b[^>]*application/ld\+json[^>]*>"
# An anchor ends at its end tag, else where the next one starts, else with the page.
ANCHOR = r"(?is)<a\s[^>]*>.*?(?:</a\s*>|(?=<a\s)|\z)"
OBJECT_END = r"[a-zA-Z0-9_$]\s*=\s*(\{(?s:.+)\})\z"


def tagged(html: Column) -> Column:
    """The page up to its last '>': every tag lies in it, and no start of a tag is searched for an end that is not there."""
    return F.substring(html, F.lit(1), F.length(html) - F.length(F.substring_index(html, ">", -1)))


def _tail_as_text(html: Column) -> Column:
    """The page with each '<' after the last '>' written as a reference, but for comments: nothing there is a tag."""

    def of(tail: Column) -> Column:
        quoted = F.concat(tagged(html), F.regexp_replace(tail, "<(?!!--)", "&lt;"))
        return F.when(F.contains(tail, F.lit("<")), quoted).otherwise(html)

    return let(F.substring_index(html, ">", -1), of)


def _code_point(code: Column) -> Column:
    """Character of a numeric reference such as ``64`` or ``x40``; '' when there is none."""

    def of(low: Column) -> Column:
        number = (
            F.when(low.startswith("x"), F.conv(F.substring(low, 2, 6), 16, 10))
            .otherwise(F.conv(low, 10, 10)).cast("bigint")
        )
        return let(number, encode)

    def encode(number: Column) -> Column:
        ok = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(F.when(ok, number)), 8, "0"))
        return F.when(number.isin(WIDE_BLANK_CODES), F.lit(" ")).otherwise(
            F.coalesce(F.decode(utf32, "UTF-32"), F.lit(""))
        )

    return let(F.lower(code), of)


def _entity_map() -> Column:
    return F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")


def _decode(c: Column) -> Column:
    """Replace each distinct reference that occurs; '&amp;' last, so that nothing decodes twice."""
    found = F.array_distinct(extract_all(c, r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"))
    named = F.aggregate(
        F.filter(found, lambda k: F.lower(k) != "&amp;"),
        c,
        lambda acc, k: F.replace(
            acc, k,
            F.when(k.startswith("&#"), _code_point(F.regexp_extract(k, "[xX]?[0-9a-fA-F]+", 0)))
            .otherwise(F.coalesce(F.element_at(_entity_map(), k), k)),
        ),
    )
    return F.replace(F.replace(named, F.lit("&amp;"), F.lit("&")), F.lit("&AMP;"), F.lit("&"))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references to characters."""
    return let(c, lambda s: F.when(F.contains(s, F.lit("&")), _decode(s)).otherwise(s))


ESCAPE = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|%u[0-9a-fA-F]{4}"
MAY_BE_ESCAPED = r"%[0-9a-fA-Fu]|\\[xu]|&[#a-zA-Z]"


def _unescape(c: Column) -> Column:
    """One level of escapes: of scripts, percent signs, character references."""
    found = F.array_distinct(extract_all(c, ESCAPE))
    plain = F.aggregate(found, c, lambda acc, e: F.replace(
        acc, e, F.coalesce(F.nullif(_code_point(F.concat(F.lit("x"), F.regexp_extract(e, r"[0-9a-fA-F]+(?=\}?$)", 0))), F.lit("")), e)))
    # plus signs and percent signs that escape nothing stay as they are
    quoted = F.regexp_replace(F.replace(plain, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    percent = F.when(plain.rlike("%[0-9a-fA-F]{2}"), F.coalesce(F.try_url_decode(quoted), plain)).otherwise(plain)
    return decode_entities(percent)


def decode_escapes(c: Column, levels: int = 3) -> Column:
    """Text with escapes decoded, those inside others too, level by level up to ``levels``: ``%40``, ``\\x40``, ``\\u0040``, ``%u0040``,
    ``&#64;``. What ``unescape`` or ``decodeURIComponent`` is given in a script so becomes readable."""
    step = lambda t: F.when(t.rlike(MAY_BE_ESCAPED), _unescape(t)).otherwise(t)
    return F.aggregate(F.array(*[F.lit(i) for i in range(levels)]), c, lambda t, _: step(t))


def visible_text(html: Column) -> Column:
    """Text a reader sees; every tag leaves one blank."""
    bare = F.regexp_replace(F.regexp_replace(_tail_as_text(html), NO_TEXT, " "), WIDE_BLANKS, " ")
    return decode_entities(bare)


def without_invisible(html: Column) -> Column:
    return F.regexp_replace(_tail_as_text(html), INVISIBLE, " ")


def tags(html: Column, names: str) -> Column:
    """Start tags of the named elements (alternatives of a pattern) that have attributes."""
    return extract_all(tagged(html), rf"(?is)<(?:{names})\s[^>]*>")


def scripts(html: Column) -> Column:
    """Bodies of all scripts in document order."""
    return extract_all(_tail_as_text(html), SCRIPT, 1)


def object_literals(script: Column) -> Column:
    """Object literals that a statement assigns and ends with: ``name = {...};``. A statement ends at a semicolon."""
    closed = let(F.split(script, ";"), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    assigned = F.transform(F.filter(closed, lambda x: x.endswith("}")), lambda x: F.regexp_extract(x, OBJECT_END, 1))
    return F.filter(assigned, lambda x: x != "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, NULL when absent."""
    quoted = F.regexp_extract(tag, rf"""(?is)^<[a-z][^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return let(
        quoted,
        lambda q: F.when(q != "", decode_entities(F.regexp_replace(q, r"""^["']|["']$""", ""))),
    )


def anchors(html: Column, ends: bool = False) -> Column:
    """Anchors with a reference: array of (href, text) in document order; ``ends`` adds whether an end tag closes it."""
    bare = let(without_invisible(html), tagged)
    # what is left out may part the name of an anchor from its attributes
    markup = F.when(~html.rlike(r"(?i)<a[\s<]"), F.array().cast("array<string>")).otherwise(extract_all(bare, ANCHOR))

    def of(a: Column) -> Column:
        text = strip(decode_entities(F.regexp_replace(a, TAG, " ")))
        closed = [a.rlike(r"(?i)</a\s*>\z").alias("closed")] if ends else []
        return F.struct(attribute(a, "href").alias("href"), text.alias("text"), *closed)

    return F.filter(F.transform(markup, of), lambda a: a["href"].isNotNull())


def tel_link(html: Column) -> Column:
    """First valid number of a ``tel:`` link."""
    hrefs = F.transform(
        F.filter(tags(html, "a"), lambda a: a.rlike("(?i)tel:")), lambda a: F.lower(attribute(a, "href"))
    )
    numbers = F.transform(
        F.filter(hrefs, lambda h: h.startswith("tel:")),
        lambda h: strip(F.replace(h, F.lit("tel:"), F.lit(""))),
    )
    return F.when(html.rlike("(?i)tel:"), first_where(numbers, is_valid_phone))


def frame_sources(html: Column) -> Column:
    """Absolute addresses of frames."""
    src = F.transform(tags(html, "i?frame"), lambda t: attribute(t, "src"))
    return F.filter(src, lambda s: s.startswith("http://") | s.startswith("https://"))


def contact_metas(html: Column) -> Column:
    """Content of meta tags named after contact or e-mail that holds an address."""
    named = F.filter(
        tags(html, "meta"),
        lambda t: F.coalesce(attribute(t, "name").rlike("(?i)contact|email"), F.lit(False)),
    )
    content = F.transform(named, lambda t: attribute(t, "content"))
    return F.filter(content, lambda c: c.rlike("^(?:https?://|/)"))


def sitemap_locations(html: Column) -> Column:
    """Entries of an XML sitemap, case kept."""
    return F.transform(
        extract_all(tagged(html), r"(?is)<loc\b[^>]*>([^<]*+(?:<(?!/?loc\b)[^<]*+)*+)</loc\s*>", 1), lambda s: strip(decode_entities(s))
    )


# --- JSON-LD --------------------------------------------------------------------------------


def json_ld(html: Column) -> Column:
    """Bodies of the JSON-LD scripts that are closed."""
    closed = F.filter(
        extract_all(_tail_as_text(html), SCRIPT_ELEMENT), lambda s: s.rlike(JSON_LD_TAG) & s.rlike(r"(?i)</script\s*>\z")
    )
    bodies = F.transform(closed, lambda s: F.regexp_extract(s, r"(?is)^[^>]*>(.*)</script\s*>\z", 1))
    return F.when(html.rlike("(?i)ld\\+json"), bodies).otherwise(F.array().cast("array<string>"))


def _string_at(doc: Column, *paths: str) -> list[Column]:
    return [F.try_variant_get(doc, p, "string") for p in paths]


def _first_valid(values: list[Column], predicate) -> Column:
    return F.coalesce(*[F.when(predicate(v), v) for v in values])


def json_ld_email(html: Column) -> Column:
    """Address of the first script that has one: contact point (or its first entry), then top level."""
    paths = ("$.contactPoint.email", "$.contactPoint[0].email", "$.email")
    found = F.transform(
        json_ld(html), lambda b: _first_valid(_string_at(F.try_parse_json(b), *paths), is_valid_email)
    )
    return first_where(found, lambda v: v.isNotNull())


def json_ld_phone(html: Column) -> Column:
    paths = ("$.contactPoint.telephone", "$.contactPoint[0].telephone", "$.telephone")
    found = F.transform(
        json_ld(html), lambda b: _first_valid(_string_at(F.try_parse_json(b), *paths), is_valid_phone)
    )
    return first_where(found, lambda v: v.isNotNull())


def json_ld_contact_urls(html: Column, terms: list[str]) -> Column:
    """Contact addresses: that of the contact point if there is one, else the own URL if it holds a term."""

    def of(body: Column) -> Column:
        doc = F.try_parse_json(body)
        point = F.try_variant_get(doc, "$.contactPoint", "variant")
        point_url = F.coalesce(*_string_at(doc, "$.contactPoint.url", "$.contactPoint[0].url"))
        own = F.try_variant_get(doc, "$.url", "string")
        return F.when(point.isNotNull(), point_url).when(contains_any(F.lower(own), terms), own)

    return F.filter(F.transform(json_ld(html), of), lambda u: u.isNotNull())


# --- relevance ------------------------------------------------------------------------------


def _has_class(markup: Column, tags: str, words: str) -> Column:
    return markup.rlike(rf"""(?is)<(?:{tags})\b[^>]*?\sclass\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)(?:{words})""")


def _class_tests(markup: Column) -> dict[str, Column]:
    return {
        "section": _has_class(markup, "div|section", SECTION_WORDS),
        "form": _has_class(markup, "form", FORM_WORDS),
        "social": _has_class(markup, "div|ul", SOCIAL_WORDS),
        "map": _has_class(markup, "iframe|div", MAP_WORDS),
    }


def _text_tests(text: Column) -> dict[str, Column]:
    return {
        "place": text.rlike(PLACE_WORDS),
        "email": first_email(text).isNotNull(),
        "phone": first_phone_raw(text).isNotNull(),
    }


def relevance_tests(html: Column, text: Column) -> dict[str, Column]:
    """The seven presence tests; ``text`` is the visible text of the page."""
    return _class_tests(without_invisible(html)) | _text_tests(text)


def _weight(tests: dict[str, Column]) -> Column:
    return sum((F.when(test, RELEVANCE_WEIGHTS[name]).otherwise(0.0) for name, test in tests.items()), F.lit(0.0))


def relevance(html: Column, text: Column) -> Column:
    """How likely a page holds contact data, 0..1. The weights are halves, so their sum is exact in any order; markup is bared
    once for all class tests, and only where a class may occur."""
    classes = F.when(html.rlike("(?i)class"), let(without_invisible(html), lambda m: _weight(_class_tests(m)))).otherwise(0.0)
    return (classes + _weight(_text_tests(text))) / RELEVANCE_MAX
