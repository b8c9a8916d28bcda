"""E-mail and phone recognition as native column expressions.

Every pattern is written in the common subset of Java regular expressions and RE2 except
``EMAIL``, whose possessive run and ``\\G`` anchor keep the scan linear on long runs of
word characters (the matches are those of ``EMAIL_PLAIN``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgcard.functions.text import extract, extract_all, first_where, let, strip

# --- fixed values: patterns, in order of rising priority for phones -------------------------
EMAIL_PLAIN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_SHAPE = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"

PHONE_INTERNATIONAL = (
    r"(?:\+|00)[1-9][0-9]{0,3}(?:[\s.-]*[0-9]){8,12}[\s.-]?\(?[0-9]{1,4}\)?"
    r"[\s.-]?[0-9]{1,4}[\s.-]?[0-9]{2,10}"
)
PHONE_NORTH_AMERICA = (
    r"(?:\+?1[\s.-]?)?\(?[2-9][0-9]{2}\)?[\s.-]?[2-9][0-9]{2}[\s.-]?[0-9]{4}"
    r"(?:\s*(?:ext|x|extension)[\s.:-]*[0-9]{2,5})?"
)
PHONE_TEL_11 = r"tel:\+?[0-9]{11}"
PHONE_EUROPE = r"\+[1-9][0-9]{1,2}[\s.-]?(?:\([1-9][0-9]{0,4}\)|[1-9][0-9]{0,4})[\s.-]?[0-9]{4,10}"
PHONE_LABELLED = r"(?:tel|tél|phone|telephone|contact|call|fax|mobile|cell)[\s:]+[0-9\s()*+,.\-]{8,20}"
PHONE_UK = r"(?:0|\+44)\s*[1-9][0-9]{2,4}\s*[0-9]{6}"
PHONE_EAST_ASIA = (
    r"(?:\+?86|0086)\s*(?:1[3-9][0-9]{9}|[2-9][1-9][0-9]{8})"
    r"|(?:\+?81|0081)\s*(?:[789]0[0-9]{8}|[0-9]{9,12})"
    r"|(?:\+?82|0082)\s*(?:1[0-9]{8,9}|2[0-9]{7,8}|[3-6][0-9]{8})"
)
PHONE_CODE_9 = r"(?:\+?9[0-9][0-9]|009[0-9][0-9])\s*[1-9][0-9]{8,11}"
PHONE_VOIP = r"(?:sip|tel):\+?[0-9]{8,20}(?:;ext=[0-9]{2,5})?"

PHONES = [
    PHONE_INTERNATIONAL, PHONE_NORTH_AMERICA, PHONE_TEL_11, PHONE_EUROPE, PHONE_LABELLED,
    PHONE_UK, PHONE_EAST_ASIA, PHONE_CODE_9, PHONE_VOIP,
]

EMAIL_DOMAIN_DENY = [
    "example.com", "domain.com", "email.com", "test.com",
    "yourwebsite.com", "company.com", "website.com",
]

# Property-shaped patterns over raw markup: (e-mail, phone), rising priority.
MARKUP_EMAILS = [
    r'"email"\s*:\s*"([^"]+?@[^"]+?\.[^"]+)"',
    r'"contactPoint"\s*:\s*\{[^}]*"email"\s*:\s*"([^"]+?@[^"]+?\.[^"]+)"',
    r'<meta\s+(?:property|name)="(?:og:)?email"\s+content="([^"]+?@[^"]+?\.[^"]+)"',
    r'data-email="([^"]+?@[^"]+?\.[^"]+)"',
]
MARKUP_PHONES = [
    r'"telephone"\s*:\s*"([0-9\s()*+,.\-]{8,20})"',
    r'"contactPoint"\s*:\s*\{[^}]*"telephone"\s*:\s*"([0-9\s()*+,.\-]{8,20})"',
    r'<meta\s+(?:property|name)="(?:og:)?phone_number"\s+content="([0-9\s()*+,.\-]{8,20})"',
    r'data-phone="([0-9\s()*+,.\-]{8,20})"',
]
MARKUP_WEBSITES = [
    r'"url"\s*:\s*"((?:https?:)?//[^"]+)"',
    r'"website"\s*:\s*"((?:https?:)?//[^"]+)"',
    r'<meta\s+(?:property|name)="(?:og:)?url"\s+content="((?:https?:)?//[^"]+)"',
    r'data-website="((?:https?:)?//[^"]+)"',
]
RDFA_CONTACT = [
    r'typeof="schema:ContactPoint"[^>]*>(.*?)</\w+>',
    r'property="schema:contactPoint"[^>]*>(.*?)</\w+>',
]
# --- end of fixed values --------------------------------------------------------------------

# Patterns that can match a string too short or too long to be a number.
_UNSURE = {PHONE_INTERNATIONAL, PHONE_LABELLED, PHONE_VOIP}
# A valid number has five digits or plus signs at least, and each pattern parts these by such separators only.
_FIVE_DIGITS = r"[0-9+](?:[\s()*,.\-]*[0-9+]){4}"


def is_valid_email(c: Column, deny: list[str] | None = None) -> Column:
    """Shape, domain deny list (exact domain) and length."""
    deny = EMAIL_DOMAIN_DENY if deny is None else deny

    def test(low: Column) -> Column:
        ok = low.rlike(EMAIL_SHAPE) & F.length(low).between(3, 254)
        return ok & ~F.substring_index(low, "@", -1).isin(deny) if deny else ok

    return let(F.lower(strip(c)), test)


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9+]", "")


def is_valid_phone(c: Column) -> Column:
    return let(phone_digits(c), lambda d: F.length(d).between(5, 20) & d.rlike("[0-9]"))


def format_phone(c: Column) -> Column:
    """Digits only; a leading plus is kept, ten digits get the North American prefix."""
    return let(
        phone_digits(c),
        lambda d: F.when(~d.startswith("+") & (F.length(d) == 10), F.concat(F.lit("+1"), d)).otherwise(d),
    )


def email_key(c: Column) -> Column:
    return F.lower(strip(c))


def all_emails(text: Column, deny: list[str] | None = None) -> Column:
    """Every valid address of a text in document order."""
    found = F.filter(extract_all(text, EMAIL), lambda m: is_valid_email(m, deny))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def first_email(text: Column, deny: list[str] | None = None) -> Column:
    """First valid address of a text."""
    return F.when(
        F.contains(text, F.lit("@")),
        first_where(extract_all(text, EMAIL), lambda m: is_valid_email(m, deny)),
    )


def _first_phone_by(text: Column, pattern: str) -> Column:
    if pattern in _UNSURE:
        return first_where(extract_all(text, pattern), is_valid_phone)
    return extract(text, pattern)


def first_phone_raw(text: Column, boundary: bool = False) -> Column:
    """The match that wins in one text: the last pattern that has a valid match.

    ``boundary`` refuses hits inside a longer run of digits (card numbers and the like).
    """
    patterns = PHONES if not boundary else [rf"(?<![0-9])(?:{p})(?![0-9])" for p in PHONES]
    by_pattern = [
        first_where(extract_all(text, p), is_valid_phone) if boundary else _first_phone_by(text, p)
        for p in reversed(patterns)
    ]
    return F.when(text.rlike(_FIVE_DIGITS), F.coalesce(*by_pattern))


def first_phone(text: Column, boundary: bool = False) -> Column:
    return format_phone(first_phone_raw(text, boundary))


def phone_pattern_ord(text: Column) -> Column:
    """Which pattern (1..9) gave the number of :func:`first_phone`."""
    n = len(PHONES)
    tests = [
        F.when(_first_phone_by(text, p).isNotNull(), F.lit(n - i))
        for i, p in enumerate(reversed(PHONES))
    ]
    return F.when(text.rlike(_FIVE_DIGITS), F.coalesce(*tests))


def first_phone_raw_of(chunks: Column) -> Column:
    """Match of the first chunk (array of strings) that has one."""
    likely = F.filter(chunks, lambda t: t.rlike(_FIVE_DIGITS))
    return first_where(F.transform(likely, lambda t: first_phone_raw(t)), lambda p: p.isNotNull())


def first_email_of(chunks: Column) -> Column:
    """First valid address over the chunks; the separator cannot be part of a match."""
    return first_email(F.array_join(chunks, "\u0001"))


def _property_values(html: Column, pattern: str) -> Column:
    """What a property pattern matches, found by one linear scan.

    A quoted address is a run without quotes with a sign after its first character and a dot later, which needs no lazy
    search. A contact point is cut out first, from its name to the first brace that closes it and on to the next quote, as a
    value may go on there; the pattern takes the last member of its name in it.
    """
    pattern = pattern.replace(r'[^"]+?@[^"]+?\.[^"]+', r'[^"][^"@]*+@[^"]+\.[^"]+')
    if not pattern.startswith('"contactPoint"'):
        return extract_all(html, pattern, 1)
    areas = extract_all(html, r'(?s)"contactPoint"\s*:\s*(?=(\{[^}]*+[^"]*+"?))\{[^}]*+', 1)
    member = pattern.split(r"[^}]*", 1)[1]
    found = F.transform(areas, lambda a: F.regexp_extract(a, "(?s)^.*" + member, 1))
    return F.filter(found, lambda v: v != "")


def markup_email(html: Column) -> Column:
    """Address in property shape: JSON member, meta tag, data attribute; last pattern wins."""
    return F.coalesce(
        *[first_where(_property_values(html, p), is_valid_email) for p in reversed(MARKUP_EMAILS)]
    )


def markup_phone_raw(html: Column) -> Column:
    return F.coalesce(
        *[first_where(_property_values(html, p), is_valid_phone) for p in reversed(MARKUP_PHONES)]
    )


def markup_website(html: Column) -> Column:
    return F.coalesce(*[extract(html, p, 1) for p in reversed(MARKUP_WEBSITES)])


def rdfa_contacts(html: Column) -> Column:
    """Inner markup of RDFa contact points, as chunks."""
    return F.concat(*[extract_all(html, "(?s)" + p, 1) for p in RDFA_CONTACT])


def deobfuscate(text: Column) -> Column:
    """Rewrite ``name [at] host [dot] tld`` to a plain address.

    ``at`` and ``dot`` need brackets or blanks on both sides.
    """
    bracketed = F.regexp_replace(text, r"(?i)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", "@")
    bracketed = F.regexp_replace(bracketed, r"(?i)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", ".")
    return F.regexp_replace(
        bracketed, r"(?i)([a-z0-9._%+-]+)\s+at\s+([a-z0-9-]+)\s+dot\s+([a-z]{2,})\b", "$1@$2.$3"
    )


def percent_decode(text: Column) -> Column:
    """Decode percent escapes; the text itself where they are broken."""
    return F.when(
        text.rlike("%[0-9A-Fa-f]{2}"),
        F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text),
    ).otherwise(text)


def canonical_text(text: Column, deobfuscated: bool = False, decoded: bool = False) -> Column:
    """Apply the opt-in rewrites before recognition."""
    if decoded:
        text = percent_decode(text)
    if deobfuscated:
        text = deobfuscate(text)
    return text

