"""String expressions shared by the other modules."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_BLANK_CODES = [0xA0, 0x1680, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF]
# Blanks that the ASCII class \s of Java and RE2 does not hold; the look-ahead skips ASCII quickly.
WIDE_BLANKS = r"(?=[^\x00-\x7F])[\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def built_once(make):
    """Reuse the columns that ``make`` builds from hashable arguments: the large expressions take
    thousands of calls into the JVM, and they name columns only, so every plan can share them. A new JVM starts anew."""
    built: dict = {}
    owner: list = [None]

    @wraps(make)
    def cached(*args):
        if owner[0] is not SparkContext._gateway:
            built.clear()
            owner[0] = SparkContext._gateway
        if args not in built:
            built[args] = make(*args)
        return built[args]

    return cached


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Drop white space, tabs and newlines at both ends."""
    return F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first(arr: Column) -> Column:
    """First element of an array, NULL when it is empty."""
    return F.get(arr, F.lit(0))


def first_where(arr: Column, predicate) -> Column:
    return first(F.filter(arr, lambda x: predicate(x)))


def contains_any(c: Column, terms: list[str]) -> Column:
    """True when any of the literal terms occurs: one alternation, one pass over the string."""
    if not terms:
        return F.lit(False)
    escaped = ["".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in t) for t in terms]
    return c.rlike("|".join(escaped))
