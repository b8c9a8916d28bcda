"""URL expressions: split, resolve, validate, key, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgcard.functions.text import blank_to_null, contains_any, extract, let

# --- fixed values ---------------------------------------------------------------------------
# RFC 3986, appendix B.
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"
SOCIAL_HOSTS = ["facebook.com", "twitter.com", "linkedin.com"]
# Registry suffixes of two labels: those listed, and general ones before a country code. Any other last label is a suffix by itself.
GENERAL_SUFFIX = r"^(?:com|co|org|net|gov|edu|ac)\.[a-z]{2}$"
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.tr", "org.tr", "com.au", "net.au", "org.au",
    "co.jp", "or.jp", "ne.jp", "com.br", "org.br", "co.in", "co.nz", "co.za", "com.mx", "com.cn",
    "com.hk", "com.sg", "co.kr", "com.ar", "com.tw", "co.il", "com.my", "co.id", "com.ua",
]
SCORE_DIRECT, SCORE_REACH, SCORE_ABOUT, SCORE_SUPPORT = 0.8, 0.6, 0.4, 0.5
SCORE_PER_EXTRA_LEVEL = 0.1
# --- end of fixed values --------------------------------------------------------------------


def scheme(url: Column) -> Column:
    return F.lower(extract(url, URL_PARTS, 1))


def authority(url: Column) -> Column:
    return extract(url, URL_PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 3)


def query(url: Column) -> Column:
    """Query with its question mark, '' when absent."""
    return F.regexp_extract(url, URL_PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 5)


def host(url: Column) -> Column:
    """Authority without user and port, lower case."""
    return blank_to_null(F.regexp_replace(F.lower(authority(url)), r"^.*@|:[0-9]*$", ""))


def url_key(url: Column) -> Column:
    """Join key: scheme and host in lower case, no fragment, no slash at the end of the path."""
    return F.concat(
        scheme(url), F.lit("://"), F.lower(authority(url)),
        F.regexp_replace(path(url), "/+$", ""), query(url),
    )


def is_valid_url(url: Column, directories: list[str] | None = None) -> Column:
    """http(s) with a dotted host that is no social network (nor, on request, a directory)."""
    parts = lambda u: F.struct(scheme(u).alias("scheme"), authority(u).alias("net"))
    return let(let(url, parts), lambda u: _is_valid(u["scheme"], u["net"], directories))


def _is_valid(scheme_: Column, net: Column, directories: list[str] | None) -> Column:
    ok = (
        F.coalesce(scheme_.isin("http", "https"), F.lit(False))
        & F.coalesce(F.length(net) > 3, F.lit(False))
        & F.coalesce(F.contains(net, F.lit(".")), F.lit(False))
        & F.coalesce(~contains_any(net, SOCIAL_HOSTS), F.lit(False))
    )
    if directories:
        # A directory is listed as host/path; the host part decides.
        hosts = [d.split("/")[0] for d in directories]
        ok = ok & F.coalesce(~contains_any(net, hosts), F.lit(False))
    return ok


def _fold_dots(p: Column) -> Column:
    """Remove '.' and '..' segments of an absolute path."""

    def folded(segments: Column) -> Column:
        closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
        kept = F.aggregate(
            F.concat(segments, F.coalesce(closing, F.array().cast("array<string>"))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        return F.concat(F.lit("/"), F.array_join(kept, "/"))

    return let(
        p,
        lambda q: F.when(
            q.rlike(r"/\.\.?(?:/|$)"), let(F.split(F.substr(q, F.lit(2)), "/"), folded)
        ).otherwise(q),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a reference seen on a page."""

    def against(b: Column) -> Column:
        root = F.concat(scheme(b), F.lit("://"), authority(b))
        return let(
            F.struct(
                root.alias("root"), scheme(b).alias("scheme"), path(b).alias("path"),
                query(b).alias("query"), href.alias("href"), path(href).alias("ref"),
                F.concat(query(href), fragment(href)).alias("tail"),
            ),
            join,
        )

    def join(u: Column) -> Column:
        directory = F.coalesce(extract(u["path"], r"^(.*/)[^/]*$", 1), F.lit("/"))
        relative = F.regexp_replace(F.concat(directory, u["ref"]), "/{2,}", "/")
        own_query = F.when(u["tail"].startswith("?"), F.lit("")).otherwise(u["query"])
        return (
            F.when(u["href"] == "", base)
            .when(u["href"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u["href"])
            .when(u["href"].startswith("//"), F.concat(u["scheme"], F.lit(":"), u["href"]))
            .when(u["ref"] == "", F.concat(u["root"], u["path"], own_query, u["tail"]))
            .otherwise(
                F.concat(
                    u["root"],
                    _fold_dots(F.when(u["ref"].startswith("/"), u["ref"]).otherwise(relative)),
                    u["tail"],
                )
            )
        )

    return against(base)


def registrable_label(url: Column, suffixes: list[str] | None = None) -> Column:
    """Label left of the public suffix: ``acme`` for ``www.acme.co.uk``. For a table of suffix rules see ``operators.suffixes``."""

    def of(u: Column) -> Column:
        h, labels = u["host"], u["labels"]
        n = F.size(labels)
        last_two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
        is_suffix = last_two.isin(suffixes) if suffixes is not None else last_two.isin(TWO_LABEL_SUFFIXES) | last_two.rlike(GENERAL_SUFFIX)
        return (
            F.when(h.rlike(r"^[0-9.]+$"), h)
            .when((n >= 3) & is_suffix, F.get(labels, n - 3))
            .when(n >= 2, F.get(labels, n - 2))
            .otherwise(F.get(labels, F.lit(0)))
        )

    return let(
        host(url), lambda h: let(F.struct(h.alias("host"), F.split(h, r"\.").alias("labels")), of)
    )


def contact_score(url: Column) -> Column:
    """How much a URL looks like a contact page, 0..1."""
    low = F.lower(url)
    base = (
        F.when(F.contains(low, F.lit("/contact")), SCORE_DIRECT)
        .when(low.rlike("reach|touch|connect"), SCORE_REACH)
        .when(F.contains(low, F.lit("/about")), SCORE_ABOUT)
        .when(low.rlike("/support|/help"), SCORE_SUPPORT)
        .otherwise(0.0)
    )
    depth = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) - 2
    penalty = SCORE_PER_EXTRA_LEVEL * F.greatest(depth - 2, F.lit(0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)), 6)
