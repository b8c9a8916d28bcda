"""The registered queries in DuckDB SQL, written against the given tables.

Text and URL queries repeat the rules in the other dialect; the queries on derived pages state
their expected values per market segment in closed form.
"""

from __future__ import annotations

from orgcard.functions import contacts as C
from orgcard.functions import html as H
from orgcard.functions.names import EXCLUDED_LABELS
from orgcard.functions.urls import URL_PARTS
from orgcard.plans.derived import SEGMENTS
from orgcard.sources import dims

ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
# Character references in the test tables, and some more; '&amp;' last.
REFERENCES = [(f"&{n};", H.ENTITIES[f"&{n};"]) for n in (
    "nbsp lt gt quot apos copy reg trade middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo euro "
    "commat period plus lpar rpar").split()] + [("&amp;", "&")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- expressions ----------------------------------------------------------------------------

_DENY = ", ".join(q(d) for d in C.EMAIL_DOMAIN_DENY)


def valid_email(c: str) -> str:
    return (
        f"(regexp_matches(lower(trim({c})), {q(C.EMAIL_SHAPE)}) AND split_part(lower(trim({c})), '@', -1) "
        f"NOT IN ({_DENY}) AND length(trim({c})) BETWEEN 3 AND 254)"
    )


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9+]', '', 'g')"


def valid_phone(c: str) -> str:
    return f"(length({digits(c)}) BETWEEN 5 AND 20 AND regexp_matches({c}, '[0-9]'))"


def all_emails(t: str) -> str:
    return f"list_filter(regexp_extract_all({t}, {q(C.EMAIL_PLAIN)}), lambda m: {valid_email('m')})"


def first_email(t: str) -> str:
    return f"({all_emails(t)})[1]"


def first_phone_raw(t: str) -> str:
    hits = [
        f"list_filter(regexp_extract_all({t}, {q(p)}), lambda m: {valid_phone('m')})[1]"
        for p in reversed(C.PHONES)
    ]
    return "coalesce(" + ", ".join(hits) + ")"


def format_phone(c: str) -> str:
    d = digits(c)
    return f"CASE WHEN {d} LIKE '+%' THEN {d} WHEN length({d}) = 10 THEN '+1' || {d} ELSE {d} END"


def visible_text(h: str) -> str:
    t = f"regexp_replace(regexp_replace({h}, {q(H.INVISIBLE)}, ' ', 'g'), {q(H.TAG)}, ' ', 'g')"
    for name, char in REFERENCES:
        t = f"replace({t}, {q(name)}, {q(char)})"
    blanks = r"[\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    return f"regexp_replace({t}, {q(blanks)}, ' ', 'g')"


def part(u: str, group: int) -> str:
    return f"regexp_extract({u}, {q(URL_PARTS)}, {group})"


URL_KEY = (
    f"lower({part('url', 1)}) || '://' || lower({part('url', 2)}) || regexp_replace({part('url', 3)}, '/+$', '') "
    f"|| {part('url', 4)}"
)
LABEL = f"regexp_extract(lower({part('url', 2)}), '([^.]+)\\.example\\.(?:com|net|org)$', 1)"
SCORE = f"""round(greatest(0.0, least(1.0,
    CASE WHEN contains(lower(url), '/contact') THEN 0.8
         WHEN regexp_matches(lower(url), 'reach|touch|connect') THEN 0.6
         WHEN contains(lower(url), '/about') THEN 0.4
         WHEN regexp_matches(lower(url), '/support|/help') THEN 0.5 ELSE 0.0 END
    - 0.1 * greatest(len(string_split(url, '/')) - 1 - 2 - 2, 0))), 6)::DOUBLE"""
ANCHORS = f"regexp_extract_all(regexp_replace(html, {q(H.INVISIBLE)}, ' ', 'g'), {q(ANCHOR)})"


def entities(c: str) -> str:
    for name, char in REFERENCES:
        c = f"replace({c}, {q(name)}, {q(char)})"
    return c


HREF = entities("regexp_extract(a, '(?is)\\shref\\s*=\\s*\"([^\"]*)\"', 1)")
ANCHOR_TEXT = "trim(" + entities(f"regexp_replace(a, {q(H.TAG)}, ' ', 'g')") + ", ' \n\t\r')"


def any_of(terms: list[str]) -> str:
    return "|".join(t.replace(".", r"\.") for t in terms)


def coverage(source: str, by: str) -> str:
    names = ["success", "with_website", "with_email", "with_phone"]
    shares = ", ".join(f"round(100.0 * {n} / nullif(total, 0), 1) AS {n}_pct" for n in names)
    return f"""
WITH r AS ({source}), c AS (
  SELECT {by}, count(*) AS total, count(*) FILTER (status = 'success') AS success,
    count(*) FILTER (coalesce(website, '') <> '') AS with_website,
    count(*) FILTER (coalesce(email, '') <> '') AS with_email,
    count(*) FILTER (coalesce(phone, '') <> '') AS with_phone
  FROM r GROUP BY GROUPING SETS (({by}), ()))
SELECT {by}, total, {', '.join(names)}, {shares} FROM c"""


DOC_CONTACTS = f"""
SELECT doc_id, lang, source, email, {format_phone('raw')} AS phone FROM (
  SELECT doc_id, lang, source, {first_email('text')} AS email, {first_phone_raw('text')} AS raw
  FROM documents)"""

PAGE_TEXT = f"SELECT page_id, url, html, {visible_text('html')} AS text FROM pages"
# Pages carry contact data in their text only: no links, sections, structured data or objects.
PAGE_CONTACTS = f"""
SELECT page_id, url, email, {format_phone('raw')} AS phone FROM (
  SELECT page_id, url,
    coalesce({first_email('text')}, {first_email('script')}) AS email,
    coalesce({first_phone_raw('text')}, {first_phone_raw('script')}) AS raw
  FROM (SELECT *, array_to_string(regexp_extract_all(html, {q(H.SCRIPT)}, 1), chr(1)) AS script
        FROM ({PAGE_TEXT})))"""

# --- derived sites --------------------------------------------------------------------------

CUSTOMERS = """
SELECT *, 'customer' || substr(c_name, 10, 9) AS label,
  '+12' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '5' || substr(c_name, 13, 2) || substr(c_name, 15, 4) AS number
FROM customer"""


def case(values: dict[str, str | None]) -> str:
    """CASE over the market segment; a letter stands for letter@label.com."""

    def value(v: str | None) -> str:
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        return f"{q(v)} || '@' || label || '.com'" if len(v) == 1 else v

    whens = " ".join(f"WHEN {q(s)} THEN {value(v)}" for s, v in values.items())
    return f"CASE c_mktsegment {whens} END"


def cards(emails: str, phones: str) -> str:
    """Expected card values: one letter per segment, '-' for NULL; phones 'p' or '-'."""
    email = case({s: None if e == "-" else e for s, e in zip(SEGMENTS, emails)})
    phone = case({s: "number" if p == "p" else None for s, p in zip(SEGMENTS, phones)})
    return f"SELECT c_custkey AS page_id, {email} AS email, {phone} AS phone FROM ({CUSTOMERS})"


_HOME = "'https://www.' || label || '.com'"
_FOUND = "c_acctbal >= 0"

SITE_COMPANY_CONTACTS = f"""
SELECT c_custkey AS company_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN label ELSE c_name END AS company_name,
  CASE WHEN {_FOUND} THEN {_HOME} || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '/#home' ELSE '/' END END AS website,
  CASE WHEN {_FOUND} THEN {case(dict(zip(SEGMENTS, 'abcde')))} END AS email,
  CASE WHEN {_FOUND} THEN number END AS phone,
  CASE WHEN {_FOUND} THEN 'success' ELSE 'no_website_found' END AS status
FROM ({CUSTOMERS})"""


def _rows(segment: str, *rows: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {row} FROM ({CUSTOMERS}) WHERE c_mktsegment = {q(segment)}" for row in rows
    )


CONTACT_PAGE_RANKING = " UNION ALL ".join(
    [
        _rows("AUTOMOBILE", f"{_HOME} AS site_key, {_HOME} || '/contact' AS url, 'header' AS source, "
              "CAST(0.8 AS DOUBLE) AS score, 1 AS rn"),
        _rows("BUILDING", f"{_HOME}, {_HOME} || '/Company/Contact.html', 'sitemap', 0.8, 1"),
        _rows("FURNITURE", f"{_HOME}, {_HOME} || '/pages/kontakt.html#top', 'footer', 0.0, 1"),
        _rows("HOUSEHOLD", f"{_HOME}, {_HOME} || '/contact', 'common-path', 0.8, 1"),
    ]
)

# --- results --------------------------------------------------------------------------------

ORDER_RESULTS = """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS website,
  CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '' END AS email,
  CASE WHEN o_totalprice < 200000 THEN o_orderpriority END AS phone,
  CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'no_website_found'
       WHEN o_orderpriority LIKE '1%' THEN 'error' ELSE 'failed' END AS status
FROM orders"""

_SECOND = "'https://second.example.net/'"
_DOC_SITE = "'https://' || split_part(email, '@', -1)"


def oracle() -> dict[str, str]:
    terms = any_of(dims.literal_terms())
    exact_terms = f"regexp_matches(lower(href), {q(terms)}) OR regexp_matches(lower(text), {q(terms)})"
    patterns = dims.reference_pattern()
    categories = any_of(dims.category_names())
    excluded = ", ".join(q(x) for x in EXCLUDED_LABELS)
    weights = H.RELEVANCE_WEIGHTS
    sql: dict[str, str] = {}

    sql["doc_first_email"] = f"SELECT doc_id, {first_email('text')} AS email FROM documents"
    sql["doc_first_phone"] = (
        f"SELECT doc_id, raw, {format_phone('raw')} AS phone FROM "
        f"(SELECT doc_id, {first_phone_raw('text')} AS raw FROM documents)"
    )
    sql["doc_deobfuscated"] = (
        f"SELECT doc_id, CAST(NULL AS VARCHAR) AS plain_email, {first_email('text')} AS email FROM documents"
    )
    sql["email_domain_counts"] = f"""
SELECT split_part(email, '@', -1) AS domain, count(*) AS n_hits, count(DISTINCT email) AS n_emails,
  count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, lower(unnest({all_emails('text')})) AS email FROM documents) GROUP BY 1"""
    sql["phone_dedup"] = f"""
SELECT phone, count(*) AS n_docs, min(doc_id) AS first_doc FROM ({DOC_CONTACTS})
WHERE phone IS NOT NULL GROUP BY phone"""
    sql["coverage_by_lang"] = coverage(
        f"SELECT lang, NULL AS website, email, phone, CASE WHEN email IS NOT NULL OR phone IS NOT NULL "
        f"THEN 'success' ELSE 'failed' END AS status FROM ({DOC_CONTACTS})", "lang",
    )
    sql["conversation_contacts"] = f"""
SELECT conv_id, count(*) AS n_turns, arg_min(e, turn) FILTER (e IS NOT NULL) AS email,
  arg_min({format_phone('p')}, turn) FILTER (p IS NOT NULL) AS phone
FROM (SELECT conv_id, turn, {first_email('text')} AS e, {first_phone_raw('text')} AS p FROM conversations)
GROUP BY conv_id"""
    sql["page_url_parts"] = f"""
SELECT page_id, lower({part('url', 1)}) AS scheme, {part('url', 2)} AS authority, {part('url', 3)} AS path,
  {part('url', 4)} AS query, {part('url', 5)} AS fragment, {URL_KEY} AS url_key, {LABEL} AS label FROM pages"""
    sql["page_url_valid"] = f"""
SELECT page_id, valid, valid AND NOT contains(net, 'spam-farm.example.org') AS no_directory, score FROM (
  SELECT page_id, {part('url', 2)} AS net, {SCORE} AS score,
    lower({part('url', 1)}) IN ('http', 'https') AND length(net) > 3 AND contains(net, '.')
    AND NOT regexp_matches(net, 'facebook\\.com|twitter\\.com|linkedin\\.com') AS valid FROM pages)"""
    sql["page_links"] = f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, {HREF} AS href, {ANCHOR_TEXT} AS text,
  {part('url', 1)} || '://' || {part('url', 2)} || {HREF} AS target
FROM (SELECT page_id, url, unnest({ANCHORS}) AS a, generate_subscripts({ANCHORS}, 1) AS pos FROM pages)"""
    sql["page_visible_text"] = (
        f"SELECT page_id, length(text) AS n_chars, md5(text) AS digest FROM ({PAGE_TEXT})"
    )
    sql["page_contacts"] = PAGE_CONTACTS
    sql["site_contacts"] = f"""
SELECT lower({part('url', 2)}) AS site_key, count(*) AS n_pages,
  arg_min(email, page_id) FILTER (email IS NOT NULL) AS email,
  arg_min(phone, page_id) FILTER (phone IS NOT NULL) AS phone
FROM ({PAGE_CONTACTS}) GROUP BY 1"""
    sql["url_score_top3"] = f"""
SELECT site_key, url, score, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY score DESC, url) AS rn
  FROM (SELECT {LABEL} AS site_key, url, {SCORE} AS score FROM pages)) WHERE rn <= 3"""
    sql["term_links"] = f"""
SELECT page_id, CAST(count(href) AS INTEGER) AS n_links,
  CAST(count_if({exact_terms}) AS INTEGER) AS n_contact,
  CAST(count_if({exact_terms} OR regexp_matches(lower(href), {q(patterns)})) AS INTEGER) AS n_pattern,
  CAST(count_if(regexp_matches(lower(href), {q(categories)}) OR regexp_matches(lower(text), {q(categories)}))
    AS INTEGER) AS n_category
FROM pages LEFT JOIN (
  SELECT page_id, {HREF} AS href, {ANCHOR_TEXT} AS text FROM (SELECT page_id, unnest({ANCHORS}) AS a FROM pages))
USING (page_id) GROUP BY page_id"""
    has = "regexp_matches(markup, '(?is)<(?:{0})\\b[^>]*?\\sclass\\s*=\\s*\"[^\"]*(?:{1})')"
    tests = {
        "section": has.format("div|section", "contact|connect|reach|touch|location"),
        "form": has.format("form", "contact|enquiry|message"),
        "place": r"regexp_matches(text, '(?i)(?:business|opening|office)\s*hours|location|address')",
        "social": has.format("div|ul", "social|follow"),
        "email": f"{first_email('text')} IS NOT NULL",
        "phone": f"{first_phone_raw('text')} IS NOT NULL",
        "map": has.format("iframe|div", "map|location"),
    }
    total = " + ".join(f"CASE WHEN {t} THEN {weights[n]} ELSE 0 END" for n, t in tests.items())
    sql["page_relevance"] = f"""
SELECT page_id, round(CAST({total} AS DOUBLE) / 7, 6) AS relevance
FROM (SELECT page_id, text, regexp_replace(html, {q(H.INVISIBLE)}, ' ', 'g') AS markup FROM ({PAGE_TEXT}))"""
    sql["serp_first_hit"] = f"""
WITH p AS (
  SELECT page_id, url, {LABEL} AS label, CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END AS engine_ord FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY label, engine_ord ORDER BY page_id) - 1 AS rank FROM p)
SELECT min(page_id) AS company_id,
  array_to_string(list_transform(string_split(replace(label, '-', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') || ' Group' AS company_name,
  arg_min(url, engine_ord * 10 + rank) FILTER (rank < 5) AS website
FROM r GROUP BY label"""
    sql["excluded_domains"] = f"""
WITH h AS (
  SELECT c_mktsegment, label, unnest(CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN ['facebook', label] WHEN 'BUILDING' THEN [label, label]
    WHEN 'FURNITURE' THEN [label, label] WHEN 'HOUSEHOLD' THEN ['unrelated', label]
    ELSE ['yellowpages'] END) AS hit FROM ({CUSTOMERS}) WHERE {_FOUND})
SELECT hit AS label, count(*) AS n_hits FROM h WHERE hit NOT IN ({excluded}) GROUP BY hit"""
    clean = r"regexp_replace(lower(company_name), '[^\p{L}\p{N}_\s]', '', 'g')"
    sql["company_domain_match"] = f"""
WITH s AS (SELECT s_suppkey, substr(s_name, 10, 9) AS d FROM supplier), v AS (
  SELECT s_suppkey, 'word' AS variant, 'Acme Supplier' || d || ', Inc.' AS company_name, 'supplier' || d AS label FROM s
  UNION ALL SELECT s_suppkey, 'initials', 'Quick & Brown Fox ' || d, 'qbf0' FROM s
  UNION ALL SELECT s_suppkey, 'squeezed', 'a b ' || d, 'ab' || d FROM s
  UNION ALL SELECT s_suppkey, 'excluded', 'Amazon ' || d, 'amazon' FROM s
  UNION ALL SELECT s_suppkey, 'none', 'Zeta Ltd ' || d, 'example' || d || 'x' FROM s),
w AS (SELECT *, {clean} AS clean, regexp_split_to_array(trim({clean}), '\\s+') AS words FROM v),
f AS (SELECT *, len(list_filter(words, lambda x: length(x) > 2 AND contains(label, x))) > 0 AS by_word,
  array_to_string(list_transform(words, lambda x: x[1]), '') = label AS by_initials,
  replace(clean, ' ', '') = label AS by_squeezed FROM w)
SELECT s_suppkey, variant, label, clean, by_word, by_initials, by_squeezed,
  label NOT IN ({excluded}) AND (by_word OR by_initials OR by_squeezed) AS matched FROM f"""
    sql["company_domain_pairs"] = f"""
WITH n AS (
  SELECT DISTINCT array_to_string(list_transform(string_split(replace({LABEL}, '-', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') || ' Group' AS company_name FROM pages UNION SELECT c_name FROM customer),
l AS (SELECT DISTINCT {LABEL} AS label FROM pages),
w AS (SELECT company_name, {clean} AS clean, regexp_split_to_array(trim({clean}), '\\s+') AS words FROM n),
f AS (SELECT company_name, label, array_to_string(list_transform(words, lambda x: x[1]), '') = label AS by_initials,
  replace(clean, ' ', '') = label AS by_squeezed,
  len(list_filter(words, lambda x: length(x) > 2 AND contains(label, x))) > 0 AS by_word FROM w, l
  WHERE label <> '' AND label NOT IN ({excluded}))
SELECT company_name, label, CASE WHEN by_initials THEN 'initials' WHEN by_squeezed THEN 'squeezed' ELSE 'word' END AS rule
FROM f WHERE by_initials OR by_squeezed OR by_word"""
    sql["page_suffix_labels"] = f"""
SELECT page_id, CASE WHEN net LIKE '%example.com' THEN 'example.com' WHEN net LIKE '%example.net' THEN 'net' ELSE 'org' END AS suffix,
  CASE WHEN net LIKE '%.example.com' THEN regexp_extract(net, '([^.]+)\\.example\\.com$', 1) ELSE 'example' END AS label
FROM (SELECT page_id, lower({part('url', 2)}) AS net FROM pages)"""
    sql["page_escaped_contacts"] = """
SELECT page_id, CAST(CASE WHEN page_id % 5 = 4 THEN 1 ELSE 8 END AS INTEGER) AS method_ord, 'user' || page_id || '@site.test' AS email FROM pages"""
    sql["page_error_counts"] = """
SELECT CASE WHEN page_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM pages GROUP BY 1"""
    sql["site_company_errors"] = f"""
SELECT CASE WHEN NOT ({_FOUND}) THEN 'no_website_found' WHEN c_mktsegment = 'BUILDING' THEN 'error' ELSE 'success' END AS status,
  count(*) AS n, count(CASE WHEN {_FOUND} AND c_mktsegment <> 'BUILDING' THEN 1 END) AS n_email FROM customer GROUP BY 1"""
    sql["homepage_declared"] = """
WITH s AS (SELECT s_suppkey AS site_key, 'https://' || lower(replace(s_name, '#', '')) || '.com/' AS home, lower(replace(s_name, '#', '')) AS u FROM supplier)
SELECT site_key, 'json-ld' AS source, home || 'ld-' || u AS url FROM s WHERE site_key % 4 = 0
UNION ALL SELECT site_key, 'meta', home || 'meta-' || u FROM s WHERE site_key % 4 = 0
UNION ALL SELECT site_key, 'json-ld', home || 'contact-ld' FROM s WHERE site_key % 4 = 1
UNION ALL SELECT site_key, 'homepage', home FROM s WHERE site_key % 4 = 2"""
    sql["name_encodings"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN hex(encode(c_name)) || 'FF' ELSE c_name || ' é' END AS company_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'encoding_error' END AS status FROM customer"""
    sql["company_list"] = """
SELECT c_mktsegment AS company_name, count(*) AS n, count(*) AS n_keys FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1"""
    sql["markup_property_contacts"] = cards("abcd-", "ppp-p")
    # The name has 18 characters; the label drops its blank and all digits after the kept
    # ones; with one digit the lengths alone rule the threshold out.
    sql["company_domain_similarity"] = """
SELECT s_suppkey, kept, CASE WHEN kept > 1 THEN round(2.0 * (8 + kept) / (18 + 8 + kept), 6) END AS ratio,
  2.0 * (8 + kept) / (18 + 8 + kept) > 0.8 AS similar
FROM supplier, (VALUES (9), (5), (1)) v(kept)"""
    sql["jsonld_contacts"] = cards("abc-e", "ppp--")
    sql["js_object_contacts"] = cards("ab--e", "-pp--")
    sql["microdata_contacts"] = cards("ab--e", "pp-p-")
    sql["section_contacts"] = cards("abc-e", "p-p--")
    sql["builder_contacts"] = cards("abcde", "pp-p-")
    sql["markup_website"] = """
SELECT s_suppkey AS page_id, 'https://' || u || '.com/' AS website, u || '@' || u || '.com' AS rdfa_email
FROM (SELECT s_suppkey, lower(replace(s_name, '#', '')) AS u FROM supplier)"""
    sql["site_company_contacts"] = SITE_COMPANY_CONTACTS
    sql["contact_page_ranking"] = CONTACT_PAGE_RANKING
    sql["sitemap_pages"] = _rows(
        "BUILDING", f"{_HOME} AS site_key, {_HOME} || '/Company/Contact.html' AS url, true AS is_contact",
        f"{_HOME}, {_HOME} || '/jobs', false",
    )
    sql["common_path_probe"] = " UNION ALL ".join(
        [
            _rows("AUTOMOBILE", f"{_HOME} AS site_key, {_HOME} || '/contact' AS url_key, "
                  "round(CAST(1.5 AS DOUBLE) / 7, 6) AS relevance, false AS accepted"),
            _rows("HOUSEHOLD", f"{_HOME}, {_HOME} || '/contact', round(CAST(4.5 AS DOUBLE) / 7, 6), true"),
        ]
    )
    sql["directory_website"] = f"""
SELECT label AS company_name, 'https://www.yellowpages.com/biz/' || label AS url, {_HOME} || '/' AS website
FROM ({CUSTOMERS}) WHERE c_mktsegment = 'MACHINERY' AND {_FOUND}"""
    sql["frame_contacts"] = f"""
SELECT kind, CAST(method_ord AS INTEGER) AS method_ord, count(*) AS n FROM (
  SELECT 'email' AS kind, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 3
    WHEN 'HOUSEHOLD' THEN 9 ELSE 17 END AS method_ord FROM customer
  UNION ALL SELECT 'phone', CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 3
    WHEN 'HOUSEHOLD' THEN 4 ELSE 15 END FROM customer) GROUP BY kind, method_ord"""
    sql["batch_summary"] = coverage(
        f"SELECT *, CAST(pos // 1000 AS INTEGER) AS batch_id FROM ({ORDER_RESULTS})",
        "batch_id",
    )
    sql["status_breakdown"] = f"""
SELECT batch_id, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY batch_id), 1) AS pct FROM (
  SELECT CAST(pos // 5000 AS INTEGER) AS batch_id, status, count(*) AS n FROM ({ORDER_RESULTS})
  GROUP BY GROUPING SETS ((1, 2), (2)))"""
    sql["ordered_results"] = f"""
SELECT o_orderkey, status, pos, pos AS written_pos FROM ({ORDER_RESULTS.replace('SELECT row', 'SELECT o_orderkey, row', 1)})"""
    sql["company_batches"] = """
SELECT c_custkey, c_name AS name, pos, CAST((pos - 10) // 50 AS INTEGER) AS batch_id FROM (
  SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
WHERE pos >= 10 AND c_mktsegment <> 'BUILDING'"""
    sql["reprocess_merge"] = f"""
SELECT doc_id AS company_id, source AS company_name,
  coalesce({_DOC_SITE}, CASE WHEN phone IS NOT NULL THEN {_SECOND} END) AS website,
  coalesce(email, CASE WHEN phone IS NOT NULL THEN 'second@example.net' END) AS email, phone,
  CASE WHEN email IS NOT NULL OR phone IS NOT NULL THEN 'success' ELSE 'no_website_found' END AS status
FROM ({DOC_CONTACTS})"""
    sql["upsert_by_key"] = sql["upsert_results"] = f"""
SELECT doc_id AS company_id, source AS company_name,
  CASE WHEN phone IS NOT NULL THEN {_SECOND} ELSE {_DOC_SITE} END AS website,
  CASE WHEN phone IS NOT NULL THEN 'second@example.net' ELSE email END AS email, phone,
  CASE WHEN email IS NOT NULL OR phone IS NOT NULL THEN 'success' ELSE 'no_website_found' END AS status
FROM ({DOC_CONTACTS})"""
    sql["snapshot_latest"] = """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS) WHERE rn = 1"""
    sql["stream_results"] = f"""
SELECT doc_id AS company_id, source AS company_name, CAST(NULL AS VARCHAR) AS website, email, phone,
  'no_website_found' AS status FROM ({DOC_CONTACTS})"""
    sql["stream_first_seen"] = """
WITH RECURSIVE r AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT e.user_id, min(e.ts) AS ts FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 7 DAYS
  GROUP BY e.user_id, r.ts)
SELECT user_id, ts FROM r"""
    sql["stream_site_contacts"] = (
        f"SELECT {_HOME} AS site_key, {case(dict(zip(SEGMENTS, 'abcde')))} AS email, number AS phone FROM ({CUSTOMERS})")
    sql["props_json"] = """
SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (
  SELECT event_type, CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
GROUP BY event_type"""
    return sql
