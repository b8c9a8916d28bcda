"""Dictionaries: contact terms, directories, common paths. All are plain arguments of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ---------------------------------------------------------------------------
# Contact terms by category. The test is "contains any"; ``literal_terms`` reduces them to the shortest.
CONTACT_TERMS: dict[str, list[str]] = {
    "english": [
        "contact", "contact-us", "about/contact", "about-us/contact", "reach-us", "get-in-touch", "support", "help",
        "customer-service", "customer-support", "contact-support", "contact-form", "feedback", "enquiry", "inquiry",
        "reach-out", "connect", "talk-to-us", "contact/sales", "contact/support", "helpdesk", "help-center",
    ],
    "german": [
        "kontakt", "uber-uns/kontakt", "impressum", "kontaktformular", "kundendienst", "kundenservice", "hilfe",
        "uber-uns", "support-de", "kontaktieren-sie-uns", "schreiben-sie-uns",
    ],
    "spanish": [
        "contacto", "contactenos", "sobre-nosotros", "contactar", "atencion-al-cliente", "ayuda", "soporte",
        "servicio-al-cliente", "contactanos", "escribenos", "donde-estamos",
    ],
    "french": [
        "nous-contacter", "contact-france", "contactez-nous", "aide", "service-client", "support-fr", "assistance",
        "nous-ecrire", "coordonnees", "service-clientele",
    ],
    "italian": [
        "contatti", "contattaci", "chi-siamo", "assistenza", "servizio-clienti", "supporto", "dove-siamo", "scrivici",
    ],
    "portuguese": [
        "contato", "contacte-nos", "fale-conosco", "atendimento", "suporte", "ajuda", "onde-estamos", "assistencia",
    ],
    "dutch": [
        "contact", "neem-contact-op", "klantenservice", "over-ons", "hulp", "ondersteuning", "contact-opnemen",
    ],
    "turkish": [
        "iletisim", "bize-ulasin", "bizimle-iletisime-gecin", "destek", "musteri-hizmetleri", "iletisim-formu",
        "bize-yazin", "kunye", "firma-iletisim", "kurumsal-iletisim", "hakkimizda/iletisim", "bayi-iletisim",
        "merkez-iletisim", "genel-merkez",
    ],
    "russian": [
        "kontakty", "svyaz", "o-nas/kontakty", "podderzhka", "obratnaya-svyaz", "napisat-nam", "sluzhba-podderzhki",
        "pomoshch", "kontaktnaya-informatsiya", "svyazatsya-s-nami",
    ],
    "chinese": [
        "lian-xi-wo-men", "guan-yu-wo-men", "ke-fu-zhong-xin", "bang-zhu-zhong-xin", "lian-xi-fang-shi", "jiu-zhu",
    ],
    "japanese": [
        "otoiawase", "contact-jp", "support-jp", "help-jp", "o-toiawase", "contact-japan", "support-japan",
    ],
    "korean": [
        "munui", "munuihagi", "contact-kr", "support-kr", "gokaek-sente", "contact-korea", "support-korea",
    ],
    "arabic": [
        "ittisal", "tawasol-maana", "contact-ar", "support-ar", "musaeada", "aldaem", "contact-arabic",
    ],
    "common_variations": [
        "contact-info", "contact-information", "business-contact", "corporate-contact", "global-contact",
        "sales-contact", "office-contact", "headquarters-contact", "branch-contact", "regional-contact",
        "international-contact", "local-contact", "contact-details", "contact-directory", "contact-locations",
        "contact-addresses", "general-contact", "main-contact",
    ],
    "industry_specific": [
        "dealer-contact", "supplier-contact", "vendor-contact", "distributor-contact", "partner-contact",
        "reseller-contact", "wholesaler-contact", "manufacturer-contact", "factory-contact", "industrial-contact",
        "commercial-contact", "retail-contact",
    ],
    "file_extensions": [
        "contact.html", "contact.php", "contact.asp", "contact.jsp", "contact.aspx", "contact.shtml", "contact.cfm",
        "contact.py", "contact/", "contact/index.html",
    ],
    "api_endpoints": [
        "/api/contact", "/api/v1/contact", "/api/support", "/api/feedback", "/contact/api", "/v1/contact",
    ],
}
# Opt-in patterns: the first three are searched in the reference, the last in the host.
CONTACT_PATTERNS: dict[str, list[str]] = {
    "url_patterns": [
        "contact.*/.*html?", "about.*/.*contact.*", ".*/contact$", ".*/contact-.*",
        ".*/.*-contact", ".*/reach-.*", ".*/connect.*", "help.*/contact.*", "support.*/contact.*",
        ".*/enquiry.*", ".*/inquiry.*", ".*/feedback.*", ".*/support.*",
    ],
    "dynamic_paths": [
        "contact/[0-9]+", "contact/[a-z]{2}", "contact/[a-z]{2}-[a-z]{2}", "contact/region/[a-z]+",
        "contact/office/[a-z]+", "contact/department/[a-z]+", "support/[a-z]+/contact",
    ],
    "special_cases": [
        r"^\/$contact", r"^\/.*#contact", r"^\/.*#reach-us", r"^\/.*#get-in-touch",
        r"^\/.*#connect", r"^\/.*#support", r"contact\?.*", r"support\?.*", r"help\?.*",
    ],
    "subdomain_patterns": [
        "contact.", "support.", "help.", "info.", "customerservice.", "cs.", "enquiry.", "feedback.",
    ],
}
COMMON_PATHS = [
    "/contact", "/contact-us", "/contactus", "/connect", "/reach-us", "/reach", "/get-in-touch",
    "/about/contact", "/support/contact", "/help/contact", "/locations",
]
DIRECTORIES = ["linkedin.com/company", "facebook.com/pages", "yellowpages.com", "yelp.com/biz"]
# Anchor texts that lead from a directory entry to the company, by priority.
WEBSITE_ANCHORS = [r"(?i)website|official site|homepage|web page", r"(?i)visit.*site|view.*website"]
QUERY_SUFFIX = "official website contact"
TOP_HITS = 5
TOP_CONTACT_PAGES = 3
SELF_RELEVANCE = 0.6
PROBE_RELEVANCE = 0.4
BUILDER_CLASSES = ["uabb-info-list-item", "elementor-widget-container", "vc_column_text"]
SECTION_CLASS = "(?i)contact|footer|header|info|details"
NAV_CLASS = "(?i)(?:main|primary|global)-nav"
CACHE_DAYS = 7
STATUSES = ["success", "no_website_found", "error", "encoding_error", "failed"]
# --- end of fixed values --------------------------------------------------------------------


def literal_terms(*categories: str) -> list[str]:
    """Contact terms of some categories, of all by default, without those that hold another one: where the longer
    term occurs, so does the shorter."""
    terms = dict.fromkeys(t for c in categories or CONTACT_TERMS for t in CONTACT_TERMS[c])
    return [t for t in terms if not any(other != t and other in t for other in terms)]


def category_names() -> list[str]:
    """Names of the term categories: the narrow matching mode compares against these."""
    return [*CONTACT_TERMS, *CONTACT_PATTERNS]


def reference_pattern() -> str:
    """One alternation of the opt-in patterns that are searched in a reference."""
    groups = ("url_patterns", "dynamic_paths", "special_cases")
    return "|".join(f"(?:{p})" for g in groups for p in CONTACT_PATTERNS[g])


def host_prefixes() -> list[str]:
    return CONTACT_PATTERNS["subdomain_patterns"]


def contact_terms(spark: SparkSession) -> DataFrame:
    """The dictionary as a table (category, term, is_regex), for callers that extend it with SQL."""
    rows = [(c, t, False) for c, ts in CONTACT_TERMS.items() for t in ts]
    rows += [(c, t, c != "subdomain_patterns") for c, ts in CONTACT_PATTERNS.items() for t in ts]
    return spark.createDataFrame(rows, "category string, term string, is_regex boolean")
