"""Pages and their addresses: kinds of URLs, links and dates in HTML, keys, and texts made fit for search and for logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import urls
from plumbline.functions.words import low

#: What is cut out of queries before they are embedded.
SITES_OUT = r"(?i)(^|\s)-(?:facebook|quora|reddit|pinterest|youtube|testimonial|opinion)\b"
#: Words that no entity phrase has.
NOISE = (
    "necessary", "normal", "overall", "general", "effect", "effects", "evidence", "study", "research", "used", "use", "using", "prevent", "prevents", "prevented", "preventing", "treat", "treats", "treated", "treating",
    "cure", "cures", "cured", "curing", "boost", "boosts", "boosted", "boosting", "stop", "stops", "stopped", "stopping",
)
#: Secrets in logs.
SECRETS = (r"\b(gsk_[A-Za-z0-9_\-]{12,})\b", r"\b(sk-[A-Za-z0-9]{12,})\b", r"\b(AIza[0-9A-Za-z_\-]{12,})\b", r"\b(pcsk_[A-Za-z0-9_\-]{12,})\b", r"(?i)\b(rediss?://[^\s]+)\b")
SECRET_KEY = r"(?i)(api[_-]?key|token|secret|password|authorization|auth|credential|connectionstring)"
MASK = "***MASKED***"
#: Fixed value: hosts whose forbidden PDFs a browser cannot fetch either.
PDF_FORBIDDEN = ("stacks.cdc.gov",)
#: Parameters that a URL's key leaves out, beside all that begin with utm_.
KEY_OUT = ("fbclid", "gclid", "msclkid", "source", "ref")


def embedding_query(x: Column) -> Column:
    """A search query without operators, excluded sites and signs."""
    c = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), SITES_OUT, "$1 ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bsite:[^\s]+", " "), r"[\"`~!@#$%^&*_=+{}\[\]|\\<>(),;:]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def query_key(x: Column) -> Column:
    """A query folded, with spaces for signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(low(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def url_key(u: Column) -> Column:
    """Scheme, lower-case host and path with single slashes, and the parameters that do not track, sorted; blank for none."""
    raw = F.trim(F.coalesce(u, F.lit("")))
    bare = F.substring_index(raw, "#", 1)
    has_scheme = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    scheme = F.when(has_scheme, F.lower(F.substring_index(bare, "://", 1))).otherwise("https")
    rest = F.when(has_scheme, F.substr(bare, F.locate("://", bare) + 3)).otherwise(bare)
    where = F.substring_index(rest, "?", 1)
    net = F.when(has_scheme, F.lower(F.substring_index(where, "/", 1))).otherwise("")
    path = F.rtrim(F.regexp_replace(F.substr(where, F.length(net) + 1), "/+", "/"), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.split(F.substr(rest, F.length(where) + 2), "&"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & ~p["k"].startswith("utm_") & ~p["k"].isin(*KEY_OUT)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    made = F.concat(scheme, F.when(has_scheme, "://").otherwise(":"), net, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(raw == "", "").otherwise(made)


def query_param(u: Column, name: str) -> Column:
    """The first value of a parameter that is not blank, decoded; null without one."""
    query = F.substring_index(F.regexp_extract(F.coalesce(u, F.lit("")), r"[?](.*)$", 1), "#", 1)
    value = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(value != "", F.coalesce(F.try_url_decode(value), value))


def without_query(u: Column) -> Column:
    return F.regexp_replace(F.coalesce(u, F.lit("")), "[?#].*$", "")


def url_type(u: Column) -> Column:
    """Which kind of page of the health organisation's archives an address is; generic_html for all others."""
    host = F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    text = low(u)
    return (
        F.when(~host.endswith("who.int"), "generic_html").when(text.endswith(".pdf"), "pdf_direct")
        .when(F.contains(u, F.lit("/server/api/core/bitstreams/")) & F.contains(u, F.lit("/content")), "who_api_bitstream")
        .when(F.contains(host, F.lit("imsear.searo.who.int")) & (text.contains("download") | text.contains("handle")), "imsear_download").when(F.contains(host, F.lit("iris.who.int")), "iris_html").otherwise("generic_html")
    )


def pdf_link(html: Column, base: Column) -> Column:
    """The first link to a PDF, made whole; null without one."""
    link = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?i)href="([^"]*\.pdf[^"]*)"', 1)
    root = F.regexp_extract(F.coalesce(base, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(link == "", None).when(link.startswith("http"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.rtrim(F.coalesce(base, F.lit("")), F.lit("/")), F.lit("/"), link))


def needs_no_browser(u: Column, status: Column, hosts: Sequence[str] = PDF_FORBIDDEN) -> Column:
    """Whether a page that was forbidden is a PDF of a host that forbids a browser too."""
    return F.coalesce((status == 403) & F.contains(low(u), F.lit(".pdf")) & urls.domain(u).isin(*hosts), F.lit(False))


def publish_date(html: Column) -> Column:
    """When a page says it was published, or else changed: the first of three marks that holds a date."""
    marks = (r'"datePublished":"(.*?)"', r'"dateModified":"(.*?)"', r'<meta property="article:published_time" content="(.*?)"')
    return F.coalesce(*[F.try_to_timestamp(F.replace(F.regexp_extract(F.coalesce(html, F.lit("")), m, 1), F.lit("Z"), F.lit(""))) for m in marks])


def entity_phrase(x: Column) -> Column:
    """An entity's first four telling words, without what a relative clause adds."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(low(x)), r"^(and|or|but)\s+", ""), r"\b(?:that|which|who|whom|whose)\b.*$", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"(?U)\b[a-z][a-z\-]{2,}\b"), F.lit(0))
    return F.array_join(F.slice(F.filter(tokens, lambda t: ~t.isin(*NOISE)), 1, 4), " ")


def masked(x: Column) -> Column:
    for pattern in SECRETS:
        x = F.regexp_replace(x, pattern, MASK)
    return x


def masked_entry(key: Column, value: Column) -> Column:
    """A log value without secrets: hidden whole under a telling key, else where one stands."""
    return F.when(key.rlike(SECRET_KEY), MASK).otherwise(masked(value))


def plural_variants(x: Column) -> Column:
    """Other forms of a search term: singular or plural, without hyphens, with single spaces."""
    key = F.trim(low(x))
    long = F.length(key) > 3
    number = F.when(long & key.endswith("s"), F.left(key, F.length(key) - 1)).when(long, F.concat(key, F.lit("s")))
    return F.array_distinct(F.filter(F.array(number, F.when(F.contains(key, F.lit("-")), F.replace(key, F.lit("-"), F.lit(" "))), F.when(F.contains(key, F.lit(" ")), F.regexp_replace(key, r"\s+", " "))), lambda v: F.coalesce(v, F.lit("")) != ""))
