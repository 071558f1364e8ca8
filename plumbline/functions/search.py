"""Search results and search queries: what a claim asks for, which pages are worth reading, which queries worth sending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import domains, urls, words
from plumbline.functions.once import once
from plumbline.functions.words import contains_any, has, low

#: Words of claim types, and patterns that weigh more.
KEYWORDS = {
    "EFFICACY": ("effective", "efficacy", "works", "work", "prevent", "prevents", "reduce", "reduces", "improve", "improves", "benefit", "treat", "treats", "cure", "cures", "reverses"),
    "SAFETY": ("safe", "safety", "harm", "harmful", "toxic", "risk", "adverse", "side effect", "side effects", "dangerous", "injury", "fatal", "infertility"),
    "STATISTICAL": ("rate", "rates", "incidence", "prevalence", "odds", "percent", "percentage", "probability", "risk ratio", "hazard ratio", "proportion", "statistics"),
    "NUMERIC_COMPARISON": ("more than", "less than", "fewer than", "greater than", "higher than", "lower than", "compared to", "versus", "vs", "number of", "count", "population", "estimate"),
    "MECHANISM": ("mechanism", "pathway", "via", "through", "because", "trigger", "mediated", "binds", "metabolism", "immune"),
    "MYTH": ("myth", "hoax", "fake", "false", "debunk", "conspiracy", "rumor", "misinformation", "not true"),
    "UNIQUENESS": ("unique", "uniqueness", "fingerprint", "tongue print", "distinct", "individuality", "no two", "one of a kind", "identical", "biometric", "identification"),
}
STRONG = (
    ("STATISTICAL", r"\b\d+(?:\.\d+)?\s*%?\b", 1.5),
    ("NUMERIC_COMPARISON", r"\b(more|less|fewer|greater|higher|lower)\b.+\bthan\b|\bvs\.?\b|\bversus\b|\bcompared to\b", 1.8),
    ("NUMERIC_COMPARISON", r"\b(population|count|number of|estimate|estimated)\b", 1.2),
    ("UNIQUENESS", r"\bno two\b|\bunique\b|\bindividuality\b|\bbiometric\b", 1.5),
    ("MYTH", r"\bnot true\b|\bfalse\b|\bhoax\b|\bmyth\b|\bdebunk\b", 1.5),
    ("MECHANISM", r"\bbecause\b|\bvia\b|\bthrough\b|\bmechanism\b|\bpathway\b", 1.0),
    ("SAFETY", r"\bsafe(?:ty)?\b|\bside effects?\b|\bharm(?:ful)?\b|\brisk\b|\binfertility\b", 1.2),
    ("EFFICACY", r"\beffective\b|\bworks?\b|\bprevents?\b|\breduces?\b|\btreats?\b|\bcures?\b|\breverses?\b", 1.2),
)
#: Which type wins a tie.
PRIORITY = ("MYTH", "UNIQUENESS", "NUMERIC_COMPARISON", "SAFETY", "EFFICACY", "STATISTICAL", "MECHANISM", "GENERAL")
#: Pages that say little, in addresses and in texts.
LOW_URLS = ("/references", "human-verification", "javascript-and-cookies", "/study/nct")
LOW_TEXTS = ("manual", "policy", "handbook", "template", "brochure", "procurement")
SHELLS = ("", "index", "home", "search", "category", "tags", "about", "contact", "sitemap")
#: Words that no key term is, and that spoil a query.
NO_KEY = ("the", "a", "an", "and", "or", "but", "just", "like", "every", "individual", "around", "to", "for", "of", "in", "on", "with", "by", "at", "is", "are", "was", "were", "be", "been", "being", "about", "average", "per", "times", "each", "roughly", "approximately")
ACTION = ("is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "how", "what", "when", "where", "why", "which", "can", "could", "should", "would", "may", "might", "must")
JUNK = ("according", "significantly", "significant", "drinking", "improves", "improve", "every", "morning", "medical", "research", "your", "body", "produces", "produce", "produced", "new", "roughly", "population")
GENERIC_ENDS = ("medical evidence", "scientific research", "clinical verification", "factual analysis")
#: Marks of trusted roots by claim type, best first, and the order of roots in general.
ROUTES = {
    "EFFICACY": ("pubmed", "cochrane", "clinicaltrials", "cdc", "nih", "who", "jamanetwork", "bmj", "nejm"),
    "SAFETY": ("fda", "cdc", "nih", "who", "ema", "ecdc", "nhs", "clinicaltrials"),
    "STATISTICAL": ("ourworldindata", "ihme", "healthdata", "worldbank", "cdc", "who"),
    "NUMERIC_COMPARISON": ("pubmed", "pmc", "ncbi", "plos", "nature", "science", "ourworldindata", "worldbank"),
    "MECHANISM": ("pubmed", "pmc", "nih", "nlm", "nature", "science", "plos"),
    "MYTH": ("cdc", "who", "nih", "nhs", "nice"),
    "UNIQUENESS": ("pubmed", "pmc", "nih", "nlm", "nature", "plos"),
    "GENERAL": ("pubmed", "cdc", "nih", "who", "nhs"),
}
SITES = ("pubmed", "pmc", "ncbi", "nih", "cdc", "who", "fda", "clinicaltrials", "cochrane", "nejm", "thelancet", "bmj", "jamanetwork", "nature", "science", "nhs", "nice")
REDIRECTS = ("google.com", "google.co.uk", "google.lk")
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"


def claim_class(claim: Column) -> Column:
    """The type of claim that its words and patterns speak for most; ties by PRIORITY, GENERAL for none."""
    points = []
    for name in PRIORITY:
        p = F.lit(0.0)
        for key in KEYWORDS.get(name, ()):
            p = p + F.when(low(claim).contains(key), 1.0).otherwise(0.0)
        for of, pattern, weight in STRONG:
            if of == name:
                p = p + F.when(has(claim, pattern), weight).otherwise(0.0)
        points.append(F.round(p, 6))
    best = F.greatest(*points)
    out = F.when(best == 0, F.when(has(claim, r"\bhow many\b|\bnumber of\b|\brate of\b"), "STATISTICAL").otherwise("GENERAL"))
    for name, p in zip(PRIORITY, points, strict=True):
        out = out.when(p == best, name)
    return out


def unwrapped(u: Column) -> Column:
    """The page that a search engine's redirect leads to; other addresses as they are, trimmed."""
    raw = F.trim(F.coalesce(u, F.lit("")))
    redirect = urls.host(raw).isin(*REDIRECTS) & raw.rlike(r"^[^?#]*://[^/?#]+/url([?#]|$)")
    param = lambda name: F.trim(F.coalesce(F.try_url_decode(F.regexp_extract(raw, rf"[?&]{name}=([^&#]+)", 1)), F.lit("")))
    target = F.coalesce(F.when(param("q") != "", param("q")), F.when(param("url") != "", param("url")), raw)
    return F.when(F.coalesce(redirect, F.lit(False)), target).otherwise(raw)


def reject_reason(u: Column, title: Column, snippet: Column) -> Column:
    """The first reason not to read a page, or null."""
    raw = F.trim(F.coalesce(u, F.lit("")))
    bare = F.substring_index(raw, "#", 1)
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_extract(bare, r"[?](.*)$", 1)).otherwise("")
    params = F.filter(F.split(query, "&"), lambda p: p != "")
    tracking = F.size(F.filter(params, lambda p: F.lower(p).rlike("^(utm_|gclid|fbclid|mc_)")))
    path = F.trim(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1)), F.lit("/"))
    path = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), path).otherwise(F.trim(F.lower(F.substring_index(bare, "?", 1)), F.lit("/")))
    told = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(snippet, F.lit("")) != "")
    return (
        F.when(raw == "", "empty_url").when(contains_any(raw, ("data:text",)), "data_text_scheme").when(contains_any(raw, ("pano=",)), "pano_param")
        .when(raw.rlike("[A-Za-z0-9+/]{32,}={0,2}"), "base64_blob").when(contains_any(raw, LOW_URLS), "low_signal_pattern")
        .when((F.length(query) > 450) | (F.size(params) > 12), "querystring_too_long").when((F.size(params) > 0) & (tracking == F.size(params)), "tracking_only")
        .when(path.isin(*SHELLS) & ~told, "site_shell_page")
    )


def page_text(u: Column, title: Column, snippet: Column) -> Column:
    """A search result's words in lower case, as the gate reads them."""
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(u, F.lit(""))))


def names_anchor(text: Column, anchors: Column) -> Column:
    met = F.exists(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: (F.coalesce(a, F.lit("")) != "") & F.contains(text, F.lower(a)))
    return F.coalesce(met, F.lit(False))


def low_page(text: Column) -> Column:
    return contains_any(text, LOW_TEXTS)


def is_file(u: Column) -> Column:
    return low(u).rlike(r"\.(?:pdf|docx?|pptx?)\b")


def _weighed(*flags: Column) -> tuple[list[tuple[Column, str]], Column]:
    """The gate's conditions with their names, and the sum of their weights."""
    named = list(zip(flags, ("anchor_match", "claim_type_keyword", "trusted_domain", "low_signal_penalty", "file_penalty"), strict=True))
    score = F.lit(0.0)
    for cond, value in zip(flags, (1.5, 1.0, 0.75, -1.0, -0.5), strict=True):
        score = score + F.when(cond, value).otherwise(0.0)
    return named, score


def page_signals(u: Column, title: Column, snippet: Column) -> Column:
    """A struct of all that the gate reads in a search result alone: text, types (those whose words it has), trusted, low, file."""

    def read(text: Column) -> Column:
        has_words = lambda keys: F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(text, k))
        types = F.array_compact(F.array(*[F.when(has_words(keys), name) for name, keys in KEYWORDS.items()]))
        return F.struct(text.alias("text"), types.alias("types"), domains.is_trusted(u).alias("trusted"), low_page(text).alias("low"), is_file(u).alias("file"))

    return once(page_text(u, title, snippet), read)


def page_gate(kind: Column, anchors: Column, page: Column) -> Column:
    """A struct: passed and score of quality_gate(), from page_signals()."""

    def judged(x: Column) -> Column:
        _, score = _weighed(x["m"], x["t"], page["trusted"], page["low"], page["file"])
        return once(score, lambda s: F.struct(((s >= 1.5) & (x["m"] | x["t"])).alias("passed"), F.round(s, 3).alias("score")))

    typed = F.coalesce(F.array_contains(page["types"], kind), F.lit(False))
    return once(F.struct(names_anchor(page["text"], anchors).alias("m"), typed.alias("t")), judged)


def quality_gate(kind: Column, anchors: Column, u: Column, title: Column, snippet: Column) -> Column:
    """A struct: passed, score and reasons of a search result for a claim of a type with anchors."""
    text = page_text(u, title, snippet)
    typed = F.lit(False)
    for name, keys in KEYWORDS.items():
        typed = typed | ((kind == name) & contains_any(text, keys))
    flags, score = _weighed(names_anchor(text, anchors), typed, domains.is_trusted(u), low_page(text), is_file(u))
    reasons = F.array_compact(F.array(*[F.when(cond, name) for cond, name in flags]))
    passed = (score >= 1.5) & (F.array_contains(reasons, "anchor_match") | F.array_contains(reasons, "claim_type_keyword"))
    return F.struct(passed.alias("passed"), F.round(score, 3).alias("score"), reasons.alias("reasons"))


def query_quality(q: Column, anchors: Column) -> Column:
    """A struct: anchor_hits, anchor_total, junk_hits, token_count, passed of a search query."""
    tokens = words.found(q, words.ALPHA)
    name = lambda a: F.array_join(words.found(a, words.ALPHA), " ")
    hit = lambda a: (name(a) != "") & ((F.contains(name(a), F.lit(" ")) & F.contains(low(q), name(a))) | F.array_contains(tokens, name(a)))
    listed = F.coalesce(anchors, F.array().cast("array<string>"))
    hits, junk = F.size(F.filter(listed, hit)), F.size(F.filter(tokens, lambda t: t.isin(*JUNK)))
    passed = (junk <= 1) & (F.size(tokens) >= 3) & ((F.size(listed) == 0) | (hits > 0))
    return F.struct(hits.alias("anchor_hits"), F.size(listed).alias("anchor_total"), junk.alias("junk_hits"), F.size(tokens).alias("token_count"), passed.alias("passed"))


def key_numbers(x: Column) -> Column:
    """Distinct numbers, without the commas of thousands."""
    return F.array_distinct(F.transform(words.found(x, NUMBER), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def key_terms(x: Column) -> Column:
    return words.token_set(x, words.ALPHA, tuple(dict.fromkeys((*NO_KEY, *ACTION, *JUNK))))


def term_marks(terms: Column, numbers: Column) -> Column:
    """Key terms and numbers in the forms that queries are searched for: a struct of t and n, made once for all queries of a claim."""
    return F.struct(F.transform(F.filter(terms, lambda t: t != ""), lambda t: words.spaced(t)).alias("t"), F.filter(numbers, lambda n: n != "").alias("n"))


def names_term(q: Column, marks: Column) -> Column:
    """Whether a query names one of term_marks()."""
    forms = F.struct(words.spaced(q).alias("s"), F.replace(low(q), F.lit(","), F.lit("")).alias("d"))
    return once(forms, lambda f: F.exists(marks["n"], lambda n: F.contains(f["d"], n)) | F.exists(marks["t"], lambda t: F.contains(f["s"], t)))


def kept_queries(queries: Column, marks: Column) -> Column:
    """Distinct folded queries that name one of term_marks() and end in no stock phrase."""
    clean = F.array_distinct(F.filter(F.transform(queries, lambda q: F.trim(low(q))), lambda q: q != ""))

    def stays(q: Column, x: Column) -> Column:
        stock = F.lit(False)
        for end in GENERIC_ENDS:
            stock = stock | q.endswith(end)
        return ~stock & names_term(q, x)

    return once(marks, lambda x: F.filter(clean, lambda q: stays(q, x)))


def sanitized(q: Column) -> Column:
    """Single spaces, no unpaired quotes, no word twice in a row, at most 18 words, no doubled negations."""
    x = F.trim(F.regexp_replace(F.coalesce(q, F.lit("")), r"(?U)\s+", " "))
    x = F.when(F.regexp_count(x, F.lit('"')) % 2 == 1, F.replace(x, F.lit('"'), F.lit(""))).otherwise(x)
    parts = F.filter(F.split(x, " +"), lambda t: t != "")
    single = lambda a: F.filter(a, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(a, i - 1))))
    x = F.array_join(F.slice(F.transform(F.array(parts), single)[0], 1, 18), " ")
    for pattern, into in ((r"(?i)\b(do|does)\s+not\s+(?:do|does)\s+not\b", "$1 not"), (r"(?i)\b(?:do|does)\s+not\s+cannot\b", "does not"), (r"(?i)\bcannot\s+(?:do|does)\s+not\b", "cannot"), (r"(?i)\bnot\s+not\b", "not")):
        x = F.regexp_replace(x, pattern, into)
    return F.trim(F.regexp_replace(x, " +", " "))


def by_marks(roots: Sequence[str], marks: Sequence[str], all_roots: bool) -> list[str]:
    """Domains by the first mark that they hold, then name; those without a mark last, or left out."""
    place = lambda r: next((i for i, m in enumerate(marks) if m in r), len(marks))
    return sorted((r for r in roots if all_roots or place(r) < len(marks)), key=lambda r: (place(r), r))


def trusted_routes(kind: str) -> list[str]:
    return by_marks(domains.TRUSTED_ROOTS, ROUTES.get((kind or "GENERAL").upper(), ROUTES["GENERAL"]), False) or sorted(domains.TRUSTED_ROOTS)


def trusted_sites() -> list[str]:
    return by_marks(domains.TRUSTED_ROOTS, SITES, True)


def truth_cleaned(x: Column, limit: int = 220) -> Column:
    """Evidence for display: single spaces, no reference marks, cut at a sentence's end past 55 per cent of ``limit``, else with an ellipsis."""
    c = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?U)\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\[[0-9,\s\-]+\]", ""), r"(?i)\(\s*(?:ref|refs?|citation)\s*[:#]?\s*[0-9,\s\-]+\)", "")
    c = F.regexp_replace(c, r"^[ \-;,.]+|[ \-;,.]+$", "")
    head = F.substring(c, 1, limit)
    last = F.greatest(*[F.when(F.contains(head, F.lit(m)), F.length(head) - F.locate(m[::-1], F.reverse(head)) - 1).otherwise(-1) for m in (". ", "; ")])
    return F.when(F.length(c) <= limit, c).when(last >= int(limit * 0.55), F.trim(F.left(c, last + 1))).otherwise(F.concat(F.rtrim(F.left(c, F.lit(limit - 1))), F.lit("…")))
