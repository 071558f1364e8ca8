"""What a fact is about and what kind it is, from its words and its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import urls, words
from plumbline.functions.words import low

#: Words of topics, and topics of domains.
TOPICS = {
    "anatomy": ("bone", "bones", "skeleton", "muscle", "tongue", "heart", "hand", "hands", "foot", "feet", "organ", "organs", "anatomy", "structure"),
    "physiology": ("beats", "beat", "rate", "blood", "cells", "cell", "breathing", "respiration", "metabolism", "function"),
    "pathology": ("disease", "disorder", "syndrome", "cancer", "infection", "tumor", "symptom"),
    "pharmacology": ("drug", "medication", "dose", "dosing", "therapy", "treatment"),
    "epidemiology": ("incidence", "prevalence", "risk", "cohort", "case", "cases", "rate"),
    "genetics": ("gene", "genes", "mutation", "genetic", "chromosome", "allele"),
    "public_health": ("guideline", "vaccination", "population", "policy", "public health", "cdc", "who"),
    "nutrition": ("diet", "calorie", "vitamin", "nutrient", "nutrition", "food"),
}
DOMAIN_TOPICS = {
    "medlineplus.gov": ("anatomy", "physiology"),
    "nlm.nih.gov": ("anatomy", "physiology"),
    "pubmed.ncbi.nlm.nih.gov": ("pathology", "pharmacology", "epidemiology"),
    "cdc.gov": ("public_health", "epidemiology"),
    "who.int": ("public_health", "epidemiology"),
    "nih.gov": ("pathology", "genetics"),
}
#: Names of sources by domain, the first that fits, and document types by marks in the URL.
SOURCES = (("medlineplus.gov", "nlm"), ("nlm.nih.gov", "nlm"), ("pubmed.ncbi.nlm.nih.gov", "pubmed"), ("pmc.ncbi.nlm.nih.gov", "pubmed"), ("nih.gov", "nih"), ("cdc.gov", "cdc"), ("who.int", "who"), ("nhs.uk", "nhs"))
DOC_TYPES = (("journal", ("pubmed", "doi", "journal")), ("guideline", ("guideline", "mmwr")), ("report", ("report",)), ("news", ("news", "press")), ("encyclopedia", ("medlineplus.gov/ency",)))
#: Words of counted things, and of mechanisms.
COUNTED = ("bones", "bone", "beats", "beat", "cells", "cell", "cases", "case", "times", "bpm")
MECHANISM = ("causes", "leads to", "increases", "reduces", "associated")
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
RANGE = r"\b\d+(\.\d+)?\s*(?:-|to)\s*\d+(\.\d+)?\b"
#: Hedging and hearsay, which no grounded fact has.
HEDGED = r"\b(may|might|could|possibly|perhaps|suggests?|suspected|unclear|unknown|reportedly|allegedly)\b"


def topics(statement: Column, entities: Column, domain: Column) -> Column:
    """A struct: up to two topics, the best first, and how sure that is; none where no word or domain speaks of one.

    Two points for a hint of the domain, one for each word of a topic; topics one
    point behind the best stay. Ties by name.
    """
    own = words.token_set(F.concat_ws(" \n ", F.coalesce(statement, F.lit("")), F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " \n ")), words.ALPHA)
    host = F.coalesce(domain, F.lit(""))
    each = []
    for name, keys in TOPICS.items():
        points = F.size(F.array_intersect(own, F.array(*[F.lit(k) for k in keys])))
        for of, named in DOMAIN_TOPICS.items():
            if name in named:
                points = points + F.when(host.endswith(of), 2).otherwise(0)
        each.append(F.struct((-points).alias("p"), F.lit(name).alias("t")))
    listed = F.array_sort(F.array(*each))

    def chosen(a: Column) -> Column:
        best = -a[0]["p"]
        kept = F.filter(a, lambda x: -x["p"] >= F.greatest(F.lit(1), best - 1))
        none = F.array().cast("array<string>")
        return F.struct(F.when(best > 0, F.slice(F.transform(kept, lambda x: x["t"]), 1, 2)).otherwise(none).alias("topics"), F.when(best > 0, F.least(F.lit(1.0), best / 5.0)).otherwise(0.0).alias("confidence"))

    return F.transform(F.array(listed), chosen)[0]


def doc_type(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, marks in DOC_TYPES:
        out = out.when(words.contains_any(url, marks), name)
    return out.otherwise("web")


def source_name(domain: Column) -> Column:
    """The source's short name, else the domain itself; 'unknown' for none."""
    out = F.when(F.coalesce(domain, F.lit("")) == "", "unknown")
    for of, name in SOURCES:
        out = out.when(domain.endswith(of), name)
    return out.otherwise(domain)


def fact_type(statement: Column) -> Column:
    """A struct: type (range, count, definition, mechanism, other) and, for counts, the first number."""
    x = low(statement)
    number = F.regexp_extract(x, NUMBER, 0)
    counts = (number != "") & words.contains_any(statement, COUNTED)
    defines = words.contains_any(statement, (" is ", " are ", " was ", " were "))
    ranged = x.rlike(RANGE)
    kind = F.when(ranged, "range").when(counts, "count").when(defines, "definition").when(words.contains_any(statement, MECHANISM), "mechanism").otherwise("other")
    return F.struct(kind.alias("type"), F.when(~ranged & counts, F.replace(number, F.lit(","), F.lit("")).cast("double")).alias("value"))


def enriched(df, statement: str = "statement", url: str = "source_url", entities: str = "entities"):
    """df with domain, source, doc_type, topic, topic_confidence, fact_type and count_value; what a row already has stays, but the topic.

    Columns of these names may be missing or blank.
    """
    have = lambda x: F.when(F.coalesce(F.col(x).cast("string"), F.lit("")) != "", F.col(x)) if x in df.columns else F.lit(None).cast("string")
    c = F.col
    found = F.coalesce(urls.domain(c(url)), F.lit(""))
    rows = df.withColumns({"_found": found, "_type": fact_type(c(statement))}).withColumn("_topics", topics(c(statement), c(entities), c("_found")))
    known = have("fact_type")
    value = F.when(known.isNull(), c("_type.value"))
    return rows.withColumns({
        "domain": F.coalesce(have("domain"), c("_found")), "source": F.coalesce(have("source"), source_name(c("_found"))), "doc_type": F.coalesce(have("doc_type"), doc_type(c(url))),
        "topic": F.coalesce(F.get("_topics.topics", F.lit(0)), have("topic"), F.lit("other")), "topic_confidence": c("_topics.confidence"), "fact_type": F.coalesce(known, c("_type.type")),
        "count_value": F.coalesce(value, c("count_value")) if "count_value" in df.columns else value,
    }).drop("_found", "_type", "_topics")
