"""Which entities of a claim count, what it says of them, and queries made of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import facts, search, words
from plumbline.functions.once import once
from plumbline.functions.pages import entity_phrase

#: Entities too general to count.
GENERAL = (
    "anatomical terms", "medical terms", "health terms", "general", "unknown", "misc", "medicine", "medicines", "herbal", "sleep", "used", "aid", "effect", "effects", "study", "research", "evidence", "thing", "things",
    "factor", "factors", "element", "elements", "chemical", "chemicals", "compound", "compounds", "mineral", "minerals", "nutrient", "nutrients", "substance", "substances", "agent", "agents", "product", "products",
    "system", "process", "condition",
)
#: Verbs that are no entities.
VERBS = (
    "is", "are", "was", "were", "be", "being", "been", "use", "used", "using", "help", "helps", "support", "supports", "cause", "causes", "reduce", "improve", "prevent", "prevents", "prevented", "preventing",
    "treat", "treats", "treated", "treating", "cure", "cures", "cured", "curing", "boost", "boosts", "boosted", "boosting", "stop", "stops", "stopped", "stopping",
)
#: Nouns that name a class, and single words that say little.
BROAD = ("mineral", "minerals", "chemical", "chemicals", "nutrient", "nutrients", "compound", "compounds", "substance", "substances")
WEAK = ("adult", "adults", "human", "body", "located", "more", "than", "half", "most", "many", "some")
#: Words about a source instead of its subject.
ABOUT_SOURCES = ("study", "studies", "research", "evidence", "article", "paper", "claim", "claims", "myth", "rumor", "rumour", "opinion")
#: Where a claim's predicate stands.
SAID = r"([a-z][a-z\-]{2,}(?:\s+[a-z][a-z\-]{2,}){0,2})"
DENIED = r"\b(?:does|do|did|is|are|was|were|can|could|should|would|has|have|had|will)\s+not\s+" + SAID
STATED = r"\b(?:does|do|did|is|are|was|were|can|could|may|might|must|should|would|will|has|have|had)\b\s+" + SAID
NAMED = (
    r"\b(reduce|reduces|reduced|increase|increases|increased|cause|causes|caused|prevent|prevents|prevented|treat|treats|treated|improve|improves|improved|"
    r"control|controls|controlled|associate|associates|associated|link|links|linked)\b"
)
#: A part's subject and what is said of it.
PARTED = (
    r"(?i)^(.+?)\s+\b(?:is|are|was|were)\b\s+(.+)$",
    r"(?i)^(.+?)\s+\b(?:contribut(?:e|es|ed|ing)|help|helps|support|supports|reduce|reduces|prevent|prevents|cause|causes)\b\s+(.+)$",
)
#: Subjects that take "do", beside those that end in s.
PLURAL = ("i", "you", "we", "they", "people", "adults", "children", "supplements")
MOST_ALIASES = 3


def _none() -> Column:
    return F.array().cast("array<string>")


def entity_tokens(x: Column) -> Column:
    return F.regexp_extract_all(words.low(x), F.lit(words.ALPHA), F.lit(0))


def salient(entity: Column) -> Column:
    """No relative clause, no general word or verb, and one word at least beside those."""
    low = F.trim(words.low(entity))
    return ~words.has(low, r"\b(that|which|who|whom|whose)\b") & ~low.isin(*GENERAL, *VERBS) & F.exists(entity_tokens(low), lambda t: ~t.isin(*GENERAL, *VERBS))


def truth_entities(entities: Column) -> Column:
    """Distinct lower-case entities of two letters or more that are not about sources."""
    clean = F.transform(F.coalesce(entities, _none()), lambda e: F.trim(words.low(e)))
    return F.array_distinct(F.filter(clean, lambda e: (F.length(e) >= 2) & ~e.isin(*ABOUT_SOURCES)))


def must_have(claim: Column, entities: Column) -> Column:
    """The one entity phrase that speaks most for a claim: in its words, early, short, and specific; ties by length, then name."""
    low, listed = words.low(claim), F.coalesce(entities, _none())
    phrases = F.transform(listed, entity_phrase)

    def scored(lead: Column, candidates: Column) -> Column:
        def points(e: Column) -> Column:
            def of(t: Column) -> Column:
                distinct = F.array_distinct(t)
                single = F.size(distinct) == 1
                longer = F.exists(candidates, lambda o: (o != e) & F.array_contains(entity_tokens(o), F.get(t, F.lit(0))) & (F.size(F.array_distinct(entity_tokens(o))) > 1))
                return (
                    F.when(F.rlike(low, F.concat(F.lit(r"\b"), e, F.lit(r"\b"))), 4).otherwise(0) + F.when(F.arrays_overlap(lead, t), 2).otherwise(0) + F.when(F.size(t) == 1, 2).when(F.size(t) == 2, 1).otherwise(-1)
                    - F.when(single & F.get(t, F.lit(0)).isin(*WEAK), 4).otherwise(0) - F.when(single & longer, 3).otherwise(0) - F.when(~F.exists(t, lambda w: ~w.isin(*BROAD)), 3).otherwise(0)
                )

            return once(entity_tokens(e), of)

        rated = F.transform(F.filter(candidates, lambda e: F.size(entity_tokens(e)) > 0), lambda e: F.struct((-points(e)).alias("p"), (-F.length(e)).alias("l"), e.alias("e")))
        return F.transform(F.slice(F.array_sort(rated), 1, 1), lambda r: r["e"])

    def chosen(every: Column) -> Column:
        good = F.filter(every, salient)
        lead = once(entity_tokens(claim), lambda t: F.slice(t, 1, F.greatest(F.lit(1), F.floor(F.size(t) * 0.5).cast("int"))))
        return once(F.struct(lead.alias("lead"), F.when(F.size(good) > 0, good).otherwise(F.filter(every, lambda e: e != "")).alias("kept")), lambda s: scored(s["lead"], s["kept"]))

    return F.when(F.coalesce(claim, F.lit("")) == "", F.slice(listed, 1, 1)).otherwise(once(phrases, chosen))


def aliases(entities: Column, must: Column) -> Column:
    """The must-have phrases, then a claim's phrases that share a word with the first of them, three in all."""
    phrases = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, _none()), entity_phrase), salient))

    def extended(first: Column) -> Column:
        core = entity_tokens(F.get(first, F.lit(0)))
        more = F.filter(F.array_except(phrases(entities), first), lambda e: (F.size(core) == 0) | F.arrays_overlap(entity_tokens(e), core))
        return F.concat(first, F.slice(more, 1, F.greatest(F.lit(1), MOST_ALIASES - F.size(first))))

    return once(phrases(must), extended)


def predicate_phrase(claim: Column) -> Column:
    """What a claim says: up to three words after a denied or plain auxiliary, else a verb of effect; blank for none."""
    text = F.regexp_replace(F.trim(words.low(claim)), r"(?U)\s+", " ")
    found = lambda p: F.regexp_extract(text, p, 1)
    return F.when(found(DENIED) != "", F.concat(F.lit("not "), found(DENIED))).when(found(STATED) != "", found(STATED)).otherwise(found(NAMED))


def predicate_target(claim: Column, entities: Column, own_aliases: Column) -> Column:
    """subject, predicate and object of a claim; null where it has none of them."""
    phrases = lambda a: F.transform(F.coalesce(a, _none()), entity_phrase)
    subject = F.coalesce(F.get(F.filter(F.concat(phrases(own_aliases), phrases(entities)), salient), F.lit(0)), F.lit(""))

    def whole(s: Column) -> Column:
        within = lambda e: (F.size(entity_tokens(s)) > 0) & (F.size(entity_tokens(e)) > 0) & (F.size(F.array_except(entity_tokens(e), entity_tokens(s))) == 0)
        object_ = F.coalesce(F.get(F.filter(phrases(entities), lambda e: (e != "") & (e != s) & ~within(e)), F.lit(0)), F.lit(""))
        parts = F.struct(s.alias("subject"), predicate_phrase(claim).alias("predicate"), object_.alias("object"))
        return once(parts, lambda p: F.when((p["subject"] != "") | (p["predicate"] != "") | (p["object"] != ""), p))

    return once(subject, whole)


def part_hint(part: Column) -> Column:
    """A part's telling words without the verb that joins them; blank where either side of it has none."""
    said = F.trim(F.coalesce(part, F.lit("")))
    telling = lambda x: F.array_join(F.filter(entity_tokens(x), lambda w: ~w.isin(*words.STOP)), " ")
    sides = [(telling(F.regexp_extract(said, p, 1)), telling(F.regexp_extract(said, p, 2))) for p in PARTED]
    return F.coalesce(*[F.when((s != "") & (o != ""), F.concat_ws(" ", s, o)) for s, o in sides], F.lit(""))


def retrieval_queries(claim: Column, parts: Column, most: int = 3) -> Column:
    """The claim, then its first parts, each with its hint; distinct."""
    own = F.transform(F.slice(F.coalesce(parts, _none()), 1, most), lambda p: F.array(F.trim(F.coalesce(p, F.lit(""))), part_hint(p)))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(F.coalesce(claim, F.lit("")))), F.flatten(own)), lambda q: q != ""))


def claim_topics(claims: DataFrame) -> DataFrame:
    """(claim_id, topics, confidence) of claims with their parts: all topics of the parts in order of name, and the surest one's confidence."""
    own = F.transform("parts", lambda p: facts.topics(p, F.col("entities"), F.lit("")))
    return claims.select("claim_id", own.alias("own")).select(
        "claim_id", F.array_sort(F.array_distinct(F.flatten(F.transform("own", lambda t: t["topics"])))).alias("topics"), F.coalesce(F.array_max(F.transform("own", lambda t: t["confidence"])), F.lit(0.0)).alias("confidence"),
    )


def negation_grammar(q: Column) -> Column:
    """'do not' or 'does not' by the subject before it, once."""
    text = F.coalesce(q, F.lit(""))
    form = r"(?i)^([a-z][a-z0-9\-\s]{0,60}?)\s+do\s+not\s+([a-z].+)$"
    subject, rest = F.trim(F.regexp_extract(text, form, 1)), F.trim(F.regexp_extract(text, form, 2))
    last = F.lower(F.element_at(F.split(subject, r"\s+"), -1))
    verb = F.when(last.isin(*PLURAL) | last.endswith("s"), " do not ").otherwise(" does not ")
    x = F.when(subject != "", F.concat(subject, verb, rest)).otherwise(text)
    for twice, into in (("does\\s+not\\s+does\\s+not", "does not"), ("do\\s+not\\s+do\\s+not", "do not"), ("does\\s+not\\s+cannot", "does not"), ("do\\s+not\\s+cannot", "do not")):
        x = F.regexp_replace(x, rf"(?i)\b{twice}\b", into)
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def without_operators(q: Column) -> Column:
    """A query for a search that knows no operators: of four quotation marks or more, two quoted phrases stay, in front."""
    x = search.sanitized(q)
    for pattern, into in ((r'(?i)\bintitle:"[^"]+"\s*', ""), (r"(?i)\bfiletype:\w+\b", ""), (r"[()]", " "), (r"(?i)\bOR\b", " "), (r"(?U)\s+", " ")):
        x = F.regexp_replace(x, pattern, into)

    def front(plain: Column) -> Column:
        quoted = F.filter(F.transform(F.regexp_extract_all(plain, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
        first = once(quoted, lambda a: F.filter(a, lambda p, i: F.array_position(F.transform(a, F.lower), F.lower(p)) == i + 1))
        kept = F.array_join(F.transform(F.slice(first, 1, 2), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " ")
        rest = F.trim(F.regexp_replace(plain, '"[^"]+"', ""))
        return F.when(F.regexp_count(plain, F.lit('"')) >= 4, F.array_join(F.filter(F.array(kept, rest), lambda p: p != ""), " ")).otherwise(plain)

    return once(F.trim(x), front)


#: Words between entities, words that spoil one, and verbs that none of several words begins with.
FALLBACK_STOP = (
    "the", "a", "an", "and", "or", "but", "to", "for", "of", "in", "on", "with", "by", "at", "is", "are", "was", "were", "be", "been", "being", "over", "under", "about", "around", "average", "per", "times",
    "not", "no", "never", "do", "does", "did", "this", "that", "these", "those", "it", "its", "itself", "through", "scientifically", "supported", "support", "supports",
)
SPOILED = ("not", "no", "never", "scientifically", "supported", "support", "supports", "proven", "prove", "proves")
LEADING = ("cause", "causes", "prevent", "prevents", "treat", "treats", "cure", "cures", "boost", "boosts", "help", "helps", "support", "supports")
#: Runs of up to three words, and how many entities a claim has at most.
CHUNK, MOST_ENTITIES = r"\b([A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+){0,2})\b", 10


def _candidate(raw: Column) -> Column:
    """The entity phrase of a text, blank if it does not count."""

    def judged(e: Column) -> Column:
        tokens = entity_tokens(e)
        off = F.exists(tokens, lambda t: t.isin(*SPOILED)) | ((F.size(tokens) > 1) & F.get(tokens, F.lit(0)).isin(*LEADING))
        return F.when((e != "") & (F.size(tokens) > 0) & salient(e) & ~off, e).otherwise("")

    return once(entity_phrase(raw), judged)


def fallback_entities(claim: Column, most: int = MOST_ENTITIES) -> Column:
    """Up to ``most`` entities by rule: a claim's single words that count, then what is left of its runs of up to three words, each once."""
    stop = F.array(*[F.lit(w) for w in FALLBACK_STOP])
    telling = lambda x: F.filter(entity_tokens(x), lambda t: ~F.array_contains(stop, t))
    single = F.transform(telling(claim), lambda t: _candidate(t))
    runs = F.transform(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit("(?U)" + CHUNK), F.lit(1)), lambda p: telling(p))
    joined = F.transform(F.filter(runs, lambda t: F.size(t) >= 2), lambda t: _candidate(F.array_join(t, " ")))
    return F.slice(F.array_distinct(F.filter(F.concat(single, joined), lambda e: e != "")), 1, most)


def claim_entities(claim: Column, annotated: Column | None = None) -> Column:
    """A claim's entities: those that a model found and that count, then those by rule."""
    by_rule = fallback_entities(claim)
    if annotated is None:
        return by_rule
    told = F.filter(F.transform(F.coalesce(annotated, F.array().cast("array<string>")), lambda e: F.trim(F.lower(F.coalesce(e, F.lit(""))))), lambda e: (e != "") & salient(e))
    return F.array_distinct(F.concat(told, by_rule))
