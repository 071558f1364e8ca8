"""Search queries made of a claim's part: its phrases, anchors, and what kind of evidence it asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import search, words
from plumbline.functions.entities import entity_tokens
from plumbline.functions.once import once
from plumbline.operators.lists import ngrams

#: Words that no anchor of a part has, and those that anchors are marked down for.
NO_ANCHOR = (
    "no", "not", "cause", "causes", "caused", "causing", "through", "itself", "scientifically", "supported", "support", "claim", "claims", "reported", "reports", "update", "updated", "show", "shows", "study", "studies",
)
VAGUE = ("them", "this", "that", "those", "these", "located", "studies", "study", "shows", "show")
#: Phrases that are taken whole.
DIETARY = r"\b(?:diet|intake|consumption|levels?)\s+(?:rich in|low in|high in)\s+(?:[a-zA-Z\-]+\s*){1,4}"
CHRONIC = r"\bnoncommunicable diseases?\b"
#: What a part speaks of, and the words that its queries end in.
FIGURES = r"\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?|percent|percentage|rate|rates|statistics|prevalence|incidence)\b"
CAUSAL = r"\b(cause|causes|caused|causal|link|linked|association|associated|prevent|prevents|prevented|risk|increase|increases|decrease|decreases|reduce|reduces|cure|cures|treat|treats)\b"
ADVICE = r"\b(recommend|recommended|guideline|guidelines|should|must)\b"
DENIAL = r"\b(no|not|never|without|lack|lacks|lacking)\b"
ENDS = {
    "figures": ("statistics", "prevalence", "incidence"),
    "denied": ("systematic review", "meta-analysis", "no association"),
    "causal": ("systematic review", "meta-analysis", "causal association"),
    "advice": ("guideline", "consensus statement", "clinical recommendation"),
    "other": ("systematic review", "meta-analysis", "clinical study"),
}
#: Questions, each with the words of which a text has one of every group, or must have none of the last.
QUESTIONS = (
    ("how many bones are in adult human hands and feet", (("bones", "bone"), ("hands", "hand", "feet", "foot")), ()),
    ("how many bones are in the hands and feet", (("bones", "bone"), ("hands", "hand", "feet", "foot")), ()),
    ("how many bones does an adult human have", (("bones", "bone"), ("adult", "adults")), ()),
    ("how many bones does a human have", (("bones", "bone"),), ("adult", "adults")),
    ("how many times does the human heart beat per day", (("heart",), ("beats", "beat"), ("day", "daily")), ()),
    ("how many new cells does the human body produce per second", (("cells", "cell"), ("second", "seconds")), ()),
    ("are tongue prints unique", (("tongue",), ("print", "prints")), ()),
    ("unique tongue prints individuals", (("tongue",), ("print", "prints")), ()),
)
FIRST_SITE = "site:pubmed.ncbi.nlm.nih.gov"
DIGIT = r"\d"


def _none() -> Column:
    return F.array().cast("array<string>")


def _lit(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _folded(x: Column) -> Column:
    return F.array_join(entity_tokens(x), " ")


def _quoted(a: Column) -> Column:
    return F.when(F.contains(a, F.lit(" ")), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)


def ends(part: Column) -> Column:
    """The three words or phrases that a part's queries end in."""
    causal = words.has(part, CAUSAL)
    return (
        F.when(words.has(part, FIGURES), _lit(ENDS["figures"])).when(causal & words.has(part, DENIAL), _lit(ENDS["denied"])).when(causal, _lit(ENDS["causal"]))
        .when(words.has(part, ADVICE), _lit(ENDS["advice"])).otherwise(_lit(ENDS["other"]))
    )


def phrases(text: Column, entities: Column | None = None, most: int = 4) -> Column:
    """Phrases on diets and chronic diseases, entities of two words or more, then pairs of telling words of eight letters or more."""
    low = words.low(text)
    tail = "(?: (?:" + "|".join(search.ACTION) + "))+$"
    diets = F.filter(F.transform(F.regexp_extract_all(low, F.lit(DIETARY), F.lit(0)), lambda p: F.regexp_replace(_folded(p), tail, "")), lambda p: F.size(F.split(p, " ")) >= 3)
    chronic = F.transform(F.regexp_extract_all(low, F.lit(CHRONIC), F.lit(0)), _folded)
    named = _none() if entities is None else F.filter(F.transform(F.coalesce(entities, _none()), _folded), lambda e: F.contains(e, F.lit(" ")))
    telling = F.filter(entity_tokens(text), lambda t: ~t.isin(*search.NO_KEY, *search.ACTION))
    pairs = once(telling, lambda t: F.filter(ngrams(t, 2), lambda p: F.length(p) >= 8))
    return F.slice(F.array_distinct(F.concat(diets, chronic, named, pairs)), 1, most)


def numbers(x: Column) -> Column:
    return F.array_distinct(words.found(x, search.NUMBER))


def part_anchors(part: Column, entities: Column | None = None, most: int = 10) -> Column:
    """Phrases of a part, entities that share a word with it, its words by count and length, and its numbers."""
    own = F.filter(entity_tokens(part), lambda t: ~t.isin(*search.NO_KEY, *search.ACTION, *search.JUNK, *NO_ANCHOR))

    def all_of(t: Column) -> Column:
        counted = F.transform(F.array_distinct(t), lambda w: F.struct((-F.size(F.filter(t, lambda x: x == w))).alias("n"), (-F.length(w)).alias("l"), w.alias("w")))
        single = F.transform(F.slice(F.array_sort(counted), 1, 8), lambda r: r["w"])
        telling = lambda e: F.filter(entity_tokens(e), lambda w: ~w.isin(*search.NO_KEY, *search.JUNK, *NO_ANCHOR))
        named = _none() if entities is None else F.transform(F.filter(F.transform(F.coalesce(entities, _none()), telling), lambda e: F.arrays_overlap(e, t)), lambda e: F.array_join(e, " "))
        said = F.filter(F.transform(F.concat(phrases(part), named, single), _folded), lambda a: (a != "") & ~F.arrays_overlap(entity_tokens(a), _lit(NO_ANCHOR)))
        return F.slice(F.array_distinct(F.concat(said, numbers(part))), 1, most)

    return once(own, all_of)


def direct_query(text: Column, entities: Column) -> Column:
    """A text's numbers, then its telling words by count, length and whether an entity has them; eight terms."""
    own = F.filter(entity_tokens(text), lambda t: ~t.isin(*search.NO_KEY, *search.ACTION, *search.JUNK))
    named = entity_tokens(F.array_join(F.coalesce(entities, _none()), " "))

    def ranked(t: Column) -> Column:
        score = lambda w: 2.0 * F.size(F.filter(t, lambda x: x == w)) + F.least(F.lit(1.0), F.length(w) / 8.0) + F.when(F.array_contains(named, w), 1.0).otherwise(0.0)
        return F.transform(F.array_sort(F.transform(F.array_distinct(t), lambda w: F.struct((-score(w)).alias("s"), w.alias("w")))), lambda r: r["w"])

    terms = F.concat(F.slice(numbers(text), 1, 3), F.slice(search.key_numbers(text), 1, 3), once(own, ranked))
    return F.array_join(F.slice(F.array_distinct(terms), 1, 8), " ")


def _kinds(anchors: Column) -> tuple[Column, Column, Column]:
    """Phrases, single words, and anchors with digits."""
    digit = lambda a: F.rlike(a, F.lit(DIGIT))
    spaced = lambda a: F.contains(a, F.lit(" "))
    return F.filter(anchors, lambda a: spaced(a) & ~digit(a)), F.filter(anchors, lambda a: ~spaced(a) & ~digit(a)), F.filter(anchors, digit)


def _asked(queries: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(queries, search.sanitized), lambda q: q != ""))


def anchor_queries(part: Column, entities: Column) -> Column:
    """A part's best anchors with each of its ends, and once more at the first site."""

    def score(a: Column) -> Column:
        return F.when(F.rlike(a, F.lit(DIGIT)), 4.0).otherwise(0.0) + F.when(F.contains(a, F.lit(" ")), 1.2).otherwise(0.0) + F.least(F.lit(2.0), F.length(a) / 6.0) - F.when(a.isin(*VAGUE), 2.0).otherwise(0.0)

    def core(ranked: Column) -> Column:
        whole, single, counted = _kinds(ranked)
        best = F.slice(whole, 1, 2)
        held = F.flatten(F.transform(best, entity_tokens))
        first = F.concat(F.transform(best, _quoted), F.filter(F.slice(single, 1, 3), lambda t: ~F.array_contains(held, t)), F.slice(counted, 1, 2))
        return once(first, lambda f: F.when(F.size(f) < 2, F.slice(F.array_distinct(F.concat(f, F.transform(ranked, _quoted))), 1, 2)).otherwise(f))

    def made(terms: Column) -> Column:
        text = F.array_join(terms, " ")
        own = F.transform(ends(part), lambda e: F.concat_ws(" ", text, e))
        return F.when(F.size(terms) > 0, _asked(F.concat(own, F.array(F.concat_ws(" ", F.lit(FIRST_SITE), text, F.get(ends(part), F.lit(0))))))).otherwise(_none())

    rated = F.transform(F.array_sort(F.transform(part_anchors(part, entities), lambda a: F.struct((-score(a)).alias("s"), a.alias("a")))), lambda r: r["a"])
    return once(once(rated, core), made)


def plain_queries(text: Column) -> Column:
    """Two queries of a text's first phrases, words and number with the first two of its ends."""

    def made(anchors: Column) -> Column:
        whole, single, counted = _kinds(anchors)
        core = F.array_join(F.slice(F.concat(F.transform(F.slice(whole, 1, 2), _quoted), F.slice(single, 1, 3), F.slice(counted, 1, 1)), 1, 6), " ")
        return F.when(core != "", _asked(F.transform(F.slice(ends(text), 1, 2), lambda e: F.concat_ws(" ", core, e)))).otherwise(_none())

    return once(part_anchors(text), made)


def question_queries(text: Column) -> Column:
    """Questions on bones, heartbeats, cells and tongue prints where a text speaks of them."""

    def asked(own: Column) -> Column:
        each = []
        for question, groups, none_of in QUESTIONS:
            fits = ~F.arrays_overlap(own, _lit(none_of)) if none_of else F.lit(True)
            for group in groups:
                fits = fits & F.arrays_overlap(own, _lit(group))
            each.append(F.when(fits, F.lit(question)))
        return F.filter(F.array(*each), lambda q: q.isNotNull())

    return once(entity_tokens(text), asked)


#: How a part begins that goes on with the one before, and words that let it stand by itself.
GOES_ON = r"(?i)^\s*(?:and|or|but|however|although|while)\s+"
MEDICAL = ("flu", "influenza", "autism", "vaccine", "vaccines", "antibiotic", "antibiotics", "virus", "viruses", "sugar", "hyperactivity", "adhd", "cholesterol", "heart")
#: Fixed value: a denied effect, the object of which may change.
DENIED_EFFECT = r"(?i)^(.+?\b(?:do|does|did|can|could|may|might|must|should|would|will)?\s*not\s+(?:cause|cure|treat|prevent|trigger))\s+.+$"
LONG_FRAGMENT = 4


def _bare(x: Column) -> Column:
    """Single spaces, and no spaces, commas or full stops around."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ ,.]+|[ ,.]+$", "")


def merged_parts(parts: Column) -> Column:
    """Parts of a claim, where one that begins with a conjunction takes over the denied effect before it, or joins the part before it if it is short and names nothing medical."""

    def step(held: Column, raw: Column) -> Column:
        part = F.trim(F.coalesce(raw, F.lit("")))
        last = F.coalesce(F.get(held, F.size(held) - 1), F.lit(""))
        fragment = F.regexp_replace(part, GOES_ON, "")
        effect = F.regexp_extract(_bare(last), DENIED_EFFECT, 1)
        own = F.filter(entity_tokens(fragment), lambda t: ~t.isin(*search.NO_KEY))
        joins = (F.size(own) <= LONG_FRAGMENT) & ~F.exists(own, lambda t: t.isin(*MEDICAL))
        joined = F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.concat(F.regexp_replace(last, "[, ]+$", ""), F.lit(" "), part)))
        goes_on = F.rlike(part, F.lit(r"(?i)^(?:and|or|but|however|although|while) ")) & (F.size(held) > 0)
        return (
            F.when(part == "", held).when(~goes_on, F.concat(held, F.array(part))).when((effect != "") & (_bare(fragment) != ""), F.concat(held, F.array(_bare(F.concat(effect, F.lit(" "), _bare(fragment))))))
            .when(joins, joined).otherwise(F.concat(held, F.array(part)))
        )

    return F.aggregate(F.coalesce(parts, _none()), _none(), step)


#: Kinds of evidence that a query names as its text does, the first one else; and what texts on some do not ask for.
KINDS = ("statistics", "prevalence", "incidence", "guideline", "systematic review", "meta-analysis")
EXCLUDED = (("adult", ("-fetal", "-pediatric")), ("human", ("-veterinary",)))


def variants(phrase: Column) -> Column:
    """A phrase, a single word's other number, and its form without hyphens."""
    x = _folded(phrase)
    other = F.when(F.contains(x, F.lit(" ")), x).when(~x.endswith("s"), F.concat(x, F.lit("s"))).when(F.length(x) > 3, F.left(x, F.length(x) - 1)).otherwise(x)
    return F.when(x != "", F.array_distinct(F.array(x, other, F.replace(x, F.lit("-"), F.lit(" "))))).otherwise(_none())


def research_query(text: Column, entities: Column) -> Column:
    """Variants of a text's first phrase, its phrases and numbers, a kind of evidence, and what is not asked for."""
    quoted = lambda a: F.transform(a, lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    low = words.low(text)
    kind = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KINDS], F.lit(KINDS[0]))
    out = F.slice(F.concat(*[F.when(F.contains(low, F.lit(w)), _lit(marks)).otherwise(_none()) for w, marks in EXCLUDED]), 1, 2)

    def made(said: Column) -> Column:
        block = once(F.when(F.size(said) > 0, variants(F.get(said, F.lit(0)))), lambda v: F.when(F.size(v) > 1, F.array(F.concat(F.lit("("), F.array_join(quoted(v), " OR "), F.lit(")")))).otherwise(_none()))
        return F.array_join(F.concat(block, quoted(F.slice(said, 1, 2)), F.slice(numbers(text), 1, 2), F.array(kind), out), " ")

    return once(phrases(text, entities), made)


def operator_queries(text: Column, entities: Column) -> Column:
    """The research query, as papers have it, and for titles of meta-analyses."""
    return once(research_query(text, entities), lambda q: F.array(q, F.concat(q, F.lit(" filetype:pdf")), F.concat(F.lit('intitle:"meta-analysis" '), q)))
