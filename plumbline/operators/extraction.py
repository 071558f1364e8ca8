"""Facts out of page texts without a model, and triples matched with the facts that they come from.

Sentences are exploded once; everything after is column arithmetic on narrow
rows, keyed by claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text, words
from plumbline.functions.words import has, low
from plumbline.operators.alignment import strong_anchor
from plumbline.operators.ingest import NEGATION
from plumbline.session import by_value, written

#: Hedging, and hearsay, which no grounded statement has.
HEDGED = r"\bmay\b|\bmight\b|\bcould\b|\bpossible\b|\bpossibly\b|\bpotentially\b|\blikely\b|\bunlikely\b|\bsuggest(?:s|ed|ing)?\b|\bappear(?:s|ed|ing)?\b|\bindicate(?:s|d)?\b|\bhypothes(?:is|ized|es)\b"
HEARSAY = r"\b(some people|many people)\s+(say|claim|believe)\b|\bit is believed\b|\brumou?r\b|\bconspiracy\b|\bopinion\b"
#: Families of predicates.
FAMILIES = (
    ("improve_reduce", r"\b(reduc|lower|decreas|alleviat|improv|help|benefit|reliev)\w*\b"),
    ("increase_cause", r"\b(increas|worsen|exacerbat|aggravat|trigger|cause)\w*\b"),
    ("treat_prevent", r"\b(treat|cure|prevent|protect|work|effective|effic)\w*\b"),
    ("associate", r"\b(associat|link|correlat|relat)\w*\b"),
)
#: Negation in sentences of pages.
NEGATED = r"\b(?:no|not|never|none|without|cannot|can't|does not|do not|did not|is not|are not|was not|were not|doesn't|don't|didn't|isn't|aren't|wasn't|weren't|lack|lacks|lacking)\b"
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
#: Marks of causal relations, and what their denial is called.
CAUSAL_MARKS = ("cause", "causing", "contribut", "induc", "trigger", "result in", "results in", "resulted in", "lead to", "leads to", "led to", "associate", "association", "link", "increase risk", "increases risk")
DENIALS = (("cause", "does_not_cause"), ("contribut", "does_not_cause"), ("lead to", "does_not_cause"), ("result in", "does_not_cause"), ("associat", "not_associated_with"), ("link", "not_linked_to"), ("increase risk", "does_not_increase_risk_of"))


def content_chunks(x: Column, size: int, most: int) -> Column:
    """Pieces of ``size`` characters, each beginning a little before the last one's end; a short text is one piece, a blank one none."""
    whole = F.trim(F.coalesce(x, F.lit("")))
    step = size - min(240, size // 6)
    count = F.least(F.lit(most), F.ceil((F.length(whole) - size) / step).cast("int") + 1)
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    pieces = F.filter(F.transform(starts, lambda i: F.trim(F.substr(whole, i * step + 1, F.lit(size)))), lambda p: p != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= size, F.array(whole)).otherwise(pieces)


def grounded(x: Column) -> Column:
    """Ten letters at least, no question, no hedging, no hearsay."""
    return (F.length(F.trim(F.coalesce(x, F.lit("")))) >= 10) & ~low(x).contains("?") & ~has(x, HEDGED) & ~has(x, HEARSAY)


def atomic_parts(x: Column) -> Column:
    """A statement's parts: between semicolons, else at 'and' where there are two numbers or more."""
    whole = F.trim(F.coalesce(x, F.lit("")))
    clean = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    semi = clean(F.split(whole, ";"))
    numbers = F.regexp_count(whole, F.lit(NUMBER))
    split = (numbers >= 2) & low(whole).contains(" and ") & ~low(whole).contains("hands and feet")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(semi) > 1, semi).when(split, clean(F.split(whole, r"(?iU)\band\b"))).otherwise(F.array(whole))


def atomic_facts(df: DataFrame) -> DataFrame:
    """Facts (statement, source_url, ..) cut to atomic ones of ten letters or more, without page furniture, with their fact_id."""
    parts = df.withColumn("statement", F.explode(atomic_parts(text.clean_statement(F.col("statement")))))
    kept = parts.filter((F.length("statement") >= 10) & ~words.contains_any(F.col("statement"), words.LOW_SIGNAL))
    return kept.withColumn("statement", text.clean_statement(F.col("statement"))).withColumn("fact_id", text.fact_id(F.col("statement"), F.col("source_url")))


def families(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(x, pattern), name) for name, pattern in FAMILIES]))


def _names(a: Column) -> Column:
    return words.token_set(F.array_join(F.coalesce(a, F.array().cast("array<string>")), " \n "), words.ALPHA, words.STOP)


def claim_profile(claims: DataFrame) -> DataFrame:
    """claims (claim_id, claim, entities, must_have) to what sentences are measured by."""
    c = F.col
    return claims.select(
        "claim_id", "claim", "entities", "must_have", words.token_set(c("claim"), words.ALPHA, words.STOP).alias("claim_tokens"), _names(c("entities")).alias("entity_tokens"), _names(c("must_have")).alias("must_tokens"),
        families(c("claim")).alias("claim_families"), has(c("claim"), NEGATED).alias("claim_negated"),
    )


def sentence_facts(pages: DataFrame, claims: DataFrame, most: int = 280) -> DataFrame:
    """Grounded sentences of pages (claim_id, url, content) that speak of their claim, as facts with confidence and stance.

    Of each page the first ``most`` sentences are looked at, as the feature has
    it. A sentence needs a word, an entity or a kind of predicate of the claim.
    """
    c = F.col
    listed = F.slice(F.transform(text.sentences(c("content")), text.clean_statement), 1, most)
    rows = pages.select("claim_id", "url", F.posexplode(listed).alias("place", "statement")).filter(grounded(c("statement")))
    d = rows.join(claim_profile(claims), "claim_id").withColumn("tokens", words.token_set(c("statement"), words.ALPHA, words.STOP))
    asked = F.when(F.size("must_tokens") > 0, c("must_tokens")).otherwise(c("entity_tokens"))
    d = d.withColumns({"lexical": words.shared(c("tokens"), c("claim_tokens")), "named": words.shared(c("tokens"), asked), "same_family": F.arrays_overlap(families(c("statement")), "claim_families"), "n_asked": F.size(asked)})
    d = d.filter((F.size("tokens") > 0) & ((c("lexical") > 0) | (c("named") > 0) | c("same_family")) & ~((F.size("must_tokens") > 0) & (c("named") == 0) & (c("lexical") < 2)))
    score = 0.50 * F.least(F.lit(1.0), c("lexical") / F.greatest(F.lit(1), F.size("claim_tokens"))) + 0.30 * F.least(F.lit(1.0), c("named") / F.greatest(F.lit(1), c("n_asked"))) + 0.20 * c("same_family").cast("double")
    d = d.withColumn("score", F.round(score, 9)).filter("score >= 0.16").withColumn("negated", has(c("statement"), NEGATED))
    stance = F.when(c("claim_negated") != c("negated"), "REFUTES").when(~c("negated") & (c("score") >= 0.35), "SUPPORTS").otherwise("NEUTRAL")
    sure = F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.90), 0.55 + 0.35 * c("score"))), 3)
    return d.select("claim_id", "url", "place", "statement", "score", sure.alias("confidence"), stance.alias("stance"), text.fact_id(c("statement"), c("url")).alias("fact_id"))


def admissible_facts(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Facts (claim_id, statement, ..) that name an entity of their claim and share its words and kind of predicate.

    A claim none of whose facts passes keeps those that share two words with it
    and name what it must have.
    """
    c = F.col
    d = facts.join(claim_profile(claims), "claim_id").withColumn("_t", words.token_set(c("statement"), words.ALPHA, words.STOP)).filter(F.size("_t") > 0)
    must, entity = F.arrays_overlap("_t", "must_tokens"), F.arrays_overlap("_t", "entity_tokens")
    common = words.shared(c("_t"), c("claim_tokens"))
    named = F.when(F.size("must_tokens") > 0, must | strong_anchor(c("_t"), c("must_have"))).when(F.size("entity_tokens") > 0, entity | strong_anchor(c("_t"), c("entities"))).otherwise(True)
    spoken = (F.size("claim_tokens") == 0) | (common > 0)
    kind = (F.size("claim_families") == 0) | F.arrays_overlap(families(c("statement")), "claim_families") | ((must | entity) & (common >= 2))
    fallback = ((F.size("must_tokens") == 0) | must) & ((F.size("claim_tokens") == 0) | (common >= 2))
    d = d.withColumns({"_in": named & spoken & kind, "_back": fallback}).withColumn("_any", F.max("_in").over(Window.partitionBy("claim_id")))
    return d.filter(F.when(c("_any"), c("_in")).otherwise(c("_back"))).select(*facts.columns)


def triple_alignment(s: Column, r: Column, o: Column, own: Column) -> Column:
    """How much of a triple's words (of subject, relation and object) a statement's words hold, 0 to 1."""
    ends = F.array_union(s, o)
    share = lambda t: F.when(F.size(t) > 0, words.shared(own, t) / F.size(t)).otherwise(0.0)
    whole = lambda t: F.when((F.size(t) > 0) & (words.shared(own, t) >= F.greatest(F.lit(1), F.when(F.size(t) == 1, 1).otherwise(F.size(t) - 1))), 0.12).otherwise(0.0)
    x = F.least(F.lit(1.0), 0.75 * share(ends) + 0.25 * share(r) + whole(s) + whole(o))
    return F.round(F.when((F.size(own) == 0) | ((F.size(ends) == 0) & (F.size(r) == 0)), 0.0).otherwise(x), 9)


def resolved_triples(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """triples (batch, triple_id, fact_index, subject, relation, object) with the fact of their batch that they come from.

    The given index stays if its fact has 0.35 of the triple; else the best fact
    takes it, with 0.45 at least (ties: the first); else it is -1. facts: batch,
    fact_index, statement; a batch is one answer's handful.
    """
    c = F.col
    of = lambda x: words.token_set(c(x), words.ALPHA, words.STOP)
    texts = ["subject", "relation", "object", "statement"]
    aligned = lambda rows: written(rows.select("*", of("subject").alias("_s"), of("relation").alias("_r"), of("object").alias("_o"), of("statement").alias("_t"))).select(*texts, triple_alignment(c("_s"), c("_r"), c("_o"), c("_t")).alias("_a"))
    pairs = triples.select("batch", "triple_id", "fact_index", *texts[:3]).join(facts.select("batch", c("fact_index").alias("_i"), "statement"), "batch")
    pairs = by_value(pairs, texts, aligned)
    best = pairs.groupBy("batch", "triple_id").agg(F.max(F.when(c("_i") == c("fact_index"), c("_a"))).alias("given"), F.max(F.when(c("_a") > 0, F.struct("_a", (-c("_i")).alias("n")))).alias("best"))
    best = best.select("batch", "triple_id", "given", c("best._a").alias("top"), (-c("best.n")).alias("top_index"))
    index = F.when(F.coalesce("given", F.lit(0.0)) >= 0.35, c("fact_index")).when(F.coalesce("top", F.lit(0.0)) >= 0.45, c("top_index")).otherwise(-1)
    return triples.join(best, ["batch", "triple_id"], "left").withColumn("resolved", index).drop("given", "top", "top_index")


def negation_guard(statement: Column, relation: Column) -> Column:
    """The relation, its denial where it is causal and the statement denies it, or null where that has no name."""
    rel = F.trim(F.regexp_replace(F.lower(F.trim(F.replace(F.coalesce(relation, F.lit("")), F.lit("_"), F.lit(" ")))), r"\s+", " "))
    causal, denied = F.lit(False), F.lit(False)
    for mark in CAUSAL_MARKS:
        causal = causal | rel.contains(mark)
    for pattern in NEGATION:
        denied = denied | low(statement).rlike(pattern)
    name = F.when(F.lit(False), "")
    for mark, of in DENIALS:
        name = name.when(rel.contains(mark), of)
    return F.when(causal & denied, name).otherwise(relation)


def claim_aligned(subject: Column, relation: Column, obj: Column, statement: Column, profile_claim: Column, claim_tokens: Column, entities: Column, entity_tokens: Column, must_have: Column, must_tokens: Column, claim_families: Column) -> Column:
    """A triple and its statement name what the claim must have, or one of its entities, share a word with it, and a kind of predicate or two words."""
    own = words.token_set(F.concat_ws(" ", subject, relation, obj, statement), words.ALPHA, words.STOP)
    must = F.arrays_overlap(own, must_tokens) | strong_anchor(own, must_have)
    entity = F.arrays_overlap(own, entity_tokens) | strong_anchor(own, entities)
    named = F.when(F.size(must_tokens) > 0, must).when(F.size(entity_tokens) > 0, entity).otherwise(True)
    common = words.shared(own, claim_tokens)
    kind = families(F.concat_ws(" ", relation, statement))
    fits = (F.size(claim_families) == 0) | (F.size(kind) == 0) | F.arrays_overlap(claim_families, kind) | (common >= 2)
    asked_nothing = (F.coalesce(profile_claim, F.lit("")) == "") & (F.size(entity_tokens) == 0) & (F.size(must_tokens) == 0)
    return asked_nothing | ((F.size(own) > 0) & named & ((F.size(claim_tokens) == 0) | (common > 0)) & fits)


#: Words left out where a statement is looked for in its source.
GROUND_STOP = (*words.STOP, "that", "this", "these", "those", "as", "from", "it", "its", "their")
GROUND_TOKEN = r"\b[a-z][a-z0-9_-]{2,}\b"


def best_sentence(statement: Column, source: Column, most: int = 250) -> Column:
    """A struct: the sentence of a source that holds most of a statement's words, and its score; '' and 0 for none.

    0.75 of the share of the statement's words, 0.25 of the sentence's, and more
    where the statement's first words are there. Ties go to the earlier sentence.
    """
    from plumbline.functions.once import once

    own = words.token_set(statement, GROUND_TOKEN, GROUND_STOP)
    listed = F.slice(F.transform(text.sentences(source), text.clean_statement), 1, most)

    def of(w: Column) -> Column:
        def scored(x: Column, i: Column) -> Column:
            def score(t: Column) -> Column:
                common = words.shared(w, t)
                lead = F.when(F.array_contains(t, F.coalesce(F.get(w, F.lit(0)), F.lit(""))), 0.20).otherwise(0.0) + F.when(F.array_contains(t, F.coalesce(F.get(w, F.lit(1)), F.lit(""))), 0.10).otherwise(0.0)
                return F.when(common > 0, F.round(0.75 * common / F.size(w) + 0.25 * common / F.size(t) + lead, 9)).otherwise(0.0)

            return F.struct(once(words.token_set(x, GROUND_TOKEN, GROUND_STOP), score).alias("score"), (-i).alias("i"), x.alias("sentence"))

        return F.array_max(F.transform(listed, scored))

    best = once(own, of)
    hit = (F.size(own) > 0) & (best["score"] > 0)
    return F.struct(F.when(hit, best["sentence"]).otherwise("").alias("sentence"), F.when(hit, best["score"]).otherwise(0.0).alias("score"))


def grounded_statement(statement: Column, source: Column) -> Column:
    """The cleaned statement, or its closest source sentence where that says the opposite or nearly the same."""
    clean = text.clean_statement(statement)
    best = best_sentence(clean, source)
    opposite = (has(clean, NEGATED) != has(best["sentence"], NEGATED)) & (best["score"] >= 0.55)
    return F.when((best["score"] >= 0.40) & (opposite | (best["score"] >= 0.88)), best["sentence"]).otherwise(clean)
