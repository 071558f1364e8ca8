"""What vector and graph search give for a claim: anchors, boosts, gates, and the join of entities with the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import domains, words
from plumbline.functions.policy import GENERIC
from plumbline.functions.scoring import clamp01
from plumbline.operators.ingest import relation_label, relation_type
from plumbline.session import cut

#: Claim words that say little about the claim.
GENERIC_CLAIM = ("health", "healthy", "immune", "immunity", "vitamin", "supplement", "supplements", "support", "function", "benefit", "benefits", "effect", "effects")
#: Page furniture in vector matches.
FURNITURE = ("data element definitions", "registration or results information", "javascript and cookies", "requires human verification")
#: The least score of a vector match, that of one that fills up, and how many rows are wanted.
MIN_SCORE, FILL_SCORE, WANTED = 0.28, 0.20, 5


def _texts(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def context_hash(claim: Column) -> Column:
    """What names a claim's own facts: 16 hex digits of the SHA-1 of its folded text; blank for no text."""
    folded = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(claim, F.lit("")))), r"(?U)\s+", " "))
    return F.when(folded == "", "").otherwise(F.substring(F.sha1(folded), 1, 16))


def tokens_of(texts: Column) -> Column:
    return words.token_set(F.array_join(_texts(texts), " \n "), words.ALPHA, words.STOP)


def usable_anchors(anchors: Column) -> Column:
    """Distinct lower-case anchors without those of one word that is generic, or part of a longer anchor; all, if none is left."""
    clean = F.filter(F.array_distinct(F.transform(_texts(anchors), lambda a: F.lower(F.trim(F.coalesce(a, F.lit("")))))), lambda a: a != "")
    with_words = F.transform(clean, lambda a: F.struct(a.alias("a"), words.token_set(a, words.ALPHA, words.STOP).alias("t")))

    def kept(every: Column) -> Column:
        def stays(x: Column) -> Column:
            word = F.get(x["t"], F.lit(0))
            longer = F.exists(every, lambda y: (F.size(y["t"]) > 1) & F.array_contains(y["t"], F.coalesce(word, F.lit(""))))
            single = (F.size(x["t"]) == 1) & (longer | (word.isin(*GENERIC) & (F.size(every) > 1)))
            return (F.size(x["t"]) > 0) & ~single

        return F.transform(F.filter(every, stays), lambda x: x["a"])

    left = F.transform(F.array(with_words), kept)[0]
    return F.when(F.size(left) > 0, left).otherwise(clean)


def strong_anchor(tokens: Column, anchors: Column) -> Column:
    """The tokens hold all words but one of an anchor, and one at least; a single generic word does not count."""

    def met(anchor: Column) -> Column:
        n = lambda t: F.size(t)
        enough = lambda t: (n(t) > 0) & ~((n(t) == 1) & F.get(t, F.lit(0)).isin(*GENERIC)) & (words.shared(tokens, t) >= F.greatest(F.lit(1), n(t) - 1))
        return F.transform(F.array(words.token_set(anchor, words.ALPHA, words.STOP)), enough)[0]

    return F.exists(_texts(anchors), met)


def claim_context(claims: DataFrame) -> DataFrame:
    """(claim_id, claim, anchors) to what matches are measured by."""
    c = F.col
    rows = claims.select("claim_id", "claim", usable_anchors(c("anchors")).alias("usable"), words.token_set(c("claim"), words.ALPHA, words.STOP).alias("claim_tokens"), context_hash(c("claim")).alias("claim_hash"))
    specific = F.filter("claim_tokens", lambda t: ~t.isin(*GENERIC_CLAIM))
    return rows.withColumns({"anchor_tokens": tokens_of(c("usable")), "specific": specific})


def meets_claim(tokens: Column, anchors: Column, claim_tokens: Column) -> Column:
    """A candidate's tokens hold an anchor, or a claim word that is specific, or any if the claim has no specific one."""
    specific = F.filter(claim_tokens, lambda t: ~t.isin(*GENERIC_CLAIM))
    by_word = F.when(F.size(specific) > 0, F.arrays_overlap(tokens, specific)).otherwise(F.arrays_overlap(tokens, claim_tokens))
    return (F.size(tokens) > 0) & (strong_anchor(tokens, anchors) | F.coalesce(by_word, F.lit(False)))


def allowed(vectors: DataFrame, topics: Column, language: Column) -> Column:
    """Whether a stored vector (topic, language, claim_context_hash) is searched for a claim: its topic is asked for or 'other', its language and claim fit."""
    fits = (F.size(_texts(topics)) == 0) | F.array_contains(F.concat(_texts(topics), F.array(F.lit("other"))), F.col("topic"))
    return fits & (F.coalesce(language, F.lit("")).isin("") | (F.col("language") == language))


def with_retry(matches: DataFrame, fallback: DataFrame) -> DataFrame:
    """Matches by claim, and for claims that have none those of the wider search."""
    return matches.unionByName(fallback.join(matches.select("claim_id").distinct(), "claim_id", "left_anti"))


def aligned_matches(matches: DataFrame, claims: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Vector matches lifted by what they share with the claim, without those that share nothing.

    matches: claim_id, score, statement, entities, context_entities,
    context_hash, stance. A claim with fewer than WANTED rows is filled up with
    the best of those a little below ``least``.
    """
    c = F.col
    d = matches.join(claim_context(claims), "claim_id")
    d = d.withColumn("tokens", words.token_set(F.concat_ws(" \n ", "statement", F.array_join(_texts(c("entities")), " \n "), F.array_join(F.slice(_texts(c("context_entities")), 1, 20), " \n ")), words.ALPHA, words.STOP))
    d = d.withColumns({
        "anchor_overlap": words.shared(c("tokens"), c("anchor_tokens")), "claim_overlap": words.shared(c("tokens"), c("claim_tokens")), "specific_overlap": words.shared(c("tokens"), c("specific")),
        "same_claim": (c("claim_hash") != "") & (F.lower(F.trim(F.coalesce("context_hash", F.lit("")))) == c("claim_hash")), "raw": F.coalesce("score", F.lit(0.0)),
    })
    directed = F.upper(F.trim(F.coalesce("stance", F.lit("")))).isin("SUPPORTS", "REFUTES")
    boost = F.when(c("same_claim"), F.when(directed, 0.20).otherwise(0.12)).otherwise(0.0) + F.least(F.lit(0.10), 0.02 * c("anchor_overlap")) + F.least(F.lit(0.06), 0.01 * c("claim_overlap"))
    asked = (F.size("anchor_tokens") > 0) | (F.size("claim_tokens") > 0) | (c("claim_hash") != "")
    fits = c("same_claim") | strong_anchor(c("tokens"), c("usable")) | (c("specific_overlap") > 0) | (c("anchor_overlap") >= 2) | ((F.size("specific") == 0) & (c("claim_overlap") >= 2))
    off = asked & ~fits & (c("raw") < max(least + 0.10, 0.45))
    d = d.filter(~off).withColumns({"boost": F.round(boost, 9), "aligned": F.round(F.least(F.lit(1.0), c("raw") + boost), 9)})
    d = d.withColumn("strict", (c("aligned") >= least) & (F.coalesce("statement", F.lit("")) != "") & ~words.contains_any(c("statement"), FURNITURE))
    own = Window.partitionBy("claim_id")
    low = (c("aligned") < least) & (c("aligned") >= FILL_SCORE)
    d = d.withColumns({"_kept": F.count_if("strict").over(own), "_turn": F.row_number().over(own.orderBy(low.desc(), c("aligned").desc(), "statement", "match_id"))})
    fills = low & (c("_turn") <= WANTED - c("_kept")) & (F.coalesce("statement", F.lit("")) != "") & ~words.contains_any(c("statement"), ("javascript and cookies", "human verification"))
    d = d.filter(c("strict") | fills)
    return d.withColumn("rank", F.row_number().over(own.orderBy(c("aligned").desc(), "statement", "match_id"))).drop("_kept", "_turn")


def role_alignment(subject: Column, obj: Column, anchors: Column) -> Column:
    """0.6 of the subject's and 0.4 of the object's best share of an anchor's words; 1 without anchors."""
    s, o = words.token_set(subject, words.ALPHA, words.STOP), words.token_set(obj, words.ALPHA, words.STOP)
    sets = F.filter(F.transform(_texts(anchors), lambda a: words.token_set(a, words.ALPHA, words.STOP)), lambda t: F.size(t) > 0)
    best = lambda own: F.coalesce(F.array_max(F.transform(sets, lambda t: words.shared(own, t) / F.size(t))), F.lit(0.0))
    return F.when(F.size(sets) == 0, 1.0).when((F.size(s) == 0) & (F.size(o) == 0), F.when(F.size(_texts(anchors)) == 0, 1.0).otherwise(0.0)).otherwise(clamp01(0.60 * best(s) + 0.40 * best(o)))


def named_entities(names: DataFrame, asked: DataFrame, gram: int = 4) -> DataFrame:
    """(claim_id, name): names (name) that equal an asked entity (claim_id, entity) or, if it has more than three letters, contain it.

    Containment is found through the entity's first ``gram`` letters, which the
    name must have somewhere: an equi-join on short strings, then the exact test.
    """
    lower = names.select("name", F.lower("name").alias("n")).distinct()
    want = asked.select("claim_id", F.lower("entity").alias("e")).distinct()
    equal = want.join(lower, F.col("e") == F.col("n")).select("claim_id", "name")
    grams = lower.filter(F.length("n") >= gram).select("name", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - gram + 1), lambda i: F.substr(F.col("n"), i, F.lit(gram))))).alias("g"))
    inside = want.filter(F.length("e") >= gram).withColumn("g", F.substring("e", 1, gram)).join(grams, "g").filter(F.contains("n", "e")).select("claim_id", "name")
    return equal.union(inside).distinct()


def graph_paths(relations: DataFrame, sources: DataFrame, asked: DataFrame) -> DataFrame:
    """One- and two-hop paths at whose either end an asked entity stands, with a source if there is one.

    relations: rid, subject, relation, object, confidence. sources: rid,
    source_url; of several the first by name. A two-hop path has the first
    relation and its object, the better confidence, and counts as hop 2.
    """
    c = F.col
    src = sources.groupBy("rid").agg(F.min("source_url").alias("source_url"))
    edges = cut(relations.join(src, "rid", "left"))
    ends = edges.select(c("subject").alias("name")).union(edges.select("object")).distinct()
    hit = cut(named_entities(ends, asked))
    one = edges.join(hit.withColumnRenamed("name", "subject"), "subject").unionByName(edges.join(hit.withColumnRenamed("name", "object"), "object"))
    one = one.select("claim_id", "subject", "relation", "object", "confidence", "source_url", F.lit(1).alias("hop")).distinct()
    a = edges.select("subject", "relation", c("object").alias("middle"), c("confidence").alias("c1"), c("source_url").alias("u1"), c("rid").alias("r1"))
    b = edges.select(c("subject").alias("middle"), c("object").alias("end"), c("confidence").alias("c2"), c("source_url").alias("u2"), c("rid").alias("r2"))
    names = ["claim_id", *a.columns, "end", "c2", "u2", "r2"]
    # from each end inwards: only edges of asked entities meet their neighbours
    begun = hit.withColumnRenamed("name", "subject").join(a, "subject").join(b, "middle")
    ended = hit.withColumnRenamed("name", "end").join(b, "end").join(a, "middle")
    two = begun.select(*names).unionByName(ended.select(*names)).distinct()
    two = two.select("claim_id", "subject", "relation", c("middle").alias("object"), F.greatest("c1", "c2").alias("confidence"), F.coalesce("u1", "u2").alias("source_url"), F.lit(2).alias("hop"))
    return one.unionByName(two)


def graph_candidates(paths: DataFrame, claims: DataFrame, k: int = 10) -> DataFrame:
    """Paths as scored candidates, the k best per claim: one per subject, relation and object (the shorter, then surer path), without those far from the claim."""
    c = F.col
    order = F.struct("hop", -c("confidence"), F.coalesce("source_url", F.lit("")))
    first = paths.groupBy("claim_id", "subject", "relation", "object").agg(F.min_by(F.struct("confidence", "source_url", "hop"), order).alias("p")).select("claim_id", "subject", "relation", "object", "p.*")
    d = first.join(claim_context(claims), "claim_id")
    spoken = F.trim(F.replace(F.coalesce("relation", F.lit("")), F.lit("_"), F.lit(" ")))
    d = d.withColumns({"statement": F.trim(F.concat_ws(" ", "subject", spoken, "object")), "path": F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)) - F.when(c("hop") == 2, 0.15).otherwise(0.0))})
    d = d.withColumn("tokens", words.token_set(c("statement"), words.ALPHA, words.STOP))
    d = d.withColumns({
        "anchor_overlap": words.shared(c("tokens"), c("anchor_tokens")), "claim_overlap": words.shared(c("tokens"), c("claim_tokens")), "specific_overlap": words.shared(c("tokens"), c("specific")),
        "role": F.round(role_alignment(c("subject"), c("object"), c("usable")), 9), "label": relation_label(c("relation")),
    })
    anchored, plain = F.size("anchor_tokens") > 0, F.size("specific") == 0
    drift = anchored & ~strong_anchor(c("tokens"), c("usable")) & (c("anchor_overlap") == 0) & (c("specific_overlap") == 0) & plain & (c("claim_overlap") == 0) & ((c("hop") > 1) | (c("path") < 0.65))
    misfit = anchored & (c("role") < 0.34) & ((c("hop") > 1) | (c("path") < 0.75))
    score = F.least(F.lit(1.0), c("path") + F.least(F.lit(0.15), 0.03 * c("anchor_overlap")))
    by_words = F.when(c("specific_overlap") > 0, F.least(F.lit(0.08), 0.02 * c("specific_overlap"))).when(plain & (c("claim_overlap") > 0), F.least(F.lit(0.05), 0.01 * c("claim_overlap"))).otherwise(0.0)
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), score + by_words) + 0.05 * c("role"))
    d = d.filter(~drift & ~misfit).withColumns({"score": F.round(score, 9), "credibility": domains.credibility(c("source_url")), "kind": relation_type(c("label"))})
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(c("score").desc(), "statement", "subject", "object"))
    return d.withColumn("rank", rank).filter(c("rank") <= k)
